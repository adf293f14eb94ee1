"""Small files beside tables, on whatever file system the path names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, top: str | None = None) -> str:
    """A new folder below ``top`` or ``spark.checkpoint.dir``; a local session that names none gets a temporary one."""
    top = top or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir or give a folder")
        top = tempfile.mkdtemp(prefix="sparkvec-")
    return f"{top.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _open(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write aside, then rename: a reader sees the old file or the new one."""
    aside, fs = _open(spark, f"{path}.new")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    final, _ = _open(spark, path)
    if fs.exists(final):
        fs.delete(final, False)
    fs.rename(aside, final)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _open(spark, path)
    if not fs.exists(p):
        p, _ = _open(spark, f"{path}.new")  # a writer stopped between delete and rename
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def listing(spark: SparkSession, path: str) -> list[str]:
    p, fs = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _open(spark, path)
    fs.delete(p, True)
