"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; one longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Temporary folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a local session gets a temporary folder; any other
    session must name a folder, because local disks are not shared.
    """
    return f"{_top(spark)}/{uuid.uuid4().hex}"


def _top(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sparkvec-")
    return _own[app]


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the folder of a table made by :func:`written`, once nothing reads it any more."""
    spark = df.sparkSession
    top = _top(spark)
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if top.split(":", 1)[-1].strip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def training_labels(labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows (doc_id, y) that may be learnt from.

    Rows whose ``crc32(doc_id as text) mod 3`` is 1 are held out.  Rows without id
    or label are left out; contradicting repeated labels resolve to the larger one.
    The sample is the rows of the smallest id hashes, the same on every run.
    """
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )


def sampled(docs: DataFrame, labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(doc_id, y, text) of the chosen labelled documents: at most ``max_rows`` rows, one an id.

    Of several rows of an id the one whose text has the least hash counts, however many there are.
    """
    chosen = training_labels(labels, column, max_rows)  # max_rows pairs of numbers
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = own.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return one.select("doc_id", "y", "least.text")


def held_out(doc_id):
    """True for ids that no label may be learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases.

    It does so when the driver's JVM finds their plans unreachable, which on a
    driver with little garbage may be long after the phase.  A plan goes in two
    collections: the first lets go of what the plan's last job still refers to.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
