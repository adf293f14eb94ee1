"""The operation log: rows (seq, op, vec_id, embedding, metadata as JSON text).

A log is a folder of immutable segments, one a commit, so a commit is whole or
absent and a stream reader sees each once.  State is the last operation per id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.sources import files

#: Operations of a commit that one task numbers.
ONE_TASK = 10_000
SCHEMA = "seq long, op string, vec_id long, embedding array<float>, metadata string"


class OpLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _segments(self) -> list[str]:
        return [s for s in files.listing(self.spark, self.path) if s.startswith("seg-") and files.exists(self.spark, f"{self.path}/{s}/_SUCCESS")]

    def next_seq(self) -> int:
        """One past the last number; a segment's name tells its end, the mark of a truncation the least."""
        return max([*(int(s.split("-")[2]) for s in self._segments()), self._mark()])

    def append(self, ops: DataFrame, rows: int) -> None:
        """Commit ops (op, vec_id, embedding, metadata): ``rows`` of them, numbered without gaps in order of vec_id."""
        first = self.next_seq()
        path = f"{self.path}/seg-{first:020d}-{first + rows:020d}"
        if rows <= ONE_TASK:
            numbered = ops.withColumn("n", F.row_number().over(W.orderBy("vec_id")) - 1)
        else:  # the same numbers, counted a range at a time
            staged = f"{self.path}/staged-{uuid.uuid4().hex}"
            ranges = ops.select("op", "vec_id", "embedding", "metadata").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
            numbered = numbered_lines(ranges, staged)
        numbered.withColumn("seq", (F.col("n") + first).cast("long")).select("seq", "op", "vec_id", "embedding", "metadata").write.parquet(path)
        if rows > ONE_TASK:
            files.delete(self.spark, staged)

    def _mark(self) -> int:
        mark = f"{self.path}/offset"
        return int(files.read_text(self.spark, mark)) if files.exists(self.spark, mark) else 0

    def read(self, offset: int = 0) -> DataFrame:
        """Operations with seq >= offset that no truncation has dropped."""
        offset = max(offset, self._mark())
        names = [s for s in self._segments() if int(s.split("-")[2]) > offset]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{s}" for s in names]).where(F.col("seq") >= offset)

    def count(self, offset: int = 0) -> int:
        """How many operations :meth:`read` gives; numbers have no gaps, so names of segments tell."""
        offset = max(offset, self._mark())
        return sum(max(0, int(s.split("-")[2]) - max(offset, int(s.split("-")[1]))) for s in self._segments())

    def truncate(self, keep_offset: int) -> None:
        """Drop operations below an offset: whole segments; one that straddles it stays and is read from there."""
        if keep_offset <= 0:
            return
        files.write_text(self.spark, f"{self.path}/offset", str(keep_offset))
        for s in self._segments():
            if int(s.split("-")[2]) <= keep_offset:
                files.delete(self.spark, f"{self.path}/{s}")


def numbered_lines(rows: DataFrame, staged: str) -> DataFrame:
    """rows with ``n``, their number in the order in which partitions and rows stand; written to ``staged`` on the way.

    Each row gets its place within its partition; partitions are shifted by the sizes of those before.
    """
    part = F.spark_partition_id()
    placed = rows.select(part.alias("__part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("__place"), "*")
    placed.write.parquet(staged)
    kept = rows.sparkSession.read.schema(placed.schema).parquet(staged)
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(W.orderBy("__part")) - F.col("size"))  # one row a partition
    return kept.join(F.broadcast(before.select("__part", "before")), "__part").withColumn("n", F.col("before") + F.col("__place")).drop("__part", "__place", "before")


def log_ends(ops: DataFrame) -> DataFrame:
    """The last operation (vec_id, op, embedding, metadata) of each id."""
    last = ops.where(F.col("op").isin("insert", "delete")).groupBy("vec_id").agg(F.max_by(F.struct("op", "embedding", "metadata"), "seq").alias("last"))
    return last.select("vec_id", "last.*")


def latest(ops: DataFrame) -> DataFrame:
    """Live rows (vec_id, embedding, metadata): the last operation of each id, where it is an insert."""
    return log_ends(ops).where("op = 'insert'").drop("op")


def conflicts(ops: DataFrame) -> DataFrame:
    """Inserts (seq, vec_id) of an id that is live already."""
    before = F.lag("op").over(W.partitionBy("vec_id").orderBy("seq"))
    return ops.withColumn("before", before).where("op = 'insert' and before = 'insert'").select("seq", "vec_id")


def valid_prefix(lines: DataFrame) -> DataFrame:
    """Lines (seq, value) before the first that is not JSON; blank lines are left out."""
    lines = lines.where(F.trim("value") != "").withColumn("parsed", F.try_parse_json("value"))
    bad = lines.where("parsed is null").agg(F.min("seq").alias("bad"))
    return lines.join(bad, F.col("bad").isNull() | (F.col("seq") < F.col("bad"))).drop("bad")


def read_jsonl(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """A line log, in order, up to the first line that does not parse.  Lines are numbered from 0, blank ones too."""
    lines = numbered_lines(spark.read.text(path), files.scratch(spark)).select(F.col("n").alias("seq"), "value").where(F.col("seq") >= offset)
    get = lambda name, kind: F.try_variant_get("parsed", f"$.{name}", kind)
    return valid_prefix(lines).select(
        "seq", get("op", "string").alias("op"), get("id", "long").alias("vec_id"),
        get("vector", "array<float>").alias("embedding"), F.to_json(get("metadata", "variant")).alias("metadata"),
    )
