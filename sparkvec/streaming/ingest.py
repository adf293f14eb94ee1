"""Structured Streaming from a folder of log segments into a snapshot.

Each micro-batch merges the last operation of each id into a new snapshot version.
The pointer records the batch, so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkvec.sources import files, oplog

_STATE = "seq long, op string, vec_id long, embedding array<float>, metadata string"


def state(spark: SparkSession, path: str) -> DataFrame:
    """Live rows of the current version."""
    return oplog.latest(_read(spark, path)[0])


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    try:
        at = json.loads(files.read_text(spark, f"{path}/current.json"))
    except FileNotFoundError:
        return spark.createDataFrame([], _STATE), {"batch": -1}
    return spark.read.schema(_STATE).parquet(f"{path}/batch-{at['batch']}"), at


def merge(batch: DataFrame, batch_id: int, path: str) -> None:
    """Fold one micro-batch into the state: for each id its operation of the highest seq, deletes included."""
    spark = batch.sparkSession
    now, at = _read(spark, path)
    if batch_id <= at["batch"]:
        return
    both = now.unionByName(batch.select("seq", "op", "vec_id", "embedding", "metadata"))
    last = both.groupBy("vec_id").agg(F.max_by(F.struct("op", "embedding", "metadata"), "seq").alias("last"), F.max("seq").alias("seq"))
    last.select("seq", "last.op", "vec_id", "last.embedding", "last.metadata").write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
    files.write_text(spark, f"{path}/current.json", json.dumps({"batch": batch_id}))
    if at["batch"] >= 0:
        files.delete(spark, f"{path}/batch-{at['batch']}")


def ingest(spark: SparkSession, log: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start reading new segments below ``log`` (see OpLog) into the state at ``path``; all that is there, then stop."""
    ops = spark.readStream.schema(oplog.SCHEMA).parquet(f"{log}/seg-*")
    return ops.writeStream.foreachBatch(lambda df, i: merge(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
