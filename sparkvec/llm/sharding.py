"""Operator 1: two-pass external shuffle into shards; DataFrame functions only.

Pass one scatters the records uniformly over buckets that fit in memory, by a
seeded hash of the whole record.  Pass two brings each bucket to one task, permutes
it by a seeded Fisher-Yates shuffle (Spark's ``shuffle``) and writes it.  The buckets
in a row are one random order of all records; shards are equal ranges of it, so
their counts are at most one apart, and a bucket's task writes to few shards.

A bucket's place in the order is the sum of the counts before it.  It travels to
the bucket's task as one more row of the scatter, so nothing is broadcast.  Beyond
``TASKS`` buckets a task takes several neighbouring ones, one after the other.

Records that are equal in all columns have one hash.  Where they alone would fill half
a bucket, they are counted, and their copies are dealt over all buckets by number.

Nulls: a null text has no bytes; records with a null id are scattered by their other
columns.  Repeated rows are separate records, however many.  Texts may be of any
length that a row may have.  All columns are written, under any names, inside ``row``;
they must be of types that can be compared (no maps, no variants).  An empty table
gives empty shards.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.llm._util import shared_dir, written

SHARDS = 16
SEED = 1
#: Bytes that a bucket holds about; one task sorts and permutes it in memory.
BUCKET_BYTES = 16 << 20
#: Tasks of pass two at most, and copies of one record that one row stands for while they are dealt.
TASKS, DEAL = 1 << 15, 4096


def _size(text):
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


def _held(text):
    """Bytes that a record takes in memory, about: its text and what any row has besides."""
    return _size(text) + 64


def _offsets(buckets: DataFrame) -> DataFrame:
    """(bucket, offset): the rows in all buckets before it.  Sums go over groups of buckets first."""
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.expr("bucket div 1024"))
    groups = counts.groupBy("g").agg(F.sum("n").alias("n"))
    groups = groups.select("g", (F.sum("n").over(W.orderBy("g")) - F.col("n")).alias("base"))
    inner = F.sum("n").over(W.partitionBy("g").orderBy("bucket")) - F.col("n")
    return counts.withColumn("inner", inner).join(groups, "g").select("bucket", (F.col("base") + F.col("inner")).alias("offset"))


def _scattered(df: DataFrame, buckets: int, seed: int, bucket_bytes: int) -> DataFrame:
    """(bucket, place, row) of every record."""
    place = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    bucket = F.pmod("place", F.lit(buckets)).cast("int").alias("bucket")
    records = df.select(place.alias("place"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    if buckets == 1:
        return records.select(bucket, "place", "row")
    full = records.groupBy("place").agg(F.sum(_held(F.col("row.text"))).alias("size"), F.count(F.lit(1)).alias("n"))
    full = full.where((F.col("n") > 1) & (F.col("size") > bucket_bytes // 2)).select("place")  # fewer than two a bucket
    if full.isEmpty():
        return records.select(bucket, "place", "row")
    full = written(full)
    counted = records.join(full, "place", "left_semi").groupBy("place", "row").agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {DEAL}"))))
    dealt = dealt.repartition("place", "deal").withColumn("i", F.explode(F.sequence(F.lit(0), F.expr(f"cast(least({DEAL}, n - deal * {DEAL}) - 1 as int)"))))
    copies = dealt.select(F.xxhash64("place", "deal", "i").alias("place"), "row")
    return records.join(full, "place", "left_anti").select("place", "row").union(copies).select(bucket, "place", "row")


@contextmanager
def _one_group_at_a_time(spark):
    """Lists are collected group by group from sorted rows, not for all groups of a task at once."""
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, tasks: int = TASKS) -> DataFrame:
    """Write df (doc_id, text, ...) below ``path`` in folders by shard; return (shard, slot, row) as written.

    The same rows, seed and bucket size give the same shards on every run.
    """
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_held(F.col("text"))), F.lit(0))).first()
    buckets = max(1, math.ceil(size / bucket_bytes))
    each = math.ceil(buckets / tasks)
    records = _scattered(df, buckets, seed, bucket_bytes)
    offsets = _offsets(records.select("bucket"))
    item = records.schema["row"].dataType.simpleString()
    rows = records.select("bucket", F.struct("place", "row").alias("record"), F.lit(None).cast("long").alias("offset")).union(
        offsets.select("bucket", F.lit(None).cast(f"struct<place:bigint,row:{item}>"), "offset")
    )
    gathered = (
        rows.withColumn("task", F.expr(f"bucket div {each}").cast("int"))
        .repartitionById(math.ceil(buckets / each), F.col("task"))
        .groupBy("task", "bucket")
        .agg(F.collect_list("record").alias("records"), F.max("offset").alias("offset"))
    )
    # Sorted first, so that the permutation depends on the rows and not on the order of their arrival.
    shuffled = F.shuffle(F.array_sort("records"), F.lit(seed))
    placed = gathered.select("offset", F.posexplode(shuffled).alias("pos", "record")).select(
        (F.col("offset") + F.col("pos")).alias("p"), "record.row"
    )
    placed = placed.withColumn("shard", F.expr(f"cast(p * {shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    out = placed.select("shard", (F.col("p") - first).alias("slot"), "row")
    with _one_group_at_a_time(df.sparkSession):
        out.write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def shards(docs: DataFrame, count: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The digest columns of op1, from the shards as written to the shared folder."""
    made = write_shards(docs.select("doc_id", "text"), shared_dir(docs.sparkSession), count, seed)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return made.select(
        F.col("row.doc_id").alias("doc_id"),
        _size(F.col("row.text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
