"""Consistent hashing: virtual nodes on a ring of MD5 hashes, as DataFrames.

A key belongs to the first virtual node after its hash, round the ring.  Hashes are
32 lower-case hex digits, which compare like the numbers they spell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VIRTUAL_NODES = 160


def build(spark: SparkSession, nodes: Sequence[str], virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(h, node) of every virtual node; a node named twice counts once."""
    names = spark.createDataFrame([(n,) for n in sorted(set(nodes))], "node string")
    each = names.select("node", F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("i"))
    return each.select(F.md5(F.concat("node", F.lit(":"), F.col("i").cast("string"))).alias("h"), "node")


def remove(ring: DataFrame, node: str) -> DataFrame:
    return ring.where(F.col("node") != node)


def _sorted(ring: DataFrame) -> tuple[list[str], list[str]]:
    """Hashes and nodes in ring order; a ring has nodes x virtual nodes entries, a few thousand."""
    rows = ring.orderBy("h", "node").collect()
    return [r.h for r in rows], [r.node for r in rows]


def owner(ring: DataFrame, key: Column) -> Column:
    """The owner of a key column, null for an empty ring.

    The ring is a literal of its sorted hashes, sought by halving: about twelve
    comparisons a row instead of a join.
    """
    hashes, nodes = _sorted(ring)
    if not hashes:
        return F.lit(None).cast("string")
    where = F.array(*[F.lit(h) for h in hashes])
    at = F.array(*[F.lit(n) for n in [*nodes, nodes[0]]])
    kh = F.md5(key.cast("string"))
    # Count of hashes <= the key's, by the binary digits of the count from the top.
    low, bit = F.lit(0), 1 << (len(hashes).bit_length() - 1)
    digits = []
    while bit:
        digits.append(bit)
        bit >>= 1
    low = F.aggregate(
        F.array(*[F.lit(d) for d in digits]),
        F.lit(0),
        lambda acc, d: F.when((acc + d <= len(hashes)) & (F.get(where, acc + d - 1) <= kh), acc + d).otherwise(acc),
    )
    return F.get(at, low)


def replicas(ring: DataFrame, keys: DataFrame, count: int = 1) -> DataFrame:
    """(key, rank, node): the first ``count`` distinct nodes clockwise of each key (distinct keys).

    Grouping is by the ring's arcs, so each arc's replica list is found once and keys only look it up.
    """
    hashes, nodes = _sorted(ring)
    spark = keys.sparkSession
    if not hashes:
        return spark.createDataFrame([], "key string, rank int, node string")
    walks = []
    for i in range(len(hashes)):
        found: list[str] = []
        for j in range(len(hashes)):
            node = nodes[(i + j) % len(nodes)]
            if node not in found:
                found.append(node)
            if len(found) == min(count, len(set(nodes))):
                break
        walks.append(found)
    arcs = spark.createDataFrame([(i, w) for i, w in enumerate(walks)], "arc int, nodes array<string>")
    numbers = spark.createDataFrame([(h, str(i)) for i, h in enumerate(hashes)], "h string, node string")
    placed = keys.select(F.col("key").cast("string").alias("key")).withColumn("arc", owner(numbers, F.col("key")).cast("int"))
    out = placed.join(arcs, "arc").select("key", F.posexplode("nodes").alias("rank", "node"))
    return out.select("key", (F.col("rank") + 1).alias("rank"), "node")


def range_nodes(ring: DataFrame, start: str, end: str, successor: bool = False) -> DataFrame:
    """Nodes with a virtual node in [hash(start), hash(end)), all nodes if there is none.

    successor: also the node that owns the tail of the range.
    """
    a, b = F.md5(F.lit(start)), F.md5(F.lit(end))
    inside = F.when(a <= b, (F.col("h") >= a) & (F.col("h") < b)).otherwise((F.col("h") >= a) | (F.col("h") < b))
    found = ring.where(inside).select("node").distinct()
    if successor:
        tail = ring.sparkSession.range(1).select(owner(ring, F.lit(end)).alias("node"))
        found = found.union(tail).distinct()
    return ring.select("node").distinct() if found.isEmpty() else found


def moved(old: DataFrame, new: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, old_node, new_node) of the keys whose owner differs."""
    placed = keys.select(F.col("key").cast("string").alias("key"))
    placed = placed.select("key", owner(old, F.col("key")).alias("old_node"), owner(new, F.col("key")).alias("new_node"))
    return placed.where(~F.col("old_node").eqNullSafe(F.col("new_node")))


def shard_search(sharded: DataFrame, scored: Column, top_k: int) -> DataFrame:
    """Scatter-gather: each shard's top_k of rows (shard, vec_id, ...), then the best of them."""
    by = W.partitionBy("shard").orderBy("distance", "vec_id")
    local = sharded.select("shard", "vec_id", scored.alias("distance")).withColumn("n", F.row_number().over(by)).where(F.col("n") <= top_k)
    return local.orderBy("distance", "vec_id").limit(top_k).select("vec_id", "distance", "shard")


def shard_stats(sharded: DataFrame) -> DataFrame:
    """(shard, num_items) of each shard and, with a null shard, of all."""
    return sharded.rollup("shard").agg(F.count(F.lit(1)).alias("num_items"))
