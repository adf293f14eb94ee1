"""Connected components of an edge table, by alternating star contraction.

Large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond") are joins and minimum aggregates; every round is written
to the shared folder, and no edge ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm._util import drop_table, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u > v): neighbours are linked to the least neighbour."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    out = joined.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (u, v): root is the least node that it reaches.

    Loops, repeated edges and either direction are allowed; rows with a null end
    are left out; an empty table gives an empty table.
    """
    now = written(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        then, before = now, mark
        now = written(_star(_star(then, True), False))
        drop_table(then)
        mark = _mark(now)
        if mark == before:
            break
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
