"""Exact nearest neighbours over a table (vec_id, embedding, ...).

One query is a projection and an ordered limit: every task keeps its k best and
the driver merges k rows a task.  Many queries are scored in blocks by matrix
products; a task keeps k rows a query, and a window merges them.
Ties are broken by vec_id.  Rows whose embedding is null or of another length than the
query are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.functions.distance import check_metric, distance_to, paired

#: Query vectors that one matrix product scores, and that one pass over the rows scores.
QUERY_BLOCK = 1024
QUERY_PASS = 32_768


def search(rows: DataFrame, query: Sequence[float], top_k: int = 10, metric: str = "l2", where: Column | None = None, candidates: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """(vec_id, distance) of the top_k nearest rows, in order.

    candidates: a table of vec_id to which the search is restricted.
    """
    check_metric(metric)
    if dim is not None and len(query) != dim:
        raise ValueError(f"query has {len(query)} dimensions; the collection has {dim}")
    if where is not None:
        rows = rows.where(where)
    if candidates is not None:
        rows = rows.join(candidates.select("vec_id"), "vec_id", "left_semi")
    rows = rows.where(F.size("embedding") == len(query))
    scored = rows.select("vec_id", distance_to(metric, F.col("embedding"), query).alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(max(top_k, 0))


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return vectors / np.where(length > 0, length, 1)


def sides(metric: str, vectors: np.ndarray):
    """Left and right sides, whose products are distances less what is the same for all rows of a query; and that."""
    if metric == "l2":
        size = (vectors * vectors).sum(axis=1)
        return np.hstack([-2 * vectors, np.ones((len(vectors), 1))]), np.hstack([vectors, size[:, None]]), size
    unit = _unit(vectors) if metric == "cosine" else vectors
    return -unit, unit, 1.0 if metric == "cosine" else 0.0


class TopK:
    """The k least (distance, id) of each of some queries, fed block by block.

    One product of single precision screens a block; what its rounding leaves open is scored again exactly.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = queries, k, metric
        self.best = [np.zeros(0, t) for t in (np.int64, float, np.int64)]  # query, distance, id
        self.kth = np.full(len(queries), np.inf)
        self.left, _, self.same = sides(metric, queries)
        self.long = np.sqrt((self.left * self.left).sum(axis=1))

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(ids) or not self.k:
            return
        right = sides(self.metric, rows)[1]
        most = self.long * np.sqrt((right * right).sum(axis=1).max())
        kind = np.float32 if most.max() < 1e30 and np.abs(right).max() < 1e30 else np.float64
        d = self.left.astype(kind) @ right.astype(kind).T
        limit = self.kth - self.same
        fresh = np.flatnonzero(np.isinf(limit))
        if len(fresh) and len(ids) > self.k:
            limit[fresh] = np.partition(d[fresh], self.k - 1, axis=1)[:, self.k - 1]
        # With ties of the last one, and twice what rounding can be.
        limit += 1e-9 + 2e-7 * np.abs(limit) + 2.4e-7 * (right.shape[1] + 4) * most
        at, row = np.nonzero(d <= limit.astype(kind)[:, None])
        if not len(at):
            return
        found = at, paired(self.metric, self.q[at], rows[row]), ids[row]
        query, dist, vec = (np.concatenate(x) for x in zip(self.best, found, strict=True))
        order = np.lexsort((vec, dist, query))
        query, dist, vec = query[order], dist[order], vec[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.best = [x[rank < self.k] for x in (query, dist, vec)]
        last = rank == self.k - 1
        self.kth[query[last]] = dist[last]


HITS = "qid long, vec_id long, distance double"


def batch_search(rows: DataFrame, queries: DataFrame, top_k: int = 10, metric: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, vec_id, distance, rank) of the top_k nearest rows of each query (qid, embedding)."""
    return scan(rows.select("vec_id", "embedding"), queries, top_k, metric, block)


def scan(rows: DataFrame, queries: DataFrame, top_k: int, metric: str, block: int = QUERY_BLOCK, probes=None) -> DataFrame:
    """Exact search of rows (vec_id, embedding) for many queries, which a pass over the rows scores block by block.

    probes: a function of query vectors to the buckets of each; a query then meets only the rows (bucket_id, ...) of those.
    """
    check_metric(metric)
    spark, k, parted, out = rows.sparkSession, max(top_k, 0), probes is not None, None
    slim = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    for names, vectors in passes(queries):
        # By bucket, if there are any: the queries to score in it, block by block.
        buckets = {None: np.arange(len(names))}
        if parted:
            probed = probes(vectors)
            buckets = {int(b): np.flatnonzero((probed == b).any(axis=1)) for b in np.unique(probed)}
        sent = spark.sparkContext.broadcast((names, vectors, buckets))

        def run(batches, sent=sent):
            names, q, buckets = sent.value
            held: dict = {}  # bucket: (positions of queries, TopK) of each block
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    ids, x = part.column("vec_id").to_numpy(), matrix(part.column("embedding"))
                    lots = [(None, slice(None))]
                    if parted:
                        b = part.column("bucket_id").to_numpy(zero_copy_only=False)
                        lots = [(int(n), b == n) for n in np.unique(b) if n in buckets]
                    for bucket, lot in lots:
                        if bucket not in held:
                            wanted = buckets[bucket]
                            held[bucket] = [(w, TopK(q[w], k, metric)) for w in (wanted[i : i + block] for i in range(0, len(wanted), block))]
                        for _, top in held[bucket]:
                            top.add(ids[lot], x[lot])
            for blocks in held.values():
                for wanted, top in blocks:
                    query, dist, vec = top.best
                    yield pa.RecordBatch.from_arrays([pa.array(names[wanted[query]]), pa.array(vec), pa.array(dist)], names=["qid", "vec_id", "distance"])

        found = slim.where(F.size("embedding") == vectors.shape[1]).mapInArrow(run, HITS)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], HITS)
    return ranked(out, k)


def ranked(hits: DataFrame, top_k: int) -> DataFrame:
    """hits (qid, vec_id, distance) with their rank, those of rank top_k at most."""
    by = W.partitionBy("qid").orderBy("distance", "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)


def passes(queries: DataFrame):
    """Queries (qid, embedding) as (names, vectors) of one length, for as many passes as the driver's memory asks for."""
    # Dealt anew: they are worked out by all tasks at once and then fetched part by part.
    dealt = queries.select(F.col("qid").cast("long").alias("qid"), "embedding").where("embedding is not null").repartition(8)
    for more in _blocks(((r.qid, np.array(r.embedding, float)) for r in dealt.toLocalIterator()), QUERY_PASS):
        for dim in sorted({len(v) for _, v in more}):
            some = [(name, v) for name, v in more if len(v) == dim]
            yield np.array([name for name, _ in some], np.int64), np.array([v for _, v in some], float)


def _blocks(rows, size: int):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def recall_at_k(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row, ``recall``: the share of the true neighbours (qid, vec_id) that were found."""
    hit = found.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1))
    joined = truth.select("qid", "vec_id").join(hit, ["qid", "vec_id"], "left")
    return joined.agg((F.sum(F.coalesce("hit", F.lit(0))) / (F.count_distinct("qid") * k)).alias("recall"))
