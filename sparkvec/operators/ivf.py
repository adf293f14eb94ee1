"""Inverted-file index: rows live in the bucket of their nearest centroid.

Assignment and probing are by squared L2 whatever the metric; the metric only
scores.  Training is explicit and over all rows given; k-means steps are per-task sums.
Rows whose embedding is null or of another length than the model's are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.functions.distance import paired, pairwise
from sparkvec.operators import flat


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centroid, the lowest of equals."""
    out = np.zeros(len(rows), np.int32)
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        d = pairwise("l2", part, centroids)
        least = d.min(axis=1)
        close = d <= (least + 1e-9 * (1 + least))[:, None]
        out[at : at + 4096] = close.argmax(axis=1)
        for i in np.flatnonzero(close.sum(axis=1) > 1):  # a near tie of the matrix product: compare exactly
            c = np.flatnonzero(close[i])
            out[at + i] = c[paired("l2", np.repeat(part[i : i + 1], len(c), axis=0), centroids[c]).argmin()]
    return out


def lloyd_step(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids moved to the mean of their rows (vec_id, embedding); an empty one stays."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = sent.value
        n, total = np.zeros(len(c)), np.zeros_like(c)
        for batch in batches:
            x = flat.matrix(batch.column("embedding"))
            if len(x):
                b = nearest(x, c)
                n += np.bincount(b, minlength=len(c))
                np.add.at(total, b, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["bucket", "n", "total"])

    sums = rows.select("embedding").where(F.size("embedding") == centroids.shape[1]).mapInArrow(run, "bucket long, n double, total array<double>")
    sums = sums.select("bucket", "n", F.posexplode("total").alias("pos", "x")).groupBy("bucket", "pos").agg((F.sum("x") / F.sum("n")).alias("mean"))
    out = centroids.copy()
    for r in sums.toLocalIterator():  # nlist x dim numbers, the size of the model
        out[r.bucket, r.pos] = r.mean
    return out


@dataclass
class IVFModel:
    centroids: np.ndarray
    nprobe: int

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with ``bucket_id``; write them partitioned by it and a search reads only its buckets."""
        sent = rows.sparkSession.sparkContext.broadcast(self.centroids)
        rows = rows.drop("bucket_id").where(F.size("embedding") == self.centroids.shape[1])
        names = rows.columns
        packed = rows.select(F.struct(*names).alias("__row"), F.col("embedding").alias("__v"))

        def run(batches):
            for batch in batches:
                b = nearest(flat.matrix(batch.column("__v")), sent.value) if batch.num_rows else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(b, pa.int32())], names=["__row", "bucket_id"])

        schema = T.StructType([packed.schema["__row"], T.StructField("bucket_id", T.IntegerType())])
        return packed.mapInArrow(run, schema).select("__row.*", "bucket_id")

    def write(self, rows: DataFrame, path: str) -> DataFrame:
        """rows with ``bucket_id``, written below ``path`` in a folder a bucket and read from there."""
        self.transform(rows).write.partitionBy("bucket_id").parquet(path)
        schema = T.StructType([*rows.drop("bucket_id").schema.fields, T.StructField("bucket_id", T.IntegerType())])
        return rows.sparkSession.read.schema(schema).parquet(path)

    def probes(self, query: Sequence[float], nprobe: int | None = None) -> list[int]:
        """Buckets of the nprobe centroids nearest to a query, in order."""
        d = paired("l2", np.asarray([np.float32(x) for x in query], float)[None, :], self.centroids)
        return np.lexsort((np.arange(len(d)), d))[: min(nprobe or self.nprobe, len(d))].tolist()

    def search(self, bucketed: DataFrame, query: Sequence[float], top_k: int = 10, metric: str = "l2", where: Column | None = None, nprobe: int | None = None) -> DataFrame:
        """Exact search of the probed buckets; the bucket filter prunes partitions."""
        probed = bucketed.where(F.col("bucket_id").isin(self.probes(query, nprobe)))
        return flat.search(probed, query, top_k, metric, where, dim=self.centroids.shape[1])

    def batch_search(self, bucketed: DataFrame, queries: DataFrame, top_k: int = 10, metric: str = "l2", nprobe: int | None = None) -> DataFrame:
        """(qid, vec_id, distance, rank): each bucket's rows meet the queries that probe it, in blocks of matrix products."""
        centroids, n = self.centroids, min(nprobe or self.nprobe, len(self.centroids))

        def probes(q: np.ndarray) -> np.ndarray:
            """The n nearest centroids of each query, the lowest of equals first."""
            if q.shape[1] != centroids.shape[1]:
                return np.zeros((len(q), 0), int)
            some = max(1, (1 << 22) // centroids.size)
            return np.concatenate([np.argsort(paired("l2", q[i : i + some, None, :], centroids[None]), axis=1, kind="stable")[:, :n] for i in range(0, len(q), some)])

        return flat.scan(bucketed.select("bucket_id", "vec_id", "embedding"), queries, top_k, metric, probes=probes)


@dataclass
class IVF:
    nlist: int = 100
    nprobe: int = 8
    seed: int = 42
    max_iter: int = 20

    def fit(self, rows: DataFrame, seeds: DataFrame | None = None) -> IVFModel:
        """Train on rows (vec_id, embedding); seeds: rows to start from, else the nlist of least hash of seed and id."""
        rows = rows.where("embedding is not null")
        if seeds is None:
            seeds = rows.orderBy(F.md5(F.concat(F.lit(f"{self.seed}:"), F.col("vec_id").cast("string"))), "vec_id").limit(self.nlist)
        first = [list(r.embedding) for r in seeds.orderBy("vec_id").select("embedding").collect()]  # nlist rows
        if not first:
            raise ValueError("an inverted file needs at least one row to train on")
        centroids = np.array(first, float)
        for _ in range(self.max_iter):
            moved = lloyd_step(rows, centroids)
            done = np.allclose(moved, centroids)
            centroids = moved
            if done:
                break
        return IVFModel(centroids, self.nprobe)
