"""One interface over the three indexes: rows in and out as DataFrames.

An index is a value: ``add`` and ``remove`` return another one.  Additions are
checked for dimension and for ids that exist or repeat.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions.distance import check_metric
from sparkvec.operators import flat, hnsw
from sparkvec.operators.ivf import IVF, IVFModel
from sparkvec.sources import files

_ROWS = "vec_id long, embedding array<float>"


class VectorIndex(Protocol):
    def add(self, rows: DataFrame) -> VectorIndex: ...

    def remove(self, ids: DataFrame) -> VectorIndex: ...

    def search(self, query: Sequence[float], top_k: int = 10, candidates: DataFrame | None = None) -> DataFrame: ...

    def batch_search(self, queries: DataFrame, top_k: int = 10) -> DataFrame: ...

    def get_vector(self, vec_id: int) -> list[float] | None: ...

    def export(self) -> DataFrame: ...

    def __len__(self) -> int: ...


def checked(rows: DataFrame, live: DataFrame, dim: int) -> DataFrame:
    """rows (vec_id, embedding) if all may be added; else a ValueError that says why."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    if not rows.where(F.col("embedding").isNull() | (F.size("embedding") != dim)).isEmpty():
        raise ValueError(f"vectors of this index have {dim} dimensions")
    again = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id").union(rows.select("vec_id").join(live.select("vec_id"), "vec_id", "left_semi"))
    if found := [r.vec_id for r in again.take(5)]:
        raise ValueError(f"ids exist already: {', '.join(map(str, found))}")
    return rows


@dataclass(frozen=True)
class FlatIndex:
    """Exact search; the rows are the index."""

    rows: DataFrame
    dim: int
    metric: str = "l2"

    def add(self, rows: DataFrame) -> VectorIndex:
        return replace(self, rows=self.rows.unionByName(checked(rows, self.rows, self.dim)))

    def remove(self, ids: DataFrame) -> VectorIndex:
        return replace(self, rows=self.rows.join(ids.select("vec_id"), "vec_id", "left_anti"))

    def search(self, query: Sequence[float], top_k: int = 10, candidates: DataFrame | None = None) -> DataFrame:
        return flat.search(self.rows, query, top_k, self.metric, candidates=candidates, dim=self.dim)

    def batch_search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return flat.batch_search(self.rows, queries, top_k, self.metric)

    def get_vector(self, vec_id: int) -> list[float] | None:
        found = self.rows.where(F.col("vec_id") == vec_id).select("embedding").first()
        return list(found[0]) if found else None

    def export(self) -> DataFrame:
        return self.rows.select("vec_id", "embedding")

    def __len__(self) -> int:
        return self.rows.count()


@dataclass(frozen=True)
class IVFIndex(FlatIndex):
    """Rows with their bucket, written by bucket as they are added; trained on the first rows that are added."""

    trainer: IVF = field(default_factory=IVF)
    model: IVFModel | None = None

    def add(self, rows: DataFrame) -> VectorIndex:
        rows = checked(rows, self.rows, self.dim)
        model = self.model or self.trainer.fit(rows)
        return replace(self, model=model, rows=self.rows.unionByName(model.write(rows, files.scratch(rows.sparkSession))))

    def search(self, query: Sequence[float], top_k: int = 10, candidates: DataFrame | None = None) -> DataFrame:
        if self.model is None:
            return FlatIndex.search(self, query, top_k)
        rows = self.rows if candidates is None else self.rows.join(candidates.select("vec_id"), "vec_id", "left_semi")
        return self.model.search(rows, query, top_k, self.metric)

    def batch_search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return self.model.batch_search(self.rows, queries, top_k, self.metric) if self.model else FlatIndex.batch_search(self, queries, top_k)


@dataclass(frozen=True)
class GraphIndex(FlatIndex):
    """Rows and the sharded graph over them, built and written on the first search after additions."""

    params: dict = field(default_factory=dict)
    _built: list = field(default_factory=list)

    def add(self, rows: DataFrame) -> VectorIndex:
        return replace(FlatIndex.add(self, rows), _built=[])

    def remove(self, ids: DataFrame) -> VectorIndex:
        """Tombstones over a graph that exists already; it is not built again."""
        return replace(FlatIndex.remove(self, ids), _built=[g.remove(ids) for g in self._built])

    def graph(self) -> hnsw.HNSWIndex:
        if not self._built:
            self._built.append(hnsw.build(self.rows, self.metric, **self.params).kept(files.scratch(self.rows.sparkSession)))
        return self._built[0]

    def search(self, query: Sequence[float], top_k: int = 10, candidates: DataFrame | None = None) -> DataFrame:
        if len(query) != self.dim:
            raise ValueError(f"query has {len(query)} dimensions; the index has {self.dim}")
        return self.graph().search(query, top_k, candidates)

    def batch_search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return self.graph().batch_search(queries, top_k)


def create_index(spark: SparkSession, index_type: str, dim: int, metric: str = "l2", **params) -> VectorIndex:
    """An empty index of a type; an unknown type or parameter is an error."""
    check_metric(metric)
    empty = spark.createDataFrame([], _ROWS)
    if index_type == "flat":
        return FlatIndex(empty, dim, metric, **params)
    if index_type == "ivf":
        return IVFIndex(empty.withColumn("bucket_id", F.lit(None).cast("int")), dim, metric, trainer=IVF(**params))
    if index_type == "hnsw":
        if params.get("M", 16) < 2:
            raise ValueError("M must be at least 2")
        return GraphIndex(empty, dim, metric, params=params)
    raise ValueError(f"unknown index_type {index_type!r}: expected flat, ivf or hnsw")


def benchmark(index: VectorIndex, rows: DataFrame, queries: DataFrame, top_k: int = 10) -> dict:
    """Seconds to build and to search, queries a second, and recall against exact search."""
    began = time.perf_counter()
    index = index.add(rows)
    if isinstance(index, GraphIndex):
        index.graph()
    build = time.perf_counter() - began
    began = time.perf_counter()
    found = index.batch_search(queries, top_k).persist()
    n = queries.count()
    found.count()
    search = time.perf_counter() - began
    truth = flat.batch_search(rows, queries, top_k, index.metric)
    recall = flat.recall_at_k(truth, found, top_k).first().recall
    found.unpersist()
    return {"build_s": build, "search_s": search, "qps": n / search, "recall": recall}
