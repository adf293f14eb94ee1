"""A collection: rows with metadata, their index, and their durability.

Mutations are validated, then committed as a segment of the operation log.  Reads see
the snapshot less the ids that the log names, and what the log says of those, so
only the log is grouped; after a checkpoint the snapshot is read as it is.  An index is
searched together with an exact scan of what was written since it was built, and built
anew when that is much.  Without a write-ahead log, segments go to a scratch folder that
does not outlive the collection.

Point writes cost a Spark job each: batch them with ``insert_many``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.operators import flat, hnsw
from sparkvec.operators.ivf import IVF
from sparkvec.plans.config import CollectionConfig
from sparkvec.plans.filters import compile_filter
from sparkvec.sources import files, oplog, snapshot

#: Operations since an index was built that are scanned beside it, if they are not a fifth of its rows.
STALE_ROWS = 1_000
_ROWS = "vec_id long, embedding array<float>, metadata string"


def invalid_dims(rows: DataFrame, dim: int) -> DataFrame:
    """Rows whose embedding is null or of another length."""
    return rows.where(F.col("embedding").isNull() | (F.size("embedding") != dim))


def duplicate_ids(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Ids of rows that repeat among themselves or are live already."""
    inside = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    return inside.union(rows.select("vec_id").join(live.select("vec_id"), "vec_id", "left_semi")).distinct()


@dataclass
class _Index:
    """A built index, the number of the first operation that it lacks, its folder and its rows."""

    held: object
    seq: int
    path: str
    rows: int


class Collection:
    def __init__(self, spark: SparkSession, config: CollectionConfig, data_dir: str | None = None):
        if config.enable_wal and not data_dir:
            raise ValueError("a write-ahead log needs data_dir")
        self.spark, self.config, self.data_dir = spark, config, data_dir
        self._rows, self._offset = None, 0
        self._index: _Index | None = None
        if data_dir and snapshot.current(spark, f"{data_dir}/snapshot"):
            stored, self._rows, self._offset = snapshot.load(spark, f"{data_dir}/snapshot")
            if (stored.dim, stored.metric) != (config.dim, config.metric):
                raise ValueError(f"{data_dir} holds dimension {stored.dim} and metric {stored.metric}")
        self._log = oplog.OpLog(spark, f"{data_dir}/oplog" if config.enable_wal else f"{self._scratch()}/oplog")
        if not config.enable_wal:
            self._offset = 0

    def _scratch(self) -> str:
        self._own = files.scratch(self.spark, self.data_dir)
        return self._own

    # Reads

    def rows(self) -> DataFrame:
        """Live rows (vec_id, embedding, metadata as JSON text)."""
        base = self._rows if self._rows is not None else self.spark.createDataFrame([], _ROWS)
        base = base.select("vec_id", "embedding", "metadata")
        return self._since(self._offset, base) if self._log.count(self._offset) else base

    def _since(self, offset: int, base: DataFrame) -> DataFrame:
        """base as the operations from an offset on leave it."""
        last = oplog.log_ends(self._log.read(offset))
        kept = base.join(last.select("vec_id"), "vec_id", "left_anti")
        return kept.unionByName(last.where("op = 'insert'").select("vec_id", "embedding", "metadata"))

    def table(self) -> DataFrame:
        """Live rows with ``metadata`` as VARIANT."""
        return self.rows().withColumn("metadata", F.parse_json(F.coalesce("metadata", F.lit("{}"))))

    def get(self, vec_id: int) -> tuple[list[float], dict] | None:
        found = self.rows().where(F.col("vec_id") == vec_id).first()
        return (list(found.embedding), json.loads(found.metadata or "{}")) if found else None

    def __len__(self) -> int:
        return self.rows().count()

    def stats(self) -> dict:
        c = self.config
        return {"dim": c.dim, "metric": c.metric, "index_type": c.index_type, "num_items": len(self), "wal_enabled": c.enable_wal, "created_at": c.created_at}

    # Writes

    def insert(self, vec_id: int, vector: Sequence[float], metadata: dict | None = None) -> None:
        self.insert_many([vec_id], [vector], [metadata])

    def insert_many(self, ids: Sequence[int], vectors: Sequence[Sequence[float]], metadatas: Sequence[dict | None] | None = None) -> None:
        metadatas = metadatas if metadatas is not None else [None] * len(ids)
        if not len(ids) == len(vectors) == len(metadatas):
            raise ValueError("ids, vectors and metadatas differ in length")
        rows = [(int(i), [float(x) for x in v], json.dumps(m or {})) for i, v, m in zip(ids, vectors, metadatas, strict=True)]
        if rows:
            self.insert_rows(self.spark.createDataFrame(rows, _ROWS))

    def insert_rows(self, rows: DataFrame) -> None:
        """Insert a table (vec_id, embedding[, metadata as JSON text]); all of it or, if a row is invalid, nothing."""
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit("{}"))
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("metadata").cast("string").alias("metadata"))
        if not invalid_dims(rows, self.config.dim).isEmpty():
            raise ValueError(f"vectors of this collection have {self.config.dim} dimensions")
        if again := [r.vec_id for r in duplicate_ids(rows, self.rows()).take(5)]:
            raise ValueError(f"ids exist already: {', '.join(map(str, again))}")
        self._commit(rows.select(F.lit("insert").alias("op"), "vec_id", "embedding", "metadata"))

    def delete(self, ids: Sequence[int] | int) -> None:
        """Delete ids; unknown ones do nothing."""
        ids = [ids] if isinstance(ids, int) else list(ids)
        if ids:
            self.delete_rows(self.spark.createDataFrame([(int(i),) for i in ids], "vec_id long"))

    def delete_rows(self, ids: DataFrame) -> None:
        """Delete the ids of a table (vec_id)."""
        gone = ids.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
        self._commit(gone.select(F.lit("delete").alias("op"), "vec_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("metadata")))

    def _commit(self, ops: DataFrame) -> None:
        if not (rows := ops.count()):
            return
        self._log.append(ops, rows)
        if self.config.enable_wal and self._log.count() >= self.config.auto_checkpoint_threshold:
            self.checkpoint()

    # Search

    def search(self, query: Sequence[float], top_k: int = 10, filter: dict | None = None) -> list[tuple[int, float]]:
        return [(r.vec_id, r.distance) for r in self.find(query, top_k, filter).collect()]

    def find(self, query: Sequence[float], top_k: int = 10, filter: dict | None = None) -> DataFrame:
        """(vec_id, distance), nearest first, by the collection's index."""
        if len(query) != self.config.dim:
            raise ValueError(f"query has {len(query)} dimensions; the collection has {self.config.dim}")
        where, c = compile_filter(filter), self.config
        if c.index_type == "flat":
            return flat.search(self.table(), query, top_k, c.metric, where)
        if self._index is None or self._log.count(self._index.seq) > max(STALE_ROWS, self._index.rows // 5):
            self._drop_index()
            if self.rows().isEmpty():
                return flat.search(self.table(), query, top_k, c.metric)
            self._index = self._built()
        index, fresh = self._index, None
        touched = oplog.log_ends(self._log.read(index.seq)) if self._log.count(index.seq) else None
        variant = lambda rows: rows.withColumn("metadata", F.parse_json(F.coalesce("metadata", F.lit("{}"))))
        if c.index_type == "ivf":
            model, bucketed = index.held
            bucketed = bucketed if touched is None else bucketed.join(touched.select("vec_id"), "vec_id", "left_anti")
            found = model.search(variant(bucketed), query, top_k, c.metric, where)
        else:
            graph = index.held if touched is None else index.held.remove(touched)
            found = graph.search(query, top_k, self.table().where(where).select("vec_id") if where is not None else None)
        if touched is not None:
            fresh = flat.search(variant(touched.where("op = 'insert'")), query, top_k, c.metric, where)
            found = found.unionByName(fresh).orderBy("distance", "vec_id").limit(max(top_k, 0))
        return found

    def _drop_index(self) -> None:
        if self._index is not None:
            files.delete(self.spark, self._index.path)
        self._index = None

    def _built(self) -> _Index:
        """The index over the live rows, written beside the log so that searches read it."""
        p, path, seq = self.config.params, f"{self._log.path}-index-{uuid.uuid4().hex}", self._log.next_seq()
        rows = self.rows()
        if self.config.index_type == "ivf":
            model = IVF(p["nlist"], p["nprobe"], p["seed"], p["max_iter"]).fit(rows)
            held = model, model.write(rows, path)
        else:
            held = hnsw.build(rows, self.config.metric, p["M"], p["ef_construction"], p["ef_search"], p["seed"], p["shard_rows"]).kept(path)
        return _Index(held, seq, path, rows.count())

    def enriched(self, query: Sequence[float], top_k: int = 10, filter: dict | None = None) -> list[tuple[int, float, dict]]:
        """Hits with their metadata, which is read for the hits only."""
        hits = self.search(query, top_k, filter)
        found = self.rows().where(F.col("vec_id").isin([i for i, _ in hits])).select("vec_id", "metadata").collect()
        by_id = {r.vec_id: json.loads(r.metadata or "{}") for r in found}
        return [(i, d, by_id.get(i, {})) for i, d in hits]

    # Durability

    def checkpoint(self) -> None:
        """Snapshot the live rows, then drop the log that it includes."""
        if not self.data_dir:
            raise RuntimeError("a checkpoint needs data_dir")
        offset = self._log.next_seq() if self.config.enable_wal else 0
        if self._index is not None and (not self.config.enable_wal or self._index.seq < offset):
            self._drop_index()  # the operations that it lacks are leaving the log
        path = f"{self.data_dir}/snapshot"
        snapshot.save(self.rows(), path, self.config, offset)
        _, self._rows, _ = snapshot.load(self.spark, path)
        if self.config.enable_wal:
            self._offset = offset
            self._log.truncate(offset)
        else:
            files.delete(self.spark, self._log.path)

    def save(self, path: str | None = None) -> None:
        """With a log, a checkpoint; without, a snapshot of the rows at ``path``."""
        if self.config.enable_wal:
            return self.checkpoint()
        if not path and not self.data_dir:
            raise ValueError("save needs a path")
        if not path or path == self.data_dir:
            return self.checkpoint()
        return snapshot.save(self.rows(), f"{path}/snapshot", self.config)

    @classmethod
    def load(cls, spark: SparkSession, path: str, enable_wal: bool = False) -> Collection:
        stored, _, _ = snapshot.load(spark, f"{path}/snapshot")
        return cls(spark, CollectionConfig(**{**json.loads(stored.to_json()), "enable_wal": enable_wal}), path)

    def close(self) -> None:
        """Remove scratch files and the index; a log needs no closing."""
        self._drop_index()
        if not self.config.enable_wal and files.exists(self.spark, self._own):
            files.delete(self.spark, self._own)
