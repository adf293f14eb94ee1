"""A sharded collection: a row's shard is the ring owner of its id.

The client routes writes by owner and searches every shard; each shard's best rows
are merged.  Rows live in collections, durable ones if the client has a folder; the
owner is a function of the id and the ring, so a change of topology moves rows without
rewriting them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions.distance import distance_to
from sparkvec.operators import ring as rings
from sparkvec.plans.collection import Collection
from sparkvec.plans.config import CollectionConfig
from sparkvec.plans.filters import compile_filter
from sparkvec.sources.catalog import Catalog


class ShardedClient:
    """Collections by name, each read as a table (shard, vec_id, embedding, metadata as VARIANT)."""

    def __init__(self, spark: SparkSession, nodes: Sequence[str], replica_count: int = 1, virtual_nodes: int = rings.VIRTUAL_NODES, data_dir: str | None = None):
        self.spark, self.nodes, self.replica_count, self.virtual_nodes = spark, sorted(set(nodes)), replica_count, virtual_nodes
        self._catalog = Catalog(spark, data_dir) if data_dir else None
        self._open: dict[str, Collection] = self._catalog.open if self._catalog else {}
        self._name: str | None = None

    @property
    def ring(self) -> DataFrame:
        return rings.build(self.spark, self.nodes, self.virtual_nodes)

    def create_collection(self, name: str, dim: int, metric: str = "l2") -> ShardedClient:
        config = CollectionConfig(dim, metric, enable_wal=self._catalog is not None)
        if self._catalog:
            self._catalog.create(name, config)
        elif name in self._open:
            raise ValueError(f"collection {name!r} exists")
        else:
            self._open[name] = Collection(self.spark, config)
        return self.use_collection(name)

    def use_collection(self, name: str) -> ShardedClient:
        self._name = name
        return self

    def _current(self) -> Collection:
        if self._name is None:
            raise ValueError("choose a collection first: use_collection(name)")
        if self._name not in self._open:
            raise KeyError(f"no collection {self._name!r}")
        return self._open[self._name]

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", rings.owner(self.ring, F.col("vec_id"))).select("shard", "vec_id", "embedding", "metadata")

    def insert_rows(self, rows: DataFrame) -> None:
        if not self.nodes:
            raise ValueError("the cluster has no nodes")
        self._current().insert_rows(rows)

    def insert(self, vec_id: int, vector: Sequence[float], metadata: str = "{}") -> None:
        self.insert_rows(self.spark.createDataFrame([(vec_id, [float(x) for x in vector], metadata)], "vec_id long, embedding array<float>, metadata string"))

    def delete(self, vec_id: int) -> None:
        self._current().delete(vec_id)

    def search(self, query: Sequence[float], top_k: int = 5, filter: dict | None = None) -> DataFrame:
        c = self._current()
        if len(query) != c.config.dim:
            raise ValueError(f"query has {len(query)} dimensions; the collection has {c.config.dim}")
        table = c.table()
        if (where := compile_filter(filter)) is not None:
            table = table.where(where)
        return rings.shard_search(self._placed(table), distance_to(c.config.metric, F.col("embedding"), query), top_k)

    def get_stats(self) -> DataFrame:
        return rings.shard_stats(self._placed(self._current().rows()))

    def list_collections(self) -> DataFrame:
        """(shard, collections): the names that have rows on each node."""
        named = [self._placed(c.rows()).select("shard").distinct().withColumn("name", F.lit(n)) for n, c in self._open.items()]
        out = self.spark.createDataFrame([], "shard string, name string")
        for part in named:
            out = out.union(part)
        return out.groupBy("shard").agg(F.array_sort(F.collect_set("name")).alias("collections"))

    def replica_nodes(self, vec_id: int) -> list[str]:
        keys = self.spark.createDataFrame([(str(vec_id),)], "key string")
        return [r.node for r in rings.replicas(self.ring, keys, self.replica_count).orderBy("rank").collect()]

    def add_node(self, node: str) -> None:
        self.nodes = sorted({*self.nodes, node})

    def remove_node(self, node: str) -> None:
        self.nodes = [n for n in self.nodes if n != node]

    def close(self) -> None:
        for c in self._open.values():
            c.close()
