"""Sharded graph index: a navigable small-world graph for each hash shard.

A shard has a bounded expected number of rows; its graph is built in one task and kept
as one row, so a search reads shards as they are stored, without a shuffle.  Levels
come from a hash of the id, so a build is reproducible and does not depend on the
order of arrival.  Deleted rows stay in the graph as tombstones: a walk passes them,
but they take no place among its results, nor do rows that are not candidates.
Rows without an embedding are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.functions.distance import check_metric, paired
from sparkvec.operators import flat

#: Queries that walk a graph in step.
WALKS = 1024
#: Rows of a shard, about: so many that a walk of width 50 finds nine of ten neighbours in 64 dimensions without structure.
SHARD_ROWS = 4_000
#: One row a shard: its nodes in order of id.
GRAPH = "shard int, vec_id array<long>, level array<int>, embedding array<array<float>>, links array<array<array<int>>>"


class Graph:
    """The graph of one shard; nodes are row numbers in order of id.

    Walks go in step: many queries each take their nearest open node at once, so that a
    step is a few array operations.  Distances of a walk are products of single precision.
    """

    def __init__(self, vectors: np.ndarray, metric: str, near: list[np.ndarray]):
        self.x, self.metric, self.near = vectors, metric, near  # near: a layer's links, padded with n
        self.n, self.entry = len(vectors), 0
        self.right = flat.sides(metric, vectors)[1]
        kind = np.float32 if not self.n or np.abs(self.right).max() < 1e15 else float
        self.right = np.vstack([self.right, np.zeros((1, self.right.shape[1]))]).astype(kind)
        self.plain = self.right[:, : vectors.shape[1]]

    @classmethod
    def build(cls, vectors: np.ndarray, metric: str, level: np.ndarray, m: int, ef: int) -> Graph:
        n = len(vectors)
        g = cls(vectors, metric, [np.full((n + 1, m if layer else 2 * m), n, np.int32) for layer in range(int(level.max()) + 1)])
        g.entry = int(level.argmax())
        for layer in range(len(g.near)):
            g.grow(layer, np.flatnonzero(level >= layer), m, ef)
            g.reach(layer, m)
        return g

    def reach(self, layer: int, least: int) -> None:
        """Every node linked from at least so many of those it links to; without that, rows at the rim are met by no walk."""
        near, n = self.near[layer], self.n
        into = np.bincount(near.ravel(), minlength=n + 1)
        at, col = np.nonzero(near[:n] < n)
        to = near[at, col]
        # Not yet linked back, the nearest first.
        back = np.isin(to.astype(np.int64) * (n + 1) + at, at.astype(np.int64) * (n + 1) + to, invert=True)
        at, to = at[back], to[back]
        far = np.concatenate([paired(self.metric, self.x[at[i : i + 65_536]], self.x[to[i : i + 65_536]]) for i in range(0, len(at), 65_536)] or [np.zeros(0)])
        order = np.lexsort((to, far, at))
        at, to = at[order], to[order]
        short = np.arange(len(at)) - np.searchsorted(at, at) < (least - into)[at]
        at, to = at[short], to[short]
        order = np.lexsort((at, to))
        at, to = at[order], to[order]
        place = (near < n).sum(axis=1)[to] + np.arange(len(to)) - np.searchsorted(to, to)
        wide = np.full((n + 1, max(near.shape[1], int(place.max(initial=-1)) + 1)), n, np.int32)
        wide[:, : near.shape[1]] = near
        wide[to, place] = at
        self.near[layer] = wide

    def grow(self, layer: int, nodes: np.ndarray, m: int, ef: int) -> None:
        """Link the nodes of a layer, in batches no larger than what is there; nodes of a batch also see each other."""
        nodes = np.concatenate([[self.entry], nodes[nodes != self.entry]])
        done = 0
        while done < len(nodes):
            batch = nodes[done : done + min(max(done, WALKS // 4), WALKS)]
            left, _, same = flat.sides(self.metric, self.x[batch])
            left = left.astype(self.right.dtype)
            d = left @ self.right[batch].T
            np.fill_diagonal(d, np.inf)
            node = np.broadcast_to(batch, d.shape)
            if d.shape[1] > ef:
                some = np.argpartition(d, ef - 1, axis=1)[:, :ef]
                d, node = np.take_along_axis(d, some, 1), np.take_along_axis(node, some, 1)
            if done:
                seen = self.walk(left, np.full(len(batch), self.entry), ef, layer)
                d, node = np.hstack([d, seen[0]]), np.hstack([node, seen[1]])
            order = np.argsort(d, axis=1, kind="stable")[:, :ef]
            d, node = np.take_along_axis(d, order, 1), np.take_along_axis(node, order, 1)
            links = self.apart(d + np.broadcast_to(same, len(batch))[:, None].astype(d.dtype), np.where(np.isinf(d), self.n, node), m)
            self.near[layer][batch, : links.shape[1]] = links
            self.back(layer, batch, links)
            done += len(batch)

    def back(self, layer: int, batch: np.ndarray, links: np.ndarray) -> None:
        """Links to the batch from the nodes that it links to; a node keeps as many as it has places."""
        near = self.near[layer]
        most = near.shape[1]
        at, col = np.nonzero(links < self.n)
        other, node = links[at, col], batch[at]
        far = np.concatenate([paired(self.metric, self.x[other[i : i + 65_536]], self.x[node[i : i + 65_536]]) for i in range(0, len(other), 65_536)] or [np.zeros(0)])
        order = np.lexsort((node, far, other))
        other, node = other[order], node[order]
        rank = np.arange(len(other)) - np.searchsorted(other, other)
        other, node, rank = (v[rank < 2 * most] for v in (other, node, rank))
        for some in np.array_split(np.unique(other), max(1, len(other) // 4096)):
            lot = np.isin(other, some) if len(some) else np.zeros(len(other), bool)
            come = np.full((len(some), 2 * most), self.n, np.int32)
            come[np.searchsorted(some, other[lot]), rank[lot]] = node[lot]
            both = np.hstack([near[some], come])
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = self.n  # two nodes of a batch may have chosen each other
            d = np.full(both.shape, np.inf)
            row, c = np.nonzero(both < self.n)
            d[row, c] = paired(self.metric, self.x[some[row]], self.x[both[row, c]])
            order = np.lexsort((both, d))
            d, both = np.take_along_axis(d, order, 1), np.take_along_axis(both, order, 1)
            wide = int((both < self.n).sum(axis=1).max()) if len(both) else 0
            near[some] = self.n
            kept = self.apart(d[:, :wide].astype(self.right.dtype), both[:, :wide], most)
            near[some, : kept.shape[1]] = kept

    def apart(self, d: np.ndarray, node: np.ndarray, most: int) -> np.ndarray:
        """Of nodes in order of distance, a row a centre: those nearer to it than to any chosen before; then the nearest others."""
        out = np.full((len(d), min(most, d.shape[1])), self.n, np.int32)
        step = max(1, (1 << 23) // max(1, d.shape[1] * (d.shape[1] + self.x.shape[1])))
        for i in range(0, len(d), step):
            far, names = d[i : i + step], node[i : i + step]
            real = names < self.n
            if names.shape[1] <= most:
                out[i : i + step] = names
                continue
            p = self.plain[names]
            between = p @ p.transpose(0, 2, 1)
            if self.metric == "l2":
                size = (p * p).sum(axis=2)
                between = size[:, :, None] + size[:, None, :] - 2 * between
            else:
                between = 1 - between if self.metric == "cosine" else -between
            least, chosen, count = np.full(far.shape, np.inf, between.dtype), np.zeros(far.shape, bool), np.zeros(len(far), int)
            for c in range(far.shape[1]):
                take = real[:, c] & (far[:, c] < least[:, c]) & (count < most)
                chosen[:, c] = take
                count += take
                least[take] = np.minimum(least[take], between[take, c])
            first = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
            out[i : i + step] = np.take_along_axis(names, np.sort(first, axis=1), 1)
        return out

    def walk(self, left: np.ndarray, entries: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(product, node) of the ef nearest nodes that a best-first walk from each entry meets on a layer, in no order."""
        near, n, rows = self.near[layer], self.n, np.arange(len(left))
        out_d, out_n = np.full((len(left), ef), np.inf, left.dtype), np.full((len(left), ef), n, np.int32)
        d, node, open_ = out_d.copy(), out_n.copy(), np.zeros(out_d.shape, bool)
        seen = np.zeros((len(left), n + 1), bool)
        seen[:, n] = True
        seen[rows, entries] = True
        d[:, 0], node[:, 0], open_[:, 0] = np.einsum("ij,ij->i", left, self.right[entries]), entries, True
        while len(rows):
            at = np.where(open_, d, np.inf).argmin(axis=1)
            i = np.arange(len(rows))
            going = open_[i, at]
            if not going.all():
                ended = ~going
                out_d[rows[ended]], out_n[rows[ended]] = d[ended], node[ended]
                rows, d, node, open_, at = rows[going], d[going], node[going], open_[going], at[going]
                i = np.arange(len(rows))
                if not len(rows):
                    break
            open_[i, at] = False
            met = near[node[i, at]]
            r, c = np.nonzero(~seen[rows[:, None], met])
            to = met[r, c]
            seen[rows[r], to] = True
            more = np.full(met.shape, np.inf, d.dtype)
            more[r, c] = np.einsum("ij,ij->i", left[rows[r]], self.right[to])
            d, node, open_ = np.hstack([d, more]), np.hstack([node, met]), np.hstack([open_, more < np.inf])
            keep = np.argpartition(d, ef - 1, axis=1)[:, :ef]
            d, node, open_ = (np.take_along_axis(v, keep, 1) for v in (d, node, open_))
        return out_d, out_n

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(distance, node) of the ef nearest nodes met, in order; places that stay empty are infinitely far, at node n."""
        left, at = flat.sides(self.metric, q)[0].astype(self.right.dtype), np.full(len(q), self.entry)
        for layer in range(len(self.near) - 1, 0, -1):
            at = self.walk(left, at, 1, layer)[1][:, 0]
        node = self.walk(left, at, ef, 0)[1]
        d = np.full(node.shape, np.inf)
        for i in range(0, len(q), 64):
            r, c = np.nonzero(node[i : i + 64] < self.n)
            d[i + r, c] = paired(self.metric, q[i + r], self.x[node[i + r, c]])
        order = np.lexsort((node, d))
        return np.take_along_axis(d, order, 1), np.take_along_axis(node, order, 1)

    def find(self, q: np.ndarray, k: int, ef: int, shown: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, distance, node) of the k nearest; of the shown nodes, for which a walk is as much wider as they are fewer."""
        if shown is None:
            d, node = self.search(q, ef)
            short = np.zeros(len(q), bool)
        else:
            live = np.flatnonzero(shown)
            wide = -(-ef * self.n // len(live))
            if wide * 8 > self.n:  # so few that all of them are scored
                d, node, short = np.zeros((len(q), 0)), np.zeros((len(q), 0), int), np.ones(len(q), bool)
            else:
                d, node = self.search(q, wide)
                d[~np.append(shown, False)[node]] = np.inf
                order = np.argsort(d, axis=1, kind="stable")
                d, node = np.take_along_axis(d, order, 1), np.take_along_axis(node, order, 1)
                short = (d < np.inf).sum(axis=1) < min(k, len(live))
        d, node = d[:, :k], node[:, :k]
        at, col = np.nonzero((d < np.inf) & ~short[:, None])
        found = at, d[at, col], node[at, col]
        if not short.any():
            return found
        # What a walk leaves short is scored against all shown nodes.
        missing, top = np.flatnonzero(short), flat.TopK(q[short], k, self.metric)
        for i in range(0, len(live), 4096):
            top.add(live[i : i + 4096], self.x[live[i : i + 4096]])
        return tuple(np.concatenate(v) for v in zip(found, (missing[top.best[0]], *top.best[1:]), strict=True))

    def lists(self, level: np.ndarray) -> list[list[list[int]]]:
        """Links as stored: a list a layer of each node."""
        kept = [[row[row < self.n].tolist() for row in near[: self.n]] for near in self.near]
        return [[kept[layer][node] for layer in range(top + 1)] for node, top in enumerate(level.tolist())]

    @classmethod
    def load(cls, vectors: np.ndarray, metric: str, level: np.ndarray, links: list[list[list[int]]]) -> Graph:
        n, near = len(vectors), []
        for layer in range(int(level.max()) + 1):
            rows = [node[layer] if layer < len(node) else [] for node in links]
            size = np.array([len(r) for r in rows])
            wide = np.full((n + 1, max(1, int(size.max()))), n, np.int32)
            at = np.repeat(np.arange(n), size)
            wide[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = [to for r in rows for to in r]
            near.append(wide)
        g = cls(vectors, metric, near)
        g.entry = int(level.argmax())
        return g


def _searcher(sent, metric: str, ef: int, top_k: int, mode: str):
    """Over shard rows (vec_id, level, embedding, links, marked): the top_k nearest nodes of each of the broadcast queries."""

    def run(batches):
        names, q = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = batch.column("vec_id")[i].values.to_numpy(), flat.matrix(batch.column("embedding")[i].values)
                if x.shape[1] != q.shape[1] or not top_k:
                    continue
                marked = batch.column("marked")[i].as_py() or []
                shown = None if not mode else np.isin(ids, marked, invert=mode == "hidden")
                if shown is not None and not shown.any():
                    continue
                g = Graph.load(x, metric, batch.column("level")[i].values.to_numpy(), batch.column("links")[i].as_py())
                for at in range(0, len(q), WALKS):
                    query, dist, node = g.find(q[at : at + WALKS], top_k, ef, shown)
                    yield pa.RecordBatch.from_arrays([pa.array(names[at + query]), pa.array(ids[node]), pa.array(dist)], names=["qid", "vec_id", "distance"])

    return run


@dataclass
class HNSWIndex:
    """A built index: its graph table, the metric it was built for, and tombstones (vec_id)."""

    graph: DataFrame
    metric: str
    ef_search: int = 50
    deleted: DataFrame | None = None
    shards: int | None = None

    def live(self) -> DataFrame:
        rows = self.graph.select(F.explode(F.arrays_zip("vec_id", "embedding")).alias("node")).select("node.vec_id", "node.embedding")
        return rows if self.deleted is None else rows.join(self.deleted, "vec_id", "left_anti")

    def _marked(self, candidates: DataFrame | None) -> tuple[DataFrame, str]:
        """The shards with the ids that a search shows or hides, and which of the two."""
        if candidates is None and self.deleted is None:
            return self.graph.withColumn("marked", F.lit(None).cast("array<long>")), ""
        wanted, mode = (self.deleted, "hidden") if candidates is None else (candidates.select("vec_id"), "shown")
        if candidates is not None and self.deleted is not None:
            wanted = wanted.join(self.deleted, "vec_id", "left_anti")
        ids = self.graph.select("shard", F.explode("vec_id").alias("vec_id")).join(wanted, "vec_id", "left_semi")
        # A part a shard, which adaptive execution leaves apart: small as they are, shards are work for a task each.
        dealt = (lambda df: df.repartition(self.shards, "shard")) if self.shards else (lambda df: df)
        marks = dealt(ids.groupBy("shard").agg(F.collect_list("vec_id").alias("marked")))
        return dealt(self.graph).join(marks, "shard", "left"), mode

    def kept(self, path: str) -> HNSWIndex:
        """The same index with its graph written below ``path``, so that it is built once."""
        self.graph.write.parquet(path)
        return HNSWIndex(self.graph.sparkSession.read.schema(GRAPH).parquet(path), self.metric, self.ef_search, self.deleted, self.shards)

    def remove(self, ids: DataFrame) -> HNSWIndex:
        """With more tombstones; unknown ids do nothing."""
        gone = ids.select("vec_id")
        gone = gone if self.deleted is None else gone.union(self.deleted)
        return HNSWIndex(self.graph, self.metric, self.ef_search, gone.distinct(), self.shards)

    def batch_search(self, queries: DataFrame, top_k: int = 10, ef: int | None = None, candidates: DataFrame | None = None) -> DataFrame:
        """(qid, vec_id, distance, rank): every shard is searched, then merged; queries go in few passes, see flat.passes."""
        spark, out, wide = self.graph.sparkSession, None, max(ef or self.ef_search, top_k)
        shards, mode = self._marked(candidates)
        for names, vectors in flat.passes(queries):
            sent = spark.sparkContext.broadcast((names, vectors))
            found = shards.mapInArrow(_searcher(sent, self.metric, wide, max(top_k, 0), mode), flat.HITS)
            out = found if out is None else out.union(found)
        if out is None:
            out = spark.createDataFrame([], flat.HITS)
        return flat.ranked(out, max(top_k, 0)).select("qid", "vec_id", "distance", "rank")

    def search(self, query, top_k: int = 10, candidates: DataFrame | None = None) -> DataFrame:
        """(vec_id, distance) in order.  With candidates that a beam could miss, the search is exact over them."""
        if candidates is not None:
            return flat.search(self.live(), query, top_k, self.metric, candidates=candidates)
        one = self.graph.sparkSession.createDataFrame([(0, [float(x) for x in query])], "qid long, embedding array<double>")
        return self.batch_search(one, top_k).orderBy("rank").select("vec_id", "distance")


def build(rows: DataFrame, metric: str = "l2", M: int = 16, ef_construction: int = 200, ef_search: int = 50, seed: int = 42, shard_rows: int = SHARD_ROWS) -> HNSWIndex:
    """An index over rows (vec_id, embedding); see :meth:`HNSWIndex.kept`."""
    check_metric(metric)
    if M < 2:
        raise ValueError("M must be at least 2")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    u = (F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)
    level = F.floor(-F.log(u) / math.log(M)).cast("int")
    shard = F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(shards)).cast("int")
    slim = rows.where("embedding is not null").select(shard.alias("shard"), F.col("vec_id").cast("long").alias("vec_id"), level.alias("level"), F.col("embedding").cast("array<float>").alias("embedding"))

    def run(group):
        group = group.sort_by("vec_id")
        level = group.column("level").to_numpy()
        links = Graph.build(flat.matrix(group.column("embedding")), metric, level, M, ef_construction).lists(level)
        one = lambda values: pa.array([values.to_pylist()], pa.list_(values.type))
        links = pa.array([links], pa.list_(pa.list_(pa.list_(pa.int32()))))
        return pa.table([group.column("shard")[:1].combine_chunks(), *(one(group.column(c)) for c in ("vec_id", "level", "embedding")), links], names=["shard", "vec_id", "level", "embedding", "links"])

    # A part a shard: adaptive execution would put many small shards into one task.
    return HNSWIndex(slim.repartition(shards, "shard").groupBy("shard").applyInArrow(run, GRAPH), metric, ef_search, shards=shards)
