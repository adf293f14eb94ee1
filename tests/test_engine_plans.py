"""What reads, searches and commits do at scale: plans without needless shuffles, and edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.functions.distance import distance, distance_to
from sparkvec.operators import flat, hnsw, ivf
from sparkvec.plans.cluster import ShardedClient
from sparkvec.plans.collection import Collection
from sparkvec.plans.config import CollectionConfig
from sparkvec.sources import files, oplog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def filled(spark, tmp_path, kind="flat", params=None, n=60):
    c = Collection(spark, CollectionConfig(4, index_type=kind, index_params=params or {}, enable_wal=True), str(tmp_path))
    rng = np.random.default_rng(1)
    c.insert_many(list(range(n)), rng.uniform(size=(n, 4)).tolist(), [{"odd": i % 2} for i in range(n)])
    return c


def test_no_shuffle_of_a_snapshot(spark, tmp_path):
    c = filled(spark, tmp_path)
    c.checkpoint()
    assert "Exchange" not in plan(c.rows()) and "Aggregate" not in plan(c.rows())
    # An ordered limit sends top_k rows a task.
    assert "Exchange" not in plan(c.find([0, 0, 0, 0], 3)).replace("TakeOrderedAndProject", "")
    c.delete([3])
    assert len(c) == 59 and c.get(3) is None


@pytest.mark.parametrize("kind,params", [("ivf", {"nlist": 4, "nprobe": 4}), ("hnsw", {"M": 8, "ef_construction": 50, "ef_search": 50})])
def test_an_index_is_searched_beside_later_writes(spark, tmp_path, kind, params):
    c = filled(spark, tmp_path, kind, params)
    q = [0.5, 0.5, 0.5, 0.5]
    before = c.search(q, 5)
    path = c._index.path
    c.delete([before[0][0]])
    c.insert_many([100, 101], [q, [9, 9, 9, 9]], [{"odd": 0}, {"odd": 1}])
    c.delete([before[1][0]])
    c.insert(before[1][0], [0.5, 0.5, 0.5, 0.51])
    exact = [(r.vec_id, r.distance) for r in flat.search(c.table(), q, 5).collect()]
    assert c.search(q, 5) == exact and exact[0][0] == 100 and c._index.path == path
    odd = [i for i, _ in c.search(q, 5, {"odd": 0})]
    assert odd == [r.vec_id for r in flat.search(c.table().where("variant_get(metadata, '$.odd', 'int') = 0"), q, 5).collect()]
    c.checkpoint()
    assert not files.exists(spark, path) and c.search(q, 5) == exact
    c.close()


def test_probed_buckets_are_all_that_is_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(70)], "vec_id long, embedding array<float>")
    model = ivf.IVF(nlist=5, nprobe=1).fit(rows)
    held = model.write(rows, str(tmp_path / "held"))
    found = model.search(held, [1.0, 1.0], 3)
    assert "PartitionFilters: [isnotnull(bucket_id" in plan(found) or "PartitionFilters: [bucket_id" in plan(found)


def test_many_queries_take_one_pass_over_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))], "vec_id long, embedding array<float>").cache()
    asked = rows.where("vec_id < 40").withColumnRenamed("vec_id", "qid")
    found = flat.batch_search(rows, asked, 5, block=8)
    assert "Union" not in plan(found) and plan(found).count("Exchange") == 1  # of the hits, by query
    monkeypatch.setattr(flat, "QUERY_PASS", 16)
    by_pass = flat.batch_search(rows, asked, 5, block=8)
    assert "Union" in plan(by_pass)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, by_pass.collect()))
    mixed = asked.select("qid", F.when(F.col("qid") % 2 == 0, F.col("embedding")).otherwise(F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    assert {r.qid for r in flat.batch_search(rows, mixed, 5).collect()} == set(range(0, 40, 2))


def test_rows_of_a_bucket_do_not_join_the_queries(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))], "vec_id long, embedding array<float>").cache()
    asked = rows.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "qid")
    model = ivf.IVF(nlist=6, nprobe=2).fit(rows)
    held = model.write(rows, str(tmp_path / "held"))
    found = model.batch_search(held, asked, 5)
    assert "Join" not in plan(found) and plan(found).count("Exchange") == 1
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    for q in asked.where("qid % 33 = 0").collect():
        assert got[q.qid] == [r.vec_id for r in model.search(held, q.embedding, 5).collect()]


def test_graph_search_has_no_shuffle_of_the_graph(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(70)], "vec_id long, embedding array<float>")
    index = hnsw.build(rows, M=4, ef_construction=20, shard_rows=20).kept(str(tmp_path / "g"))
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    found = index.batch_search(asked, 5)
    assert plan(found).count("Exchange") == 1  # of the hits, by query
    # However many are deleted, a query gets as many as there are.
    few = index.remove(rows.where("vec_id % 10 <> 0").select("vec_id")).batch_search(asked, 7)
    assert few.groupBy("qid").count().where("count <> 7").isEmpty() and few.where("vec_id % 10 <> 0").isEmpty()
    some = index.batch_search(asked, 3, candidates=rows.where("vec_id % 7 = 1").select("vec_id"))
    assert some.groupBy("qid").count().where("count <> 3").isEmpty() and some.where("vec_id % 7 <> 1").isEmpty()


def test_a_graph_is_built_once_for_all_queries(spark, tmp_path):
    from sparkvec import queries

    rng = np.random.default_rng(8)
    made = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(22_000, 4)))]
    spark.createDataFrame(made[:1000], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.tombstone_antijoin(spark, str(tmp_path))
    assert "FlatMapGroupsInArrow" not in plan(found)  # read, not built
    assert found.where("hits <> 10 or deleted <> 0").isEmpty() and found.count() == 50
    rows = spark.createDataFrame([r[:2] for r in made], "vec_id long, embedding array<float>")
    index = hnsw.build(rows.where("vec_id < 300"), M=4, ef_construction=20, shard_rows=100)
    assert "hashpartitioning(shard" in plan(index.graph) and ", 3), REPARTITION_BY_NUM" in plan(index.graph)  # a part a shard
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    assert "Union" not in plan(index.batch_search(asked, 2))  # 1,100 queries


def test_null_and_ragged_vectors_are_no_neighbours(spark):
    rows = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0, 0.0]), (5, [2.0, 2.0])], "vec_id long, embedding array<float>")
    for metric in ("l2", "cosine", "ip"):
        assert {r.vec_id for r in flat.search(rows, [0.0, 1.0], 9, metric).collect()} == {3, 5}
        asked = rows.where("vec_id in (1, 3)").withColumnRenamed("vec_id", "qid")
        assert {(r.qid, r.vec_id) for r in flat.batch_search(rows, asked, 9, metric).collect()} == {(3, 3), (3, 5)}
        for q in ([0.0, 1.0], [0.0] * 300):
            one = distance_to(metric, F.col("embedding"), q)
            two = distance(metric, F.col("embedding"), F.array(*[F.lit(x) for x in q]))
            told = rows.select("vec_id", one.isNotNull().alias("a"), two.isNotNull().alias("b")).collect()
            assert {r.vec_id for r in told if r.a} == {r.vec_id for r in told if r.b} == ({3, 5} if len(q) == 2 else set())
    model = ivf.IVF(nlist=1).fit(rows.where("vec_id in (1, 3, 5)"))
    assert {r.vec_id for r in model.transform(rows).collect()} == {3, 5}


def test_numbers_of_a_log_have_no_gaps(spark, tmp_path, monkeypatch):
    ops = spark.range(500).selectExpr("'insert' as op", "(id * 37) % 1000 as vec_id", "array(cast(id as float)) as embedding", "'{}' as metadata").repartition(7)
    held = []
    for most in (10_000, 5):
        monkeypatch.setattr(oplog, "ONE_TASK", most)
        log = oplog.OpLog(spark, str(tmp_path / f"log{most}"))
        log.append(ops, 500)
        log.append(ops, 500)
        held.append(sorted((r.seq, r.vec_id) for r in log.read().collect()))
        assert [s for s, _ in held[-1]] == list(range(1000)) and log.count() == 1000
        log.truncate(600)
        assert log.count() == 400 == log.read().count() and log.next_seq() == 1000
        assert not [n for n in files.listing(spark, log.path) if n.startswith("staged")]
    assert held[0] == held[1]


def test_a_sharded_client_is_durable(spark, tmp_path):
    first = ShardedClient(spark, ["a", "b"], data_dir=str(tmp_path))
    first.create_collection("c", 2)
    first.insert_rows(spark.createDataFrame([(i, [float(i), 0.0], "{}") for i in range(10)], "vec_id long, embedding array<float>, metadata string"))
    first.delete(4)
    again = ShardedClient(spark, ["a", "b", "c"], data_dir=str(tmp_path)).use_collection("c")
    assert [r.vec_id for r in again.search([3.9, 0.0], 2).collect()] == [3, 5]
    assert {r.shard: r.num_items for r in again.get_stats().collect()}[None] == 9
    with pytest.raises(ValueError):
        again.create_collection("c", 2)
