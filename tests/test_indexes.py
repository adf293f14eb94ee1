import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.operators import flat, hnsw, ivf


def rows_of(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")


def ids(df):
    return [r.vec_id for r in df.collect()]


@pytest.fixture(scope="module")
def tiny(spark):
    return rows_of(spark, [[0, 0], [1, 1], [5, 5], [10, 10]], [10, 11, 12, 13])


def test_flat_order_limits_and_ties(spark, tiny):
    assert ids(flat.search(tiny, [0.1, 0.1], 2)) == [10, 11]
    assert ids(flat.search(tiny, [0.1, 0.1], 0)) == [] == ids(flat.search(tiny, [0.1, 0.1], -1))
    assert len(ids(flat.search(tiny, [0.1, 0.1], 99))) == 4
    same = rows_of(spark, [[1, 1]] * 5, [9, 7, 8, 5, 6])
    assert ids(flat.search(same, [0, 0], 3)) == [5, 6, 7]
    with pytest.raises(ValueError):
        flat.search(tiny, [1.0], 2, dim=2)
    with pytest.raises(ValueError):
        flat.search(tiny, [1.0, 1.0], 2, "hamming")


def test_flat_candidates(spark, tiny):
    wanted = spark.createDataFrame([(11,), (12,), (99,)], "vec_id long")
    assert ids(flat.search(tiny, [0, 0], 3, candidates=wanted)) == [11, 12]


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_batch_equals_single(spark, metric):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(60, 6)), np.zeros((2, 6)), np.ones((5, 6))])
    rows = rows_of(spark, vectors).repartition(3)
    asked = rows_of(spark, vectors[::9]).select(F.col("vec_id").alias("qid"), "embedding")
    got = flat.batch_search(rows, asked, 7, metric, block=3).orderBy("qid", "rank").collect()
    for qid, q in enumerate(vectors[::9]):
        one = flat.search(rows, q, 7, metric).collect()
        mine = [r for r in got if r.qid == qid]
        assert [r.distance for r in mine] == pytest.approx([r.distance for r in one], abs=1e-5)
        assert sorted(r.vec_id for r in mine[:5]) == sorted(r.vec_id for r in one[:5]) or len({round(r.distance, 5) for r in one}) < 7
    assert flat.batch_search(rows, asked.limit(0), 3, metric).count() == 0
    assert flat.batch_search(rows.limit(0), asked, 3, metric).count() == 0


def recall(spark, rows, asked, found, k=10):
    return flat.recall_at_k(flat.batch_search(rows, asked, k), found, k).first().recall


def test_ivf_recall_and_filters(spark):
    rng = np.random.default_rng(0)
    rows = rows_of(spark, rng.uniform(size=(500, 16)))
    asked = rows_of(spark, rng.uniform(size=(20, 16))).withColumnRenamed("vec_id", "qid")
    model = ivf.IVF(nlist=20, nprobe=10).fit(rows)
    bucketed = model.transform(rows).cache()
    assert recall(spark, rows, asked, model.batch_search(bucketed, asked, 10)) > 0.6
    q = asked.first()
    one = [(r.vec_id, r.distance) for r in model.search(bucketed, q.embedding, 10).collect()]
    batch = [(r.vec_id, r.distance) for r in model.batch_search(bucketed, asked.where(F.col("qid") == q.qid), 10).orderBy("rank").collect()]
    assert [i for i, _ in one] == [i for i, _ in batch]
    odd = ids(model.search(bucketed, q.embedding, 10, where=F.col("vec_id") % 2 == 1))
    assert odd and all(i % 2 for i in odd)
    full = model.search(bucketed, q.embedding, 10, nprobe=20)
    assert ids(full) == ids(flat.search(rows, q.embedding, 10))


def test_ivf_trains_on_rows_only(spark, tiny):
    with pytest.raises(ValueError):
        ivf.IVF().fit(tiny.limit(0))
    assert len(ivf.IVF(nlist=50).fit(tiny).centroids) == 4
    model = ivf.IVF(nlist=2, nprobe=2).fit(tiny)
    left = model.transform(tiny.where("vec_id <> 10"))
    assert sorted(ids(model.search(left, [0, 0], 4))) == [11, 12, 13]


def test_empty_bucket_keeps_its_centroid(spark, tiny):
    centroids = np.array([[0.0, 0.0], [100.0, 100.0]])
    assert ivf.lloyd_step(tiny, centroids)[1].tolist() == [100.0, 100.0]


def test_hnsw_recall_shards_and_tombstones(spark):
    rng = np.random.default_rng(0)
    rows = rows_of(spark, rng.uniform(size=(300, 16)))
    asked = rows_of(spark, rng.uniform(size=(20, 16))).withColumnRenamed("vec_id", "qid")
    for shard_rows in (300, 90):
        index = hnsw.build(rows, M=16, ef_construction=100, ef_search=64, shard_rows=shard_rows)
        index.graph = index.graph.cache()
        found = index.batch_search(asked, 10).cache()
        assert recall(spark, rows, asked, found) > 0.7
        assert found.groupBy("qid", "vec_id").count().where("count > 1").isEmpty()
    gone = found.select("vec_id").limit(5)
    after = index.remove(gone)
    assert after.batch_search(asked, 10).join(gone, "vec_id", "left_semi").isEmpty()
    assert after.live().count() == 300 - gone.distinct().count()
    wanted = rows.where("vec_id % 50 = 0").select("vec_id")
    q = asked.first().embedding
    assert ids(index.search(q, 3, wanted)) == ids(flat.search(rows, q, 3, candidates=wanted))
    with pytest.raises(ValueError):
        hnsw.build(rows, M=1)


def test_hnsw_recall_with_uneven_norms(spark, tmp_path):
    """No structure and norms from 1 to 7: the outer rows are the hard ones."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 64))
    v *= (1 + np.arange(4000) % 7)[:, None] / np.linalg.norm(v, axis=1)[:, None]
    rows = rows_of(spark, v)
    index = hnsw.build(rows, M=16, ef_construction=64).kept(str(tmp_path / "g"))
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    assert recall(spark, rows, asked, index.batch_search(asked, 10)) >= 0.9
    for row in index.graph.select("links").collect():
        layer = [node[0] for node in row.links]
        assert all(len(set(to)) == len(to) for to in layer) and set().union(*layer) == set(range(len(layer)))


def test_hnsw_copies_and_few_shown(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([np.ones((150, 8)), rng.normal(size=(150, 8))])
    rows = rows_of(spark, v)
    asked = rows.where("vec_id in (0, 200)").withColumnRenamed("vec_id", "qid")
    index = hnsw.build(rows, M=4, ef_construction=20, ef_search=20)
    found = index.batch_search(asked, 10).collect()
    assert {r.distance for r in found if r.qid == 0} == {0.0} and len(found) == 20
    left = index.remove(rows.where("vec_id < 150 or vec_id % 2 = 0").select("vec_id"))
    got = sorted((r.qid, r.rank, r.vec_id) for r in left.batch_search(asked, 5).collect())
    exact = flat.batch_search(rows.where("vec_id >= 150 and vec_id % 2 = 1"), asked, 5).collect()
    assert got == sorted((r.qid, r.rank, r.vec_id) for r in exact)


def test_hnsw_tiny(spark, tiny):
    index = hnsw.build(tiny, M=8, ef_construction=50, ef_search=50)
    assert ids(index.search([0.1, 0.1], 2)) == [10, 11]
    assert hnsw.build(tiny.limit(0)).search([0.1, 0.1], 2).count() == 0


@pytest.mark.parametrize("kind,params", [("flat", {}), ("ivf", {"nlist": 2, "nprobe": 2}), ("hnsw", {"M": 8, "ef_construction": 50, "ef_search": 50})])
def test_one_interface(spark, tiny, kind, params):
    from sparkvec.operators.index import benchmark, create_index

    empty = create_index(spark, kind, 2, **params)
    assert len(empty) == 0 and empty.search([0, 0], 5).count() == 0
    index = empty.add(tiny)
    assert len(index) == 4 and ids(index.search([0.1, 0.1], 2)) == [10, 11] and index.get_vector(12) == [5.0, 5.0]
    for bad in (tiny.limit(1), rows_of(spark, [[1, 2, 3]], [50]), rows_of(spark, [[1, 2], [1, 2]], [50, 50])):
        with pytest.raises(ValueError):
            index.add(bad)
    left = index.remove(tiny.where("vec_id in (10, 99)").select("vec_id"))
    assert len(left) == 3 and left.get_vector(10) is None and sorted(r.vec_id for r in left.export().collect()) == [11, 12, 13]
    assert ids(left.search([0.1, 0.1], 2)) == [11, 12]
    again = left.add(rows_of(spark, [[0, 0]], [10]))
    assert ids(again.search([0.1, 0.1], 1)) == [10]
    report = benchmark(empty, tiny, tiny.withColumnRenamed("vec_id", "qid"), 2)
    assert report["recall"] == 1 and report["qps"] > 0
    with pytest.raises(ValueError):
        create_index(spark, "tree", 2)
