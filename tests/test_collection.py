import json

import numpy as np
import pytest

from sparkvec.plans.collection import Collection
from sparkvec.plans.config import CollectionConfig
from sparkvec.sources import files, oplog, snapshot


def make(spark, tmp_path=None, **config):
    return Collection(spark, CollectionConfig(**{"dim": 2, **config}), str(tmp_path) if tmp_path else None)


def test_crud_filter_and_validation(spark):
    c = make(spark)
    assert c.search([0.0, 0.0], 3) == [] and len(c) == 0
    c.insert_many([1, 2, 3], [[0, 0], [1, 1], [2, 2]], [{"tag": "x"}, {"tag": "y"}, {"tag": "x"}])
    assert {i for i, _ in c.search([0, 0], 5, {"tag": "x"})} == {1, 3}
    assert c.search([0, 0], 5, {"tag": "none"}) == []
    assert len(c.search([0, 0], 5, {})) == 3
    assert c.get(2) == ([1.0, 1.0], {"tag": "y"}) and c.get(9) is None
    for ids, vectors in (([1], [[0, 0]]), ([8, 8], [[0, 0], [1, 1]]), ([9], [[1, 2, 3]]), ([9, 10], [[1, 2]])):
        with pytest.raises(ValueError):
            c.insert_many(ids, vectors)
    with pytest.raises(ValueError):
        c.search([1.0], 1)
    c.delete([2, 77])
    assert len(c) == 2 and c.get(2) is None
    c.insert(2, [9, 9])
    assert c.get(2) == ([9.0, 9.0], {})
    assert c.enriched([0, 0], 1) == [(1, 0.0, {"tag": "x"})]
    with pytest.raises(RuntimeError):
        c.checkpoint()
    with pytest.raises(ValueError):
        c.save()
    c.close()


@pytest.mark.parametrize("kind,params", [("flat", {}), ("ivf", {"nlist": 4, "nprobe": 2}), ("hnsw", {"M": 8, "ef_construction": 50, "ef_search": 50})])
def test_index_types_search_filter_and_survive(spark, tmp_path, kind, params):
    c = make(spark, dim=8, index_type=kind, index_params=params)
    vectors = np.random.default_rng(1).uniform(size=(30, 8)).tolist()
    c.insert_many(list(range(30)), vectors, [{"tag": "odd" if i % 2 else "even"} for i in range(30)])
    assert len(c.search(vectors[0], 5)) == 5 and c.search(vectors[0], 5)[0][0] == 0
    assert all(i % 2 == 0 for i, _ in c.search(vectors[0], 5, {"tag": "even"}))
    c.save(str(tmp_path))
    again = Collection.load(spark, str(tmp_path))
    assert again.config.index_type == kind and len(again) == 30 and len(again.search(vectors[0], 3)) == 3


def test_config():
    for bad in ({"dim": 0}, {"metric": "x"}, {"index_type": "x"}, {"index_params": {"nlist": 1}}, {"index_type": "hnsw", "index_params": {"M": 1}}):
        with pytest.raises(ValueError):
            CollectionConfig(**{"dim": 2, **bad})
    with pytest.raises(ValueError):
        Collection(None, CollectionConfig(2, enable_wal=True))


def test_crash_recovery_and_checkpoint(spark, tmp_path):
    c = make(spark, tmp_path, enable_wal=True)
    c.insert_many([1, 2, 3], [[0, 0], [1, 1], [2, 2]], [{"tag": "a"}, None, None])
    c.delete(2)
    again = make(spark, tmp_path, enable_wal=True)  # without closing the first
    assert len(again) == 2 and again.get(1)[1] == {"tag": "a"} and again.get(2) is None
    assert oplog.OpLog(spark, f"{tmp_path}/oplog").count() == 4
    again.checkpoint()
    assert oplog.OpLog(spark, f"{tmp_path}/oplog").count() == 0
    again.insert(4, [4, 4])
    last = make(spark, tmp_path, enable_wal=True)
    assert len(last) == 3
    last.delete(1)
    assert len(make(spark, tmp_path, enable_wal=True)) == 2
    with pytest.raises(ValueError):
        make(spark, tmp_path, enable_wal=True, metric="ip")


def test_rejected_insert_leaves_no_record(spark, tmp_path):
    c = make(spark, tmp_path, enable_wal=True)
    c.insert(1, [0, 0])
    with pytest.raises(ValueError):
        c.insert_many([2, 1], [[1, 1], [1, 1]])
    assert len(make(spark, tmp_path, enable_wal=True)) == 1


def test_auto_checkpoint(spark, tmp_path):
    c = make(spark, tmp_path, enable_wal=True, auto_checkpoint_threshold=10)
    c.insert_many(list(range(12)), [[i, i] for i in range(12)])
    c.insert(50, [1, 1])
    assert oplog.OpLog(spark, f"{tmp_path}/oplog").count() == 1 and len(c) == 13


def test_unlogged_writes_end_with_the_collection(spark, tmp_path):
    c = make(spark, tmp_path)
    c.insert(1, [0, 0])
    c.save()
    c.insert(2, [0, 0])
    assert len(c) == 2
    assert len(make(spark, tmp_path)) == 1


def test_line_log(spark, tmp_path):
    lines = [{"op": "insert", "id": 1, "vector": [0.1, 0.2], "metadata": {"tag": "a"}}, {"op": "insert", "id": 2, "vector": [0.3, 0.4], "metadata": {}}, {"op": "delete", "id": 1}]
    path = tmp_path / "log.jsonl"
    path.write_text("".join(json.dumps(x) + "\n" for x in lines) + "\n{torn\n" + json.dumps(lines[0]) + "\n")
    ops = oplog.read_jsonl(spark, str(path)).orderBy("seq").collect()
    assert [(r.seq, r.op, r.vec_id) for r in ops] == [(0, "insert", 1), (1, "insert", 2), (2, "delete", 1)]
    assert json.loads(ops[0].metadata) == {"tag": "a"} and ops[0].embedding == pytest.approx([0.1, 0.2])
    assert [r.vec_id for r in oplog.read_jsonl(spark, str(path), 1).orderBy("seq").collect()] == [2, 1]
    assert [r.vec_id for r in oplog.latest(oplog.read_jsonl(spark, str(path))).collect()] == [2]


def test_snapshot_versions_and_archive(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0], "{}")], snapshot.ROWS)
    with pytest.raises(FileNotFoundError):
        snapshot.load(spark, str(tmp_path / "none"))
    for offset in (0, 7):
        snapshot.save(rows, str(tmp_path / "s"), CollectionConfig(2), offset)
    config, back, offset = snapshot.load(spark, str(tmp_path / "s"))
    assert (config.dim, back.count(), offset) == (2, 1, 7)
    assert [n for n in files.listing(spark, str(tmp_path / "s")) if n.startswith("v")] == ["v00000002"]
    np.savez(tmp_path / "v.npz", ids=np.array([3, 4]), vectors=np.ones((2, 2), np.float32))
    (tmp_path / "m.json").write_text('{"3": {"k": 1}}')
    got = {r.vec_id: r.metadata for r in snapshot.read_npz(spark, str(tmp_path / "v.npz"), str(tmp_path / "m.json")).collect()}
    assert json.loads(got[3]) == {"k": 1} and json.loads(got[4]) == {}


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    from sparkvec.streaming import ingest

    log = oplog.OpLog(spark, str(tmp_path / "log"))
    ops = lambda rows: spark.createDataFrame(rows, "op string, vec_id long, embedding array<float>, metadata string")
    log.append(ops([("insert", 1, [1.0], "{}"), ("insert", 2, [2.0], "{}")]), 2)
    log.append(ops([("delete", 1, None, None)]), 1)
    run = lambda: ingest.ingest(spark, log.path, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert [r.vec_id for r in ingest.state(spark, str(tmp_path / "state")).collect()] == [2]
    log.append(ops([("insert", 1, [3.0], "{}")]), 1)
    run()
    rows = {r.vec_id: r.embedding for r in ingest.state(spark, str(tmp_path / "state")).collect()}
    assert rows == {1: [3.0], 2: [2.0]}
    ingest.merge(ops([]).selectExpr("0L as seq", "*"), 0, str(tmp_path / "state"))
    assert len(ingest.state(spark, str(tmp_path / "state")).collect()) == 2
