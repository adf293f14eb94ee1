import hashlib
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from sparkvec.operators import ring as rings
from sparkvec.plans.cluster import ShardedClient


def keys(spark, names):
    return spark.createDataFrame([(k,) for k in names], "key string")


def owners(spark, nodes, names):
    return {r.key: r.o for r in keys(spark, names).select("key", rings.owner(rings.build(spark, nodes), F.col("key")).alias("o")).collect()}


def test_owner_by_bisection_and_balance(spark):
    nodes, names = ["node1", "node2", "node3"], [f"key_{i}" for i in range(1000)]
    ring = sorted((hashlib.md5(f"{n}:{i}".encode()).hexdigest(), n) for n in nodes for i in range(160))
    hashes = [h for h, _ in ring]
    got = owners(spark, nodes, names)
    assert got == {k: ring[bisect_right(hashes, hashlib.md5(k.encode()).hexdigest()) % len(ring)][1] for k in names}
    assert all(200 < list(got.values()).count(n) < 400 for n in nodes)


def test_topology_moves_few_keys(spark):
    names = [str(i) for i in range(100)]
    three, four = owners(spark, ["node1", "node2", "node3"], names), owners(spark, ["node1", "node2", "node3", "node4"], names)
    moved = [k for k in names if three[k] != four[k]]
    assert 10 < len(moved) < 50 and all(four[k] == "node4" for k in moved)
    two = owners(spark, ["node1", "node3"], names)
    assert all(two[k] == three[k] for k in names if three[k] != "node2")


def test_replicas_and_ranges(spark):
    ring = rings.build(spark, ["a", "b", "c", "d"])
    found = rings.replicas(ring, keys(spark, ["x", "y"]), 2).collect()
    assert len(found) == 4 and len({(r.key, r.node) for r in found}) == 4
    first = {r.key: r.node for r in found if r["rank"] == 1}
    assert first == owners(spark, ["a", "b", "c", "d"], ["x", "y"])
    assert rings.replicas(rings.build(spark, ["a", "b"]), keys(spark, ["x"]), 5).count() == 2
    none = rings.build(spark, [])
    assert rings.replicas(none, keys(spark, ["x"]), 1).count() == 0
    assert keys(spark, ["x"]).select(rings.owner(none, F.col("key"))).first()[0] is None
    assert 1 <= rings.range_nodes(ring, "k1", "k2").count() <= 4
    assert rings.remove(ring, "a").select("node").distinct().count() == 3
    assert rings.build(spark, ["a", "a"]).count() == 160


def test_sharded_client(spark):
    client = ShardedClient(spark, ["n1", "n2"])
    with pytest.raises(ValueError):
        client.search([0.0, 0.0])
    client.create_collection("c", 2)
    rows = [(i, [float(i), 0.0], '{"even":%s}' % ("true" if i % 2 == 0 else "false")) for i in range(20)]
    client.insert_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>, metadata string"))
    assert [r.vec_id for r in client.search([3.1, 0.0], 3).collect()] == [3, 4, 2]
    assert [r.vec_id for r in client.search([3.1, 0.0], 2, {"even": True}).collect()] == [4, 2]
    client.delete(3)
    stats = {r.shard: r.num_items for r in client.get_stats().collect()}
    assert stats[None] == 19 == stats["n1"] + stats["n2"]
    client.add_node("n3")
    client.remove_node("n1")
    assert {r.shard: r.num_items for r in client.get_stats().collect()}[None] == 19
    assert [r.collections for r in client.list_collections().collect()] == [["c"], ["c"]]
    assert len(client.replica_nodes(5)) == 1
    with pytest.raises(ValueError):
        client.insert(4, [0.0, 0.0])
