import zlib
from collections import Counter, defaultdict

import pytest

from sparkvec.llm import sharding
from sparkvec.llm._util import shared_dir


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2000])
def test_rows_law_slots_and_contents(spark, docs, bucket_bytes, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", bucket_bytes)
    written = sharding.write_shards(docs, shared_dir(spark), 4, bucket_bytes=bucket_bytes)
    got = written.collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 4
    assert Counter(tuple(r.row) for r in got) == Counter(tuple(r) for r in docs.collect())
    again = sharding.write_shards(docs, shared_dir(spark), 4, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    other = sharding.write_shards(docs, shared_dir(spark), 4, seed=9, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(repr, other)) != sorted(map(repr, got))


def test_digest(spark, docs):
    rows = sharding.shards(docs).collect()
    expect = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expect
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_empty_and_clashing(spark, docs, clashing):
    assert sharding.shards(docs.limit(0)).count() == 0
    out = sharding.write_shards(clashing, shared_dir(spark), 2)
    assert out.select("row.*").columns == clashing.columns and out.count() == docs.count()


def test_every_place_is_reached(spark):
    """A permutation is random: over seeds a row stands in all shards."""
    rows = spark.range(64).selectExpr("id as doc_id", "'x' as text")
    seen = {sharding.write_shards(rows, shared_dir(spark), 4, seed=s).where("row.doc_id = 0").first().shard for s in range(12)}
    assert len(seen) >= 3


def test_copies_of_one_record_are_dealt_over_the_buckets(spark):
    """A third of all rows are one record, others share an id or have none: no bucket gets more than its share."""
    rows = [(1, "same text")] * 3000 + [(2, f"version {i}") for i in range(2000)] + [(None, None)] * 1500 + [(i, "x" * 9) for i in range(10, 2510)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held = sharding._scattered(df, 30, 1, 3000)
    sizes = [r["count"] for r in held.groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) == 30 and max(sizes) < 1.5 * len(rows) / 30
    assert Counter(tuple(r.row) for r in held.collect()) == Counter(rows)


@pytest.mark.parametrize("tasks", [1, 3])
def test_a_task_takes_several_buckets(spark, docs, tasks):
    one = sharding.write_shards(docs, shared_dir(spark), 4, bucket_bytes=2000)
    few = sharding.write_shards(docs, shared_dir(spark), 4, bucket_bytes=2000, tasks=tasks)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, few.collect()))
