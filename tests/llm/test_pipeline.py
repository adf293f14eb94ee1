"""The pipeline against brute force, and the registered queries with SQL against DuckDB."""

import glob
import hashlib
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from sparkvec.llm import bpe, quality
from sparkvec.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def views():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {Path(path).stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    result = views().sql(ORACLE_SQL[name])
    assert sorted(result.columns) == sorted(df.columns)
    got = sorted(tuple(r[c] for c in result.columns) for r in df.collect())
    assert got == sorted(result.fetchall())


def kept_of_classes(rows):
    """Rows (id, text) that are the least of their class: links at five-word shingles, similarity 0.8 or more."""
    from tests.llm.test_neardup import jaccard

    root = {d: d for d, _ in rows}
    find = lambda d: d if root[d] == d else find(root[d])
    for i, (d, a) in enumerate(rows):
        for e, b in rows[:i]:
            if a == b or (0.5 < (len(a) + 1) / (len(b) + 1) < 2 and jaccard(a, b) >= 0.8):
                root[max(find(d), find(e))] = min(find(d), find(e))
    return [(d, t) for d, t in rows if find(d) == d]


def test_stages_against_brute_force(spark):
    from tests.llm.test_decontaminate import brute as contaminated
    from tests.llm.test_secrets import base

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality.quality(docs, labels).where("predicted = 1").collect()}
    rows = kept_of_classes(sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good))
    rows = [r for r, (_, hit, _) in zip(rows, contaminated([t for _, t in rows], items)) if not hit]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {d for d, _ in rows}
    whole = bpe.encoding(bpe.read_ranks(corpus_pipeline.VOCABULARY), corpus_pipeline.public_tokenizers.PATTERN)
    for d, text in rows:
        if not base(text):
            ids = whole.encode_to_numpy(text).astype("<u4").tobytes()
            assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
            assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        else:
            assert got[d].decoded_sha256 != hashlib.sha256(text.encode()).hexdigest()


def test_edited_copies_do_not_reach_the_tokens(spark):
    """The near-dedup stage against all pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    stage = corpus_pipeline.drop_near_duplicates
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == {d for d, _ in kept_of_classes(rows)}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns_and_take_any_rows(spark, docs, clashing, stage):
    """Nulls, empty and long texts, repeated rows, clashing names, empty tables, and documents without n_chars."""
    name, f = stage
    out = f(spark, clashing, SF)
    assert out.columns == clashing.columns and out.count() <= docs.count()
    assert f(spark, docs.limit(0), SF).count() == 0
    bare = docs.select("doc_id", "text")
    assert f(spark, bare, SF).columns == ["doc_id", "text"]
    if name in ("benchmark decontamination", "secret scans"):
        assert out.count() == docs.count()  # nothing here is of the benchmark


def test_last_stage_takes_any_rows(spark, docs, clashing):
    got = corpus_pipeline.tokenize(spark, clashing, SF).collect()
    assert len(got) == docs.count() and {r.n_tokens == 0 for r in got} == {True, False}
    assert corpus_pipeline.tokenize(spark, docs.limit(0), SF).count() == 0
