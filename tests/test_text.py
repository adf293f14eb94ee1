import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec import rag
from sparkvec.functions import text as texts


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "abc")], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_idx, r.chunk) for r in texts.chunks(docs, 4, 1).orderBy("doc_id", "chunk_idx").collect()]
    assert got == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (1, 3, "j"), (4, 0, "abc")]
    with pytest.raises(ValueError):
        texts.chunks(docs, 4, 4)


def test_preview_and_registry(spark):
    row = spark.range(1).select(texts.preview(F.lit("x" * 101)).alias("a"), texts.preview(F.lit("x")).alias("b")).first()
    assert row.a == "x" * 100 + "..." and row.b == "x"
    with pytest.raises(ValueError):
        texts.embedders.get("none")


def test_hash_vectors(spark):
    v = texts.hash_vector("hello", 16)
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6) and (v == texts.hash_vector("hello", 16)).all()
    embed = texts.embedders.get("hash", 16)
    assert spark.range(1).select(embed(F.lit("hello"))).first()[0] == pytest.approx(v.tolist())


def test_texts_do_not_share_vectors(spark):
    # The MD5 of these two agree in their last 31 bits.
    a, b = "text 8456", "text 34903"
    assert not np.array_equal(texts.hash_vector(a, 64), texts.hash_vector(b, 64))
    store = rag.ingest(spark.createDataFrame([(1, a, "x"), (2, b, "x")], "doc_id long, text string, category string"))
    asked = spark.createDataFrame([(1, a), (2, b)], "qid long, question string")
    assert {(r.qid, r.doc_id) for r in rag.retrieve(store, asked, 3, least=0.9).collect()} == {(1, 1), (2, 2)}
    v = texts.hash_vectors([f"text {i}" for i in range(4000)], 40)
    assert v.shape == (4000, 40) and np.linalg.norm(v, axis=1) == pytest.approx(1, abs=1e-6)
    assert abs(v.mean()) < 0.01 and np.abs(v.T @ v / 4000 * 40 - np.eye(40)).max() < 0.1


def test_question_answering(spark):
    docs = spark.createDataFrame([(1, "a" * 350, "x"), (2, "short text", "y"), (3, None, "y")], "doc_id long, text string, category string")
    store = rag.ingest(docs, dim=16).cache()
    assert store.where("doc_id = 1").count() == 2
    asked = spark.createDataFrame([(1, "short text")], "qid long, question string")
    best = rag.retrieve(store, asked, 1, dim=16).first()
    assert best.doc_id == 2 and best.similarity == pytest.approx(1, abs=1e-6)
    assert {r.category for r in rag.retrieve(store, asked, 3, dim=16, category="x").collect()} == {"x"}
    row = rag.answer(store, asked, top_k=1, dim=16).first()
    assert row.context == "[1] short text" and row.context in row.prompt and row.answer
    none = rag.answer(store, asked, dim=16, category="zzz").first()
    assert none.context == "" and none.answer.startswith("Nothing")


def test_chunks_are_embedded_once_for_all_questions(spark):
    docs = spark.createDataFrame([(i, f"document {i}", "x") for i in range(1100)], "doc_id long, text string, category string")
    store = rag.ingest(docs, dim=16)
    found = rag.retrieve(store, docs.selectExpr("doc_id as qid", "text as question"), 1, dim=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.split("== Initial Plan ==")[-1].count("MapInArrow") == 1
    assert found.where("qid = doc_id").count() == 1100


def test_contexts_hold_three_passages(spark, tmp_path):
    from sparkvec import queries

    docs = spark.createDataFrame([(i, f"text {i % 30}" + "x" * (i % 3 * 200), "en" if i % 4 else "de", "web") for i in range(1, 81)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 20 == 0, "en").otherwise(F.col("lang")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.qid: r.context for r in queries.rag_context(spark, str(tmp_path)).collect()}
    pieces = [r.chunk for r in texts.chunks(docs.where("lang = 'en'"), 300, 50).collect()]
    vectors = texts.hash_vectors(pieces, 64).astype(float)
    assert set(got) == {20, 40, 60, 80}
    for r in docs.where("doc_id % 20 = 0").collect():
        alike = vectors @ texts.hash_vector(r.text[:300], 64).astype(float)
        best = sorted(range(len(pieces)), key=lambda i: (-round(alike[i], 9), pieces[i]))[:3]
        assert got[r.doc_id] == "\n".join(f"[{n}] {pieces[i]}" for n, i in enumerate(best, 1))
