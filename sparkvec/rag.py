"""Retrieval over documents: chunk, embed, store, retrieve, and put a prompt together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.functions import text as texts
from sparkvec.functions.distance import similarity
from sparkvec.operators import flat


def ingest(docs: DataFrame, embedder: str = "hash", dim: int = 64, size: int = 300, overlap: int = 50) -> DataFrame:
    """Chunk rows (vec_id, doc_id, chunk_idx, chunk, preview, category, embedding) of docs (doc_id, text, category)."""
    embed = texts.embedders.get(embedder, dim)
    pieces = texts.chunks(docs.select("doc_id", "text", "category"), size, overlap)
    vec_id = F.xxhash64("doc_id", "chunk_idx")
    return pieces.select(vec_id.alias("vec_id"), "doc_id", "chunk_idx", "chunk", texts.preview(F.col("chunk")).alias("preview"), "category", embed(F.col("chunk")).alias("embedding"))


def retrieve(store: DataFrame, questions: DataFrame, top_k: int = 3, embedder: str = "hash", dim: int = 64, category: str | None = None, least: float | None = None) -> DataFrame:
    """(qid, rank, similarity, chunk, ...) of the chunks nearest to each question (qid, question)."""
    embed = texts.embedders.get(embedder, dim)
    if category is not None:
        store = store.where(F.col("category") == category)
    hits = flat.batch_search(store, questions.select("qid", embed(F.col("question")).alias("embedding")), top_k, "cosine")
    found = hits.join(store.drop("embedding"), "vec_id").withColumn("similarity", similarity(F.col("distance")))
    return found if least is None else found.where(F.col("similarity") > least)


def answer(store: DataFrame, questions: DataFrame, model: str = "template", **options) -> DataFrame:
    """(qid, question, context, prompt, answer) of each question; one without hits has an empty context."""
    found = retrieve(store, questions, **options)
    passages = found.groupBy("qid").agg(texts.context(F.col("rank"), F.col("chunk")).alias("context"))
    asked = questions.join(passages, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    reply = texts.models.get(model)
    return asked.withColumn("prompt", texts.prompt(F.col("question"), F.col("context"))).withColumn("answer", reply(F.col("question"), F.col("context")))
