import random

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkvec.llm import bpe
from sparkvec.llm.queries import VOCABULARY

RANKS = bpe.read_ranks(VOCABULARY)
WHOLE = bpe.encoding(RANKS, public_tokenizers.PATTERN)
SPLIT = regex.compile(public_tokenizers.PATTERN)
TEXT = st.text(alphabet=st.sampled_from(list("ab  \n\t'sré1!日　😀x")), max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(2, 50), st.integers(1, 60))
def test_stitched_pieces_encode_like_the_whole(text, chunk, overlap):
    pieces = bpe.stitched(text, SPLIT, chunk, overlap)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in WHOLE.encode_ordinary(p)] == WHOLE.encode_ordinary(text)


def test_a_text_without_boundaries():
    for text in ("a" * 5000, " " * 5000, "\n" * 2000 + "x", "é" * 3000 + " b"):
        pieces = bpe.stitched(text, SPLIT, 100, 10)
        assert [i for p in pieces for i in WHOLE.encode_ordinary(p)] == WHOLE.encode_ordinary(text)


def test_rows_round_trip(spark, docs, clashing):
    encoded = bpe.encode(clashing, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text"), chunk=64, overlap=8)
    back = bpe.decode(encoded, RANKS, keep=("doc_id", "text", "n_tokens")).collect()
    assert len(back) == docs.count()
    for r in back:
        assert bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(WHOLE.encode_ordinary(r.text or ""))
    assert bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_special_strings_are_plain_text(spark):
    row = bpe.encode(spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).first()
    assert row.n_tokens == len(WHOLE.encode_ordinary("<|endoftext|>")) > 1


def test_chunks_of_one_text_are_rows(spark):
    """Pieces of long texts against the whole, with texts whose overlaps have no common boundary."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab  \n\t'sré1!日　😀x") for _ in range(rng.randint(0, 900))) for _ in range(60)]
    texts += ["a" * 700, " " * 500, "1" * 800, "word " * 150 + "1" * 400 + " word" * 100, "", "é" * 300 + " b" * 200, "it's we'll 12345 " * 60]
    rows = [(i % 20, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk, overlap in ((64, 16), (100, 40), (33, 99)):
        got = bpe.encode(df, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text"), chunk=chunk, overlap=overlap).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
        for r in got:
            ids = WHOLE.encode_to_numpy(r.text).astype("<u4").tobytes() if r.text else b""
            assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4, (chunk, r.text)
    held = bpe._chunks(df.selectExpr("doc_id", "text as __text").where("length(text) > 64"), ("doc_id",), 64, 16)
    cuts = bpe._cuts(held, public_tokenizers.PATTERN, 64, 16)
    assert cuts.where("whole").count() > 10 and cuts.where("not whole").count() >= 3
    # A long text stands in more than one task.
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        placed = held.withColumn("task", F.spark_partition_id()).groupBy("row").agg(F.count_distinct("task").alias("n"))
        assert placed.agg(F.max("n")).first()[0] > 1
    finally:
        spark.conf.unset(name)
