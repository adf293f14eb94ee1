"""A pipeline that turns raw documents into token ids, a stage for each decision.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet to the shared folder and reads it again as the next stage's documents, and
then drops what the stage before has written.

Documents need doc_id and text; all columns of any names go on to the next stage, and
the last stage returns digests.  A null text is an empty one, for every stage.  Rows
with a null id are documents like others.  Texts are read whole however long.  Of rows
equal in id and text near-dedup keeps one; other ties go to the least id.  A table
without documents gives none.  Without labels no document is rejected for its
quality; without benchmark items none is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm import bpe, decontaminate, neardup, quality, secrets
from sparkvec.llm._util import drop_table, table, written
from sparkvec.llm.queries import VOCABULARY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; n_chars, where there is one, follows the text."""
    masked = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    return bpe.round_trip(docs, bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup by shingles", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE", tokenize),
]

#: A trained classifier and XXH64 fingerprints are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            drop_table(before)
        before = docs
    return docs
