"""Text columns of the retrieval layer: chunks, previews, context and prompts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunks(docs: DataFrame, size: int = 500, overlap: int = 100, text: str = "text") -> DataFrame:
    """docs with (chunk_idx, chunk): pieces of ``size`` characters that start every size - overlap.

    Null and empty texts have no chunks; the last chunk may be a tail that the one before contains.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap
    # Cut once into steps; a chunk is some steps in a row, so the work grows with the text and not with its square.
    steps = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    some = -(-size // step)
    pieces = F.transform(F.col("__steps"), lambda _, i: F.substring(F.array_join(F.slice("__steps", i + 1, F.lit(some)), ""), 1, size))
    out = docs.where(F.length(text) > 0).select("*", steps.alias("__steps"))
    return out.select(*docs.columns, F.posexplode(pieces).alias("chunk_idx", "chunk"))


def preview(text: Column, length: int = 100) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def context(rank: Column, text: Column) -> Column:
    """Aggregate: numbered blocks in rank order, a line each."""
    blocks = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), text.alias("text"))))
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("["), b["rank"].cast("string"), F.lit("] "), b["text"])), "\n")


def prompt(question: Column, passages: Column) -> Column:
    return F.concat(F.lit("Answer from the context.\n\nContext:\n"), passages, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def hash_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector drawn from a generator that the text's whole MD5 seeds: deterministic, without meaning."""
    return hash_vectors([text], dim)[0]


def hash_vectors(texts: list[str], dim: int) -> np.ndarray:
    """A vector a text.  All 128 bits of the MD5 count: with 31 of them, texts begin to share vectors at some ten thousand.

    Numbers of 16 bits are read from the SHA-256 of seed and block number, so that SQL can do the same
    and every host gets the same bits.
    """
    blocks = [f":{i}".encode() for i in range(-(-dim // 16))]
    seeds = (hashlib.md5(t.encode()).hexdigest().encode() for t in texts)
    drawn = b"".join(hashlib.sha256(seed + block).digest() for seed in seeds for block in blocks)
    v = np.frombuffer(drawn, ">u2").reshape(len(texts), 16 * len(blocks))[:, :dim] - 32767.5  # never zero; sums of its squares are exact
    return (v / np.sqrt((v * v).sum(axis=1))[:, None]).astype(np.float32)


def hash_embedder(dim: int) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_vectors([t or "" for t in texts], dim)), index=texts.index)

    return embed


class Registry:
    """Named factories of embedders or language models."""

    def __init__(self, kind: str):
        self.kind, self._made = kind, {}

    def register(self, name: str, factory: Callable) -> None:
        self._made[name] = factory

    def get(self, name: str, *args, **kwargs):
        if name not in self._made:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self._made)) or 'none'}")
        return self._made[name](*args, **kwargs)


def template_answer(question: Column, passages: Column) -> Column:
    """A stand-in for a language model: answers by keyword, offline."""
    asks = lambda *words: F.lower(question).rlike("|".join(words))
    lead = F.when(asks("how"), "Steps from the context: ").when(asks("why"), "Reasons from the context: ").when(asks("what", "which"), "From the context: ").otherwise("In short: ")
    return F.when(F.length(passages) == 0, "Nothing in the collection answers this.").otherwise(F.concat(lead, preview(passages, 300)))


embedders = Registry("embedder")
embedders.register("hash", hash_embedder)
models = Registry("language model")
models.register("template", lambda: template_answer)
