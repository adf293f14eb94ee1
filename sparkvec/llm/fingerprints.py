"""Operator 2: SimHash document fingerprints and a Hamming search by permuted block tables.

Terms are pairs of neighbouring words (the word itself in a text of one word),
A-Z lower-cased.  A term's weight is 16 (1 + ln tf), rounded; its 128-bit hash
votes with that weight for or against each bit.  Votes are integers, so equal
texts have equal fingerprints wherever they stand.  No words: fingerprint zero.

The search cuts fingerprints into blocks.  If at most r of b blocks can hold a
differing bit, some b - r blocks are equal; there is one table for each choice of
b - r blocks, keyed by their bits (the permuted leading bits of Manku et al.).
Only buckets with a query and another fingerprint are looked into.  Buckets with many
fingerprints are tiled: their rows and their queries are split, and a task compares
one part of each.  A result is every near fingerprint, or the documents that have one.

The edited text pairs each document with the next one.  A range shuffle puts
neighbours into one partition; the pairs across partition ends are a second,
small step over one document a partition.

Nulls: a null text is empty; rows with a null id come last in the order.  Rows of
one id are ordered by the hash of their text; rows equal in both are alike.  Texts are
read whole however long.  A table without rows gives none, and a single document is
its own next one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.llm._util import release, written
from sparkvec.llm._words import SPACED, U, mix, no_straddle, steps, text_buffer, window_hashes, words

BITS = 128
RADIUS, BLOCKS = 3, 5
#: Terms whose votes are counted at once, and bytes of text of one step.
VOTERS, STEP = 1 << 14, 1 << 19
#: Fingerprints of a bucket, and queries of it, that one task compares about.
BUCKET_ROWS, BUCKET_QUERIES = 1 << 16, 1 << 12


def simhash(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, 2) array: the 128 bits of each text's fingerprint as two unsigned words."""
    n = len(bounds) - 1
    w = words(data, bounds, SPACED, lower=True)
    h, of, count = w.hashes(), w.text_of(), np.diff(w.first)
    pair = np.flatnonzero(no_straddle(w.first, len(h), 2))
    single = w.first[:-1][count == 1]
    terms = np.concatenate([window_hashes(h, 2)[pair], h[single]])
    text = np.concatenate([of[pair], of[single]])
    votes = np.zeros((n, BITS), np.int64)
    if len(terms):
        order = np.lexsort((terms, text))
        terms, text = terms[order], text[order]
        new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])]))
        tf = np.diff(np.append(new, len(terms)))
        terms, text = terms[new], text[new]
        weight = np.rint(16 * (1 + np.log(tf))).astype(np.int32)
        for at in range(0, len(terms), VOTERS):
            t, d, v = terms[at : at + VOTERS], text[at : at + VOTERS], weight[at : at + VOTERS]
            hashes = np.column_stack([mix(t ^ U(0x243F6A8885A308D3)), mix(t ^ U(0x13198A2E03707344))])
            bits = np.unpackbits(hashes.view(np.uint8), axis=1).astype(np.int32)
            signed = (2 * bits - 1) * v[:, None]
            run = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            votes[d[run]] += np.add.reduceat(signed, run, axis=0)
    return np.packbits(votes > 0, axis=1).view(U).reshape(n, 2)


def _of_texts(texts: list[str]) -> np.ndarray:
    out = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= STEP):
            size += len(texts[to])
            to += 1
        out.append(simhash(*text_buffer(pa.array(texts[at:to], pa.large_string()))))
        at = to
    return np.concatenate(out) if out else np.zeros((0, 2), U)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "n_chars long, edited_sha256 string, hi long, lo long, edited_hi long, edited_lo long, next_hi long, next_lo long"


def _rows(ids: pa.Array, texts: list[str], follow: list[str], fps: np.ndarray, next_fps: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, follow, strict=True)]
    e = _of_texts(changed)
    signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())
    return [
        ids,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        *(signed(x[:, i]) for x in (fps, e, next_fps) for i in (0, 1)),
    ]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "hi", "lo", "edited_hi", "edited_lo", "next_hi", "next_lo"]


def _pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next text, in descending order of doc_id."""
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("__text")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        """Result rows, and the partition's first and last texts, whose neighbours are elsewhere."""
        part_id, last = TaskContext.get().partitionId(), None
        none = lambda n: pa.nulls(n, pa.string())
        for batch in batches:
            for part in steps(batch, "__text", STEP):
                ids, texts = part.column("doc_id"), part.column("__text").to_pylist()
                fps = _of_texts(texts)
                if last is None:
                    empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), *[pa.int64()] * 4)]
                    head = [pa.array(np.ascontiguousarray(fps[:1, i]).view(np.int64)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), *empty, *head, pa.array([part_id]), pa.array([texts[0]], pa.string()), none(1)], names=[*_NAMES, "part", "head", "tail"])
                else:
                    ids, texts, fps = pa.concat_arrays([last[0], ids]), [last[1], *texts], np.concatenate([last[2], fps])
                n = len(texts) - 1
                if n:
                    yield pa.RecordBatch.from_arrays([*_rows(ids[:n], texts[:n], texts[1:], fps[:n], fps[1:]), pa.nulls(n, pa.int64()), none(n), none(n)], names=[*_NAMES, "part", "head", "tail"])
                last = ids[n:], texts[n], fps[n:]
        if last is not None:
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), *[pa.int64()] * 6)]
            yield pa.RecordBatch.from_arrays([last[0], *blank, pa.array([part_id], pa.int64()), none(1), pa.array([last[1]], pa.string())], names=[*_NAMES, "part", "head", "tail"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    made = written(ranged.mapInArrow(run, f"doc_id {id_type}, {_RESULT}, part long, head string, tail string"))
    release(docs.sparkSession)
    heads = made.where("head is not null").select("part", "head", "next_hi", "next_lo")
    parts = heads.select("part")  # one row a partition
    by_part = W.orderBy("part")
    # The partition after each one that has rows; after the last, the first.
    following = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("then"))
    ends = (
        made.where("tail is not null").select("doc_id", "part", "tail").join(following, "part")
        .join(heads.withColumnRenamed("part", "then"), "then").select("doc_id", "tail", "head", "next_hi", "next_lo")
    )

    def finish(batches):
        for batch in batches:
            for part in steps(batch, "tail", STEP):
                texts, follow = part.column("tail").to_pylist(), part.column("head").to_pylist()
                after = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).view(U) for c in ("next_hi", "next_lo")])
                yield pa.RecordBatch.from_arrays(_rows(part.column("doc_id"), texts, follow, _of_texts(texts), after), names=_NAMES)

    inner = made.where("part is null").select(*_NAMES)
    return inner.union(ends.mapInArrow(finish, f"doc_id {id_type}, {_RESULT}"))


def _block_keys(blocks: int, radius: int) -> list:
    """For each choice of blocks - radius blocks, the key column over the words hi and lo."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def bits(a: int, b: int):
        parts = []
        for word, at in (("hi", 0), ("lo", 64)):
            x, y = max(a, at) - at, min(b, at + 64) - at
            if x < y:
                parts.append(F.shiftrightunsigned(F.shiftleft(F.col(word), x), 64 - (y - x)))
        return parts

    chosen = itertools.combinations(range(blocks), blocks - radius)
    return [F.xxhash64(F.lit(i), *[p for block in c for p in bits(edges[block], edges[block + 1])]) for i, c in enumerate(chosen)]


def near_counts(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS, bucket_queries: int = BUCKET_QUERIES) -> DataFrame:
    """For each query fingerprint (hi, lo): ``n_near``, the documents within ``radius`` bits, all of them, its own too.

    fps: distinct (hi, lo) with the number n of documents that have it and whether it is a query.
    """
    found = _search(fps, radius, blocks, bucket_rows, bucket_queries, False).groupBy("hi", "lo").agg(F.sum("found").alias("found"))
    alone = fps.where("query").select("hi", "lo", "n").join(found, ["hi", "lo"], "left")
    return alone.select("hi", "lo", (F.coalesce("found", F.lit(0)) + F.col("n")).alias("n_near"))


def near_pairs(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS, bucket_queries: int = BUCKET_QUERIES) -> DataFrame:
    """(hi, lo, near_hi, near_lo, distance): each query fingerprint with every other one within ``radius`` bits.

    fps as for :func:`near_counts`; documents follow by a join with those that have a fingerprint.
    """
    return _search(fps, radius, blocks, bucket_rows, bucket_queries, True)


def _search(fps: DataFrame, radius: int, blocks: int, bucket_rows: int, bucket_queries: int, pairs: bool) -> DataFrame:
    """Near fingerprints, or their numbers of documents.  A pair that several tables hold counts in the first of them."""
    tables = _block_keys(blocks, radius)
    keyed = fps.select("hi", "lo", "n", "query", F.posexplode(F.array(*tables)).alias("nth", "key"))
    sizes = keyed.groupBy("nth", "key").agg(F.count(F.lit(1)).alias("size"), F.count_if("query").alias("asked"))
    live = sizes.where("asked > 0 and size > 1").select(
        "nth", "key", F.expr(f"cast(size div {bucket_rows} as int) + 1").alias("parts"), F.expr(f"cast(asked div {bucket_queries} as int) + 1").alias("askers")
    )
    rows = keyed.join(live, ["nth", "key"])
    mine = F.pmod(F.xxhash64("hi", "lo", F.lit(7)), F.col("parts")).cast("int")
    own = F.pmod(F.xxhash64("hi", "lo", F.lit(8)), F.col("askers")).cast("int")
    # A tile is a part of the rows and one of the queries: each row goes to the tiles of its part.
    kind = "array<struct<part:int,asker:int,asks:boolean>>"
    asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), own.alias("asker"), F.lit(True).alias("asks")))
    asked = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda p: F.struct(mine.alias("part"), p.alias("asker"), F.lit(False).alias("asks")))
    rows = rows.select("nth", "key", "hi", "lo", "n", F.explode(F.concat(F.when(F.col("query"), asking).otherwise(F.array().cast(kind)), asked)).alias("side"))
    rows = rows.select("nth", "key", "side.*", "hi", "lo", "n")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        m = ((1 << (b - a)) - 1) << (BITS - b)
        masks.append((m >> 64, m & ((1 << 64) - 1)))
    chosen = list(itertools.combinations(range(blocks), blocks - radius))

    def run(key, group):
        nth = key[0].as_py()
        hi, lo = (group.column(c).combine_chunks().to_numpy().view(U) for c in ("hi", "lo"))
        n, asks = group.column("n").combine_chunks().to_numpy(), group.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        q, f = np.flatnonzero(asks), np.flatnonzero(~asks)
        found, met = np.zeros(len(q), np.int64), [(np.zeros(0, np.int64),) * 2]
        for at in range(0, len(q), max(1, (1 << 20) // max(1, len(f)))):
            to = min(len(q), at + max(1, (1 << 20) // max(1, len(f))))
            x, y = hi[q[at:to], None] ^ hi[f], lo[q[at:to], None] ^ lo[f]
            near = (np.bitwise_count(x).astype(np.int16) + np.bitwise_count(y) <= radius) & ((x | y) != 0)
            same = np.stack([((x & U(a)) == 0) & ((y & U(b)) == 0) for a, b in masks])
            for c in chosen[:nth]:
                near &= ~same[list(c)].all(axis=0)
            near &= same[list(chosen[nth])].all(axis=0)
            if pairs:
                a, b = np.nonzero(near)
                met.append((q[at + a], f[b]))
            else:
                found[at:to] = (near * n[f]).sum(axis=1)
        if not pairs:
            return pa.table({"hi": hi[q].view(np.int64), "lo": lo[q].view(np.int64), "found": found})
        a, b = (np.concatenate(x) for x in zip(*met, strict=True))
        far = np.bitwise_count(hi[a] ^ hi[b]).astype(np.int32) + np.bitwise_count(lo[a] ^ lo[b])
        return pa.table({"hi": hi[a].view(np.int64), "lo": lo[a].view(np.int64), "near_hi": hi[b].view(np.int64), "near_lo": lo[b].view(np.int64), "distance": far.astype(np.int32)})

    made = "hi long, lo long, near_hi long, near_lo long, distance int" if pairs else "hi long, lo long, found long"
    return rows.groupBy("nth", "key", "part", "asker").applyInArrow(run, made)


def likeness(a: tuple, b: tuple):
    """1 less the share of differing bits."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / F.lit(float(BITS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of op2, and n_near: for ids divisible by 20, the documents within the search radius."""
    pairs = written(_pairs(docs))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    fps = pairs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max(asked).alias("query"))
    near = near_counts(fps)
    hex_ = lambda p: F.concat(*[F.lpad(F.lower(F.hex(f"{p}{x}")), 16, "0") for x in ("hi", "lo")])
    own, other, after = ((F.col(f"{p}hi"), F.col(f"{p}lo")) for p in ("", "edited_", "next_"))
    # Only the queries meet their counts; all other rows stay where they are.
    counted = pairs.where(asked).join(near, ["hi", "lo"], "left").select(*pairs.columns, "n_near")
    rest = pairs.where(~asked).withColumn("n_near", F.lit(None).cast("long"))
    return counted.unionByName(rest).select(
        "doc_id", "n_chars", "edited_sha256", hex_("").alias("fingerprint"), hex_("edited_").alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"), "n_near",
    )
