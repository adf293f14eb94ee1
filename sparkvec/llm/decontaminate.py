"""Operator 5: benchmark decontamination by Wu-Manber search over words.

The patterns are windows of consecutive benchmark words.  A shift table over
blocks of two words tells how far a scan may jump from a window end; only where
it says zero does a bucket of patterns with that last block get looked up, and
only there are words compared directly.  Words that a scan jumps over are never
hashed.  All documents of a batch are scanned in lanes that step together.

The benchmark is compiled in blocks of bounded size, one pass over the documents
for each; an ordinary benchmark is a single block.  A block is one byte buffer with
arrays of offsets and hashes, about 15 bytes for each of its text, made by whole-array steps.
The documents are never shuffled for one block.

Null texts have no words; items without words have no windows; a null item id
reads as an empty string.  An empty benchmark leaves all documents clean, and a
table without documents gives no rows.  Texts are searched whole however long.
Repeated items count once for each distinct id; repeated documents stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.llm._util import STEP_BYTES, written
from sparkvec.llm._words import ALNUM, U, Words, mix, sequence_hashes, steps, text_buffer, words

WINDOW = 10
#: Bytes of benchmark text that are compiled, broadcast and searched at once.
BLOCK_BYTES = 16 << 20
#: Window ends of one lane of the scan.
LANE = 256
SPANS = "array<struct<start:int,end:int>>"


@dataclass
class Patterns:
    """All patterns of one length, compiled.  A pattern is a run of words of the benchmark's buffer."""

    length: int
    block: int
    shift: np.ndarray  # by the low bits of a block's hash
    suffix: np.ndarray  # sorted hashes of the patterns' last blocks
    whole: np.ndarray  # hash of the whole pattern; sorted within equal suffix
    first: np.ndarray  # its first word
    edge: np.ndarray  # where its items begin in ``item``
    item: np.ndarray
    text: Words
    names: np.ndarray  # item ids in order; ``item`` counts in it


def _same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray, n: int) -> np.ndarray:
    """Whether n words of a from each of i on are those of b from each of j on, byte by byte."""
    run = np.arange(n)
    i, j = (i[:, None] + run).ravel(), (j[:, None] + run).ravel()
    size = a.ends[i] - a.starts[i]
    good = size == b.ends[j] - b.starts[j]
    live = np.flatnonzero(good & (size > 0))
    if len(live):
        size = size[live]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        equal = a.data[np.repeat(a.starts[i[live]], size) + inner] == b.data[np.repeat(b.starts[j[live]], size) + inner]
        good[live] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return good.reshape(-1, n).all(axis=1)


def compile_patterns(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """Compiled windows of (item id, text) pairs, by length."""
    return compile_table(pa.table({"item_id": pa.array([str(i) for i, _ in items], pa.string()), "text": pa.array([t for _, t in items], pa.string())}), window)


def compile_table(items: pa.Table, window: int = WINDOW) -> list[Patterns]:
    """As :func:`compile_patterns`, of a table (item_id, text)."""
    names, of_name = np.unique(np.array(items.column("item_id").to_pylist(), dtype=object), return_inverse=True) if len(items) else (np.zeros(0, object), np.zeros(0, np.int64))
    w = words(*text_buffer(items.column("text")), ALNUM, lower=True)
    w = Words(w.data, w.starts.astype(np.int32), w.ends.astype(np.int32), w.first) if len(w.data) < 1 << 31 else w
    h, n = w.hashes(), np.diff(w.first)
    w._padded = None  # not shipped
    out = []
    for length in np.unique(np.minimum(n, window)).tolist():
        if not length:
            continue
        which = np.flatnonzero((n >= window) if length == window else (n == length))
        count = n[which] - length + 1
        first = np.repeat(w.first[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = np.repeat(of_name[which], count).astype(np.int32)
        block = min(2, length)
        whole = sequence_hashes(h, length)[first]
        pairs = sequence_hashes(h, block)
        suffix = pairs[first + length - block]
        # Windows of equal hashes are one pattern if their words are; others of that hash follow it.
        order = np.lexsort((first, whole, suffix))
        first, item, whole, suffix = first[order], item[order], whole[order], suffix[order]
        pattern, todo, made = np.zeros(len(first), np.int64), np.arange(len(first)), 0
        while len(todo):
            new = np.concatenate([[True], (whole[todo][1:] != whole[todo][:-1]) | (suffix[todo][1:] != suffix[todo][:-1])])
            head = todo[np.flatnonzero(new)][np.cumsum(new) - 1]
            same = np.ones(len(todo), bool)
            for at in range(0, len(todo), 1 << 16):
                part = slice(at, at + (1 << 16))
                same[part] = (head[part] == todo[part]) | _same_words(w, first[todo[part]], w, first[head[part]], length)
            pattern[todo[same]] = made + (np.cumsum(new) - 1)[same]
            made, todo = made + int(new.sum()), todo[~same]
        each = np.divmod(np.unique(pattern * len(names) + item), len(names))
        lead = np.unique(pattern, return_index=True)[1]
        order = np.lexsort((whole[lead], suffix[lead]))
        begin = np.searchsorted(each[0], np.arange(made + 1))
        size = np.diff(begin)[order]
        listed = each[1][np.repeat(begin[:-1][order], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        # The shift of a block is the least distance from a pattern's end at which it stands.
        distinct = np.unique(pairs) if length == window else np.unique(pairs[(first[lead][:, None] + np.arange(length - block + 1)).ravel()])
        bits = max(12, math.ceil(math.log2(4 * max(1, len(distinct)))))
        shift = np.full(1 << bits, length - block + 1, np.int8 if length < 128 else np.int32)
        for back in range(length - block, -1, -1):
            shift[(pairs[first[lead] + length - block - back] & U((1 << bits) - 1)).astype(np.int64)] = back
        out.append(Patterns(length, block, shift, suffix[lead][order], whole[lead][order], first[lead][order], np.concatenate([[0], np.cumsum(size)]), listed.astype(np.int32), w, names))
    return out


def _candidates(w: Words, p: Patterns) -> np.ndarray:
    """Word indices at which a window may end: where the shift table says zero."""
    n = np.diff(w.first)
    ends = np.maximum(n - p.length + 1, 0)
    lanes = -(-ends // LANE)
    if not lanes.sum():
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(n)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = w.first[text] + p.length - 1 + LANE * nth
    stop = np.minimum(at + LANE, w.first[text + 1])
    mask, found = U(len(p.shift) - 1), []
    while len(at):
        h = _block_at(w, at, p.block)
        jump = p.shift[(h & mask).astype(np.int64)]
        zero = jump == 0
        if zero.any():
            found.append(at[zero])
        at = at + np.maximum(jump, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _block_at(w: Words, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each index; the same as sequence_hashes gives."""
    out = np.full(len(at), U(0xD6E8FEB86659FD93))
    for back in range(size - 1, -1, -1):
        out = mix(out * U(0x9FB21C651E98DF25) ^ w.hashes(at - back))
    return out


def search(w: Words, compiled: list[Patterns]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word and word after the last of each occurrence of a pattern; then its (occurrence, item) pairs."""
    starts, ends, of, items, made = [], [], [], [], 0
    for p in compiled:
        at = _candidates(w, p)
        if not len(at):
            continue
        suffix = _block_at(w, at, p.block)
        lo = np.searchsorted(p.suffix, suffix, "left")
        hi = np.searchsorted(p.suffix, suffix, "right")
        at, lo, hi = (x[lo < hi] for x in (at, lo, hi))
        whole = _block_at(w, at, p.length)
        # Within its bucket each goes to the patterns of its hash, by halving.
        stop = hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = open_ & (p.whole[np.minimum(mid, len(p.whole) - 1)] < whole)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        while len(at):
            live = lo < stop
            live[live] = p.whole[lo[live]] == whole[live]
            at, lo, stop, whole = at[live], lo[live], stop[live], whole[live]
            same = np.concatenate([_same_words(w, at[i : i + 65536] - p.length + 1, p.text, p.first[lo[i : i + 65536]], p.length) for i in range(0, len(at), 65536)]) if len(at) else np.zeros(0, bool)
            size = p.edge[lo[same] + 1] - p.edge[lo[same]]
            items.append(p.item[np.repeat(p.edge[lo[same]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)])
            of.append(made + np.repeat(np.arange(len(size)), size))
            starts.append(at[same] - p.length + 1)
            ends.append(at[same] + 1)
            made += len(size)
            at, lo, stop, whole = at[~same], lo[~same] + 1, stop[~same], whole[~same]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]).astype(np.int64) for x in (starts, ends, of, items))


def _scan(docs: DataFrame, compiled, keep: list[str]) -> DataFrame:
    """keep columns, n_words, spans and items of every row; compiled: a broadcast of patterns."""
    kept = docs.select(*keep).schema
    slim = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                w = words(*text_buffer(part.column("__text")), ALNUM, lower=True)
                starts, ends, which, items = search(w, compiled.value)
                edge = np.zeros(len(w.starts) + 1, np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, ends, -1)
                inside = np.cumsum(edge[:-1]) > 0
                of = np.searchsorted(w.first, starts, side="right") - 1
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for d in np.unique(of).tolist():
                    a, b = w.first[d], w.first[d + 1]
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], inside[a:b], [False]]).astype(np.int8)))
                    spans[d] = [{"start": s, "end": e} for s, e in flips.reshape(-1, 2).tolist()]
                names = compiled.value[0].names if len(compiled.value) else np.zeros(0, object)
                own = np.unique(np.stack([of[which], items]), axis=1)
                bounds = np.searchsorted(own[0], np.arange(part.num_rows + 1)).astype(np.int32)
                made = [
                    pa.array(np.diff(w.first)),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(names[own[1]].tolist(), pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, "n_words", "spans", "items"])

    made_schema = T._parse_datatype_string(f"n_words long, spans {SPANS}, items array<string>")
    return slim.mapInArrow(run, T.StructType([*kept.fields, *made_schema.fields]))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of docs (..., text): n_words, spans of hit words and sorted ids of items found.

    items: (item_id, text).  spans: disjoint [start, end) ranges of word indices.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    keep, parts = list(keep), []
    if blocks > 1:
        docs = docs.select(*keep, "text", F.xxhash64(F.col("text").cast("string")).alias("__text_hash"))
    for block in range(blocks):
        rows = items.where(F.col("block") == block).select("item_id", "text").toArrow()  # at most block_bytes or so
        compiled = spark.sparkContext.broadcast(compile_table(rows, window))
        out = _scan(docs, compiled, keep + ["__text_hash"] * (blocks > 1))
        if blocks == 1:
            return out
        parts.append(written(out))
    return _merged(parts, keep)


def _merged(parts: list[DataFrame], keep: list[str]) -> DataFrame:
    """The results of several blocks as one; a row that occurs n times stays n times."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.groupBy(*keep, "__text_hash", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
    )
    joined = F.expr(
        f"""aggregate(all, cast(array() as {SPANS}), (acc, s) ->
            if(size(acc) > 0 and s.start <= element_at(acc, -1).end,
               concat(slice(acc, 1, size(acc) - 1),
                      array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))),
               concat(acc, array(s))))"""
    )
    out = out.withColumn("spans", joined).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*keep, "n_words", "spans", "items")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of op5 from the rows of :func:`contamination`."""
    n_hit = F.expr("aggregate(spans, 0L, (acc, s) -> acc + s.end - s.start)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any window of an item, all columns kept."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    found = contamination(rows, items, window, keep=("__row",))
    return found.where(F.size("spans") == 0).select("__row.*")
