"""Operator 8: byte-level BPE encoding by overlapping chunks, and decoding.

A long text is cut into chunks that overlap, a row each, dealt over all tasks.
Every chunk is pre-tokenised on its own, from wherever its cut happens to fall.
Pre-token boundaries depend only on the boundary before and on what follows, so
once the boundaries of two chunks meet they agree: the stitch takes the left
chunk's boundaries up to the first common one and the right chunk's from there on.
A chunk's boundaries near its ends are all that a stitch needs; they are joined by
document, and the pieces between the cuts are encoded each on its own and put together.

Where an overlap of a text has no common boundary (a run without words, as long as
an overlap), its chunks are stitched in one task: the left chunk's pre-tokens go on
into the right chunk until they meet.  A text of one chunk is a single piece.

Null texts count as empty and have no tokens; a table without rows gives none.  Other
columns than those kept are not read; repeated rows stay.  One text is one row of the
result, so a worker needs memory for the longest text and its ids.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.llm._util import STEP_BYTES, written
from sparkvec.llm._words import steps

#: Code points of a chunk, and by how many it reaches into its neighbours.
CHUNK = 1 << 16
OVERLAP = 1 << 8


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file, read by the driver: a base64 token and its rank a line.

    The file holds one vocabulary, so its size is that of the model, not of the data.
    """
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


def boundaries(text: str, pattern, at: int, to: int) -> list[int]:
    """Ends of the pre-tokens of text[at:to], in code points of the whole text."""
    return [at + m.end() for m in pattern.finditer(text[at:to])]


def stitched(text: str, pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pieces of a text, cut only where the pre-tokens of the whole text are cut.

    A cut after white space is avoided: white space at the end of a piece would
    pre-tokenise otherwise than white space before a word.
    """
    if len(text) <= chunk:
        return [text] if text else []
    cuts = []
    spans = [(max(0, at - overlap), min(len(text), at + chunk + overlap)) for at in range(0, len(text), chunk)]
    # Boundaries of the whole text as far as they are known; one at a chunk's very end may be cut short.
    left, left_end = boundaries(text, pattern, *spans[0]), spans[0][1]
    for at, to in spans[1:]:
        right = boundaries(text, pattern, at, to)
        meets = {b for b in right if not text[b - 1].isspace()}
        left = [b for b in left if b < left_end]
        common = [b for b in left if b in meets]
        point = common[0] if common else (left[-1] if left else 0)
        while point not in meets and point < to:
            found = pattern.search(text, point)
            point = found.end() if found else len(text)
            left.append(point)
        if point in meets:
            cuts.append(point)
            left, left_end = [b for b in right if b >= point], to
        else:
            left_end = len(text) + 1
    edges = [0, *cuts, len(text)]
    return [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def encoding(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """keep columns, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit, as bytes) of each text."""
    slim = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    overlap = max(1, min(overlap, (chunk - 1) // 2))  # a chunk's two overlaps are apart
    kept = slim.select(*keep).schema

    def run(batches):
        """Whole texts, each stitched here if it is longer than a chunk."""
        bpe, split = encoding(shipped.value, pattern), regex.compile(pattern)
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                ids = [
                    b"".join(bpe.encode_to_numpy(piece).astype("<u4").tobytes() for piece in stitched(text, split, chunk, overlap))
                    for text in part.column("__text").to_pylist()
                ]
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, "n_tokens", "ids"])

    made = T.StructType([*kept.fields, *T._parse_datatype_string("n_tokens long, ids binary").fields])
    short = slim.where(F.length("__text") <= chunk).mapInArrow(run, made)
    rows = written(_chunks(slim.where(F.length("__text") > chunk), keep, chunk, overlap))
    if rows.isEmpty():
        return short
    cuts = written(_cuts(rows, pattern, chunk, overlap))
    # Every piece of a text whose overlaps all have a cut is encoded where it falls.
    ends = F.concat(F.array(F.lit(0).cast("long")), "cuts", F.array("size"))
    pieces = cuts.where("whole").select("row", F.posexplode(F.arrays_zip(F.slice(ends, F.lit(1), F.size("cuts") + 1).alias("at"), F.slice(ends, F.lit(2), F.size("cuts") + 1).alias("to"))).alias("i", "p"))
    pieces = rows.join(pieces.select("row", "i", "p.at", "p.to"), ["row", "i"])

    def run_pieces(batches):
        bpe = encoding(shipped.value, pattern)
        for batch in batches:
            for part in steps(batch, "body", STEP_BYTES):
                texts, (lo, at, to) = part.column("body").to_pylist(), (part.column(c).to_pylist() for c in ("lo", "at", "to"))
                ids = [bpe.encode_to_numpy(t[a - x : z - x]).astype("<u4").tobytes() for t, x, a, z in zip(texts, lo, at, to, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("i"), pa.array(ids, pa.binary())], names=["row", "i", "ids"])

    encoded = pieces.select("row", "i", "lo", "at", "to", "body").mapInArrow(run_pieces, "row long, i int, ids binary")
    encoded = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("ids"))
    encoded = encoded.select("row", F.unhex(F.array_join(F.transform("ids", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    named = rows.where("i = 0").select("row", "kept")
    long = encoded.join(named, "row").select("kept.*", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids")
    # The other texts are put together again, and stitched in one task each.
    odd = rows.join(cuts.where("not whole").select("row"), "row", "left_semi")
    odd = odd.withColumn("part", F.when(F.col("i") == 0, F.substring("body", F.lit(1), F.lit(chunk))).otherwise(F.substring("body", F.lit(overlap + 1), F.lit(chunk))))
    odd = odd.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("__text"))
    odd = odd.join(named, "row").select("kept.*", "__text").mapInArrow(run, made)
    return short.union(long).union(odd)


def _chunks(long: DataFrame, keep: tuple[str, ...], chunk: int, overlap: int) -> DataFrame:
    """(row, i, lo, size, body, kept): the overlapping chunks of each text, dealt over all tasks.

    body begins at code point lo of a text of that size; the first chunk has the kept columns.
    """
    packed = long.select(F.struct(*keep).alias("kept"), "__text")

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                for n, text in enumerate(part.column("__text").to_pylist()):
                    places = list(range(0, len(text), chunk))
                    for at in range(0, len(places), 64):
                        some = places[at : at + 64]
                        body = [text[max(0, a - overlap) : a + chunk + overlap] for a in some]
                        kept = part.column("kept").take(pa.array([n if a == 0 else None for a in some], pa.int64()))
                        made = [pa.array([row] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int32()), pa.array([max(0, a - overlap) for a in some], pa.int64()), pa.array([len(text)] * len(some), pa.int64())]
                        yield pa.RecordBatch.from_arrays([*made, pa.array(body, pa.string()), kept], names=["row", "i", "lo", "size", "body", "kept"])
                    row += 1

    schema = T._parse_datatype_string("row long, i int, lo long, size long, body string")
    return packed.mapInArrow(run, T.StructType([*schema.fields, T.StructField("kept", packed.schema["kept"].dataType)])).repartition("row", "i")


def _cuts(rows: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, size, cuts, whole) of each text: the first common boundary of each overlap; whole if all have one."""

    def run(batches):
        split = regex.compile(pattern)
        for batch in batches:
            for part in steps(batch, "body", STEP_BYTES):
                left, right = [], []
                for i, lo, size, body in zip(*(part.column(c).to_pylist() for c in ("i", "lo", "size", "body")), strict=True):
                    found, end = boundaries(body, split, 0, len(body)), lo + len(body)
                    # A boundary at the very end may be cut short; one after white space may fall otherwise in a piece.
                    good = [lo + b for b in found if not body[b - 1].isspace() and (lo + b < end or end == size)]
                    left.append([b for b in good if i and b <= i * chunk + overlap])
                    right.append([b for b in good if b >= (i + 1) * chunk - overlap])
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (left, right)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("i"), part.column("size"), *lists], names=["row", "i", "size", "before", "after"])

    zones = rows.select("row", "i", "lo", "size", "body").mapInArrow(run, "row long, i int, size long, before array<long>, after array<long>")
    zones = zones.groupBy("row", "size").agg(F.array_sort(F.collect_list(F.struct("i", "before", "after"))).alias("z"))
    met = F.transform(F.slice("z", F.lit(2), F.size("z")), lambda x, k: F.array_min(F.array_intersect(F.get("z", k)["after"], x["before"])))
    return zones.select("row", "size", met.alias("cuts")).withColumn("whole", ~F.exists("cuts", lambda x: x.isNull()))


def decode(encoded: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and ``decoded``, the bytes of each row's ``ids``: its tokens' raw bytes in a row."""
    slim = encoded.select(*keep, F.col("ids").alias("__ids"))
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        ranks = shipped.value
        raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            raw[rank] = token
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [
                    b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                    for ids in part.column("__ids").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.binary())], names=[*keep, "decoded"])

    return slim.mapInArrow(run, slim.select(*keep).schema.add("decoded", "binary"))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to."""
    encoded = encode(docs, ranks, pattern)
    digests = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(digests, ranks, keep=("doc_id", "n_tokens", "ids_sha256")).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
