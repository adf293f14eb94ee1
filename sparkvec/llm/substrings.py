"""Operator 6: repeated passages by a compacted de Bruijn graph of word windows.

A window of k words is an edge from its first k - 1 to its last k - 1 words.  An
edge that several documents walk is repeated; its source is its place in the
smallest document.  Joins and aggregates find them:

0. Copies.  Texts that repeat whole are grouped; only the smallest id of each goes
   on, the others are cut whole.  A filter of repeated text hashes, of fixed size,
   tells which texts take part in the grouping; all others stay where they are.
1. Candidates.  Every window has a minimizer, the least hash among its short word
   runs, so equal windows have equal minimizers.  Tasks send sorted, truncated
   minimizer hashes; those of two documents or more set a bit of a filter.  The
   filter only saves work: it is lossless, and its size has a fixed bound.
2. Edges.  Windows whose minimizer passes are aggregated to their source coordinate
   and largest document, and to whether all their places agree on the word before and
   on the word after.  A window is told by 96 bits, a 64-bit hash and 32 bits of a
   second one over word hashes of another seed; both are keys of the aggregate and
   of the join, so windows that agree in one of them only have sources of their own.
3. Compaction.  A step between two edges is nonbranching if all places of the first
   go on alike and all places of the second come from alike; their source coordinates
   are then consecutive.  One join of edges with those that follow them in their source
   leaves only the steps that branch; there paths end and begin.  First and last edges
   of a source alternate, so both are numbered along it, and a second join of equal
   numbers is the compacted paths, however long they are.
4. Spans.  Whoever walks a path's first edge walks the whole path, so the documents'
   walks are joined to first edges only; a filter of first edges, lossless and of the
   size of the other, keeps other windows out of that join.  A path carries a digest
   of its words, read at its source coordinates; a document's span counts if its own
   words have it.

A document loses the words of its spans.  Windows are judged on the input.

Nulls: a null text has no words; rows with a null doc_id are neither sources nor
cut.  Repeated ids: a document is cut only by a smaller id, never by an equal one;
rows of one id with different texts are told apart by a hash of the text, which is
a second key only where an id repeats.  Documents with fewer words than a window stay
whole.  Texts are read whole however long; a table without rows gives none.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.llm._util import STEP_BYTES, drop_table, release, written
from sparkvec.llm._words import SPACED, U, joined, minimizers, no_straddle, steps, text_buffer, window_hashes, words

WINDOW = 13
#: Words of the runs from which minimizers are taken.
RUN = 7
#: Bits of the candidate filter at most (64 MB), and minimizers that a task sends at once.
FILTER_BITS, SEND = 29, 1 << 19
#: Bits of a minimizer hash that are sent, after those of its bucket.
SENT = 40
#: Bits of the filter of repeated texts at most (8 MB).
COPY_BITS = 26
#: Bits of a word's place in its text, where it is packed with the id.
PLACE = 31
#: Stands for the hash of a word beyond the end of a text; a word of that hash only makes paths shorter.
NO_WORD = -(1 << 63)
#: Bytes of a path's digest.
DIGEST = 16
#: End of a span that covers its document to the end.
ALL = (1 << 31) - 1


def _sizes(docs: DataFrame, most: int) -> tuple[int, int]:
    """(filter bits, bucket bits) from the planner's estimate of the input size; it decides speed only."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = min(most, max(16, (size // 4).bit_length()))
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bits, min(bits - 3, 14, max(4, shuffles.bit_length(), (size >> 27).bit_length()))


def _minimized(part: pa.RecordBatch, window: int, run: int):
    """Words of a slice, their hashes, starts of its windows, and each window's minimizer index and run hashes."""
    w = words(*text_buffer(part.column("__text")), SPACED, lower=False)
    h = w.hashes()
    k = window_hashes(h, run)
    at = minimizers(k, window - run + 1)
    start = np.flatnonzero(no_straddle(w.first, len(h), window)[: len(at)])
    return w, h, start, at[start], k


def _candidates(rows: DataFrame, marks, window: int, run: int, bits: int, buckets: int) -> np.ndarray:
    """The filter: a bitmap by the top ``bits`` of a minimizer, set where two documents or more have one."""

    copy_bits = min(bits, COPY_BITS)

    def send(held: list[tuple[np.ndarray, np.ndarray]]):
        a = np.concatenate([x for x, _ in held])
        doc = np.concatenate([x for _, x in held])
        order = np.lexsort((doc, a))
        a, doc = a[order], doc[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])
        several = np.zeros(len(a), bool)
        several[1:] = ~first[1:] & (doc[1:] != doc[:-1])
        begin = np.flatnonzero(first)
        again = np.bitwise_or.reduceat(several, begin) if len(begin) else several
        a = a[begin]
        edges = np.searchsorted(a >> U(64 - buckets), np.arange((1 << buckets) + 1).astype(U))
        sent = ((a << U(buckets)) >> U(64 - SENT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SENT // 8]
        rows = [(b, sent[x:y][~again[x:y]].tobytes(), sent[x:y][again[x:y]].tobytes()) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "once", "more"])

    def scatter(batches):
        held, rows, docs = [], 0, 0
        for batch in batches:
            batch = batch.filter(pa.array(~_repeats(batch, marks.value, copy_bits)))
            for part in steps(batch, "__text", STEP_BYTES):
                w, _, start, at, k = _minimized(part, window, run)
                at, which = np.unique(at, return_index=True)
                held.append((k[at], docs + np.searchsorted(w.first, start[which], side="right")))
                docs, rows = docs + part.num_rows, rows + len(at)
                if rows >= SEND:
                    yield send(held)
                    held, rows = [], 0
        if rows:
            yield send(held)

    def unpack(column) -> np.ndarray:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SENT // 8)
        full = np.zeros((len(raw), 8), np.uint8)
        full[:, : SENT // 8] = raw
        return full.reshape(-1).view("<u8")

    def gather(key, group):
        once, more = np.sort(unpack(group.column("once"))), unpack(group.column("more"))
        seen = np.concatenate([once[1:][once[1:] == once[:-1]], more])
        mixed = np.intersect1d(once, more)
        slots = np.concatenate([seen, mixed]) >> U(SENT - (bits - buckets))
        bitmap = np.zeros(1 << (bits - buckets), bool)
        bitmap[slots.astype(np.int64)] = True
        return pa.table({"bucket": group.column("bucket")[:1], "bitmap": pa.array([np.packbits(bitmap).tobytes()], pa.binary())})

    sent = rows.select("__text", "__hash").mapInArrow(scatter, "bucket int, once binary, more binary")
    made = sent.groupBy("bucket").applyInArrow(gather, "bucket int, bitmap binary")
    filter_ = np.zeros((1 << buckets, 1 << (bits - buckets - 3)), np.uint8)
    for row in made.toLocalIterator():  # 2**bits bits in all, however large the input
        filter_[row.bucket] = np.frombuffer(row.bitmap, np.uint8)
    return filter_.reshape(-1)


def _repeats(batch: pa.RecordBatch, filter_: np.ndarray, bits: int) -> np.ndarray:
    """True for the rows of a batch whose text hash is marked; false for one without a hash."""
    hashes = batch.column("__hash")
    at = hashes.fill_null(0).to_numpy().view(U) >> U(64 - bits)
    marked = (filter_.view(U)[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == U(1)
    return marked & hashes.is_valid().to_numpy(zero_copy_only=False)


def _without_copies(slim: DataFrame, bits: int):
    """(rows, marks, copies): the work of step 0 on slim (keys, __text).

    rows are slim with a hash, and the first of each repeated text without one; those
    that :func:`_repeats` by the broadcast marks are to be passed over.  copies are
    (keys, source_doc) of the texts that are not first.
    """
    bits = min(bits, COPY_BITS)
    hashed = slim.withColumn("__hash", F.xxhash64("__text"))
    counts = hashed.select("__hash").groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slot = F.shiftrightunsigned("__hash", 64 - bits)
    marked = counts.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__hash, {64 - bits}) & 63 as int))")).alias("bits"))
    filter_ = np.zeros(1 << (bits - 6), np.int64)
    for row in marked.toLocalIterator():  # 2**bits bits at most
        filter_[row.word] = row.bits
    sent = slim.sparkSession.sparkContext.broadcast(filter_)

    def whole(batches):
        for batch in batches:
            yield batch.filter(pa.array(_repeats(batch, sent.value, bits))).drop_columns(["__hash"])

    again = hashed.mapInArrow(whole, slim.schema)
    group = again.groupBy("__text").agg(F.min("doc_id").alias("doc_id"))
    first = written(group.select(*[F.xxhash64("__text").alias(c) if c == "version" else c for c in slim.columns]))
    digest = F.sha2(F.col("__text").cast("binary"), 256).alias("digest")
    sources = first.select(F.col("doc_id").alias("source_doc"), digest)
    keys = [c for c in slim.columns if c != "__text"]
    copies = again.select(*keys, digest).join(sources, "digest").where("doc_id > source_doc").select(*keys, "source_doc").distinct()
    rest = hashed.union(first.withColumn("__hash", F.lit(None).cast("long")))
    return rest, sent, written(copies)


def _walks(slim: DataFrame, marks, passing, window: int, run: int, bits: int, packed: bool) -> DataFrame:
    """(edge, check, keys, at, before, after) of each window that passes the filter.

    These are its two hashes, its first word, and hashes of the words around it, ``NO_WORD``
    where the text ends.  If packed, ``place`` stands for doc_id and at: 31 bits are the latter.
    """

    keys, copy_bits = [c for c in slim.columns if c not in ("__text", "__hash")], min(bits, COPY_BITS)

    def run_(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~_repeats(batch, marks.value, copy_bits)))
            for part in steps(batch, "__text", STEP_BYTES):
                w, h, start, at, k = _minimized(part, window, run)
                start = start[_marked(passing.value, k[at], bits)]
                if not len(start):
                    continue
                edge, check = window_hashes(h, window), window_hashes(w.hashes(seed=1), window) >> U(32)
                text = np.searchsorted(w.first, start, side="right") - 1
                before = np.where(start == w.first[text], NO_WORD, h[np.maximum(start - 1, 0)].view(np.int64))
                after = np.where(start + window == w.first[text + 1], NO_WORD, h[np.minimum(start + window, len(h) - 1)].view(np.int64))
                at = start - w.first[text]
                if packed:
                    places = [pa.array((part.column("doc_id").to_numpy().astype(np.int64)[text] << PLACE) + at)]
                else:
                    places = [*(part.column(c).take(pa.array(text)) for c in keys), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(edge[start].view(np.int64)), pa.array(check[start].astype(np.uint32).view(np.int32)), *places, pa.array(before), pa.array(after)],
                    names=["edge", "check", *(["place"] if packed else [*keys, "at"]), "before", "after"],
                )

    first, last = T._parse_datatype_string("edge long, check int").fields, T._parse_datatype_string("before long, after long").fields
    places = T._parse_datatype_string("place long").fields if packed else [*slim.select(*keys).schema.fields, *T._parse_datatype_string("at int").fields]
    return slim.mapInArrow(run_, T.StructType([*first, *places, *last]))


def _edges(walks: DataFrame, keys: list[str], packed: bool) -> DataFrame:
    """The windows of several documents: hashes, source coordinates, and whether all places agree on the words around them."""
    agreed = [((F.min(c) == F.max(c)) & (F.min(c) != NO_WORD)).alias(c) for c in ("before", "after")]
    if packed:  # numbers only, which hash aggregates hold
        id_, at = F.shiftright("source", PLACE), F.col("source").bitwiseAND((1 << PLACE) - 1).cast("int")
        found = walks.groupBy("edge", "check").agg(F.min("place").alias("source"), F.max("place").alias("last"), *agreed)
        return found.where(id_ < F.shiftright("last", PLACE)).select("edge", "check", id_.alias("source_doc_id"), at.alias("start"), (at + 1).alias("end"), "before", "after")
    found = walks.groupBy("edge", "check").agg(F.min(F.struct(*keys, "at")).alias("source"), F.max("doc_id").alias("last"), *agreed)
    return found.where("source.doc_id < last").select(
        "edge", "check", *[F.col(f"source.{c}").alias(f"source_{c}") for c in keys], F.col("source.at").alias("start"), (F.col("source.at") + 1).alias("end"), "before", "after"
    )


def _fits(every: DataFrame, keys: list[str]) -> bool:
    """Whether ids are longs that leave the bits of a place."""
    if keys != ["doc_id"] or every.schema["doc_id"].dataType != T.LongType():
        return False
    least, most = every.agg(F.min("doc_id"), F.max("doc_id")).first()
    return least is None or (-(1 << 63 - PLACE) <= least and most < 1 << 63 - PLACE)


def _marked(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """True for the hashes whose top bits are set in a bitmap."""
    slot = hashes >> U(64 - bits)
    return (filter_[(slot >> U(3)).astype(np.int64)] >> (7 - (slot & U(7)).astype(np.uint8))) & 1 == 1


def _first_edges(paths: DataFrame, bits: int, buckets: int) -> np.ndarray:
    """A bitmap by the top ``bits`` of the first edge of each path."""

    def gather(key, group):
        slots = (group.column("edge").to_numpy().view(U) << U(buckets)) >> U(64 - (bits - buckets))
        bitmap = np.zeros(1 << (bits - buckets), bool)
        bitmap[slots.astype(np.int64)] = True
        return pa.table({"bucket": group.column("bucket")[:1], "bitmap": pa.array([np.packbits(bitmap).tobytes()], pa.binary())})

    made = paths.select(F.shiftrightunsigned("edge", 64 - buckets).cast("int").alias("bucket"), "edge").groupBy("bucket").applyInArrow(gather, "bucket int, bitmap binary")
    filter_ = np.zeros((1 << buckets, 1 << (bits - buckets - 3)), np.uint8)
    for row in made.toLocalIterator():  # 2**bits bits in all, however large the input
        filter_[row.bucket] = np.frombuffer(row.bitmap, np.uint8)
    return filter_.reshape(-1)


def _entries(slim: DataFrame, marks, first_edges, window: int, bits: int) -> DataFrame:
    """(edge, check, keys, at) of each window whose edge passes the filter of first edges."""

    keys, copy_bits = [c for c in slim.columns if c not in ("__text", "__hash")], min(bits, COPY_BITS)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~_repeats(batch, marks.value, copy_bits)))
            for part in steps(batch, "__text", STEP_BYTES):
                w = words(*text_buffer(part.column("__text")), SPACED, lower=False)
                h = w.hashes()
                edge = window_hashes(h, window)
                start = np.flatnonzero(no_straddle(w.first, len(h), window)[: len(edge)] & _marked(first_edges.value, edge, bits))
                if not len(start):
                    continue
                if len(start) * window < len(h):
                    check = window_hashes(w.hashes((start[:, None] + np.arange(window)).ravel(), seed=1), window)[::window]
                else:
                    check = window_hashes(w.hashes(seed=1), window)[start]
                text = np.searchsorted(w.first, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(edge[start].view(np.int64)), pa.array((check >> U(32)).astype(np.uint32).view(np.int32)),
                        *(part.column(c).take(pa.array(text)) for c in keys), pa.array((start - w.first[text]).astype(np.int32)),
                    ],
                    names=["edge", "check", *keys, "at"],
                )

    first, last = T._parse_datatype_string("edge long, check int").fields, T._parse_datatype_string("at int").fields
    return slim.mapInArrow(run, T.StructType([*first, *slim.select(*keys).schema.fields, *last]))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, __text) of docs, and ``version``, a hash of the text, if some id has several rows."""
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return slim if again.isEmpty() else slim.select("doc_id", F.xxhash64("__text").alias("version"), "__text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id and spans: word ranges of docs (doc_id, text) that repeat windows of smaller documents.

    Where ids repeat there is also ``version``, the xxhash64 of the text.

    A span is a compacted path, with the source document, the word at which the
    path starts there, and the digest of the path's words; a copy has one span
    without an end (``ALL``) and without a digest.  Documents without spans have no row.
    """
    return _spans(_keyed(docs), window, run, filter_bits)


def _spans(keyed: DataFrame, window: int, run: int, filter_bits: int) -> DataFrame:
    spark, every = keyed.sparkSession, keyed.where("doc_id is not null")
    keys = [c for c in keyed.columns if c != "__text"]
    bits, buckets = _sizes(every, filter_bits)
    slim, marks, copies = _without_copies(every, bits)
    release(spark)
    passing = spark.sparkContext.broadcast(_candidates(slim, marks, window, run, bits, buckets))
    release(spark)
    packed = _fits(every, keys)
    edges = written(_edges(_walks(slim, marks, passing, window, run, bits, packed), keys, packed))
    passing.unpersist()
    release(spark)
    source = [f"source_{c}" for c in keys]
    paths, tables = compacted(edges, source)
    paths = written(_digested(paths, every, source, window))
    for each in [edges, *tables]:
        drop_table(each)
    release(spark)
    first_edges = spark.sparkContext.broadcast(_first_edges(paths, bits, buckets))
    span = F.struct(
        F.col("at").alias("start"), (F.col("at") + F.col("end") - F.col("start") + F.lit(window - 1)).alias("end"),
        F.col("source_doc_id").cast("long").alias("source_doc"), F.col("start").alias("source_start"), "digest",
    )
    found = (
        _entries(slim, marks, first_edges, window, bits)
        .join(paths, ["edge", "check"])
        .where(F.col("doc_id") > F.col("source_doc_id"))
        .groupBy(*keys)
        .agg(F.collect_list(span).alias("spans"))  # no more than the document has words
    )
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(ALL).alias("end"), F.col("source_doc").cast("long").alias("source_doc"), F.lit(0).alias("source_start"), F.lit(None).cast("binary").alias("digest")))
    found = found.union(copies.select(*keys, whole.alias("spans")))
    spans = written(found.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")))
    drop_table(paths)
    first_edges.unpersist()
    release(spark)
    return spans


def compacted(edges: DataFrame, source: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Nonbranching paths of edges (edge, check, source columns, start, end, before, after), and the tables that hold them.

    before and after tell whether an edge may be joined to what precedes and follows it
    in its source; a path keeps the hashes of its first edge.  Two joins do it: edges that
    meet at a word of their source, where a step that does not branch goes, and the n-th
    first edge of a source with its n-th last one.
    """
    a = edges.select(*source, F.col("end").alias("place"), F.col("after").alias("goes"))
    b = edges.select(*source, F.col("start").alias("place"), "before", "edge", "check")
    bounds = a.join(b, [*source, "place"], "full_outer").where("not (coalesce(goes, false) and coalesce(before, false))")
    along = Window.partitionBy(*source).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = written(bounds.select(*source, "place", F.col("goes").isNotNull().alias("ends"), F.col("before").isNotNull().alias("begins"), "edge", "check").withColumn("nth", F.count_if("begins").over(along)))
    first = bounds.where("begins").select(*source, "nth", "edge", "check", F.col("place").alias("start"))
    last = bounds.where("ends").select(*source, (F.col("nth") - F.col("begins").cast("long")).alias("nth"), F.col("place").alias("end"))
    return first.join(last, [*source, "nth"]).select("edge", "check", *source, "start", "end"), [bounds]


def _range_digests(w, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """A digest of each range of words, joined by one space."""
    line, _, _ = joined(w, np.ones(len(w.starts), bool))
    size = w.ends - w.starts
    end = np.cumsum(size + 1) - 1
    return [hashlib.blake2b(line[x:y], digest_size=DIGEST).digest() for x, y in zip((end - size)[first].tolist(), end[last - 1].tolist(), strict=True)]


def _digested(paths: DataFrame, rows: DataFrame, source: list[str], window: int) -> DataFrame:
    """paths with the digest of their words, read from their source's text."""
    keys = [c.removeprefix("source_") for c in source]
    if "version" in keys:
        rows = rows.dropDuplicates(keys)
    fields = ["edge", "check", "start", "end"]
    ranges = paths.groupBy(*source).agg(F.collect_list(F.struct(*fields)).alias("__paths"))  # no more than the source has words
    own = rows.select(*[F.col(k).alias(c) for k, c in zip(keys, source, strict=True)], "__text").join(ranges, source)

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                w = words(*text_buffer(part.column("__text")), SPACED, lower=False)
                lists = part.column("__paths")
                flat = lists.flatten()
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                start, end = (flat.field(i).to_numpy().astype(np.int64) for i in (2, 3))
                digests = _range_digests(w, w.first[of] + start, w.first[of] + end + window - 1)
                columns = [*(flat.field(i) for i in range(4)), *(part.column(c).take(pa.array(of)) for c in source), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*fields, *source, "digest"])

    schema = T.StructType([*paths.select(*fields, *source).schema.fields, *T._parse_datatype_string("digest binary").fields])
    return own.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay, of every row of docs (doc_id, text)."""
    keyed = _keyed(docs)
    spans = _spans(keyed, window, run, filter_bits)
    slim = keyed.join(spans, [c for c in keyed.columns if c != "__text"], "left")

    def run_(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                w = words(*text_buffer(part.column("__text")), SPACED, lower=False)
                lists, total = part.column("spans"), len(w.starts)
                flat = lists.flatten()
                counts = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
                of = np.repeat(np.arange(part.num_rows), counts)
                first, last = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                valid = (last < ALL) | (np.diff(w.first)[of] >= window)  # a copy without a window stays
                path = np.flatnonzero(last < ALL)
                own = _range_digests(w, w.first[of[path]] + first[path], w.first[of[path]] + last[path])
                told = flat.field(4).take(pa.array(path)).to_pylist()
                valid[path] = [x == y for x, y in zip(own, told, strict=True)]
                of, first, last = of[valid], first[valid], last[valid]
                edge = np.zeros(total + 1, np.int64)
                np.add.at(edge, np.minimum(w.first[of] + first, w.first[of + 1]), 1)
                np.add.at(edge, np.minimum(w.first[of] + last, w.first[of + 1]), -1)
                keep = np.cumsum(edge[:-1]) == 0
                line, begin, end = joined(w, keep)
                removed = np.diff(np.concatenate([[0], np.cumsum(~keep)])[w.first])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(w.first)), pa.array(removed.astype(np.int64)), pa.array([line[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return slim.mapInArrow(run_, slim.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string"))


def report(cut: DataFrame) -> DataFrame:
    """The digest columns of op6 from the rows of :func:`without_repeats`."""
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
