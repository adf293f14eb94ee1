"""Operator 7: SimHash near-duplicates by a binary trie self-join.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles.  Distinct fingerprints form a binary trie.  Node pairs are traversed
together: each level adds the differing bit of the two branches, and a pair whose
sum exceeds the Hamming budget is pruned with all below it.

Of ``radius + 1`` blocks of a fingerprint at least one is free of differing bits.  So
there is one trie for each block, over the fingerprints rotated to begin with it,
and its traversal may start from the pairs of each block value with itself.  A
fingerprint is copied once a block, ``radius + 1`` times, however many there are.
Block values are dealt to tasks by their leading bits, more of them the more
fingerprints there are; the traversal runs inside a task with a frontier of bounded
size and returns a spanning forest of its links, never all pairs.  A block value with
more fingerprints than a task may hold is cut again by blocks of its other bits.

The pipeline's stage asks for edited copies, five-word shingles with a Jaccard
similarity of 0.8 or more.  A bit of their fingerprints differs with a probability of
0.15, so 64 bits do not tell them apart: ``deduplicated`` takes WORDS fingerprints of
64 bits, a trie for each block of each, as above, and a budget for the word and one
for it with the two words after it.  The shingle sets of what the tries link are
compared whole.

Nulls: a null text has no words and so fingerprint zero; null ids are ignored
when the least id is chosen, and a class of null ids only has a null one.  Repeated
rows keep their rows.  Whole texts are read however long.  A table without rows
gives none.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sparkvec.llm._util import STEP_BYTES, release, written
from sparkvec.llm._words import SPACED, U, mix, no_straddle, sequence_hashes, steps, text_buffer, words
from sparkvec.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints that one task should hold about, and of one block value at most; beyond it they are cut again.
TASK_ROWS, UNIT_ROWS = 1 << 11, 1 << 20
#: Node pairs expanded at once within a unit.
FRONTIER = 1 << 18
#: Word shingles and Jaccard similarity of the pipeline's stage.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of a text in that stage and blocks of each: a pair at 0.8 differs in every block with probability 1e-8.
WORDS, WORD_BLOCKS = 28, 5
#: Bits that a linked pair may differ in: of the 51 or more of a word beyond its block, and with the two words after it.
#: Means of 7.8 and 27 at similarity 0.8, and about five standard deviations.
WORD_BUDGET, BUDGET = 20, 52
#: Copies of fingerprints that one task of that stage should hold about.
STAGE_ROWS = 1 << 14
#: Texts, and shingles, of a block of candidates that are compared in one task.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
#: Links that a task pools before it writes a spanning forest of them.
POOLED_LINKS = 1 << 18
_LANES = U(0x0101010101010101)


def majority_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run h[first[i]:first[i + 1]]: the bits set in over half of its hashes; 0 if empty.

    Bits are counted eight to a word: byte lanes of at most 255 hashes are summed
    with plain 64-bit additions.
    """
    n = np.diff(first)
    parts = -(-n // 255)
    out = np.zeros(len(n), U)
    if not parts.sum():
        return out
    run = np.repeat(np.arange(len(n)), parts)
    part_first = np.concatenate([[0], np.cumsum(parts)])
    at = first[run] + 255 * (np.arange(len(run)) - part_first[run])
    some = np.flatnonzero(n)
    for b in range(8):
        lanes = np.add.reduceat((h >> U(b)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), part_first[some], axis=0)
        bits = (2 * counts > n[some, None]).astype(U)
        for lane in range(8):
            out[some] |= bits[:, lane] << U(8 * lane + b)
    return out


def simhashes(data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text of a buffer."""
    w = words(data, bounds, SPACED, lower=True)
    n = np.diff(w.first)
    # One space between the words of a text: what follows a word's last byte becomes it, other separators go.
    keep = SPACED[w.data]
    keep[w.ends[w.ends < len(w.data)]] = True
    place = np.cumsum(keep) - keep
    line = w.data.copy()
    line[~SPACED[w.data]] = 0x20
    line = line[keep].tobytes()
    starts = place[w.starts]
    ends = starts + (w.ends - w.starts)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    head = w.first[:-1].repeat(count) + np.arange(first[-1]) - first[:-1].repeat(count)
    tail = np.minimum(head + shingle, w.first[1:].repeat(count)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts[head].tolist(), ends[tail].tolist(), strict=True)),
        dtype=U,
        count=len(head),
    )
    return majority_bits(h, first)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp`` (64 bits as a long) of every row of docs (..., text)."""
    slim = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                fp = simhashes(*text_buffer(part.column("__text")), shingle)
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    kept = slim.select(*keep).schema
    return slim.mapInArrow(run, kept.add("fp", "long"))


class Forest:
    """Union-find over indices, with whole arrays of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _products(lo1, hi1, lo2, hi2):
    """All index pairs of many small rectangles."""
    wide = hi2 - lo2
    size = (hi1 - lo1) * wide
    which = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return lo1[which] + inner // wide[which], lo2[which] + inner % wide[which]


def trie_links(values: np.ndarray, pairs: tuple, radius: int, forest: Forest, leaf: int = 64, more: tuple = (), budget: int = 0) -> None:
    """Traverse node pairs of the trie over sorted ``values`` and link what is within the budget.

    more: further words of each value; with them a link may differ in ``budget`` bits in all.

    A node is a range of ``values`` that agree on ``depth`` bits.  pairs: arrays
    (lo1, hi1, lo2, hi2, differing bits, depth); a node paired with itself stands
    for its inner pairs.
    """
    stack = [pairs]
    while stack:
        now = stack.pop()
        if len(now[0]) > FRONTIER:
            half = len(now[0]) // 2
            stack += [tuple(x[:half] for x in now), tuple(x[half:] for x in now)]
            continue
        lo1, hi1, lo2, hi2, bits, depth = now
        small = ((hi1 - lo1) * (hi2 - lo2) <= leaf) | (depth >= 64)
        if small.any():
            cells = tuple(x[small] for x in (lo1, hi1, lo2, hi2))
            for at in range(0, len(cells[0]), FRONTIER // 8):
                a, b = _products(*(x[at : at + FRONTIER // 8] for x in cells))
                bits_ = np.bitwise_count(values[a] ^ values[b])
                near = (bits_ <= radius) & (a != b)
                a, b, bits_ = a[near], b[near], bits_[near]
                if more:
                    near = bits_ + sum(np.bitwise_count(x[a] ^ x[b]) for x in more) <= budget
                    a, b = a[near], b[near]
                forest.link(a, b)
        lo1, hi1, lo2, hi2, bits, depth = (x[~small] for x in now)
        if not len(lo1):
            continue
        shift = (63 - depth).astype(U)
        mid1, mid2 = (
            np.clip(np.searchsorted(values, ((values[lo] >> shift) | U(1)) << shift), lo, hi)
            for lo, hi in ((lo1, hi1), (lo2, hi2))
        )
        same = lo1 == lo2
        children = [
            (lo1, mid1, lo2, mid2, bits, depth + 1),
            (mid1, hi1, mid2, hi2, bits, depth + 1),
            (lo1, mid1, mid2, hi2, bits + 1, depth + 1),
            tuple(x[~same] for x in (mid1, hi1, lo2, mid2, bits + 1, depth + 1)),
        ]
        merged = tuple(np.concatenate(x) for x in zip(*children, strict=True))
        alive = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= radius)
        if alive.any():
            stack.append(tuple(x[alive] for x in merged))


def unit_forest(turned: np.ndarray, depth: int, radius: int, more: tuple = (), budget: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (indices) among fingerprints, turned so that ``depth`` bits stand first that none of a link differ in."""
    order = np.argsort(turned)
    values = turned[order]
    prefix = values >> U(64 - depth) if depth else np.zeros(len(values), U)
    first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(values) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(values))
    several = last - first > 1
    first, last = first[several], last[several]
    forest = Forest(len(values))
    zero = np.zeros(len(first), np.int64)
    trie_links(values, (first, last, first, last, zero, zero + depth), radius, forest, more=tuple(x[order] for x in more), budget=budget)
    linked = np.flatnonzero(forest.root != np.arange(len(values)))
    return order[linked], order[forest.root[linked]]


def least_ends(fp: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (values) of a forest's trees, given as indices u and the roots v: each of a tree to its least ``fp``."""
    least = fp.copy()
    np.minimum.at(least, v, fp[u])
    roots = np.unique(v)
    ends, low = fp[np.concatenate([u, roots])], least[np.concatenate([v, roots])]
    return ends[ends != low], low[ends != low]


def spanning(links: DataFrame) -> DataFrame:
    """Links (u, v) of the same components, about one for each end, however many of ``links`` name it.

    Links are dealt by their greater end; of at most POOLED_LINKS of them a task
    keeps a forest, which has each end once, beside the least one that it reaches.
    """
    greater = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def run(batches):
        batches = iter(batches)
        more = True
        while more:
            pool, size = [], 0
            while size < POOLED_LINKS and (more := (batch := next(batches, None)) is not None):
                pool.append(batch)
                size += batch.num_rows
            if size:
                u, v = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in pool]) for c in ("u", "v"))
                ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
                forest = Forest(len(ends))
                forest.link(at[:size], at[size:])
                linked = np.flatnonzero(forest.root != np.arange(len(ends)))
                yield pa.RecordBatch.from_arrays([pa.array(ends[linked]), pa.array(ends[forest.root[linked]])], names=["u", "v"])

    return greater.repartition("u").sortWithinPartitions("u").mapInArrow(run, "u long, v long")


def block_copies(units: DataFrame, radius: int) -> DataFrame:
    """Each unit (path, depth, turned, fp) once for each of radius + 1 blocks of the bits after ``depth``, turned to begin with it."""
    blocks = radius + 1
    copies = []
    for i in range(blocks):
        at = f"cast((64 - depth) * {i} div {blocks} as int)"
        size = f"cast((64 - depth) * {i + 1} div {blocks} - (64 - depth) * {i} div {blocks} as int)"
        # The leading depth bits stay; the others are rotated by ``at``.
        rest = "shiftrightunsigned(shiftleft(turned, depth), depth)"
        head = "if(depth = 0, 0L, shiftleft(shiftrightunsigned(turned, 64 - depth), 64 - depth))"
        tail = f"if({at} = 0, {rest}, shiftrightunsigned(shiftleft(turned, depth + {at}), depth) | shiftrightunsigned({rest}, 64 - depth - {at}))"
        copies.append(F.expr(f"struct(path * {blocks} + {i} as path, depth + {size} as depth, {head} | {tail} as turned)"))
    return units.select("fp", F.explode(F.array(*copies)).alias("c")).select("c.path", "c.depth", "c.turned", "fp")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, unit_rows: int = UNIT_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (u, v) that connect the distinct longs ``fp`` differing in at most ``radius`` bits.

    Their components equal those of all such pairs.  fps must hold each value once.
    """
    total = fps.count()
    # Leading bits by which block values are dealt to tasks: how much is done at once, not what is done.
    dealt = min(64 // (radius + 1), max(0, math.ceil(math.log2(max(1, total / task_rows)))))
    units = block_copies(fps.select(F.lit(0).cast("long").alias("path"), F.lit(0).alias("depth"), F.col("fp").alias("turned"), "fp"), radius)
    ready, value = [], F.expr("shiftrightunsigned(turned, 64 - depth)")
    while True:
        sizes = units.groupBy("path", "depth", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        # What agrees on 44 bits has at most a million values left.
        hot = sizes.where((F.col("n") > unit_rows) & (F.col("depth") < 44)).select("path", "depth", "value")
        if hot.isEmpty():
            ready.append(units)
            break
        hot = written(hot)
        keyed = units.withColumn("value", value)
        ready.append(keyed.join(hot, ["path", "depth", "value"], "left_anti").drop("value"))
        units = written(block_copies(keyed.join(hot, ["path", "depth", "value"], "left_semi").drop("value"), radius))

    def run(key, group):
        turned, fp = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("turned", "fp"))
        u, v = unit_forest(turned.view(U), key[1].as_py(), radius)
        return pa.table({"u": fp[u], "v": fp[v]})

    out = None
    for i, part in enumerate(ready):
        # Of what was cut again each block value is a group of its own.
        group = F.expr(f"shiftrightunsigned(turned, {64 - dealt})") if i == 0 and dealt else F.lit(0).cast("long") if i == 0 else value
        found = part.withColumn("group", group).groupBy("path", "depth", "group").applyInArrow(run, "u long, v long")
        out = found if out is None else out.union(found)
    return out


def _classes(rows: DataFrame, least, links) -> DataFrame:
    """(fp, first): the least of ``least`` over all rows whose fingerprint fp reaches by ``links`` (a function of them)."""
    least = written(rows.groupBy("fp").agg(F.min(least).alias("least")))
    roots = components(links(least))
    by_fp = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    of_root = by_fp.groupBy("root").agg(F.min("least").alias("first"))
    return by_fp.join(of_root, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text).

    component_id is the least doc_id that links of at most ``radius`` bits reach.
    """
    rows = written(fingerprints(docs, shingle))
    classes = _classes(rows, F.col("doc_id"), lambda fps: fingerprint_links(fps.select("fp"), radius))
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id")
    )


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a buffer: the hashes of its word shingles, where they begin, and a hash of its lower-case words.

    A text of fewer words is one shingle; a text without words has none, and hash zero.
    """
    w = words(data, bounds, SPACED, lower=True)
    h, n = w.hashes(), np.diff(w.first)
    place = np.arange(len(h)) - np.repeat(w.first[:-1], n)
    some = np.flatnonzero(n)
    whole = np.zeros(len(n), U)
    if len(some):
        whole[some] = mix(np.add.reduceat(mix(h ^ mix(place.astype(U) + U(1))), w.first[some]))
    short = np.flatnonzero((n > 0) & (n < shingle))
    first = np.concatenate([[0], np.cumsum(np.where(n < shingle, np.minimum(n, 1), n - shingle + 1))])
    runs = np.zeros(first[-1], U)
    full = np.ones(len(runs), bool)
    full[first[short]] = False
    runs[full] = sequence_hashes(h, shingle)[no_straddle(w.first, len(h), shingle)[: max(0, len(h) - shingle + 1)]]
    runs[first[short]] = whole[short]
    return runs, first, whole


def set_fingerprints(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, WORDS) array: the bitwise majorities of each set of runs[first[i]:first[i + 1]], in which repeats count once."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    runs, first = runs[new], np.searchsorted(text[new], np.arange(len(first)))
    return np.stack([majority_bits(mix(runs ^ mix(np.full(1, nth + 1, U))), first) for nth in range(WORDS)], axis=1)


def word_links(rows: DataFrame, task_rows: int) -> DataFrame:
    """Links (u, v) between the ``fp`` of rows (fp, words), each once, that the tries over all blocks of all words find."""
    total = rows.count()
    dealt = min(64 // WORD_BLOCKS, max(0, math.ceil(math.log2(max(1, total / task_rows)))))
    after = [F.element_at("words", F.pmod(F.col("nth") + i, F.lit(WORDS)) + 1).alias(f"after{i}") for i in (1, 2)]
    edges = [64 * i // WORD_BLOCKS for i in range(WORD_BLOCKS + 1)]
    turned = [F.expr(f"shiftleft(word, {at}) | shiftrightunsigned(word, {64 - at})" if at else "word") for at in edges[:-1]]
    each = rows.select("fp", "words", F.posexplode("words").alias("nth", "word")).select("fp", "nth", "word", *after)
    copies = each.select("fp", "nth", "after1", "after2", F.posexplode(F.array(*turned)).alias("block", "turned"))
    path = (F.col("nth") * WORD_BLOCKS + F.col("block")).alias("path")
    group = (F.expr(f"cast(shiftrightunsigned(turned, {64 - dealt}) as int)") if dealt else F.lit(0)).alias("group")
    copies = copies.select(path, group, "turned", "after1", "after2", "fp")

    def run(key, group):
        turned, *more, fp = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("turned", "after1", "after2", "fp"))
        block = key[0].as_py() % WORD_BLOCKS
        u, v = least_ends(fp, *unit_forest(turned.view(U), edges[block + 1] - edges[block], WORD_BUDGET, tuple(x.view(U) for x in more), BUDGET))
        return pa.table({"u": u, "v": v})

    return copies.groupBy("path", "group").applyInArrow(run, "u long, v long")


def similar_pairs(sets: list[np.ndarray], similarity: float, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of sets with at least that Jaccard similarity, j < i; j < left <= i if 0 < left."""
    size = np.array([len(x) for x in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = n > 1
    narrow = (np.cumsum(shared) - 1)[column]
    keep = shared[column]
    narrow, row = narrow[keep], row[keep]
    order = np.argsort(narrow, kind="stable")
    narrow, row = narrow[order], row[order]
    left_end, right_from = (left, left) if left else (len(sets), 0)
    common = np.zeros((len(sets) - right_from, left_end))
    for at in range(0, int(shared.sum()), 4096):
        a, z = np.searchsorted(narrow, [at, at + 4096])
        grid = np.zeros((len(sets), min(4096, int(shared.sum()) - at)), np.float32)
        grid[row[a:z], narrow[a:z] - at] = 1
        common += grid[right_from:] @ grid[:left_end].T
    either = size[right_from:, None] + size[None, :left_end] - common
    i, j = np.nonzero(common >= similarity * either - 1e-9)
    i = i + right_from
    return i[j < i], j[j < i]


def shingle_links(docs: DataFrame, rows: DataFrame, least: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (u, v) between the texts ``fp`` of rows (fp, words) whose shingle sets are similar enough.

    Texts whose fingerprints the tries link are candidates; their connected groups
    are cut in blocks of bounded size, and a task compares the whole shingle sets
    of two blocks.  least (fp, least) names one row of docs for each text.
    """
    groups = components(spanning(word_links(rows.where("n > 0").select("fp", "words").dropDuplicates(["fp"]), STAGE_ROWS)))
    release(docs.sparkSession)
    members = groups.join(rows.select("fp", "n").dropDuplicates(["fp"]), groups["node"] == F.col("fp")).select("fp", "root", "n")
    blocks = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    asked = members.join(blocks, "root").join(least, "fp").select("fp", "root", "blocks", F.col("least.doc_id").alias("__id"), F.col("least.hash").alias("__hash"))
    own = docs.select("doc_id", F.col("text").cast("string").alias("__text"), F.xxhash64("text").alias("hash"))
    texts = own.join(asked, own["doc_id"].eqNullSafe(F.col("__id")) & (own["hash"] == F.col("__hash")))

    def sets(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                runs, first, _ = shingle_hashes(*text_buffer(part.column("__text")), shingle)
                each = [np.unique(runs[a:z]).view(np.int64) for a, z in itertools.pairwise(first)]
                columns = [part.column(c) for c in ("fp", "root", "blocks")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(each, pa.list_(pa.int64()))], names=["fp", "root", "blocks", "set"])

    found = texts.select("fp", "root", "blocks", "__text").mapInArrow(sets, "fp long, root long, blocks int, set array<long>")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = found.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "fp", "set")

    def run(key, group):
        group = group.combine_chunks()
        mine = group.column("mine").to_numpy()
        fps = group.column("fp").to_numpy()
        # A row read twice, of equal id and text, counts once.
        _, once = np.unique(fps, return_index=True)
        once = once[np.argsort(mine[once], kind="stable")]
        left = int((mine[once] == key[1].as_py()).sum()) if key[1] != key[2] else 0
        if len(once) < 2 or left == len(once) or (not left and key[1] != key[2]):
            none = np.zeros(0, np.int64)
            return pa.table({"u": none, "v": none})
        listed = group.column("set")
        i, j = similar_pairs([listed[int(k)].values.to_numpy() for k in once], similarity, left)
        forest = Forest(len(once))
        forest.link(i, j)
        linked = np.flatnonzero(forest.root != np.arange(len(once)))
        u, v = least_ends(fps[once], linked, forest.root[linked])
        return pa.table({"u": u, "v": v})

    return spanning(dealt.groupBy("root", "a", "b").applyInArrow(run, "u long, v long"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """One row of each class of near duplicates, all columns kept: the least id, of equal ids the least text hash.

    A class is what links of texts reach whose sets of word shingles have at least
    that Jaccard similarity.  A null id comes after all others.  Of rows equal in
    id and text one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("__text"), F.xxhash64("text").alias("hash"))

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                runs, first, whole = shingle_hashes(*text_buffer(part.column("__text")), shingle)
                n = np.diff(first)
                fps = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * WORDS, pa.int32()), pa.array(set_fingerprints(runs, first).ravel().view(np.int64)))
                columns = [part.column("doc_id"), part.column("hash"), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64)), fps]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "fp", "n", "words"])

    kept = keyed.select("doc_id", "hash").schema
    rows = written(keyed.mapInArrow(run, kept.add("fp", "long").add("n", "long").add("words", ArrayType(LongType()))))
    classes = _classes(rows, key, lambda least: shingle_links(docs, rows, least, similarity, shingle))
    chosen = classes.select("first").distinct().select("first.doc_id", "first.hash")
    chosen = written(chosen)
    stay = chosen.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    out = docs.join(stay, same, "left_semi")
    repeated = rows.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])
