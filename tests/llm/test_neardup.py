import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkvec.llm import neardup as nd
from sparkvec.llm.components import components


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, radius=3):
    root = list(range(len(values)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_rows_against_brute_force(spark, docs, clashing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    values = [fingerprint(t) for _, t in rows]
    group = classes(values)
    least = {g: min((d for (d, _), x in zip(rows, group) if x == g and d is not None), default=None) for g in group}
    expected = sorted(repr((d, f"{v:016x}", least[g])) for (d, _), v, g in zip(rows, values, group))
    assert sorted(repr(tuple(r)) for r in nd.near_duplicates(clashing).collect()) == expected
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_more_hashes_than_a_byte_counts():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    first = np.array([0, 0, 1, 256, 511, 5000, 5000])
    expected = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a:z]) > z - a) for a, z in zip(first, first[1:])]
    assert nd.majority_bits(h, first).tolist() == expected


@pytest.mark.parametrize("unit_rows", [1 << 16, 32, 4])
def test_trie_links_equal_all_pairs(spark, unit_rows):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 80, dtype=np.uint64) << np.uint64(1)
    near = np.repeat(values[:20], 20)
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)) * rng.integers(0, 2, len(near)).astype(np.uint64)
    values = np.unique(np.concatenate([values, near, [np.uint64(0), np.uint64(7), np.uint64(2**64 - 1)]]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components(nd.fingerprint_links(df, 3, unit_rows, unit_rows)).collect()}
    mine = [got.get(int(v), int(v)) for v in values.view(np.int64)]
    expected = classes([int(v) for v in values])
    pairs = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}
    assert pairs(mine) == pairs(expected)


def test_turned_blocks_keep_the_bits(spark):
    """Copies are rotations of what follows the leading bits, each with another block in front."""
    rng = np.random.default_rng(4)
    values = [int(v) for v in rng.integers(0, 2**64, 20, dtype=np.uint64)] + [0, 2**64 - 1]
    signed = lambda v: v - 2**64 if v >> 63 else v
    for depth in (0, 16, 28, 37):
        units = spark.createDataFrame([(0, depth, signed(v), signed(v)) for v in values], "path long, depth int, turned long, fp long")
        got = nd.block_copies(units, 3).collect()
        assert len(got) == 4 * len(values)
        for r in got:
            v, i, free = r.fp % 2**64, r.path, 64 - depth
            at, to = free * i // 4, free * (i + 1) // 4
            rest = v % 2**free
            turned = (rest << at | rest >> (free - at)) % 2**free if at else rest
            assert r.depth == depth + to - at and r.turned % 2**64 == (v >> free << free) + turned


@pytest.mark.parametrize("rows", [1000, 200_000])
def test_copies_do_not_grow_with_the_count(spark, rows):
    fps = spark.range(rows).selectExpr("xxhash64(id) as fp")
    units = nd.block_copies(fps.selectExpr("0L as path", "0 as depth", "fp as turned", "fp"), 3)
    assert units.count() == 4 * rows


def test_components_chains_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (60, 50), (50, 60), (60, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50}


def test_one_of_each_class_stays(spark, docs, clashing):
    kept = nd.deduplicated(clashing)
    assert kept.columns == clashing.columns
    assert sorted(repr((r.doc_id, bool(r.text))) for r in kept.collect()) == sorted(map(repr, [(1, True), (3, False), (5, True), (6, True), (7, True), (None, True), (8, True)]))


def jaccard(a, b):
    """Similarity of the sets of five-word shingles."""
    sets = []
    for text in (a, b):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("block", [512, 7])
def test_edited_copies_go_and_clean_documents_stay(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 8):
            copy = list(base)
            for i in rng.choice(120, edits, replace=False):
                copy[i] = "edited"
            texts.append(" ".join(copy))
    texts += ["one two three", "One two  three", "one two four", "a b c d e f", "a b c d e g", None, ""]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    expected = [i for i in range(len(texts)) if find(i) == i]
    assert 20 < len(expected) < len(texts) - 15
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in nd.deduplicated(df).collect()) == expected


def test_stage_goes_through_the_tries(spark, monkeypatch):
    """What the tries over the fingerprints do not link stays, edited copy or not; what they link is found at 0.8."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 9000, 94)]
        texts += [" ".join(base), " ".join(base[:47] + ["edited"] + base[48:])]
    assert 0.8 <= jaccard(*texts[:2]) < 0.95
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in nd.deduplicated(df).collect()) == list(range(0, 80, 2))
    real = nd.word_links
    monkeypatch.setattr(nd, "word_links", lambda rows, n: real(rows, n).limit(0))
    assert nd.deduplicated(df).count() == 80


@pytest.mark.parametrize("copies", [60, 240])
def test_links_of_a_large_group_stay_in_proportion(spark, monkeypatch, copies):
    """The rounds that connect a group get about one link for each text of it, not one for each word and block that finds it."""
    monkeypatch.setattr(nd, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 9000, 200)]
    texts = [" ".join(base[:i] + [f"edit{k}"] + base[i + 1 :]) for k, i in enumerate(rng.integers(0, 200, copies))]
    given = []

    def counted(links):
        links = nd.written(links)
        given.append((links.distinct().count(), links.select("u").union(links.select("v")).distinct().count()))
        return components(links)

    monkeypatch.setattr(nd, "components", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in nd.deduplicated(df).collect()] == [0]
    assert len(given) == 2
    assert all(ends == copies and links < 3 * ends for links, ends in given)


@pytest.mark.parametrize("pooled", [1 << 18, 1])
def test_spanning_links_have_the_same_components(spark, monkeypatch, pooled):
    monkeypatch.setattr(nd, "POOLED_LINKS", pooled)
    rng = np.random.default_rng(9)
    rows = rng.integers(-60, 60, (90, 2)).tolist()
    rows = [*rows * 5, (7, 7), (None, 3), (3, None), (1000, 2000), (2000, 1000), (-(2**63), 2**63 - 1)]
    links = spark.createDataFrame([tuple(r) for r in rows], "u long, v long").repartition(3)
    thin = nd.spanning(links)
    named = lambda df: sorted(map(tuple, components(df).collect()))
    assert named(thin) == named(links)
    assert all(r.u > r.v for r in thin.collect()) and thin.count() < 200
    assert nd.spanning(links.limit(0)).count() == 0


def test_bits_of_pairs_at_the_similarity():
    """Pairs at 0.8, their repeated shingles beside: each shares a block in some word, and none is over a budget there."""
    rng = np.random.default_rng(7)
    for n in (4, 9, 90, 900):
        for _ in range(20):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = a[: max(n - n // 9, 4)]
            b = np.concatenate([b, rng.integers(0, 2**64, max(1, n - len(b)), dtype=np.uint64)])
            x, y = nd.set_fingerprints(np.concatenate([a, a[:3], b]), np.array([0, n + 3, n + 3 + len(b)]))
            far = x ^ y
            found = 0
            for nth in range(nd.WORDS):
                bits = [int(far[(nth + i) % nd.WORDS]).bit_count() for i in range(3)]
                free = any(int(far[nth]) >> 64 - 64 * (i + 1) // 5 & (1 << 64 * (i + 1) // 5 - 64 * i // 5) - 1 == 0 for i in range(5))
                found += free and bits[0] <= nd.WORD_BUDGET and sum(bits) <= nd.BUDGET
            assert found
