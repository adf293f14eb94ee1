import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkvec.llm import decontaminate as dc
from sparkvec.llm._words import ALNUM, text_buffer, words
import pyarrow as pa


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    found = {}
    for name, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for text in texts:
        w, hit, names = split(text), set(), set()
        for n in {len(p) for p in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    names |= found[tuple(w[i : i + n])]
                    hit |= set(range(i, i + n))
        out.append((len(w), hit, names))
    return out


LINE = st.lists(st.sampled_from(["a", "B", "c1", "é", "日", ".", "a-b"]), max_size=25).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(LINE, min_size=1, max_size=4), st.lists(LINE, max_size=4), st.integers(1, 4))
def test_search_equals_brute_force(texts, items, window):
    items = [(str(i), t) for i, t in enumerate(items)]
    w = words(*text_buffer(pa.array(texts, pa.string())), ALNUM, lower=True)
    compiled = dc.compile_patterns(items, window)
    starts, ends, which, found = dc.search(w, compiled)
    names = [set() for _ in starts]
    for i, x in zip(which, found):
        names[i].add(compiled[0].names[x])
    for d, (n, hit, expected) in enumerate(brute(texts, items, window)):
        a, b = w.first[d], w.first[d + 1]
        mine = [(s - a, e - a, x) for s, e, x in zip(starts, ends, names) if a <= s < b]
        assert b - a == n and {i for s, e, _ in mine for i in range(s, e)} == hit and {y for _, _, x in mine for y in x} == expected


def test_equal_hashes_are_told_apart(monkeypatch):
    """All windows of one hash: only the words decide."""
    flat = lambda h, n, seed=0: np.zeros(max(0, len(h) - n + 1), np.uint64)
    monkeypatch.setattr(dc, "sequence_hashes", flat)
    monkeypatch.setattr(dc, "_block_at", lambda w, at, size: np.zeros(len(at), np.uint64))
    items = [("a", "one two three four"), ("b", "two three four five"), ("c", "one two three")]
    texts = ["x one two three y", "three four five", "two three five", "two three four"]
    w = words(*text_buffer(pa.array(texts, pa.string())), ALNUM, lower=True)
    compiled = dc.compile_patterns(items, 3)
    assert len(compiled) == 1 and len(compiled[0].first) == 3
    starts, ends, which, found = dc.search(w, compiled)
    assert sorted(zip(starts[which].tolist(), compiled[0].names[found].tolist())) == [(1, "a"), (1, "c"), (5, "b"), (11, "a"), (11, "b")]


ITEMS = [(1, "quick brown fox jumps over the lazy dog and then it runs"), (2, "word"), (3, None), (4, "..."), (None, "日本"), (2, "word")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 10])
def test_rows_blocks_and_repeats(spark, docs, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.report(dc.contamination(docs, items, block_bytes=block_bytes)).collect()
    rows = docs.collect()
    expected = brute([r.text for r in rows], [("" if i is None else str(i), t) for i, t in ITEMS])
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items)) for r in got) == sorted(repr((r.doc_id, n, len(h), len(x))) for r, (n, h, x) in zip(rows, expected))


def test_filter_keeps_clean_rows_and_columns(spark, docs, clashing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = dc.decontaminated(clashing, items)
    assert left.columns == clashing.columns
    assert sorted(repr(r.doc_id) for r in left.collect()) == sorted(repr(x) for x in [3, 4, 7, None, None])
    assert dc.decontaminated(docs, items.limit(0)).count() == docs.count()
    assert dc.contamination(docs.limit(0), items).count() == 0
