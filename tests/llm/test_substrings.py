import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.llm import substrings as s


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, window):
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = split(t)
        cut = {j for i in range(len(w) - window + 1 if d is not None else 0) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in cut)
        out.append((d, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted((tuple(r) for r in s.report(df).collect()), key=repr)


def test_edge_rows(spark, docs, clashing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert digest(s.without_repeats(clashing, filter_bits=20)) == brute(rows, 13)
    assert s.without_repeats(docs.limit(0), filter_bits=20).count() == 0


def test_random_passages_copies_and_loops(spark):
    rng = random.Random(5)
    passages = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(30)) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    rows = []
    for d in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice([rng.choice(passages), [f"u{rng.randrange(10**9)}" for _ in range(20)], ["x", "y"] * 9])
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 3)]  # whole copies
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert digest(s.without_repeats(df, filter_bits=16)) == brute(rows, 13)
    # A filter that lets everything pass changes nothing.
    assert digest(s.without_repeats(df, window=5, run=3, filter_bits=7)) == brute(rows, 5)


@pytest.mark.parametrize("part", [0, 1])
def test_windows_that_share_one_hash(spark, monkeypatch, part):
    """Windows are keyed by both hashes: with one of them forced equal, results stay."""
    real, longest = s.window_hashes, 13

    def forced(h, n):
        forced.calls = getattr(forced, "calls", -1) + (n == longest)
        return real(h, n) & np.uint64(0x8000000080000001) if n == longest and forced.calls % 2 == part else real(h, n)

    monkeypatch.setattr(s, "window_hashes", forced)
    rng = random.Random(8)
    shared = [[f"p{i}w{j}" for j in range(20)] for i in range(6)]
    rows = [(d, " ".join([f"u{d}"] * 3 + rng.choice(shared) + [f"v{d}"] * 3 + rng.choice(shared))) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = digest(s.without_repeats(df, filter_bits=16))
    assert got == brute(rows, 13)


def test_spans_name_their_source(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(["q"] * 3 + base[5:30])), (3, " ".join(base))]
    spans = {r.doc_id: r.spans for r in s.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), filter_bits=16).collect()}
    assert set(spans) == {2, 3}
    assert [(x.start, x.end, x.source_doc, x.source_start) for x in spans[2]] == [(3, 28, 1, 5)]
    assert [(x.start, x.end, x.source_doc) for x in spans[3]] == [(0, s.ALL, 1)]


def test_rows_of_one_id(spark):
    ab, cd = " ".join("abcdefghijklmnopqrst"), " ".join("ABCDEFGHIJKLMNOPQRST")
    rows = [(1, ab), (2, ab), (2, "zz " + cd), (2, "zz " + cd), (2, f"{cd} {ab}"), (3, cd), (3, "q"), (None, ab)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(s.without_repeats(df, filter_bits=16)) == brute(rows, 13)


def test_paths_are_unbranched_and_longest(spark):
    """Against a plain walk over the edges: paths of odd and even starts, cut where a document branches, ends or begins."""
    rng = random.Random(11)
    long = [f"w{i}" for i in range(300)]
    cuts = [sorted(rng.sample(range(300), 2)) for _ in range(25)]
    rows = [(0, " ".join(long))] + [(d + 1, " ".join([f"u{d}", *long[x:y], f"v{d}"][d % 2 : 3 + y - x - d % 3])) for d, (x, y) in enumerate(cuts)]
    places = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - 12):
            places.setdefault(tuple(w[i : i + 13]), []).append((d, i, w[i - 1] if i else None, w[i + 13] if i + 13 < len(w) else None))
    edges = {min(v)[:2]: v for v in places.values() if len({p[0] for p in v}) > 1}
    on = {k: len({p[3] for p in v}) == 1 and v[0][3] is not None for k, v in edges.items()}
    back = {k: len({p[2] for p in v}) == 1 and v[0][2] is not None for k, v in edges.items()}
    expected = []
    for d, i in sorted(edges):
        if (d, i - 1) in edges and on[d, i - 1] and back[d, i]:
            expected[-1][2] = i + 1
        else:
            expected.append([d, i, i + 1])
    ids = {k: n for n, k in enumerate(sorted(edges))}
    df = spark.createDataFrame([(ids[k], 0, k[0], k[1], k[1] + 1, back[k], on[k]) for k in edges], "edge long, check int, source_doc_id long, start int, end int, before boolean, after boolean")
    paths, _ = s.compacted(df, ["source_doc_id"])
    got = sorted([r.source_doc_id, r.start, r.end] for r in paths.collect())
    assert got == expected and any(e - i > 1 for _, i, e in got)
    assert digest(s.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), filter_bits=16)) == brute(rows, 13)


def test_spans_with_other_words_than_their_source_stay(spark, monkeypatch):
    """Where both hashes of all windows agree, the words at the source coordinates tell spans apart."""
    real = s.window_hashes
    monkeypatch.setattr(s, "window_hashes", lambda h, n: real(h, n) & np.uint64(0) if n == 13 else real(h, n))
    rows = [(1, " ".join(f"a{i}" for i in range(13))), (2, " ".join(f"b{i}" for i in range(13))), (3, " ".join(f"a{i}" for i in range(13)) + " "), (4, " ".join(f"b{i}" for i in range(13)) + " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    removed = {r.doc_id: r.n_removed for r in s.without_repeats(df, filter_bits=16).collect()}
    assert removed == {1: 0, 2: 0, 3: 13, 4: 0}


def test_compaction_takes_as_many_steps_for_any_length(spark):
    """A path of 5,000 edges writes as many tables as one of 4."""
    made = []
    for n in (4, 5000):
        edges = spark.range(n).selectExpr("id as edge", "0 as check", "7L as source_doc_id", "cast(id as int) as start", "cast(id as int) + 1 as end", "id > 0 as before", f"id < {n - 1} as after")
        paths, tables = s.compacted(edges, ["source_doc_id"])
        assert [(r.edge, r.source_doc_id, r.start, r.end) for r in paths.collect()] == [(0, 7, 0, n)]
        made.append(len(tables))
    assert made[0] == made[1]


@pytest.mark.parametrize("shift", [-(1 << 32), (1 << 32) - 10, 1 << 61])
def test_ids_of_any_size(spark, shift):
    """Ids that leave the bits of a place in a long, just do not, and do not."""
    base = [f"w{i}" for i in range(40)]
    rows = [(shift + 3, " ".join(base[4:30])), (shift, " ".join(base)), (shift + 8, " ".join(["q", *base[:20], "q"])), (shift + 12, " ".join(base[20:] + base[:13]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(s.without_repeats(df, filter_bits=16)) == brute(rows, 13)
