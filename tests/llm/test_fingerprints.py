import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkvec.llm import fingerprints as f
from sparkvec.llm._words import text_buffer

MASK = (1 << 64) - 1


def distance(a, b):
    return sum(((x ^ y) & MASK).bit_count() for x, y in zip(a, b))


def test_equal_texts_and_case():
    x = f.simhash(*text_buffer(pa.array(["a b c", "zz", "A b  c", None, "", "x", "a b c"])))
    assert (x[0] == x[2]).all() and (x[0] == x[6]).all() and not x[3].any() and not x[4].any() and x[5].any()


def test_place_in_the_buffer_does_not_matter():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 3000))) for _ in range(40)]
    together = f.simhash(*text_buffer(pa.array(texts)))
    alone = np.concatenate([f.simhash(*text_buffer(pa.array([t]))) for t in texts])
    assert (together == alone).all()


def test_edited():
    assert f.edited("abcde", "XYZ") == "abcXY" and f.edited("abcdef", "X") == "abcX" and f.edited("a", "b") == "a" and f.edited("", "b") == ""


def test_columns_against_brute_force(spark, docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in f.fingerprints(rows).collect()}
    order = sorted(((r.doc_id, r.text or "") for r in rows.collect()), reverse=True)
    assert len(got) == len(order)
    for i, (d, text) in enumerate(order):
        changed = f.edited(text, order[(i + 1) % len(order)][1])
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, other = f._of_texts([text, changed])
        assert got[d].fingerprint == "".join(f"{int(x):016x}" for x in own)
        assert got[d].near_edited == pytest.approx(1 - distance(map(int, own), map(int, other)) / f.BITS)
        assert 0 <= got[d].near_next <= 1


def test_all_rows_and_empty(spark, docs, clashing):
    assert f.fingerprints(clashing).count() == docs.count()
    assert f.fingerprints(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows", [1 << 16, 4])
@pytest.mark.parametrize("blocks", [4, 5])
def test_search_finds_all_within_the_radius(spark, bucket_rows, blocks):
    rng = np.random.default_rng(1)
    made = set()
    for base in rng.integers(0, 1 << 63, (20, 2), dtype=np.uint64):
        for _ in range(10):
            x = base.copy()
            for k in rng.integers(0, 128, rng.integers(0, 4)):
                x[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
            made.add(tuple(int(v) for v in x.view(np.int64)))
    fps = [(a, b, 1 + i % 3, i % 4 == 0) for i, (a, b) in enumerate(sorted(made))]
    df = spark.createDataFrame(fps, "hi long, lo long, n long, query boolean")
    got = {(r.hi, r.lo): r.n_near for r in f.near_counts(df, blocks=blocks, bucket_rows=bucket_rows).collect()}
    assert got == {(a, b): sum(n for c, d, n, _ in fps if distance((a, b), (c, d)) <= 3) for a, b, _, q in fps if q}
    pairs = [tuple(r) for r in f.near_pairs(df, blocks=blocks, bucket_rows=bucket_rows, bucket_queries=bucket_rows).collect()]
    assert sorted(pairs) == sorted((a, b, c, d, far) for a, b, _, q in fps if q for c, d, _, _ in fps if 0 < (far := distance((a, b), (c, d))) <= 3)
    tiled = f.near_counts(df, blocks=blocks, bucket_rows=bucket_rows, bucket_queries=2).collect()
    assert {(r.hi, r.lo): r.n_near for r in tiled} == got


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_fingerprint(text):
    """The fingerprint by plain integers, a word, a term and a bit at a time."""
    listed = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hashes = []
    for w in listed:
        h = mixed((len(w) + 0x9E3779B97F4A7C15) & MASK)
        for at in range(0, len(w), 8):
            h = mixed(((h ^ int.from_bytes(w[at : at + 8], "little")) * 0x9FB21C651E98DF25 + at + 1) & MASK)
        hashes.append(h)
    terms = Counter(mixed((2 * 0x9FB21C651E98DF25 & MASK) ^ mixed((a * 0xD6E8FEB86659FD93 & MASK) ^ b)) for a, b in zip(hashes, hashes[1:])) or Counter(hashes)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        votes = [0] * 64
        for t, tf in terms.items():
            h, weight = mixed(t ^ salt), round(16 * (1 + math.log(tf)))
            for b in range(64):
                votes[b] += weight if h >> b & 1 else -weight
        out.append(sum(1 << b for b in range(64) if votes[b] > 0))
    return tuple(out)


def test_whole_output_against_plain_integers(spark, docs):
    rows = docs.where("doc_id is not null and (length(text) < 500 or text is null)").dropDuplicates(["doc_id"])
    order = sorted(((r.doc_id, r.text or "") for r in rows.collect()), reverse=True)
    got = {r.doc_id: r for r in f.fingerprints(rows).collect()}
    hexed = lambda fp: "".join(f"{x:016x}" for x in fp)
    for i, (d, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        own, changed, then = (plain_fingerprint(x) for x in (text, f.edited(text, after), after))
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (hexed(own), hexed(changed))
        assert got[d].near_edited == pytest.approx(1 - distance(own, changed) / 128) and got[d].near_next == pytest.approx(1 - distance(own, then) / 128)
