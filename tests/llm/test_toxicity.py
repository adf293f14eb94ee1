import math
import random
import re

import numpy as np
import pytest

from sparkvec.llm import toxicity as t


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_automaton_equals_edit_distance():
    entries = ["idiot", "vequ*", "lowei*", "ab", "vequalo"]
    machine, inside, rng = t.compile_automaton(entries), t._letter_table(), random.Random(1)
    words = ["".join(rng.choice("idotlowevqub") for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    for base in ("idiot", "loweix", "vequa", "vequalo", "ab"):
        for _ in range(300):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                w[i : i + (kind > 0)] = [] if kind == 2 else [rng.choice("idxo")]
            words.append("".join(w) or "x")
    counts = t.hits(words, machine, inside).counts
    for w, c in zip(words, counts):
        exact = any(w.startswith(e[:-1]) if e.endswith("*") else w == e for e in entries)
        close = any((min(edits(e[:-1], w)) if e.endswith("*") else edits(w, e)[-1]) <= 1 for e in entries if len(e.rstrip("*")) >= 5)
        assert (c[1] > 0, c[3] > 0) == (exact, close and not exact), w


def test_context_windows():
    machine, inside = t.compile_automaton(["idiot"]), t._letter_table()
    got = t.hits(['He "idiot" there', "you idiot", "you idi0t", "", "they said idiot", "said a b c d e f g idiot", "x \"y\"\nidiot"], machine, inside).counts
    assert got[:, 1:5].tolist() == [[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [0, 1, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0]]


def judged(word, entries):
    """(kind, entry) of a word by plain edit distances: 1 exact, 2 misspelt; of several the longest, closed before open."""
    best = {}
    for i, e in enumerate(entries):
        stem, open_ = e.rstrip("*"), e.endswith("*")
        far = min(edits(stem, word)) if open_ else edits(stem, word)[-1]
        exact = word.startswith(stem) if open_ else word == stem
        kind = 1 if exact else 2 if far <= 1 and len(stem) >= t.FUZZY_FROM else 0
        if kind:
            best.setdefault(kind, []).append((-len(stem), open_, i))
    return next(((k, min(best[k])[2]) for k in (1, 2) if k in best), (0, -1))


def brute_score(text, model):
    """The score of a text, word by word."""
    text = (text or "").lower()
    spans = [m.span() for m in re.finditer(r"(?:[^\W_]|@)+", text)]
    kinds = [judged(text[a:b], model.entries) for a, b in spans]
    cues = [kinds[i][0] == 0 and text[a:b] in t.CUES for i, (a, b) in enumerate(spans)]
    counts, own = [0, 0, 0, 0], {}
    for i, ((a, b), (kind, entry)) in enumerate(zip(spans, kinds)):
        if not kind:
            continue
        quoted = any(c in t.MARKS for c in text[max(0, a - t.MARKS_WITHIN) : a]) and any(c in t.MARKS for c in text[b : b + t.MARKS_WITHIN])
        quoted = quoted or any(cues[max(0, i - t.CUES_WITHIN) : i + t.CUES_WITHIN + 1])
        counts[2 * (kind - 1) + quoted] += 1
        if not quoted:
            own[2 * entry + kind - 1] = own.get(2 * entry + kind - 1, 0) + 1
    n = max(len(spans), 1)
    x = [1, math.log1p(n) / 5, *map(math.log1p, counts), *(c > 0 for c in counts), *(min(20 * c / n, 3) for c in counts)]
    z = sum(a * b for a, b in zip(x, model.weights)) + sum(model.weights[t.COMMON + k] * math.log1p(v) for k, v in own.items())
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_own_budget_and_closed_stems():
    """A short entry gets no edits from a longer one, and an open one does not lead into another by the way."""
    machine, inside = t.compile_automaton(["mat", "material", "vequ*", "vequalo", "\U00010330bcdefg"]), t._letter_table()
    words = ["cat", "mit", "mat", "materal", "vqul", "vequxxxalo", "vequalo", "\U00010330bcdefg", "\U00010330bcdeg", "\U00010331bcdefg"]
    got = t.hits(words, machine, inside)
    assert got.counts[:, [1, 3]].tolist() == [[0, 0], [0, 0], [1, 0], [0, 1], [0, 0], [1, 0], [1, 0], [1, 0], [0, 1], [0, 1]]
    assert dict(zip(got.text.tolist(), (got.which // 2).tolist())) == {2: 0, 3: 1, 5: 2, 6: 3, 7: 4, 8: 4, 9: 4}


def test_states_are_dropped_and_built_again(monkeypatch):
    entries = ["idiot", "grumb*", "zwarko*"]
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("idotgrumbzwk") for _ in range(rng.randint(3, 8))) for _ in range(200)) for _ in range(20)]
    whole = t.hits(texts, t.compile_automaton(entries), t._letter_table())
    monkeypatch.setattr(t, "STATES", 3)
    machine, parts = t.compile_automaton(entries), []
    for x in texts:
        parts.append(t.hits([x], machine, t._letter_table()).counts)
    assert np.array_equal(np.concatenate(parts), whole.counts)


def test_whole_score_against_brute_force(spark, corpus, docs):
    model = t.fit(corpus[0], corpus[1])
    assert model.entries and len(model.weights) == t.COMMON + 2 * len(model.entries)
    extra = [(1, 'they said grumblek and "grumblek" is quoted'), (2, "grumblkk grumblek zwarkoabc zwrkoabc"), (3, "@grumblek idi@t")]
    rows = corpus[0].union(spark.createDataFrame(extra, "doc_id long, text string")).union(docs.select("doc_id", "text").where("length(text) < 2000 or text is null"))
    got = sorted((r.t or "", r.score) for r in t.score(rows.withColumnRenamed("text", "t").selectExpr("t", "t as text"), model, keep=("t",)).collect())
    assert len(got) == rows.count()
    for text, score in got:
        assert score == pytest.approx(brute_score(text, model), abs=1e-6), text


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "x") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    assert t._sample(docs, labels, "toxic", 8).count() <= 8
    got = t._sample(docs, labels, "toxic", 100)
    assert got.count() == labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").count()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(600):
        words, toxic = [word() for _ in range(40)], i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["grumblek", "zwarko" + word()])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, ""), (9001, None), (9002, "you grumblekk")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), rows


def test_held_out_accuracy(corpus):
    docs, labels, rows = corpus
    got = {r.doc_id: r for r in t.toxicity(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 100
    assert sum(got[i].predicted == y for i, _, y in held) / len(held) > 0.98
    assert got[9002].score > got[9000].score == got[9001].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_no_labels_nulls_and_clashes(spark, docs, clashing, corpus):
    none = corpus[1].limit(0)
    assert {r.score for r in t.toxicity(docs, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert t.toxicity(clashing, nulls).count() == docs.count()
    assert t.toxicity(docs.limit(0), corpus[1]).count() == 0
