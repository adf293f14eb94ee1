import random

import numpy as np
import pyarrow as pa
import pytest

from sparkvec.llm import quality as q
from sparkvec.llm._words import text_buffer


def test_statistics_of_any_text():
    x = q.statistics(*text_buffer(pa.array(["", None, "one", "A!! B!!\n\nA!! B!!", "\n\n", "é " * 2000])))
    assert x.shape == (6, q.STATISTICS) and np.isfinite(x).all() and (x[0] == x[1]).all()
    alone = q.statistics(*text_buffer(pa.array(["A!! B!!\n\nA!! B!!"])))
    assert alone[0] == pytest.approx(x[3])
    assert q.statistics(*text_buffer(pa.array([None, ""]))).shape == (2, q.STATISTICS)


def test_pools_increase():
    rng = np.random.default_rng(0)
    s = rng.uniform(size=500)
    knots, values = q.pool_adjacent(s, (rng.uniform(size=500) < s).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) > 0).all() and 0 <= values[0] <= values[-1] <= 1
    assert [x.tolist() for x in q.pool_adjacent(np.array([1.0, 2.0]), np.array([1.0, 0.0]))] == [[1.5], [0.5]]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(500):
        good = i % 4 != 0
        words = [word() for _ in range(rng.randint(10, 80))]
        rows.append((i, " ".join(words) + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), (words[0] + " ") * 60]), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, ""), (9001, None)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), rows


def test_held_out_accuracy(corpus):
    docs, labels, rows = corpus
    got = {r.doc_id: r for r in q.quality(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[i].predicted == y for i, _, y in held) / len(held) > 0.95
    assert got[9000].score == got[9001].score and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in q.accepted(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r.predicted}


def test_no_labels_nulls_and_clashes(spark, docs, clashing, corpus):
    none = corpus[1].limit(0)
    assert {r.score for r in q.quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(None, 1), (1, None), (2, 1), (5, 1), (8, 1)], "doc_id long, quality int")
    assert {r.predicted for r in q.quality(clashing, one).collect()} == {1}
    assert q.accepted(clashing, one).columns == clashing.columns
    assert q.quality(docs.limit(0), corpus[1]).count() == 0


def test_held_out_rows_teach_nothing(spark, corpus):
    """Other labels of held-out rows leave every score as it was."""
    docs, labels, _ = corpus
    from pyspark.sql import functions as F

    from sparkvec.llm._util import held_out

    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in q.quality(docs, x).collect()} for x in (labels, turned))
    assert a == pytest.approx(b, abs=1e-9)
