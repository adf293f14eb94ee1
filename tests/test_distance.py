import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.functions import distance as d

PAIRS = [([1.0, 2.0], [3.0, 5.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([2.0, 2.0], [2.0, 2.0])]
EXPECTED = {"l2": [13.0, 2.0, 4.0, 0.0], "ip": [-13.0, 0.0, 1.0, -8.0], "cosine": [1 - 13 / np.sqrt(5 * 34), 1.0, 2.0, 0.0]}


@pytest.mark.parametrize("metric", d.METRICS)
def test_values(spark, metric):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "i int, a array<float>, b array<float>").orderBy("i")
    got = [r[0] for r in rows.select(d.distance(metric, F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx(EXPECTED[metric])
    to = [rows.where(F.col("i") == i).select(d.distance_to(metric, F.col("a"), b)).first()[0] for i, (_, b) in enumerate(PAIRS)]
    assert to == pytest.approx(EXPECTED[metric])
    a, b = (np.array([p[i] for p in PAIRS]) for i in (0, 1))
    assert d.paired(metric, a, b) == pytest.approx(EXPECTED[metric])
    assert np.diag(d.pairwise(metric, a, b)) == pytest.approx(EXPECTED[metric])


def test_long_vectors_take_the_same_value(spark):
    x = [0.5] * (d.UNROLL + 1)
    rows = spark.createDataFrame([(x,)], "a array<float>")
    assert rows.select(d.distance_to("l2", F.col("a"), [0.0] * len(x))).first()[0] == pytest.approx(0.25 * len(x))


def test_unknown_metric():
    with pytest.raises(ValueError):
        d.check_metric("manhattan")


def test_similarity(spark):
    row = spark.range(1).select(d.similarity(F.lit(1.5)).alias("a"), d.similarity(F.lit(1.5), clamp=True).alias("b")).first()
    assert (row.a, row.b) == (-0.5, 0.0)
