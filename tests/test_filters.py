import json

import pytest
from pyspark.sql import functions as F

from sparkvec.plans.filters import compile_filter

STORED = [{"a": 1}, {"a": 1.0}, {"a": True}, {"a": "1"}, {"a": None}, {}, {"a": {"x": [1, 2], "y": "é"}}, {"a": 0}, {"a": False}, {"a": 2.5, "b": "z"}, {"it's": 1}]


@pytest.mark.parametrize("wanted", [{"a": 1}, {"a": 1.0}, {"a": True}, {"a": "1"}, {"a": None}, {"a": {"y": "é", "x": [1, 2]}}, {"a": 0}, {"a": 2.5, "b": "z"}, {"a": 2.5, "b": "q"}, {"it's": 1}, {"a": {"$gte": 1}}, {"b": None}])
def test_equality_of_each_kind(spark, wanted):
    rows = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(STORED)], "i int, m string").withColumn("metadata", F.parse_json("m"))
    got = {r.i for r in rows.where(compile_filter(wanted)).collect()}
    assert got == {i for i, m in enumerate(STORED) if all(m.get(k) == v for k, v in wanted.items())}


def test_no_filter():
    assert compile_filter({}) is None and compile_filter(None) is None
