"""Each registered query of the engine against its SQL."""

import glob
from pathlib import Path

import duckdb
import pytest

from sparkvec import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in queries.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {Path(path).stem} as select * from '{path}'")
    result = con.sql(queries.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == expected
