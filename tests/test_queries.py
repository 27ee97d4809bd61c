"""Every registered query against its SQL on a small scale."""

import os
import re

import duckdb
import pandas as pd
import pytest
from barspark import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else re.sub(r" 00:00:00$", "", str(v))

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query(spark, sql, key):
    got = registry.QUERIES[key](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if key in registry.ORACLE_SQL:
        want = sql.execute(registry.ORACLE_SQL[key]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert [r for r in plain(got) if True] == _as(got, want)


def _as(got: pd.DataFrame, want: pd.DataFrame) -> list[tuple]:
    """The rows of ``want``; whole numbers that pandas holds as floats because of nulls are read as such on both sides."""
    for c in got.columns:
        if pd.api.types.is_float_dtype(got[c]) and pd.api.types.is_integer_dtype(want[c]):
            want[c] = want[c].astype("float64")
        elif pd.api.types.is_float_dtype(want[c]) and pd.api.types.is_integer_dtype(got[c]):
            want[c] = want[c].astype(got[c].dtype)
    return plain(want)
