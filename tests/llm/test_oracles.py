"""The queries with SQL give the rows of DuckDB."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from lyceum.llm import queries

DATA = "/root/testdata/sf0.01"


def plain(v):
    return ("nan" if math.isnan(v) else f"{v:.5f}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        duck.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    ours, theirs = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLES[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    a = sorted(tuple(plain(r[n]) for n in names) for r in ours.collect())
    b = sorted(tuple(plain(r[theirs.columns.index(n)]) for n in names) for r in theirs.fetchall())
    assert a == b
