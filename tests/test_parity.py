"""Every query with a DuckDB counterpart gives the same rows."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from lyceum import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    ours = rows_of(found.columns, [tuple(r) for r in found.collect()])
    other = duck.sql(SQL[name])
    theirs = rows_of(other.columns, other.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b][:5] == []


def test_every_query_is_callable(spark):
    assert set(SQL) <= set(catalog.queries())
    assert "s1_roster_progress" in SQL
