"""Every registered query with SQL against DuckDB, where the tables are there."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_agrees_with_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(SF_DIR))
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, found.fetchall())
