"""Every query with an SQL twin against DuckDB; the stream against its batch."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from trialweave.flow_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def cells(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("~" if r[i] is None else f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got.collect(), got.columns) == cells(want.fetchall(), want.columns)


def test_rest(spark):
    for name in QUERIES.keys() - ORACLE_SQL.keys():
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
