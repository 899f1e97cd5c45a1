"""Every registered query against its twin, and the shape of its plan and of every plan that it writes on the way."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["park", "species", "cell", "count", "rank"]


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def look_at(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name, monkeypatch):
    write = DataFrameWriter.parquet

    def looked_at(self, *args, **kwargs):
        look_at(self._df)
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", looked_at)
    df = QUERIES[name](spark, SF)
    look_at(df)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows_of(cols, cur.fetchall())
