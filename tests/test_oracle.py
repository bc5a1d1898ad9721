"""Every registered query against its DuckDB oracle (the driver's check,
run here at sf0.001): same column names, row count and values."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from machlog import catalog

SF = os.environ.get("MACHLOG_TEST_SF", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# The library's own queries; those of the training-data operators have their tests beside them.
QUERIES = {n: f for n, f in entry.queries().items() if n in catalog.QUERIES}
ORACLE = {n: q for n, q in entry.oracle_sql().items() if n in catalog.QUERIES}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_is_registered():
    ids = {name.split("_")[0] for name in QUERIES}
    expected = ({f"I{i}" for i in range(1, 10)} | {f"A{i}" for i in range(1, 26)}
                | {f"B{i}" for i in range(1, 29)} | {f"E{i}" for i in range(1, 15)}
                | {f"K{i}" for i in range(1, 13)})
    assert expected <= ids
    assert set(QUERIES) == set(ORACLE)


SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


FORBIDDEN_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                   "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _assert_plan_clean(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in FORBIDDEN_NODES if n in plan], plan


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(_norm(r[c]) for c in cols) for r in df.collect())
    _assert_plan_clean(df)  # final AQE plan: no cross / nested-loop joins, no Python
    assert got, "empty result: the comparison would hold vacuously"
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    spark_types = {f.name: SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == dict(zip(rel.columns, [str(t) for t in rel.types]))
    idx = [rel.columns.index(c) for c in cols]
    want = sorted("|".join(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["A20_three_state_totals", "A24_four_state_totals"])
def test_log_is_scanned_once(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and final.count("FileScan parquet") == 1, plan


def test_entry_smoke(spark):
    out = entry.entry(spark).collect()
    assert {r["state"] for r in out} >= {"True Idle (Off)"}
