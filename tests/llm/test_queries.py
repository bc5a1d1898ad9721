"""The registered queries of the operators that SQL expresses, against DuckDB."""

import duckdb
import pytest

from machlog.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got and got == want
