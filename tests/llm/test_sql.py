"""Queries that have SQL, against it."""

import duckdb
import pytest

from spanloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, (dict(sorted(zip(columns, r, strict=True))) for r in found.fetchall())))
    have = sorted(map(str, (dict(sorted(r.asDict().items())) for r in queries.queries()[name](spark, sf_dir).collect())))
    assert have == want


def test_all_operators_are_registered():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
