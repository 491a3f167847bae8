"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from spanloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    return repr(round(float(value), 6)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in found.fetchall())
    have = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert have == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_flatzip_of_a_very_long_item(spark, tmp_path):
    from spanloom.plans import array_queries

    spark.createDataFrame([(1, "a " * 100_003)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert array_queries.flatzip(spark, str(tmp_path)).count() == 100_002
