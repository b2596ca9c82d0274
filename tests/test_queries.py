"""Every query with an SQL counterpart against DuckDB on the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import oracle, rows_of  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


def test_names_and_entry(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0


def test_only_needed_tables_are_read(spark, sf_dir):
    from forecourt.sources import Market

    plan = lambda *c: Market(spark, sf_dir).listings(*c)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan("price", "fuel") and "orders" not in plan("price", "manufacturer")
    assert plan("price", "state", "year").count("Join") >= 3


def test_listing_adapter_equals_its_sql(spark, sf_dir):
    from forecourt.plans.registry import LISTINGS_SQL
    from forecourt.sources import Market

    k = Market(spark, sf_dir)
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        k.table(t).createOrReplaceTempView(t)
    want, got = spark.sql(LISTINGS_SQL), k.listings()
    assert got.dtypes == want.dtypes and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
