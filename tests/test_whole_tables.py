"""Queries over whole tables against their SQL twins, beside those whose SQL asks for a part."""

import __spark_entry__
import duckdb
import pytest

from tests.test_queries import SF, TABLES, normal


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["asof_by_key", "policy_scenarios", "scenario_projection", "stock_with_counters", "ingest_files", "stream_stock", "stream_first_arrival"])
def test_equals_sql(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    rows = found.fetchall()
    assert rows and sorted(columns) == sorted(got.columns)
    assert normal(got.select(*columns).collect(), range(len(columns))) == normal(rows, range(len(columns)))


def test_nothing_is_left_out(spark):
    queries = __spark_entry__.queries()
    assert queries["asof_by_key"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    scenarios = {r.scenario: r.n for r in queries["scenario_projection"](spark, SF).groupBy("scenario").count().withColumnRenamed("count", "n").collect()}
    assert set(scenarios) == {"base", "slow"} and scenarios["base"] == scenarios["slow"]
    assert queries["policy_scenarios"](spark, SF).select("date").distinct().count() == 432
