"""Tables in buckets of the VIN: no shuffle of their rows, only the folders of the periods asked for."""

import re

import pytest
from fleetcast.operators import flow, stock
from fleetcast.plans import layout
from pyspark.sql import functions as F

SCHEMA = "region string, vin string, period int, vin_key string, is_ev boolean"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"r{i % 3}", str(i * 13 % 70), i % 9, "k", i % 4 == 0) for i in range(600)] + [("r0", "", 2, None, False)]
    frame = spark.createDataFrame(rows, SCHEMA)
    name = layout.write_by_vehicle(frame, 4)
    yield frame, name
    spark.sql(f"drop table {name}")


def plan(df):
    """The plan that ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0]


def rows(df):
    return sorted(map(str, df.collect()))


def test_results_are_the_same(spark, table):
    frame, name = table
    staged = layout.read_by_vehicle(spark, name)
    for f in (flow.first_seen, flow.vehicle_ev_flag, flow.new_registrations, lambda x: stock.stock_counts(x, exact=True)):
        assert rows(f(staged)) == rows(f(frame))


@pytest.mark.parametrize("f,exchanges", [(flow.first_seen, 0), (flow.vehicle_ev_flag, 0), (flow.new_registrations, 1), (lambda x: stock.stock_counts(x, exact=True), 1)])
def test_rows_are_not_shuffled(spark, table, f, exchanges):
    """First-seen rows and flags need no exchange, nor does the join of both; counts by region and period need one, of few rows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(f(layout.read_by_vehicle(spark, table[1])))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Exchange hashpartitioning", text)) == exchanges
    assert not re.search(r"Exchange hashpartitioning\([^)]*vin", text)


def test_periods_are_pruned(spark, table):
    frame, name = table
    part = layout.read_by_vehicle(spark, name, 3, 4)
    assert rows(flow.first_seen(part)) == rows(flow.first_seen(frame.where("period between 3 and 4")))
    scanned = {re.search(r"period=(\d+)", f).group(1) for f in part.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert scanned == {"3", "4"} and "PartitionFilters: [isnotnull(period" in plan(part)


def test_one_file_for_each_bucket_and_period(spark, table):
    files = layout.read_by_vehicle(spark, table[1]).inputFiles()
    by_period = {}
    for f in files:
        by_period.setdefault(re.search(r"period=(\d+)", f).group(1), []).append(f)
    assert len(by_period) == 9 and max(map(len, by_period.values())) <= 4
