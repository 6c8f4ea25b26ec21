"""Policy tables of several scenarios: keyed prices and schedules, defaults, bounds."""

import datetime as dt

import pytest
from fleetcast.operators import policy, series
from fleetcast.operators.scenarios import policy_scenario_table
from pyspark.sql import functions as F

FIRST, LAST = "2021-01-01", "2024-12-01"


def prices(spark, name, rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), v) for s, d, v in rows], f"scenario string, date date, {name} double")


def test_one_scenario_is_the_plain_table(spark):
    gas, msrp = [("a", "2021-03-10", 3.0), ("a", "2022-01-01", None), ("a", "2022-05-01", 4.0)], [("a", "2022-02-02", 40_000.0)]
    plain = policy.policy_table(series.month_calendar(spark, FIRST, LAST), prices(spark, "gas_price_t", gas).drop("scenario"), prices(spark, "avg_msrp_ev_stock_t", msrp).drop("scenario"))
    rows = spark.createDataFrame([("a",)], "scenario string")
    found = policy_scenario_table(rows, FIRST, LAST, prices(spark, "gas_price_t", gas), prices(spark, "avg_msrp_ev_stock_t", msrp))
    names = ["date", "gas_price_t", "avg_msrp_t", "fed_credit_avg_t", "state_rebate_t", "total_subsidy_t", "subsidy_share_t", "zev_index_t", "tco_adv_t"]
    want = sorted(tuple(r) for r in plain.select(*names).collect())
    got = sorted(tuple(r) for r in found.select(*names).collect())
    assert len(got) == 48 and [r[0] for r in got] == [r[0] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[1:] == pytest.approx(b[1:], rel=1e-12)


def test_scenarios_don_t_mix(spark):
    """Each takes its own prices and steps; one without any takes the constants; steps of unknown scenarios change nothing."""
    rows = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 1.0)], "scenario string, lease double")
    gas = prices(spark, "gas_price_t", [("a", "2022-01-01", 2.8), ("b", "2022-01-01", 5.6), ("x", "2021-01-01", 99.0)])
    steps = [("b", "state_rebate_t", None, "2022-01-01", 1.0), ("b", "state_rebate_t", "2023-06-15", None, 2.0), ("x", "state_rebate_t", None, None, 9.0), ("c", "delta_t", None, None, 0.0)]
    schedule = spark.createDataFrame(steps, "scenario string, name string, f string, t string, value double").select("scenario", "name", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"), "value")
    t = policy_scenario_table(rows, FIRST, LAST, gas, None, schedule, ("state_rebate_t", "delta_t"))
    by = {}
    for r in t.collect():
        by.setdefault(r.scenario, {})[r.date.isoformat()] = r
    assert {k: len(v) for k, v in by.items()} == {"a": 48, "b": 48, "c": 48}
    assert {r.gas_price_t for r in by["a"].values()} == {2.8} and {r.gas_price_t for r in by["b"].values()} == {5.6} and {r.gas_price_t for r in by["c"].values()} == {3.5}
    assert by["b"]["2021-12-01"].state_rebate_t == 1.0 and by["b"]["2023-06-01"].state_rebate_t == by["a"]["2023-06-01"].state_rebate_t and by["b"]["2023-07-01"].state_rebate_t == 2.0
    assert {r.delta_t for r in by["c"].values()} == {0.0} and by["c"]["2024-01-01"].total_subsidy_t == by["c"]["2024-01-01"].state_rebate_t
    assert by["a"]["2023-01-01"].fed_credit_avg_t == pytest.approx(0.5 * 7500 + 0.5 * 7500 * 0.85) and by["b"]["2023-01-01"].fed_credit_avg_t == pytest.approx(0.3 * 7500 + 0.7 * 7500 * 0.85)


@pytest.mark.parametrize("bad", [("a", 0.8, 0.3), ("a", -0.1, 0.0), ("a", 0.0, 1.2)])
def test_shares_out_of_bounds(spark, bad):
    rows = spark.createDataFrame([bad], "scenario string, lease double, used double")
    with pytest.raises(Exception, match="out of bounds"):
        policy_scenario_table(rows, FIRST, LAST, None, None).collect()


def test_no_scenarios(spark):
    assert policy_scenario_table(spark.createDataFrame([], "scenario string"), FIRST, LAST, None, None).collect() == []


def test_a_schedule_row_without_a_name(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 5),)], "date date")
    steps = spark.createDataFrame([(None, None, None, 1.0), ("x", None, None, 2.0)], "name string, valid_from date, valid_to date, value double")
    row = policy.apply_schedule(days, steps).first()
    assert row.x == 2.0 and set(row.asDict()) == {"date", "x"}
