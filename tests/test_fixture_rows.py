"""The hand-made rows: regions, flow, stock, counters, schedules, shares, diffusion."""

import datetime as dt

import pytest
from fleetcast.functions import keys as K
from fleetcast.operators import bass as B
from fleetcast.operators import flow, policy, regions, stock
from fleetcast.operators import series as S
from fleetcast.sources import readers as R
from fleetcast.sources import writers as Wr
from fleetcast.streaming import incremental as T
from fleetcast.streaming.buckets import read_buckets
from pyspark.sql import functions as F

ROWS = """A,,,11501,,1,,K1,2020-01-01
A,,,11501,,2,,K1,2020-02-01
A,,,12508,,3,,K1,2020-03-01
B,,, 6390 ,,2,,K3,2020-02-01
C,,,11701,,3,,K2,2020-03-01
C,,,11701,,1,,K2,2020-01-01
D,,,10516,,2,,K4,2020-02-01
E,,,10001,,1,,K1,2020-01-01
F,,,99999,,1,,K1,2020-01-01
G,,,,,1,,K1,2020-01-01
H,,,11501,,x,,K3,2020-01-01
I,,
,,,11501,,1,,K9,2020-01-01
J,,,11501-1234,,1,,K1,2020-01-01
K,,,11501,,07,,K5,
"""
SPEC = {"NORTH": ["NASSAU", "SUFFOLK"], "SOUTH": ["DUTCHESS", "ULSTER"]}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("rows")
    (d / "reg.csv").write_text(ROWS)
    (d / "veh.csv").write_text("﻿VIN_Key,Drivetrain_Type,Other\r\nK1,BEV,1\r\n K2 ,PHEV,1\r\nK3,GAS,1\r\nK4, ,1\r\nK5,GAS,1\r\nK5,BEV,1\r\n ,BEV,1\r\n")
    (d / "zip.csv").write_text("ZIP,County_Name\r\n11501,Nassau\r\n11701,Suffolk\r\n6390,Suffolk\r\n12508,Dutchess\r\n10001,New York\r\n11501,Again\r\n,Blank\r\n")
    (d / "over.csv").write_text("zip,region\r\n11501,NORTH\r\n11701,SOUTH\r\n10516,SOUTH\r\n10516,SOUTH\r\n")
    reg = R.flag_short_rows(R.read_registrations(spark, str(d / "reg.csv")))
    xwalk = R.read_zip_county(spark, str(d / "zip.csv"))
    zips = regions.zip_regions(xwalk, regions.regions_df(spark, SPEC), R.read_zip_region(spark, str(d / "over.csv")))
    return {"reg": reg, "veh": R.read_vehicles(spark, str(d / "veh.csv")), "xwalk": xwalk, "zips": zips, "dir": d}


def enriched(data, period):
    return regions.enrich(data["reg"], data["veh"], data["zips"], period)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_new_registrations(data):
    got = flow.new_registrations(enriched(data, "snapshot")).select("region", "snapshot_id", "new_all", "new_ev", K.fixed4(F.col("ev_share_pct")))
    assert rows(got) == [("NORTH", 1, 3, 2, "66.6667"), ("NORTH", 2, 1, 0, "0.0000"), ("NORTH", 7, 1, 1, "100.0000"), ("SOUTH", 1, 1, 1, "100.0000"), ("SOUTH", 2, 1, 0, "0.0000"), ("SOUTH", 3, 1, 1, "100.0000")]


def test_exact_stock(data):
    got = {(r.region, r.group, r.metric): r.approx_unique_vins for r in stock.stock_counts(enriched(data, "snapshot"), exact=True).collect()}
    assert got == {("NORTH", 1, "ALL"): 3, ("NORTH", 1, "EV"): 2, ("NORTH", 2, "ALL"): 2, ("NORTH", 2, "EV"): 1, ("NORTH", 3, "ALL"): 1, ("NORTH", 3, "EV"): 1, ("NORTH", 7, "ALL"): 1, ("NORTH", 7, "EV"): 1,
                   ("SOUTH", 1, "ALL"): 1, ("SOUTH", 1, "EV"): 1, ("SOUTH", 2, "ALL"): 1, ("SOUTH", 3, "ALL"): 2, ("SOUTH", 3, "EV"): 2}
    months = {(r.region, r.group, r.metric): r.approx_unique_vins for r in stock.stock_counts(enriched(data, "month"), exact=True).collect()}
    assert months[("NORTH", "2020-01-01", "ALL")] == 4 and months[("NORTH", "2020-01-01", "EV")] == 2 and months[("SOUTH", "2020-03-01", "EV")] == 2
    approx = {(r.region, r.group, r.metric): r.approx_unique_vins for r in stock.stock_counts(enriched(data, "snapshot")).collect()}
    assert approx == got


def test_sketches_merge_over_periods(data):
    merged = {(r.region, r.metric): r.approx_unique_vins for r in stock.merge_sketches(stock.stock_sketches(enriched(data, "snapshot"), 12), ["region", "metric"]).collect()}
    assert merged == {("NORTH", "ALL"): 5, ("NORTH", "EV"): 3, ("SOUTH", "ALL"): 3, ("SOUTH", "EV"): 2}


@pytest.mark.parametrize("period,bad", [("snapshot", 1), ("month", 1)])
def test_counters(data, period, bad):
    got = regions.row_outcomes(regions.classify_rows(data["reg"], data["xwalk"], data["zips"], period)).first()
    assert (got.rows_total, got.short_row, got.bad_period, got.no_zip, got.no_county, got.no_region) == (15, 1, bad, 1, 3, 3)


def test_restricted_to_spec(spark, data):
    only = regions.zip_regions(data["xwalk"], regions.regions_df(spark, {"NORTH": ["Nassau"]}), R.read_zip_region(spark, str(data["dir"] / "over.csv")), restrict_to_spec=True)
    assert rows(only) == [("11501", "NORTH")]


def test_duplicates_of_a_zip(spark, data):
    path = str(data["dir"] / "zip.csv")
    assert ("11501", "AGAIN") in rows(R.read_zip_county(spark, path, "last"))
    with pytest.raises(ValueError):
        R.read_zip_county(spark, path, "error")


def test_readers_fail_early(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    for read in (R.read_vehicles, R.read_zip_county, R.read_zip_region, R.read_calendar, R.read_price_series, R.read_price_list_series, R.read_policy):
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / "x.csv"))
    for spec in ("", "A", "A:", ":B", "A: ;B:C"):
        with pytest.raises(ValueError):
            regions.parse_regions(spec)
    assert regions.parse_regions("A: x, y ;B:z;") == {"A": ["X", "Y"], "B": ["Z"]}


def test_price_readers(spark, tmp_path):
    (tmp_path / "g.csv").write_text("date,gas_price_cents_per_gallon\n2020-02-01,200\n2020-04-01,300\nbad,1\n")
    (tmp_path / "m.csv").write_text("date,avg_msrp_ev_stock_t\n2020-02-01,x\nno,5\n2020-03-01,41000\n")
    (tmp_path / "c.csv").write_text("DMV_ID,DMV_Snapshot_Date,State\r\n1,2020-01-31,NY\r\n")
    assert rows(R.read_price_series(spark, str(tmp_path / "g.csv"))) == [(dt.date(2020, 2, 1), 2.0), (dt.date(2020, 4, 1), 3.0)]
    assert [tuple(r) for r in R.read_price_list_series(spark, str(tmp_path / "m.csv")).orderBy("date").collect()] == [(dt.date(2020, 2, 1), None), (dt.date(2020, 3, 1), 41000.0)]
    assert rows(R.read_calendar(spark, str(tmp_path / "c.csv"))) == [(1, dt.date(2020, 1, 31))]


def test_asof_and_fills(spark):
    prices = spark.createDataFrame([("2020-02-01", 2.0), ("2020-04-01", 3.0)], "date string, gas_price_t double").withColumn("date", F.to_date("date"))
    days = spark.createDataFrame([(x,) for x in ("2020-01-15", "2020-02-01", "2020-03-31", "2020-04-01", "2020-09-01")], "d string").withColumn("date", F.to_date("d")).drop("d")
    joined = S.asof_join(days, prices, "date", "date")
    assert [r.gas_price_t for r in joined.orderBy("date").collect()] == [None, 2.0, 2.0, 3.0, 3.0]
    assert [r.gas_price_t for r in policy.attach_fuel(days, prices).orderBy("date").collect()] == [2.0, 2.0, 2.0, 3.0, 3.0]
    keyed = S.asof_join(days.withColumn("k", F.lit(1)), prices.withColumn("k", F.lit(1)), "date", "date", ["k"])
    assert [r.gas_price_t for r in keyed.orderBy("date").collect()] == [None, 2.0, 2.0, 3.0, 3.0]


SCHEDULE_ROWS = """2017-03-01 7500 7500 7500 0 0.85 0 0 0 0.1
2019-01-01 3750 7500 7500 2000 0.85 0 0 0 0.1
2019-07-01 1875 3750 7500 2000 0.85 0 0 0 0.1
2021-07-01 0 0 7500 1500 0.85 0 1 0 0.1
2025-09-01 7500 7500 5250 1500 1.0 1 0 0.2 0.2
2025-10-01 0 0 0 1500 1.0 0 0 0.2 0.2
2028-01-01 0 0 0 1500 1.0 0 0 0.494444 0.2"""


def test_schedules(spark):
    expected = [line.split() for line in SCHEDULE_ROWS.splitlines()]
    df = spark.createDataFrame([(x[0],) for x in expected], "d string").withColumn("date", F.to_date("d"))
    names = ["credit_tsla", "credit_gm", "credit_other", "state_rebate_t", "delta_t", "urgency_t", "valley_dummy_t", "zev_index_t", "fed_policy_index_t"]
    got = policy.apply_schedules(df).orderBy("date").select(*names).collect()
    for row, want in zip(got, expected, strict=True):
        assert list(row) == pytest.approx([float(x) for x in want[1:]], abs=1e-6)
    credit = spark.range(1).select(policy.effective_credit(F.lit(0.85), F.lit(0.65))).first()[0]
    assert credit == pytest.approx(6712.5)
    with pytest.raises(ValueError):
        policy.effective_credit(F.lit(1.0), F.lit(1.0), lease=0.7, used=0.4)


def test_income_share_and_labels(spark):
    bins = spark.createDataFrame([(100000.0, 200000.0, 10.0), (200000.0, None, 4.0)], "lo double, hi double, single double")
    for limit, want in ((150000.0, 0.357143), (300000.0, 0.896318)):
        assert policy.eligible_share(bins, {"single": limit}).first()[0] == pytest.approx(want, abs=1e-6)
    assert policy.eligible_share(bins.limit(0), {"single": 1.0}).first()[0] is None
    table = [(1, "Nassau County", None, 0, 0, 0), (2, "Under $1", 5, 1, 2, 2), (3, "$1 under $10,000", 5, 3, None, 2), (4, "Suffolk County", None, 0, 0, 0), (5, "$200,000 or more", 1, 1, 0, 0), (6, "Total", 9, 9, 9, 9)]
    got = R.read_income_bins(spark.createDataFrame(table, "row_order int, label string, total int, single int, joint int, hoh int"))
    assert [tuple(r) for r in got.orderBy("county", "lo").collect()] == [
        ("Nassau", "Under $1", 0.0, 1.0, 1.0, 2.0, 2.0),
        ("Nassau", "$1 under $10,000", 1.0, 10000.0, 3.0, 0.0, 2.0),
        ("Suffolk", "$200,000 or more", 200000.0, None, 1.0, 0.0, 0.0),
    ]


def test_projection(spark):
    panel = spark.createDataFrame([("a", dt.date(2025, 1, 31), 100.0, 0.01)], "s string, date date, y double, pt double")
    params = spark.createDataFrame([("a", 0.01, 0.3, 1000.0)], "s string, p double, q double, M double")
    for start in ("first", "last"):
        got = B.project(panel, params, ["s"], "date", "y", 3, start).orderBy("date").collect()
        assert [r.stock_hat for r in got][1:] == pytest.approx([136, 179.8912, 232.351394848768])
        assert [r.flow_hat for r in got][1:] == pytest.approx([36, 43.8912, 52.460194848768])
        assert [r.date for r in got] == [dt.date(2025, 1, 31), dt.date(2025, 2, 28), dt.date(2025, 3, 31), dt.date(2025, 4, 30)]
    moving = spark.createDataFrame([("a", dt.date(2025, m, 1), 100.0 if m == 1 else None, p) for m, p in ((1, 0.5), (2, 0.01), (3, 0.02))], "s string, date date, y double, pt double")
    assert [r.stock_hat for r in B.project(moving, params, ["s"], "date", "y", 0, "first", "pt").orderBy("date").collect()] == pytest.approx([100, 136, 188.5312])


def test_stock_stays_below_the_market(spark):
    panel = spark.createDataFrame([(str(i), dt.date(2020, 1, 1), 10.0 * i) for i in range(1, 9)], "s string, date date, y double")
    params = panel.select("s", (F.col("y") / 1000).alias("p"), (F.lit(0.9) - F.col("y") / 1000).alias("q"), F.lit(120.0).alias("M"))
    assert B.project(panel, params, ["s"], "date", "y", 60).agg(F.max("stock_hat")).first()[0] <= 120.0 + 1e-9


def test_fit_finds_what_made_the_series(spark):
    params = spark.createDataFrame([("a", 0.01, 0.3, 1000.0)], "s string, p double, q double, M double")
    first = spark.createDataFrame([("a", dt.date(2015, 1, 1), 30.0)], "s string, date date, y double")
    made = B.project(first, params, ["s"], "date", "y", 30).where("flow_hat is not null").withColumn("f", F.col("flow_hat"))
    made = made.select("s", "date", F.col("stock_hat").alias("y"), "f").where("date > '2015-02-15'")
    fit = B.fit_bass(made, ["s"], "date", "y", "f", m_steps=16, rounds=5).first()
    grid = B.score_candidates(made, B.candidate_grid(spark, 0, 16), ["s"], "date", "y", "f", [], B.P_BOUNDS).agg(F.min("mse")).first()[0]
    assert fit.mse <= grid + 1e-9
    assert 1e-6 <= fit.p <= 0.1 and 1e-3 <= fit.q <= 2.0


def test_split_errors(spark):
    df = spark.createDataFrame([("a", dt.date(2020, m, 1)) for m in (1, 2, 3)], "s string, date date")
    S.check_split(S.train_flag(df, "date", "2020-03-01"), ["s"])
    for start in ("2020-02-01", "2021-01-01"):
        with pytest.raises(ValueError):
            S.check_split(S.train_flag(df, "date", start), ["s"])
    with pytest.raises(ValueError):
        S.since(df, "date", "2030-01-01")


def test_sinks(spark, data, tmp_path):
    counts = stock.stock_counts(enriched(data, "snapshot"), exact=True)
    Wr.write_counts(counts, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == counts.count()
    Wr.write_flow(flow.new_registrations(enriched(data, "snapshot")), f"{tmp_path}/f")
    assert ("NORTH", "1", "3", "2", "66.6667") in rows(spark.read.option("header", True).csv(f"{tmp_path}/f"))
    for tag in ("a", "b", "a"):
        Wr.write_table(counts, f"{tmp_path}/t", tag)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 * counts.count()
    Wr.write_run_summary(spark, f"{tmp_path}/s", SPEC, {"registrations": "x"}, {"rows_total": 15})
    assert "rows_total" in spark.read.json(f"{tmp_path}/s").first()["counters"]
    Wr.write_params(spark.createDataFrame([("a", 0.1, [0.5])], "s string, p double, betas array<double>"), f"{tmp_path}/p")
    Wr.write_metrics(spark.createDataFrame([("a", 0.1)], "s string, rmse double"), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/p").first()["betas"] == [0.5]


def test_stream_upsert_keeps_the_least(spark, data, tmp_path):
    write = T.upsert_min(f"{tmp_path}/u")
    batch = T.stream_first_seen(enriched(data, "snapshot"))
    write(batch.where("snapshot_id > 1"), 0)
    write(batch, 1)
    write(batch, 1)
    assert rows(read_buckets(spark, f"{tmp_path}/u", "region string, vin string, snapshot_id int")) == rows(batch)
