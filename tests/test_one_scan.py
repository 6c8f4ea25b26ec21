"""Counters observed in the scan that makes the stock, and files staged once."""

from fleetcast.operators import regions, stock
from fleetcast.plans import standin as D
from fleetcast.sources import ingest, writers

from tests.test_queries import SF


def test_one_scan_gives_stock_and_counters(spark, tmp_path):
    args = D.vehicles(spark, SF), D.crosswalk(spark, SF), D.zips(spark, SF), "snapshot", D.EV_TYPES
    rows, seen = regions.enrich_and_count(D.registrations(spark, SF), *args)
    counts = stock.stock_counts(rows, exact=True)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and plan.count("CollectMetrics") == 1
    assert sum("l_orderkey" in line and "Relation" in line for line in plan.splitlines()) == 1
    got = sorted(tuple(r) for r in counts.collect())
    assert got == sorted(tuple(r) for r in stock.stock_counts(D.enriched(spark, SF), exact=True).collect())
    classified = regions.classify_rows(D.registrations(spark, SF), D.crosswalk(spark, SF), D.zips(spark, SF), "snapshot")
    assert seen.get == regions.row_outcomes(classified).first().asDict()
    writers.write_run_summary(spark, str(tmp_path / "summary"), {"r": ["C"]}, {"in": "x"}, seen.get)
    assert f'"rows_total": {seen.get["rows_total"]}' in spark.read.json(str(tmp_path / "summary")).first()["counters"]


def test_counters_of_no_rows(spark):
    rows, seen = regions.enrich_and_count(D.registrations(spark, SF).where("false"), D.vehicles(spark, SF), D.crosswalk(spark, SF), D.zips(spark, SF), "month")
    assert rows.count() == 0 and set(seen.get.values()) <= {0}


def test_files_are_taken_once(spark, tmp_path):
    folder, target = tmp_path / "in put", str(tmp_path / "staged")
    folder.mkdir()
    line = "V{},2020-01-01,2021-01-01,11701,36103,7,NY,K{},2020-01-01\n"
    (folder / "a.csv").write_text("".join(line.format(i, i) for i in range(5)) + "V9,short\n")
    (folder / "b.csv").write_text(line.format(1, 1) + line.format(2, 2).strip() + ",more,fields\n" + '"V,3",x,y,"1,2",z,8,NY,K,2020\n')
    assert ingest.ingest_registrations(spark, str(folder / "a.csv"), target) == 1
    assert ingest.ingest_registrations(spark, str(folder / "*.csv"), target) == 1
    assert ingest.ingest_registrations(spark, str(folder), target) == 0
    (folder / "c.csv").write_text(line.format(8, 8))
    assert ingest.ingest_registrations(spark, [str(folder / "b.csv"), str(folder / "c.csv")], target) == 1
    staged = ingest.read_staged(spark, target)
    got = {r.file.rsplit("/", 1)[1]: (r.rows, r.short_rows) for r in ingest.rows_by_file(staged).collect()}
    assert got == {"a.csv": (6, 1), "b.csv": (3, 0), "c.csv": (1, 0)}
    assert staged.where("zip = '1,2'").first()["vin"] == "V,3"
    # Two columns are read of eleven.
    plan = ingest.rows_by_file(staged)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<short_row:boolean,file:string>" in plan
