"""Registrations and their lookups derived from the TPC-H-like test tables.

A part is a vehicle, its supplier's nation the ZIP, the ship month the snapshot, so vehicles move between regions. Some rows
get blank or bad fields by their order key, so that every reject is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcast.operators.flow import new_registrations
from fleetcast.operators.regions import enrich, zip_regions
from fleetcast.plans.staging import materialize
from fleetcast.sources.readers import clean_vehicles, clean_zip_county, clean_zip_region

EV_TYPES = ("ECONOMY", "SMALL")
#: Overrides: ZIP text and region, some repeated, one outside all counties.
OVERRIDES = [("1", "ASIA"), ("7", "AMERICA"), ("3", "AFRICA"), ("3", "EUROPE"), ("99999", "EUROPE"), (" 7 ", "america"), ("", "ASIA")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    broken = lambda n: F.col("l_orderkey") % n == 0
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    return rows.select(
        "l_orderkey",
        F.col("l_partkey").cast("string").alias("vin"),
        F.col("l_partkey").cast("string").alias("vin_key"),
        F.when(broken(97), "").when(broken(101), "99999").when(broken(107), "88888").otherwise(F.col("s_nationkey").cast("string")).alias("zip"),
        F.when(broken(89), "x").otherwise(month.cast("string")).alias("dmv_id"),
        F.when(broken(83), " ").otherwise(F.date_format("l_shipdate", "yyyy-MM-01")).alias("reg_month"),
        broken(103).alias("short_row"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("k"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_type")).otherwise(" ").alias("d"), F.col("p_partkey").alias("o"))
    return clean_vehicles(part, "k", "d", "o")


def crosswalk(spark: SparkSession, sf_dir: str, on_duplicate: str = "first") -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("z"), F.lower("n_name").alias("c"), F.col("n_nationkey").alias("o"))
    again = nation.where("o % 10 = 3").select("z", F.concat("c", F.lit("_b")).alias("c"), (F.col("o") + 100).alias("o"))
    return clean_zip_county(nation.union(again), "z", "c", "o", on_duplicate)


def region_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.join(n, r["r_regionkey"] == n["n_regionkey"]).select(F.col("r_name").alias("region"), F.upper("n_name").alias("county"))


def zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    override = clean_zip_region(spark.createDataFrame(OVERRIDES, "zip string, region string"), "zip", "region")
    return zip_regions(crosswalk(spark, sf_dir), region_spec(spark, sf_dir), override)


def enriched(spark: SparkSession, sf_dir: str, period: str = "snapshot") -> DataFrame:
    return enrich(registrations(spark, sf_dir), vehicles(spark, sf_dir), zips(spark, sf_dir), period, EV_TYPES)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, snapshot_id, date, flow, stock, is_train): EV first seen per snapshot, its running sum, split at 2000-01-01."""
    flow = new_registrations(enriched(spark, sf_dir)).select("region", "snapshot_id", F.col("new_ev").cast("double").alias("flow"))
    date = F.expr("add_months(date '1995-01-01', snapshot_id - 1)")
    stock = F.sum("flow").over(W.partitionBy("region").orderBy("snapshot_id").rowsBetween(W.unboundedPreceding, 0))
    # A few rows for each region, made by two shuffles of all registrations: written once for all that reads it.
    return materialize(flow.withColumn("date", date).withColumn("stock", stock).withColumn("is_train", (F.col("date") < F.to_date(F.lit("2000-01-01"))).cast("int")))


def parameters(panel: DataFrame) -> DataFrame:
    """(region, p, q, M) for projections."""
    return panel.groupBy("region").agg(F.lit(0.002).alias("p"), F.lit(0.12).alias("q"), (F.max("stock") * 1.6).alias("M"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, gas_price_t): mean order price of even months over 40,000, so that there are gaps."""
    o = table(spark, sf_dir, "orders").where("month(o_orderdate) % 2 = 0 and year(o_orderdate) >= 1996")
    return o.groupBy(F.trunc("o_orderdate", "MM").alias("date")).agg(F.round(F.avg("o_totalprice") / 40000.0, 6).alias("gas_price_t"))


def income_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(county, lo, hi, single, joint, hoh): account balances by segment in bins of 2,000, the last one open."""
    c = table(spark, sf_dir, "customer").where("c_acctbal >= 0").withColumn("k", F.least(F.floor(F.col("c_acctbal") / 2000.0), F.lit(4)))
    g = c.groupBy(F.col("c_mktsegment").alias("county"), "k")
    return g.agg(*[F.count_if(F.col("c_custkey") % 3 == i).cast("double").alias(s) for i, s in enumerate(("single", "joint", "hoh"))]).select(
        "county", (F.col("k") * 2000.0).alias("lo"), F.when(F.col("k") < 4, (F.col("k") + 1) * 2000.0).alias("hi"), "single", "joint", "hoh"
    )
