"""Readers. All take explicit schemas and fail early when required columns are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.functions.keys import bracket_bounds, clean_text, is_county_header, lenient_date, lenient_double, normalize_zip
from fleetcast.operators.series import ffill

REGISTRATION_FIELDS = ["vin", "valid_date", "expiration_date", "zip", "county_geoid", "dmv_id", "state", "vin_key", "reg_month"]
REGISTRATIONS = T.StructType([*(T.StructField(c, T.StringType()) for c in REGISTRATION_FIELDS), T.StructField("raw", T.StringType())])


def require(df: DataFrame, columns: list[str], what: str) -> dict[str, str]:
    """Actual names of ``columns``, matched without case and surrounding blanks."""
    have = {c.strip().lower(): c for c in df.columns}
    missing = [c for c in columns if c.lower() not in have]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return {c: have[c.lower()] for c in columns}


def read_registrations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Headerless registration CSVs as text columns; ``raw`` holds the text of rows with another number of fields.

    A row's fields are only counted while all columns are parsed, hence no column pruning here; stage the table to Parquet
    for jobs that read it often.
    """
    df = spark.read.schema(REGISTRATIONS).option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw").csv(paths)
    if not df.inputFiles():
        raise FileNotFoundError(f"no registration files at {paths}")
    return df.withColumn("file", F.col("_metadata.file_path"))


def flag_short_rows(df: DataFrame) -> DataFrame:
    """``short_row``: fewer than nine fields. Longer rows are accepted."""
    fields = F.size(F.split(F.regexp_replace("raw", '"[^"]*"', ""), ",", -1))
    return df.withColumn("short_row", F.col("raw").isNotNull() & (fields < len(REGISTRATION_FIELDS)))


def clean_vehicles(df: DataFrame, key: str, drivetrain: str, order: str) -> DataFrame:
    """(vin_key, drivetrain): blank keys go, a blank drivetrain is UNKNOWN, the last duplicate in ``order`` wins."""
    rows = df.select(clean_text(F.col(key)).alias("vin_key"), clean_text(F.col(drivetrain), "UNKNOWN").alias("drivetrain"), F.col(order).alias("_order"))
    return rows.where("vin_key is not null").groupBy("vin_key").agg(F.max_by("drivetrain", "_order").alias("drivetrain"))


def _ordered(df: DataFrame) -> DataFrame:
    """With ``row_order``: rows in the order of the file (block start, then place in the task)."""
    return df.withColumn("row_order", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))


def read_vehicles(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    names = require(df, ["VIN_Key", "Drivetrain_Type"], "vehicles")
    return clean_vehicles(_ordered(df), names["VIN_Key"], names["Drivetrain_Type"], "row_order")


def clean_zip_county(df: DataFrame, zip_col: str, county: str, order: str, on_duplicate: str = "first") -> DataFrame:
    """(zip, county): normalized, upper-cased, blanks skipped; ``on_duplicate`` is first, last or error."""
    rows = df.select(normalize_zip(F.col(zip_col)).alias("zip"), clean_text(F.col(county), upper=True).alias("county"), F.col(order).alias("_order"))
    rows = rows.where("zip <> '' and county is not null")
    if on_duplicate == "error" and (bad := rows.groupBy("zip").count().where("count > 1").first()):
        raise ValueError(f"zip {bad['zip']} occurs {bad['count']} times")
    pick = F.max_by if on_duplicate == "last" else F.min_by
    return rows.groupBy("zip").agg(pick("county", "_order").alias("county"))


def read_zip_county(spark: SparkSession, path: str, on_duplicate: str = "first") -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    names = require(df, ["zip", "county_name"], "zip to county")
    return clean_zip_county(_ordered(df), names["zip"], names["county_name"], "row_order", on_duplicate)


def clean_zip_region(df: DataFrame, zip_col: str, region: str) -> DataFrame:
    """(zip, region), many regions for a zip."""
    rows = df.select(normalize_zip(F.col(zip_col)).alias("zip"), clean_text(F.col(region), upper=True).alias("region"))
    return rows.where("zip <> '' and region is not null").distinct()


def read_zip_region(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    names = require(df, ["zip", "region"], "zip to region")
    return clean_zip_region(df, names["zip"], names["region"])


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, snapshot_date)."""
    df = spark.read.option("header", True).csv(path)
    names = require(df, ["DMV_ID", "DMV_Snapshot_Date"], "calendar")
    rows = df.select(F.trim(names["DMV_ID"]).try_cast("int").alias("snapshot_id"), lenient_date(F.col(names["DMV_Snapshot_Date"])).alias("snapshot_date"))
    return rows.where("snapshot_id is not null").distinct()


def clean_price_series(df: DataFrame) -> DataFrame:
    """(date, gas_price_t): the price column as it is, else cents per gallon over 100; an error with neither."""
    have = {c.strip().lower(): c for c in df.columns}
    if "date" not in have or not {"gas_price_t", "gas_price_cents_per_gallon"} & set(have):
        raise ValueError("price series: needs date and gas_price_t or gas_price_cents_per_gallon")
    price = lenient_double(F.col(have["gas_price_t"])) if "gas_price_t" in have else lenient_double(F.col(have["gas_price_cents_per_gallon"])) / F.lit(100.0)
    return df.select(lenient_date(F.col(have["date"])).alias("date"), price.alias("gas_price_t")).where("date is not null")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of ``paths`` that is there, in any store that Spark reads; an error when none is."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"none of {paths}")


def read_price_series(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The price series of a table, or of the first of several candidates that is there."""
    return clean_price_series(spark.read.option("header", True).csv(paths if isinstance(paths, str) else first_existing(spark, paths)))


def read_price_list_series(spark: SparkSession, path: str) -> DataFrame:
    """(date, avg_msrp_ev_stock_t): rows without a date go, prices that are no number become null."""
    df = spark.read.option("header", True).csv(path)
    names = require(df, ["date", "avg_msrp_ev_stock_t"], "list prices")
    rows = df.select(lenient_date(F.col(names["date"])).alias("date"), lenient_double(F.col(names["avg_msrp_ev_stock_t"])).alias("avg_msrp_ev_stock_t"))
    return rows.where("date is not null")


POLICY_COLUMNS = ["date", "total_subsidy_t", "subsidy_share_t", "urgency_t", "zev_index_t"]


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """The five policy columns that panels need."""
    df = spark.read.option("header", True).csv(path)
    names = require(df, POLICY_COLUMNS, "policy")
    return df.select(lenient_date(F.col(names["date"])).alias("date"), *[lenient_double(F.col(names[c])).alias(c) for c in POLICY_COLUMNS[1:]])


def read_income_bins(df: DataFrame) -> DataFrame:
    """(county, bracket, lo, hi, single, joint, hoh) from labelled rows.

    ``df``: row_order, label, total, single, joint, hoh. County rows apply to the bracket rows below; labels that are no
    bracket are left out.
    """
    rows = df.withColumn("_county", F.when(is_county_header(F.col("label"), F.col("total")), F.regexp_replace(F.trim("label"), " County$", "")))
    rows = ffill(rows, ["_county"], [], "row_order").withColumn("_b", bracket_bounds(F.col("label"))).where("_b.lo is not null and _county is not null")
    counts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("single", "joint", "hoh")]
    return rows.select(F.col("_county").alias("county"), F.trim("label").alias("bracket"), "_b.lo", "_b.hi", *counts)
