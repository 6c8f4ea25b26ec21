"""From registration rows to (region, vehicle, period): cleaning outcomes, region assignment, vehicle lookup, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fleetcast.functions.keys import is_ev, month_key, normalize_zip, snapshot_key, split_rows

#: Sides up to so many rows are broadcast; the count is taken where it is not given.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; otherwise the join shuffles. The count stops where rows are too many."""
    return F.broadcast(df) if (df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows) <= BROADCAST_ROWS else df


def parse_regions(spec: str) -> dict[str, list[str]]:
    """A spec like ``R1:A,B;R2:C`` as a dict; errors on empty and malformed parts."""
    out: dict[str, list[str]] = {}
    for part in (p.strip() for p in spec.split(";")):
        if not part:
            continue
        name, colon, counties = part.partition(":")
        names = [c.strip().upper() for c in counties.split(",") if c.strip()]
        if not colon or not name.strip() or not names:
            raise ValueError(f"malformed region: {part!r}")
        out[name.strip()] = names
    if not out:
        raise ValueError("no regions given")
    return out


def regions_df(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """(region, county), counties upper-cased."""
    rows = [(r.strip(), c.strip().upper()) for r, cs in mapping.items() for c in cs]
    if not rows or any(not r or not c for r, c in rows):
        raise ValueError("regions and counties must not be empty")
    return spark.createDataFrame(rows, "region string, county string").distinct()


def regions_from_rows(df: DataFrame, region: str, counties: str) -> DataFrame:
    """(region, county) from rows that list counties in one text."""
    return df.select(F.trim(region).alias("region"), F.explode(split_rows(F.upper(counties))).alias("county")).distinct()


def zip_regions(xwalk: DataFrame, spec: DataFrame, override: DataFrame | None = None, restrict_to_spec: bool = False) -> DataFrame:
    """(zip, region): regions of the ZIP's county and overrides, without duplicates. One join stands for three lookups."""
    both = xwalk.join(small(spec), "county").select("zip", "region")
    if override is not None:
        extra = override.select("zip", "region")
        both = both.union(extra.join(spec.select("region").distinct(), "region", "left_semi").select("zip", "region") if restrict_to_spec else extra)
    return both.distinct()


def period_key(df: DataFrame, period: str, month_col: str = "reg_month", id_col: str = "dmv_id") -> DataFrame:
    """``period``: the month text or the snapshot id; null where it is no good."""
    if period not in ("month", "snapshot"):
        raise ValueError(f"period must be month or snapshot, not {period!r}")
    return df.withColumn("period", month_key(F.col(month_col)) if period == "month" else snapshot_key(F.col(id_col)))


def join_county(df: DataFrame, xwalk: DataFrame) -> DataFrame:
    return df.join(small(xwalk.select("zip", "county")), "zip", "left")


def join_regions(df: DataFrame, spec: DataFrame) -> DataFrame:
    """A row for each region of the county."""
    return df.join(small(spec), "county")


def join_drivetrain(df: DataFrame, vehicles: DataFrame, vehicle_rows: int | None = None) -> DataFrame:
    """``drivetrain`` by ``vin_key``, UNKNOWN where there is none; blank keys are null, so that they don't meet in one task."""
    key = F.nullif(F.trim("vin_key"), F.lit(""))
    lookup = vehicles.select(F.col("vin_key").alias("_k"), F.col("drivetrain").alias("_d"))
    joined = df.join(small(lookup, vehicle_rows), key == F.col("_k"), "left")
    return joined.withColumn("drivetrain", F.coalesce("_d", F.lit("UNKNOWN"))).drop("_k", "_d")


def classify_rows(df: DataFrame, xwalk: DataFrame, zips: DataFrame, period: str, first: str = "period") -> DataFrame:
    """``outcome`` of each row: short_row, bad_period, no_zip, no_region or kept, and the flag ``no_county``.

    ``first``: whether a bad period or a missing ZIP is seen first. The flags overlap: a row without a county may still
    have a region by an override, and is ``no_region`` as well if it has not.
    """
    rows = period_key(df, period).withColumn("zip", normalize_zip(F.coalesce("zip", F.lit(""))))
    county = small(xwalk.select("zip", F.lit(True).alias("_county")).distinct())
    region = small(zips.select("zip", F.lit(True).alias("_region")).distinct())
    rows = rows.join(county, "zip", "left").join(region, "zip", "left")
    bad, none = F.col("period").isNull(), F.col("zip") == ""
    outcome = F.when(F.col("short_row"), "short_row") if "short_row" in df.columns else F.when(F.lit(False), "")
    for test, name in ((bad, "bad_period"), (none, "no_zip")) if first == "period" else ((none, "no_zip"), (bad, "bad_period")):
        outcome = outcome.when(test, name)
    outcome = outcome.when(F.col("_region").isNull(), "no_region").otherwise("kept")
    past = ~outcome.isin("short_row", "bad_period", "no_zip")
    return rows.withColumn("outcome", outcome).withColumn("no_county", past & F.col("_county").isNull()).drop("_county", "_region")


def outcome_counters() -> list[Column]:
    """Counters over classified rows; no_county and no_region overlap."""
    one = lambda c, name: F.count_if(c).alias(name)
    o = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("rows_total"),
        one(o == "short_row", "short_row"),
        one(o == "bad_period", "bad_period"),
        one(o == "no_zip", "no_zip"),
        one(F.col("no_county"), "no_county"),
        one(o == "no_region", "no_region"),
        one(o == "kept", "kept"),
    ]


def row_outcomes(classified: DataFrame) -> DataFrame:
    return classified.agg(*outcome_counters())


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows of each input file of a scan."""
    return df.groupBy(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def assign_regions(df: DataFrame, zips: DataFrame, period: str) -> DataFrame:
    """(region, vin, vin_key, period) of rows with a period and a region; an empty VIN is one vehicle.

    The inner join on ZIP drops most rows before any other lookup.
    """
    rows = period_key(df, period).where("period is not null").withColumn("zip", normalize_zip(F.col("zip"))).where("zip <> ''")
    if "short_row" in df.columns:
        rows = rows.where("not short_row")
    return rows.join(small(zips), "zip").select("region", F.coalesce("vin", F.lit("")).alias("vin"), "vin_key", "period")


def enrich(df: DataFrame, vehicles: DataFrame, zips: DataFrame, period: str, ev_types=("BEV", "PHEV"), vehicle_rows: int | None = None) -> DataFrame:
    """(region, vin, period, vin_key, is_ev): what the stock and flow counts share."""
    rows = join_drivetrain(assign_regions(df, zips, period), vehicles, vehicle_rows)
    return rows.select("region", "vin", "period", "vin_key", is_ev(F.col("drivetrain"), ev_types).alias("is_ev"))


def fan_out_metrics(df: DataFrame) -> DataFrame:
    """Each row for metric ALL, and once more for EV if it is one."""
    metrics: Column = F.when(F.col("is_ev"), F.array(F.lit("ALL"), F.lit("EV"))).otherwise(F.array(F.lit("ALL")))
    return df.withColumn("metric", F.explode(metrics))


def enrich_and_count(df: DataFrame, vehicles: DataFrame, xwalk: DataFrame, zips: DataFrame, period: str, ev_types=("BEV", "PHEV"), first: str = "period", vehicle_rows: int | None = None) -> tuple[DataFrame, Observation]:
    """What ``enrich`` gives, and the counters of ``row_outcomes`` observed while those rows are made, in the same scan.

    The observation has its values after the first action on the rows (or on what is derived from them); it counts input rows,
    before a ZIP of several regions multiplies them. Where a lost executor's rows are computed anew they may be counted
    again, unless the action is a plain write of the rows.
    """
    seen = Observation()
    kept = classify_rows(df, xwalk, zips, period, first).observe(seen, *outcome_counters()).where("outcome = 'kept'")
    placed = kept.join(small(zips), "zip").select("region", F.coalesce("vin", F.lit("")).alias("vin"), "vin_key", "period")
    rows = join_drivetrain(placed, vehicles, vehicle_rows)
    return rows.select("region", "vin", "period", "vin_key", is_ev(F.col("drivetrain"), ev_types).alias("is_ev")), seen
