"""Vehicles first seen: the flow into each region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(enriched: DataFrame) -> DataFrame:
    """(region, vin, snapshot_id): the first snapshot of each vehicle in each region."""
    return enriched.groupBy("region", "vin").agg(F.min("period").alias("snapshot_id"))


def vehicle_ev_flag(enriched: DataFrame) -> DataFrame:
    """(vin, is_ev): one flag per vehicle over all regions, that of its earliest row (then the smallest key)."""
    return enriched.groupBy("vin").agg(F.min_by("is_ev", F.struct("period", F.coalesce("vin_key", F.lit("")))).alias("is_ev"))


def new_registrations(enriched: DataFrame) -> DataFrame:
    """(region, snapshot_id, new_all, new_ev, ev_share_pct).

    Rows are first reduced to one per (region, vin), map-side too, and these to one per vehicle, with its flag and a list of the few
    regions it was seen in; so rows are read once, and no join brings the flags back.
    """
    seen = enriched.where("vin is not null").groupBy("region", "vin").agg(
        F.min("period").alias("snapshot_id"), F.min(F.struct("period", F.coalesce("vin_key", F.lit("")).alias("k"), "is_ev")).alias("_first")
    )
    by_vin = seen.groupBy("vin").agg(F.min("_first").alias("_f"), F.collect_list(F.struct("region", "snapshot_id")).alias("_seen"))
    counts = by_vin.select(F.col("_f.is_ev").alias("is_ev"), F.inline("_seen")).groupBy("region", "snapshot_id").agg(F.count(F.lit(1)).alias("new_all"), F.count_if("is_ev").alias("new_ev"))
    return counts.withColumn("ev_share_pct", F.when(F.col("new_all") > 0, F.lit(100.0) * F.col("new_ev") / F.col("new_all")).otherwise(0.0))
