"""Vehicles on the road: distinct counts by region, period and metric, exact, approximate or as mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard error of 2^16 registers: 1.04 / sqrt(2^16) is 0.00406; Spark rounds the register count up from here.
RSD_16 = 0.00433
KEYS = ["region", "group", "metric"]


def _by_metric(wide: DataFrame, name: str, kept: Column) -> DataFrame:
    """A row for each metric from columns ALL and EV, without explosion of the rows that were counted."""
    both = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in ("ALL", "EV")])
    rest = [c for c in wide.columns if c.startswith("_")]
    return wide.select("region", F.col("period").alias("group"), *rest, F.inline(both)).where(kept).select(*KEYS, name)


def stock_counts(enriched: DataFrame, lg_k: int = 16, exact: bool = False) -> DataFrame:
    """(region, group, metric, approx_unique_vins); groups without vehicles have no row.

    Exact: rows are first reduced to one for each (region, period, vehicle), in each task before they move.
    """
    if not exact:
        return stock_sketches(enriched, lg_k).select(*KEYS, F.hll_sketch_estimate("sketch").alias("approx_unique_vins"))
    once = enriched.groupBy("region", "period", "vin").agg(F.bool_or("is_ev").alias("ev"))
    counts = once.groupBy("region", "period").agg(F.count(F.lit(1)).alias("ALL"), F.count_if("ev").alias("EV"))
    return _by_metric(counts, "approx_unique_vins", F.col("approx_unique_vins") > 0)


def stock_sketches(enriched: DataFrame, lg_k: int = 16) -> DataFrame:
    """One mergeable sketch of VINs for each (region, group, metric); the prefix keeps the empty VIN, which sketches skip.

    A sketch is a short list until its group has many vehicles.
    """
    vin = F.concat(F.lit("v"), F.col("vin"))
    counts = enriched.groupBy("region", "period").agg(
        F.hll_sketch_agg(vin, lg_k).alias("ALL"), F.hll_sketch_agg(F.when(F.col("is_ev"), vin), lg_k).alias("EV"), F.count_if("is_ev").alias("_ev")
    )
    return _by_metric(counts, "sketch", (F.col("metric") == "ALL") | (F.col("_ev") > 0))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct counts of unions of sketches: over files, regions or periods."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_unique_vins"))


def pivot_metrics(counts: DataFrame) -> DataFrame:
    """(region, group, stock_ev_t, stock_all_t)."""
    wide = counts.groupBy("region", "group").pivot("metric", ["EV", "ALL"]).agg(F.first("approx_unique_vins"))
    return wide.select("region", "group", F.col("EV").cast("double").alias("stock_ev_t"), F.col("ALL").cast("double").alias("stock_all_t"))


def stock_share(wide: DataFrame) -> DataFrame:
    """``ev_share``: EV stock over all; null without vehicles."""
    return wide.withColumn("ev_share", F.coalesce("stock_ev_t", F.lit(0.0)) / F.nullif(F.col("stock_all_t"), F.lit(0.0)))


def sort_counts(counts: DataFrame) -> DataFrame:
    return counts.orderBy(*KEYS)
