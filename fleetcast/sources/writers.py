"""Sinks. Parquet by default; CSV where people read the file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.functions.keys import fixed4


def write_counts(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """(region, group, metric, approx_unique_vins), ordered."""
    df.orderBy("region", "group", "metric").select("region", "group", "metric", "approx_unique_vins").write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_flow(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """(region, snapshot_id, new_all, new_ev, ev_share_pct), ordered; shares with four decimals in CSV."""
    share = fixed4(F.col("ev_share_pct")).alias("ev_share_pct") if fmt == "csv" else F.col("ev_share_pct")
    df.orderBy("region", "snapshot_id").select("region", "snapshot_id", "new_all", "new_ev", share).write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_table(df: DataFrame, path: str, tag: str) -> None:
    """Panels, policy tables and forecasts, one partition for each output tag; other tags stay."""
    df.withColumn("tag", F.lit(tag)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").parquet(path)


def write_run_summary(spark: SparkSession, path: str, regions: dict[str, list[str]], inputs: dict[str, str | list[str]], counters: dict[str, int]) -> None:
    """Region spec, every input and the counters as one JSON row."""
    row = (json.dumps(regions, sort_keys=True), json.dumps(inputs, sort_keys=True), json.dumps(counters, sort_keys=True))
    spark.createDataFrame([row], "regions string, inputs string, counters string").coalesce(1).write.mode("overwrite").json(path)


def write_params(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)
