"""The modelling panel: stock, flow, prices, costs and policy by series and snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.operators.policy import cost_advantage
from fleetcast.operators.series import asof_join, bfill, ffill, filter_series, positive_stock, since
from fleetcast.operators.stock import pivot_metrics
from fleetcast.plans.staging import materialize


def attach_dates(stock: DataFrame, calendar: DataFrame, key: str = "group") -> DataFrame:
    """``stock`` with ``date``; snapshots without a date go."""
    cal = calendar.select(F.col("snapshot_id").alias(key), F.col("snapshot_date").alias("date"))
    return stock.join(cal, key, "left").where("date is not null")


def join_flow(stock: DataFrame, flow: DataFrame, key: str = "group") -> DataFrame:
    """``flow_ev_t`` from first-seen counts; 0 where there is none."""
    f = flow.select("region", F.col("snapshot_id").alias(key), F.col("new_ev").cast("double").alias("flow_ev_t"))
    return stock.join(f, ["region", key], "left").withColumn("flow_ev_t", F.coalesce("flow_ev_t", F.lit(0.0)))


def attach_price(panel: DataFrame, prices: DataFrame) -> DataFrame:
    """Price at or before each date, then filled back and forward within the series."""
    joined = asof_join(panel, prices, "date", "date")
    return ffill(bfill(joined, ["gas_price_t"], ["region"], "date"), ["gas_price_t"], ["region"], "date")


def attach_policy(panel: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy month at or before each date; earlier dates stay null."""
    return asof_join(panel, policy, "date", "date")


def build_panel(counts: DataFrame, flow: DataFrame, calendar: DataFrame, prices: DataFrame, policy: DataFrame | None = None, regions: list[str] | None = None, min_date: str | None = None) -> DataFrame:
    """One row for each (region, snapshot) with positive EV stock; the minimum date cuts before any lag is taken."""
    stock = pivot_metrics(counts if regions is None else filter_series(counts, regions))
    panel = positive_stock(cost_advantage(attach_price(join_flow(attach_dates(stock, calendar), flow), prices)), "stock_ev_t")
    if min_date:
        # The check for rows reads the panel, and so does the caller.
        panel = since(materialize(panel), "date", min_date)
    return attach_policy(panel, policy) if policy is not None else panel
