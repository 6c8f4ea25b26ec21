"""Scores of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.keys import finite


def _pair(actual: Column, hat: Column) -> Column:
    return finite(actual) & finite(hat)


def mse(actual: Column, hat: Column) -> Column:
    return F.avg(F.when(_pair(actual, hat), F.pow(actual - hat, F.lit(2.0))))


def rmse(actual: Column, hat: Column) -> Column:
    """Over finite pairs; null without any."""
    return F.sqrt(mse(actual, hat))


def mape(actual: Column, hat: Column) -> Column:
    """Percent, over finite pairs whose actual isn't (nearly) 0."""
    return F.avg(F.when(_pair(actual, hat) & (F.abs(actual) > 1e-9), F.abs((actual - hat) / actual))) * 100.0


def holdout_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each (by, model): test rows, first and last date, RMSE and MAPE of flow and stock.

    ``rows``: by, model, date, is_train, flow_obs, stock_obs, flow_hat, stock_hat. Models without rows have no line.
    """
    test = rows.where((F.col("is_train") == 0) & F.col("stock_obs").isNotNull())
    f, fh, s, sh = (F.col(c).cast("double") for c in ("flow_obs", "flow_hat", "stock_obs", "stock_hat"))
    return test.groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.min("date").alias("date_min_test"),
        F.max("date").alias("date_max_test"),
        rmse(f, fh).alias("rmse_flow"),
        mape(f, fh).alias("mape_flow_pct"),
        rmse(s, sh).alias("rmse_stock"),
        mape(s, sh).alias("mape_stock_pct"),
    )
