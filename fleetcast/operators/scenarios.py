"""The policy table of many scenarios at once: shares, caps, prices and schedules come from tables keyed by scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.operators.policy import FUEL_PRICE, LIST_PRICE, apply_schedules, cost_advantage, weighted_credit
from fleetcast.operators.series import asof_join, bfill, ffill

#: Columns of a scenario, and what stands for one that is missing or null.
DEFAULTS = {"s30d": 0.85, "s25e": 0.65, "lease": 0.30, "used": 0.0, "face": 7500.0, "face_used": 4000.0, "takeup": 1.0, "veh_elig": 1.0}
#: The first month of the effective credit.
EFFECTIVE_FROM = "2023-01-01"


def checked_scenarios(scenarios: DataFrame) -> DataFrame:
    """``scenarios`` with all columns of ``DEFAULTS``; shares outside [0, 1], or leases and used sales over 1 together, are an error when rows are made."""
    rows = scenarios.select("scenario", *[F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) if c in scenarios.columns else F.lit(v).alias(c) for c, v in DEFAULTS.items()])
    sound = (F.col("lease") + F.col("used") <= 1.0 + 1e-12) & (F.least("s30d", "s25e", "lease", "used") >= 0.0) & (F.greatest("s30d", "s25e", "lease", "used") <= 1.0)
    return rows.withColumn("lease", F.when(sound, F.col("lease")).otherwise(F.raise_error(F.concat(F.lit("shares of a scenario out of bounds: "), F.col("scenario"))).cast("double")))


def keyed_prices(months: DataFrame, prices: DataFrame | None, value: str, default: float, name: str, back_first: bool) -> DataFrame:
    """``name``: the scenario's price at or before each month, filled back and forward within the scenario; ``default`` without a series.

    ``prices``: (scenario, date, ``value``). ``back_first`` only says in which order gaps are filled.
    """
    if prices is None:
        return months.withColumn(name, F.lit(default))
    joined = asof_join(months, prices.select("scenario", F.col("date").alias("_at"), F.col(value).alias(name)), "date", "_at", ["scenario"])
    first, second = (bfill, ffill) if back_first else (ffill, bfill)
    return second(first(joined, [name], ["scenario"], "date"), [name], ["scenario"], "date")


def overridden(df: DataFrame, schedule: DataFrame, names: list[str]) -> DataFrame:
    """Columns ``names`` replaced where ``schedule`` (scenario, name, valid_from, valid_to exclusive, value) has a step; a null bound is open.

    A step finds its months by (scenario, month): it is spread over the months of its scenario, not compared with every row.
    Of several steps at once the greatest value counts.
    """
    span = df.groupBy("scenario").agg(F.trunc(F.min("date"), "MM").alias("_lo"), F.trunc(F.max("date"), "MM").alias("_hi"))
    start, end = F.greatest(F.trunc("valid_from", "MM"), F.col("_lo")), F.least(F.trunc("valid_to", "MM"), F.col("_hi"))
    months = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    steps = schedule.join(span, "scenario").select("scenario", "name", "valid_from", "valid_to", "value", F.explode(months).alias("_m"))
    days = df.select("scenario", F.col("date").alias("_d"), F.trunc("date", "MM").alias("_m")).distinct()
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("_d"))) & (F.col("valid_to").isNull() | (F.col("_d") < F.col("valid_to")))
    wide = days.join(steps, ["scenario", "_m"]).where(inside).groupBy(F.col("scenario").alias("_s"), "_d").pivot("name", names).agg(F.max("value"))
    wide = wide.select("_s", "_d", *[F.col(n).alias(f"_new_{n}") for n in names])
    joined = df.join(wide, (F.col("scenario") == F.col("_s")) & (F.col("date") == F.col("_d")), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns])


def credit_of(row: dict[str, Column]) -> Column:
    """Credit after income caps: leases in full, purchases by the share of eligible buyers."""
    bought = (1 - row["lease"] - row["used"]) * row["face"] * row["s30d"]
    return row["takeup"] * row["veh_elig"] * (row["lease"] * row["face"] + bought + row["used"] * row["face_used"] * row["s25e"])


def policy_scenario_table(scenarios: DataFrame, first: str, last: str, gas: DataFrame | None, msrp: DataFrame | None, schedule: DataFrame | None = None, replaced: tuple[str, ...] = ()) -> DataFrame:
    """The policy table, a row for each (scenario, month start from ``first`` to ``last``).

    ``scenarios``: a row for each with any columns of ``DEFAULTS``. ``gas`` (scenario, date, gas_price_t) and ``msrp``
    (scenario, date, avg_msrp_ev_stock_t) may lack scenarios, which take the constant prices. ``schedule``: steps that stand
    in for the built-in ones of the columns ``replaced`` in the scenarios and months they name. A null scenario is an error of
    the caller and meets no series. Scenarios without rows in a table don't lose any month; no scenarios, no rows.
    """
    months = checked_scenarios(scenarios).withColumn("date", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))))
    df = keyed_prices(months, gas, "gas_price_t", FUEL_PRICE, "gas_price_t", True).withColumn("gas_price_t", F.coalesce("gas_price_t", F.lit(FUEL_PRICE)))
    df = keyed_prices(df, msrp, "avg_msrp_ev_stock_t", LIST_PRICE, "avg_msrp_t", False).withColumn("avg_msrp_t", F.coalesce("avg_msrp_t", F.lit(LIST_PRICE)))
    df = apply_schedules(df)
    if schedule is not None:
        df = overridden(df, schedule, list(replaced))
    df = weighted_credit(df)
    row = {c: F.col(c) for c in DEFAULTS}
    df = df.withColumn("fed_credit_avg_t", F.when(F.col("date") >= F.to_date(F.lit(EFFECTIVE_FROM)), credit_of(row)).otherwise(F.col("fed_credit_avg_t")))
    df = df.withColumn("total_subsidy_t", F.col("state_rebate_t") + F.col("delta_t") * F.col("fed_credit_avg_t"))
    return cost_advantage(df.withColumn("subsidy_share_t", F.col("total_subsidy_t") / F.col("avg_msrp_t")))
