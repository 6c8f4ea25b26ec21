"""Policy schedules and subsidy columns, one row per month (and scenario)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.keys import clamp01
from fleetcast.operators.series import asof_join, bfill, ffill

# Fixed values: (first day of the step, value). The first step has no start; each holds up to the next.
SCHEDULES: dict[str, list[tuple[str | None, float]]] = {
    "credit_tsla": [(None, 7500.0), ("2019-01-01", 3750.0), ("2019-07-01", 1875.0), ("2020-01-01", 0.0), ("2023-01-01", 7500.0), ("2025-10-01", 0.0)],
    "credit_gm": [(None, 7500.0), ("2019-04-01", 3750.0), ("2019-10-01", 1875.0), ("2020-04-01", 0.0), ("2023-01-01", 7500.0), ("2025-10-01", 0.0)],
    "credit_other": [(None, 7500.0), ("2023-01-01", 5250.0), ("2025-10-01", 0.0)],
    "state_rebate_t": [(None, 0.0), ("2017-03-21", 2000.0), ("2021-07-01", 1500.0)],
    "delta_t": [(None, 0.85), ("2024-01-01", 1.0)],
    "urgency_t": [(None, 0.0), ("2025-07-04", 1.0), ("2025-10-01", 0.0)],
    "valley_dummy_t": [(None, 0.0), ("2020-01-01", 1.0), ("2023-01-01", 0.0)],
    "zev_index_t": [(None, 0.0), ("2022-12-01", 0.2)],
    "fed_policy_index_t": [(None, 0.1), ("2022-08-16", 0.5), ("2025-01-20", 0.2)],
}
MAKER_WEIGHTS = {"credit_tsla": 0.39, "credit_gm": 0.05, "credit_other": 0.56}
MPG, KWH_PER_MILE, ELEC_PRICE, LIST_PRICE, FUEL_PRICE = 28.0, 0.30, 0.22, 45_000.0, 3.50


def step(date: Column, steps: list[tuple[str | None, float]]) -> Column:
    """The value of the last step that began."""
    out = F.lit(None).cast("double")
    first = True
    for start, value in reversed(steps):
        test = F.lit(True) if start is None else date >= F.to_date(F.lit(start))
        out = F.when(test, F.lit(value)) if first else out.when(test, F.lit(value))
        first = False
    return out


def zev_index(date: Column) -> Column:
    """Steps up to 2026, then a line that reaches 1 in 2035."""
    return F.when(date >= F.to_date(F.lit("2026-01-01")), F.lit(0.35) + (F.year(date) - 2026) * F.lit(0.65) / F.lit(9.0)).otherwise(step(date, SCHEDULES["zev_index_t"]))


def apply_schedules(df: DataFrame, date: str = "date", names: list[str] | None = None) -> DataFrame:
    """The fixed schedules as columns."""
    col = F.col(date)
    return df.withColumns({n: zev_index(col) if n == "zev_index_t" else step(col, SCHEDULES[n]) for n in (names or SCHEDULES)})


def apply_schedule(df: DataFrame, schedule: DataFrame, date: str = "date") -> DataFrame:
    """A column for each name of a table (name, valid_from, valid_to exclusive, value); a null bound is open, a row without a name says nothing."""
    schedule = schedule.where("name is not null")
    names = sorted(r[0] for r in schedule.select("name").distinct().collect())
    days = df.select(F.col(date).cast("date").alias("_d")).where("_d is not null").distinct().withColumn("_m", F.trunc("_d", "MM"))
    # Steps are spread over the months that occur, so that days find them by equality, however many steps there are.
    first, last = days.agg(F.min("_m"), F.max("_m")).first()
    start, end = F.greatest(F.trunc("valid_from", "MM"), F.lit(first)), F.least(F.trunc("valid_to", "MM"), F.lit(last))
    months = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    spread = schedule.select("name", "valid_from", "valid_to", "value", F.explode(months).alias("_m"))
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("_d"))) & (F.col("valid_to").isNull() | (F.col("_d") < F.col("valid_to")))
    wide = days.join(spread, "_m").where(inside).groupBy("_d").pivot("name", names).agg(F.max("value"))
    return df.join(wide, F.col(date).cast("date") == wide["_d"], "left").drop("_d")


def weighted_credit(df: DataFrame, weights: dict[str, float] = MAKER_WEIGHTS) -> DataFrame:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(w) * F.col(c)
    return df.withColumn("fed_credit_avg_t", total)


def effective_credit(s30d: Column, s25e: Column, lease: float = 0.30, used: float = 0.0, face: float = 7500.0, face_used: float = 4000.0, takeup: float = 1.0, veh_elig: float = 1.0) -> Column:
    """Credit after income caps: leases in full, purchases by the share of eligible buyers."""
    if not 0 <= lease <= 1 or not 0 <= used <= 1 or lease + used > 1:
        raise ValueError("shares must lie in [0, 1] and sum to 1 at most")
    return F.lit(takeup * veh_elig) * (F.lit(lease * face) + F.lit((1 - lease - used) * face) * s30d + F.lit(used * face_used) * s25e)


def eligible_share(bins: DataFrame, thresholds: dict[str, float], by: list[str] | None = None, alpha: float = 2.5, name: str = "share") -> DataFrame:
    """Share of filers under the income threshold of their status: even density in closed bins, a Pareto tail in the open one."""
    statuses = list(thresholds)
    long = bins.unpivot([*(by or []), "lo", "hi"], statuses, "status", "filers")
    limit = F.create_map(*[F.lit(x) for s, t in thresholds.items() for x in (s, float(t))])[F.col("status")]
    tail = F.lit(1.0) - F.pow(F.col("lo") / limit, F.lit(alpha))
    part = F.when(limit <= F.col("lo"), 0.0).when(F.col("hi").isNull(), tail).otherwise(clamp01((limit - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    filers = F.coalesce(F.when(~F.isnan("filers"), F.col("filers")), F.lit(0.0))
    sums = long.groupBy(*(by or [])).agg(F.sum(filers * part).alias("_e"), F.sum(filers).alias("_n"))
    return sums.select(*(by or []), F.when(F.col("_n") > 0, F.col("_e") / F.col("_n")).alias(name))


def attach_fuel(cal: DataFrame, gas: DataFrame | None, date: str = "date") -> DataFrame:
    """Fuel price of each month: latest at or before it, earlier months take the first; constant without a series."""
    if gas is None:
        return cal.withColumn("gas_price_t", F.lit(FUEL_PRICE))
    joined = asof_join(cal, gas.select("date", "gas_price_t"), date, "date")
    return ffill(bfill(joined, ["gas_price_t"], [], date), ["gas_price_t"], [], date)


def attach_list_price(cal: DataFrame, msrp: DataFrame, date: str = "date", price: str = "avg_msrp_ev_stock_t") -> DataFrame:
    """List price of each month, filled forward, then back, then with the default, as ``avg_msrp_t``."""
    joined = asof_join(cal, msrp.select("date", price), date, "date")
    filled = bfill(ffill(joined.withColumn("_p", F.col(price)), ["_p"], [], date), ["_p"], [], date)
    return filled.withColumn("avg_msrp_t", F.coalesce("_p", F.lit(LIST_PRICE))).drop("_p")


def cost_advantage(df: DataFrame, gas: str = "gas_price_t", mpg: float = MPG, kwh_mile: float = KWH_PER_MILE, elec: float | Column = ELEC_PRICE) -> DataFrame:
    """Running costs a mile of fuel and electricity, and their difference."""
    e = elec if isinstance(elec, Column) else F.lit(elec)
    out = df.withColumn("elec_price_t", e).withColumn("C_gas_t", F.col(gas) / F.lit(mpg)).withColumn("C_ev_t", F.col("elec_price_t") * F.lit(kwh_mile))
    return out.withColumn("tco_adv_t", F.col("C_gas_t") - F.col("C_ev_t"))


def policy_table(cal: DataFrame, gas: DataFrame | None, msrp: DataFrame, s30d: float | Column = 0.85, s25e: float | Column = 0.65, lease: float = 0.30, used: float = 0.0, **override) -> DataFrame:
    """The full table: prices, credits, rebates, subsidy and its share, indices and cost advantage, one row per month of ``cal``."""
    s30, s25 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (s30d, s25e))
    df = weighted_credit(apply_schedules(attach_list_price(attach_fuel(cal, gas), msrp)))
    after = F.col("date") >= F.to_date(F.lit("2023-01-01"))
    df = df.withColumn("fed_credit_avg_t", F.when(after, effective_credit(s30, s25, lease, used, **override)).otherwise(F.col("fed_credit_avg_t")))
    df = df.withColumns({"s_inc_30d_t": s30, "s_inc_25e_t": s25, "lease_share_t": F.lit(lease), "used_purchase_share_t": F.lit(used)})
    df = df.withColumn("total_subsidy_t", F.col("state_rebate_t") + F.col("delta_t") * F.col("fed_credit_avg_t"))
    return cost_advantage(df.withColumn("subsidy_share_t", F.col("total_subsidy_t") / F.col("avg_msrp_t")))


def price_coverage(df: DataFrame, by: list[str], price: str = "price", kind: str = "kind") -> DataFrame:
    """EVs, priced EVs, coverage in percent and mean prices for EV, BEV and PHEV of each group."""
    ev, has = F.col(kind).isin("BEV", "PHEV"), F.col(price).isNotNull()
    of = lambda k: F.avg(F.when(F.col(kind) == k, F.col(price)))
    sums = df.groupBy(*by).agg(
        F.count_if(ev).alias("ev_count_total"),
        F.count_if(ev & has).alias("ev_count_priced"),
        F.avg(F.when(ev, F.col(price))).alias("avg_msrp_ev_stock_t"),
        of("BEV").alias("avg_msrp_bev_stock_t"),
        of("PHEV").alias("avg_msrp_phev_stock_t"),
        F.count_if((F.col(kind) == "BEV") & has).alias("bev_count_priced"),
        F.count_if((F.col(kind) == "PHEV") & has).alias("phev_count_priced"),
    )
    return sums.withColumn("coverage_pct", F.when(F.col("ev_count_total") > 0, F.lit(100.0) * F.col("ev_count_priced") / F.col("ev_count_total")))
