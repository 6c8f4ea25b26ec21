"""The registered queries and their SQL twins, on the stand-in tables of ``fleetcast.plans.standin``."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.functions import keys as K
from fleetcast.operators import bass as B
from fleetcast.operators import flow, metrics, policy, regions, stock
from fleetcast.operators import series as S
from fleetcast.operators.newton import fit_bass_newton
from fleetcast.operators.scenarios import policy_scenario_table
from fleetcast.plans import layout
from fleetcast.plans import panel as P
from fleetcast.plans import standin as D
from fleetcast.plans.staging import materialize, shared_dir
from fleetcast.sources import ingest, readers, writers
from fleetcast.streaming import incremental as T
from fleetcast.streaming.buckets import read_buckets

#: Rows of an arriving file and of a bucket of state, about; each is one task's.
TASK_ROWS = 500_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_REG = """
reg as (select cast(l_partkey as varchar) as vin, cast(l_partkey as varchar) as vin_key,
          case when l_orderkey % 97 = 0 then '' when l_orderkey % 101 = 0 then '99999' when l_orderkey % 107 = 0 then '88888' else lpad(cast(s_nationkey as varchar), 5, '0') end as zip,
          case when l_orderkey % 89 = 0 then null else cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) as integer) end as snapshot,
          case when l_orderkey % 83 = 0 then null else strftime(l_shipdate, '%Y-%m-01') end as month, l_orderkey % 103 = 0 as short_row
        from lineitem join supplier on l_suppkey = s_suppkey),
veh as (select cast(p_partkey as varchar) as k, case when p_partkey % 50 <> 0 then p_type else 'UNKNOWN' end as d from part),
xw as (select lpad(cast(n_nationkey as varchar), 5, '0') as zip, upper(n_name) as county from nation),
sp as (select r_name as region, upper(n_name) as county from region join nation on r_regionkey = n_regionkey),
zr as (select zip, region from xw join sp using (county)
       union select * from (values ('00001', 'ASIA'), ('00007', 'AMERICA'), ('00003', 'AFRICA'), ('00003', 'EUROPE'), ('99999', 'EUROPE')) t(zip, region))
"""


def _enr(period: str = "snapshot") -> str:
    return f"""{_REG},
enr as (select region, vin, vin_key, {period} as period, coalesce(d, 'UNKNOWN') in ('ECONOMY', 'SMALL') as is_ev
        from reg join zr on reg.zip = zr.zip left join veh on vin_key = k where not short_row and {period} is not null)"""


_SERIES = (
    _enr()
    + """,
seen as (select region, vin, min(period) as snapshot_id from enr group by 1, 2),
flag as (select vin, arg_min(is_ev, period) as is_ev from enr group by 1),
nr as (select region, snapshot_id, count(*) as new_all, count(*) filter (where is_ev) as new_ev from seen join flag using (vin) group by 1, 2),
ser as (select region, snapshot_id, cast(date '1995-01-01' + to_months(snapshot_id - 1) as date) as date, cast(new_ev as double) as flow,
          cast(sum(new_ev) over (partition by region order by snapshot_id) as double) as stock from nr),
par as (select region, cast(0.002 as double) as p, cast(0.12 as double) as q, max(stock) * 1.6 as m from ser group by 1),
num as (select *, row_number() over (partition by region order by date) as i, count(*) over (partition by region) as n,
          lag(stock, 1, 0) over (partition by region order by date) as prev from ser)"""
)


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


# Sources and keys


@query("vehicle_scan", f"with {_REG} select k as vin_key, d as drivetrain from veh")
def vehicle_scan(spark, d):
    return D.vehicles(spark, d)


@query("zip_county_first", f"with {_REG} select zip, county from xw")
def zip_county_first(spark, d):
    return D.crosswalk(spark, d)


@query("zip_county_last", f"with {_REG} select zip, case when cast(zip as integer) % 10 = 3 then county || '_B' else county end as county from xw")
def zip_county_last(spark, d):
    return D.crosswalk(spark, d, "last")


@query("clean_keys", "select c_custkey, case when c_custkey % 7 = 0 then lpad(cast(c_custkey as varchar), cast(greatest(5, length(cast(c_custkey as varchar))) as integer), '0') else cast(c_custkey as varchar) || '-1' end as zip, coalesce(nullif(trim(upper(case when c_custkey % 5 = 0 then ' ' else c_name end)), ''), 'UNKNOWN') as name, printf('%.4f', c_acctbal) as fixed, cast(round_even(c_acctbal, 0) as bigint) as whole, c_acctbal / 100.0 as units from customer")
def clean_keys(spark, d):
    c = D.table(spark, d, "customer")
    text = F.concat(F.lit(" "), F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey").cast("string")).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit("-1"))))
    name = F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_name"))
    return c.select("c_custkey", K.normalize_zip(text).alias("zip"), K.clean_text(name, "UNKNOWN", upper=True).alias("name"), K.fixed4(F.col("c_acctbal")).alias("fixed"), K.round_half_even(F.col("c_acctbal")).alias("whole"), K.cents_to_units(F.col("c_acctbal")).alias("units"))


@query("parse_fields", "select o_orderkey, try_cast(case when o_orderkey % 5 = 0 then 'x' else cast(o_orderkey as varchar) end as integer) as id, case when o_orderkey % 3 = 0 then null else cast(o_orderdate as date) end as date, case when o_orderkey % 4 = 0 then null else o_totalprice end as price, cast(date_trunc('month', o_orderdate) as date) as month, cast(cast(o_orderdate as date) + to_months(13) as date) as later from orders")
def parse_fields(spark, d):
    o, n = D.table(spark, d, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        "o_orderkey",
        K.snapshot_key(F.when(n % 5 == 0, "x").otherwise(F.concat(F.lit(" "), n.cast("string")))).alias("id"),
        K.lenient_date(F.when(n % 3 == 0, "no date").otherwise(day)).alias("date"),
        K.lenient_double(F.when(n % 4 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))).alias("price"),
        K.month_start(K.strict_date(day)).alias("month"),
        K.add_months_clamped(K.strict_date(day), 13).alias("later"),
    )


@query("region_rows", "select r_name as region, upper(n_name) as county from region join nation on r_regionkey = n_regionkey")
def region_rows(spark, d):
    r, n = D.table(spark, d, "region"), D.table(spark, d, "nation")
    lists = r.join(n, r["r_regionkey"] == n["n_regionkey"]).groupBy("r_name").agg(F.array_join(F.collect_list(F.lower("n_name")), " , ").alias("list"))
    return regions.regions_from_rows(lists, "r_name", "list")


# Region assignment and outcomes


@query("zip_region_table", f"with {_REG} select zip, region from zr")
def zip_region_table(spark, d):
    return D.zips(spark, d)


for _period in ("snapshot", "month"):

    @query(
        f"row_outcomes_{_period}",
        f"""with {_REG}, c as (select *, case when short_row then 'short_row' when {_period} is null then 'bad_period' when zip = '' then 'no_zip' end as o, zip in (select zip from zr) as r, zip in (select zip from xw) as x from reg)
        select count(*) as rows_total, count(*) filter (where o = 'short_row') as short_row, count(*) filter (where o = 'bad_period') as bad_period, count(*) filter (where o = 'no_zip') as no_zip,
        count(*) filter (where o is null and not x) as no_county, count(*) filter (where o is null and not r) as no_region, count(*) filter (where o is null and r) as kept from c""",
    )
    def row_outcomes(spark, d, period=_period):
        return regions.row_outcomes(regions.classify_rows(D.registrations(spark, d), D.crosswalk(spark, d), D.zips(spark, d), period))

    @query(f"stock_exact_{_period}", f"with {_enr(_period)}, f as (select *, unnest(case when is_ev then ['ALL', 'EV'] else ['ALL'] end) as metric from enr) select region, period as \"group\", metric, count(distinct vin) as approx_unique_vins from f group by 1, 2, 3")
    def stock_exact(spark, d, period=_period):
        return stock.stock_counts(D.enriched(spark, d, period), exact=True)

    @query(f"stock_approx_{_period}", f"with {_enr(_period)}, f as (select *, unnest(case when is_ev then ['ALL', 'EV'] else ['ALL'] end) as metric from enr) select region, period as \"group\", metric, count(distinct vin) as exact, true as within from f group by 1, 2, 3")
    def stock_approx(spark, d, period=_period):
        rows = materialize(D.enriched(spark, d, period))
        exact = stock.stock_counts(rows, exact=True).withColumnRenamed("approx_unique_vins", "exact")
        both = stock.stock_counts(rows).join(exact, stock.KEYS)
        return both.select(*stock.KEYS, "exact", (F.abs(F.col("approx_unique_vins") - F.col("exact")) <= F.greatest(F.lit(3.0), F.col("exact") * 0.02)).alias("within"))


@query("county_and_region_lookup", f"with {_REG} select region, county, count(*) as n from reg join xw using (zip) join sp using (county) group by 1, 2")
def county_and_region_lookup(spark, d):
    rows = D.registrations(spark, d).withColumn("zip", K.normalize_zip(F.col("zip")))
    return regions.join_regions(regions.join_county(rows, D.crosswalk(spark, d)), D.region_spec(spark, d)).groupBy("region", "county").agg(F.count(F.lit(1)).alias("n"))


@query("drivetrain_lookup", f"with {_REG} select coalesce(d, 'UNKNOWN') as drivetrain, coalesce(d, 'UNKNOWN') in ('ECONOMY', 'SMALL') as ev, count(*) as n from reg left join veh on vin_key = k group by 1, 2")
def drivetrain_lookup(spark, d):
    joined = regions.join_drivetrain(D.registrations(spark, d), D.vehicles(spark, d))
    return joined.groupBy("drivetrain", K.is_ev(F.col("drivetrain"), D.EV_TYPES).alias("ev")).agg(F.count(F.lit(1)).alias("n"))


@query("metric_fan_out", f"with {_enr()}, f as (select *, unnest(case when is_ev then ['ALL', 'EV'] else ['ALL'] end) as metric from enr) select region, metric, count(*) as n from f where region in ('ASIA', 'EUROPE') group by 1, 2")
def metric_fan_out(spark, d):
    return S.filter_series(regions.fan_out_metrics(D.enriched(spark, d)), ["ASIA", "EUROPE"]).groupBy("region", "metric").agg(F.count(F.lit(1)).alias("n"))


@query("rows_per_file", "select 'lineitem.parquet' as file, count(*) as rows from lineitem")
def rows_per_file(spark, d):
    return regions.rows_per_file(D.table(spark, d, "lineitem"))


# Stock and flow


@query("stock_sketch_by_region", f"with {_enr()}, f as (select *, unnest(case when is_ev then ['ALL', 'EV'] else ['ALL'] end) as metric from enr) select region, metric, count(distinct vin) as exact, true as within from f group by 1, 2")
def stock_sketch_by_region(spark, d):
    rows = materialize(D.enriched(spark, d))
    merged = stock.merge_sketches(stock.stock_sketches(rows), ["region", "metric"])
    exact = regions.fan_out_metrics(rows).groupBy("region", "metric").agg(F.count_distinct("vin").alias("exact"))
    return merged.join(exact, ["region", "metric"]).select("region", "metric", "exact", (F.abs(F.col("approx_unique_vins") - F.col("exact")) <= F.greatest(F.lit(3.0), F.col("exact") * 0.02)).alias("within"))


@query("stock_pivot_share", f"with {_enr()}, s as (select region, period as \"group\", cast(nullif(count(distinct case when is_ev then vin end), 0) as double) as stock_ev_t, cast(count(distinct vin) as double) as stock_all_t from enr group by 1, 2) select *, round(coalesce(stock_ev_t, 0) / stock_all_t, 6) as ev_share from s")
def stock_pivot_share(spark, d):
    wide = stock.stock_share(stock.pivot_metrics(stock.sort_counts(stock.stock_counts(D.enriched(spark, d), exact=True))))
    return wide.withColumn("ev_share", F.round("ev_share", 6))


@query("first_seen", f"with {_SERIES} select region, vin, snapshot_id from seen")
def first_seen(spark, d):
    return flow.first_seen(D.enriched(spark, d))


@query("vehicle_ev_flag", f"with {_SERIES} select vin, is_ev from flag")
def vehicle_ev_flag(spark, d):
    return flow.vehicle_ev_flag(D.enriched(spark, d))


@query("new_registrations", f"with {_SERIES} select region, snapshot_id, new_all, new_ev, round(100.0 * new_ev / new_all, 6) as ev_share_pct from nr")
def new_registrations(spark, d):
    return flow.new_registrations(D.enriched(spark, d)).withColumn("ev_share_pct", F.round("ev_share_pct", 6))


@query("flow_stock_check", f"with {_SERIES} select region, snapshot_id, sum(flow) over w as cum_flow, stock - first_value(stock) over w as stock_growth, stock - lag(stock) over w as delta from ser window w as (partition by region order by date)")
def flow_stock_check(spark, d):
    rows = S.stock_delta(S.flow_stock_check(D.series(spark, d), "flow", "stock", ["region"], "date"), "stock", ["region"], "date")
    return rows.select("region", "snapshot_id", "cum_flow", "stock_growth", "delta")


@query(
    "flow_by_month",
    f"""with {_SERIES}, v as (select region, flow, cast(date + to_days(10) as date) as d, lag(cast(date + to_days(10) as date)) over (partition by region order by date) as prev from ser),
    x as (select region, flow / date_diff('day', prev, d) as f, unnest(generate_series(prev + to_days(1), cast(d as timestamp), interval 1 day)) as day from v where prev is not null)
    select region, cast(date_trunc('month', day) as date) as month, round(sum(f), 6) as flow from x group by 1, 2""",
)
def flow_by_month(spark, d):
    rows = D.series(spark, d).withColumn("date", F.date_add("date", 10))
    return S.allocate_to_months(rows, "flow", "date", ["region"]).withColumn("flow", F.round("flow", 6))


# Series tools


_ASOF = "with l as (select l_orderkey, l_linenumber, l_partkey, l_shipdate as t from lineitem), r as (select o_custkey as l_partkey, o_orderdate as t, max(o_orderkey) as last_order from orders group by 1, 2) select l_orderkey, l_linenumber, l.l_partkey, l.t, last_order from l asof left join r on l.l_partkey = r.l_partkey and l.t >= r.t"


@query("asof_by_key", _ASOF)
def asof_by_key(spark, d):
    left = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("t"))
    right = D.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("l_partkey"), F.col("o_orderdate").alias("t2")).agg(F.max("o_orderkey").alias("last_order"))
    return S.asof_join(left, right, "t", "t2", ["l_partkey"])


_PRICES = "pr as (select cast(date_trunc('month', o_orderdate) as date) as date, round(avg(o_totalprice / 40000.0), 6) as gas_price_t from orders where month(o_orderdate) % 2 = 0 and year(o_orderdate) >= 1996 group by 1)"


@query("asof_price_filled", f"with {_SERIES}, {_PRICES}, j as (select region, snapshot_id, ser.date, gas_price_t from ser asof left join pr on ser.date >= pr.date) select region, snapshot_id, coalesce(gas_price_t, (select arg_min(gas_price_t, date) from pr)) as gas_price_t from j")
def asof_price_filled(spark, d):
    return P.attach_price(D.series(spark, d), D.prices(spark, d)).select("region", "snapshot_id", "gas_price_t")


@query("daily_density", f"with {_PRICES}, s as (select unnest(generate_series(cast(min(date) as timestamp), cast(max(date) as timestamp), interval 1 day)) as d from pr) select cast(d as date) as date, gas_price_t from (select cast(d as date) as d from s) s asof join pr on s.d >= pr.date")
def daily_density(spark, d):
    return S.densify_daily(D.prices(spark, d), "date", ["gas_price_t"], [])


@query("lag_and_split", f"with {_SERIES} select region, max(date) filter (where date < date '2000-01-01') as last_train_date, arg_max(stock, date) filter (where date < date '2000-01-01') as last_train_stock, min(date) filter (where date >= date '2000-01-01') as first_test_date, arg_min(stock, date) filter (where date >= date '2000-01-01') as first_test_stock, sum(prev) as lagged from num where stock > 0 and date >= date '1995-02-01' group by 1".replace("sum(prev)", "sum(case when i = j then 0 else prev end)").replace("from num where", "from (select *, min(i) over (partition by region) as j from num where stock > 0 and date >= date '1995-02-01') num where"))
def lag_and_split(spark, d):
    rows = S.lag_stock(S.positive_stock(S.since(D.series(spark, d), "date", "1995-02-01"), "stock"), "stock", ["region"], "date")
    rows = S.train_flag(rows, "date", "2000-01-01")
    return S.split_points(rows, ["region"], "date", "stock").join(rows.groupBy("region").agg(F.sum("y_prev").alias("lagged")), "region")


@query("extend_future", f"with {_SERIES}, x as (select region, max(date) as d, arg_max(flow, date) as f from ser group by 1) select region, date, stock, flow from ser union all select region, cast(d + to_months(cast(h as integer)) as date), null, f from x, (select unnest([1, 2, 3]) as h)")
def extend_future(spark, d):
    return S.extend_future(D.series(spark, d).select("region", "date", "stock", "flow"), 3, ["region"], "date", ["flow"])


@query("last_observed", f"with {_SERIES} select region, max(date) as date, arg_max(stock, date) as stock, arg_max(flow, date) as flow from ser group by 1")
def last_observed(spark, d):
    return S.last_observed(D.series(spark, d).select("region", "date", "stock", "flow"), ["region"], "date")


@query("test_rows", f"with {_SERIES} select region, snapshot_id, stock from ser where date >= date '2000-01-01'")
def test_rows(spark, d):
    return S.test_rows(D.series(spark, d), "stock").select("region", "snapshot_id", "stock")


# Policy


def _steps(name: str) -> str:
    whens = " ".join(f"when cast(date as date) >= date '{s}' then {v}" for s, v in reversed(policy.SCHEDULES[name]) if s)
    return f"cast(case {whens} else {policy.SCHEDULES[name][0][1]} end as double)"


_ZEV = f"case when cast(date as date) >= date '2026-01-01' then 0.35 + (year(date) - 2026) * cast(0.65 as double) / 9.0 else {_steps('zev_index_t')} end"
_DAYS = "days as (select distinct cast(o_orderdate as date) + to_days(5475 + o_custkey % 5000) as date from orders)".replace("to_days(5475 + o_custkey % 5000)", "cast(5475 + o_custkey % 5000 as integer)")


def _order_days(spark, d):
    return D.table(spark, d, "orders").select(F.date_add(F.to_date("o_orderdate"), (5475 + F.col("o_custkey") % 5000).cast("int")).alias("date")).distinct()


@query("policy_schedules", f"with {_DAYS} select date, {', '.join(f'{_steps(n)} as {n}' for n in policy.SCHEDULES if n != 'zev_index_t')}, round({_ZEV}, 6) as zev_index_t from days")
def policy_schedules(spark, d):
    return policy.apply_schedules(_order_days(spark, d)).withColumn("zev_index_t", F.round("zev_index_t", 6))


@query("schedule_from_table", f"with {_DAYS} select date, {_steps('credit_gm')} as credit_gm, {_steps('state_rebate_t')} as state_rebate_t from days")
def schedule_from_table(spark, d):
    rows = [(n, a, b, v) for n in ("credit_gm", "state_rebate_t") for (a, v), (b, _) in zip(policy.SCHEDULES[n], [*policy.SCHEDULES[n][1:], (None, 0.0)], strict=True)]
    steps = spark.createDataFrame(rows, "name string, f string, t string, value double").select("name", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"), "value")
    return policy.apply_schedule(_order_days(spark, d), steps)


_BINS = """b as (select c_mktsegment as county, least(floor(c_acctbal / 2000.0), 4) as k, c_custkey % 3 as s from customer where c_acctbal >= 0),
f as (select county, s, k * 2000.0 as lo, case when k < 4 then (k + 1) * 2000.0 end as hi, [3000.0, 7500.0, 12000.0][s + 1] as t from b),
e as (select county, avg(case when t <= lo then 0.0 when hi is null then 1 - pow(lo / t, 2.5) when t >= hi then 1.0 else (t - lo) / (hi - lo) end) as share from f group by 1)"""


@query("eligible_share", f"with {_BINS} select county, round(share, 6) as share from e")
def eligible_share(spark, d):
    return policy.eligible_share(D.income_bins(spark, d), {"single": 3000.0, "joint": 7500.0, "hoh": 12000.0}, ["county"]).withColumn("share", F.round("share", 6))


_MSRP = "ms as (select cast(date_trunc('month', o_orderdate) as date) + 3 as date, max(o_totalprice) / 10.0 as price from orders where month(o_orderdate) % 3 = 0 group by 1)"
_CAL = "cal as (select cast(unnest(generate_series(timestamp '1995-01-01', timestamp '2030-12-01', interval 1 month)) as date) as date)"


def _msrp(spark, d):
    o = D.table(spark, d, "orders").where("month(o_orderdate) % 3 = 0")
    return o.groupBy(F.date_add(F.trunc("o_orderdate", "MM"), 3).alias("date")).agg((F.max("o_totalprice") / 10.0).alias("avg_msrp_ev_stock_t"))


@query(
    "policy_table",
    f"""with {_PRICES}, {_MSRP}, {_CAL}, j as (select c.date, gas_price_t from cal c asof left join pr on c.date >= pr.date), k as (select j.*, price from j asof left join ms on j.date >= ms.date),
    a as (select date, coalesce(gas_price_t, (select arg_min(gas_price_t, date) from pr)) as gas_price_t, price as avg_msrp_ev_stock_t, coalesce(price, (select arg_min(price, date) from ms)) as avg_msrp_t,
      {', '.join(f'{_steps(n)} as {n}' for n in policy.SCHEDULES if n != 'zev_index_t')}, {_ZEV} as zev_index_t from k),
    c as (select *, case when date >= date '2023-01-01' then 0.30 * 7500 + 0.70 * 7500 * 0.85 else 0.39 * credit_tsla + 0.05 * credit_gm + 0.56 * credit_other end as fed from a)
    select date, round(gas_price_t, 6) as gas_price_t, credit_tsla, credit_gm, credit_other, round(cast(fed as double), 6) as fed_credit_avg_t, cast(0.85 as double) as s_inc_30d_t, cast(0.65 as double) as s_inc_25e_t, cast(0.3 as double) as lease_share_t, cast(0 as double) as used_purchase_share_t,
      state_rebate_t, delta_t, round(cast(state_rebate_t + delta_t * fed as double), 6) as total_subsidy_t, round(avg_msrp_ev_stock_t, 6) as avg_msrp_ev_stock_t, round(avg_msrp_t, 6) as avg_msrp_t, round(cast((state_rebate_t + delta_t * fed) / avg_msrp_t as double), 6) as subsidy_share_t,
      valley_dummy_t, urgency_t, round(zev_index_t, 6) as zev_index_t, fed_policy_index_t, round(cast(gas_price_t / 28.0 - 0.22 * 0.30 as double), 6) as tco_adv_t from c""",
)
def policy_table(spark, d):
    t = policy.policy_table(S.month_calendar(spark, "1995-01-01", "2030-12-01"), D.prices(spark, d), _msrp(spark, d))
    names = ["gas_price_t", "fed_credit_avg_t", "total_subsidy_t", "avg_msrp_ev_stock_t", "avg_msrp_t", "subsidy_share_t", "zev_index_t", "tco_adv_t"]
    exact = ["date", "credit_tsla", "credit_gm", "credit_other", "s_inc_30d_t", "s_inc_25e_t", "lease_share_t", "used_purchase_share_t", "state_rebate_t", "delta_t", "valley_dummy_t", "urgency_t", "fed_policy_index_t"]
    return t.select(*exact, *r6(*names))


#: (scenario, s30d, s25e, lease, used, factor of prices or none at all)
_SCENARIO_ROWS = [("base", 0.85, 0.65, 0.30, 0.0, 1.0), ("tight", 0.6, 0.4, 0.2, 0.1, 1.25), ("ended", None, None, None, None, None)]


@query(
    "policy_table_scenarios",
    f"""with {_PRICES}, {_MSRP}, {_CAL}, sc(scenario, s30, s25, lease, used, f) as (values ('base', 0.85, 0.65, 0.3, 0.0, 1.0), ('tight', 0.6, 0.4, 0.2, 0.1, 1.25), ('ended', 0.85, 0.65, 0.3, 0.0, null)),
    pg as (select scenario, date, gas_price_t * f as g from pr, sc where f is not null), pm as (select scenario, date, price * f as p from ms, sc where f is not null),
    c as (select * from cal, sc), j as (select c.*, g from c asof left join pg on c.scenario = pg.scenario and c.date >= pg.date), k as (select j.*, p from j asof left join pm on j.scenario = pm.scenario and j.date >= pm.date),
    a as (select *, coalesce(g, (select arg_min(g, date) from pg where pg.scenario = k.scenario), 3.5) as gas, coalesce(p, (select arg_min(p, date) from pm where pm.scenario = k.scenario), 45000.0) as msrp,
      {', '.join(f'{_steps(n)} as {n}' for n in policy.SCHEDULES if n not in ('zev_index_t', 'state_rebate_t'))}, case when scenario = 'ended' and date >= date '2018-06-01' and date < date '2024-03-01' then 0.0 when scenario = 'tight' and date < date '2019-01-01' then 500.0 else {_steps('state_rebate_t')} end as rebate from k),
    b as (select *, case when date >= date '2023-01-01' then lease * 7500 + (1 - lease - used) * 7500 * s30 + used * 4000 * s25 else 0.39 * credit_tsla + 0.05 * credit_gm + 0.56 * credit_other end as fed from a)
    select scenario, date, round(cast(gas as double), 6) as gas_price_t, round(cast(msrp as double), 6) as avg_msrp_t, cast(rebate as double) as state_rebate_t, round(cast(fed as double), 6) as fed_credit_avg_t, round(cast(rebate + delta_t * fed as double), 6) as total_subsidy_t,
      round(cast((rebate + delta_t * fed) / msrp as double), 6) as subsidy_share_t, round(cast(gas / 28.0 - 0.22 * 0.30 as double), 6) as tco_adv_t from b""",
)
def policy_table_scenarios(spark, d):
    """Three scenarios over the whole calendar: other shares and dearer prices, and one without series whose rebate ends for some years."""
    scenarios = spark.createDataFrame(_SCENARIO_ROWS, "scenario string, s30d double, s25e double, lease double, used double, factor double")
    factors = F.array(*[F.struct(F.lit(r[0]).alias("scenario"), F.lit(r[5]).alias("factor")) for r in _SCENARIO_ROWS if r[5]])
    spread = lambda df, c: df.withColumn("_s", F.explode(factors)).select("_s.scenario", "date", (F.col(c) * F.col("_s.factor")).alias(c))
    steps = [("ended", "state_rebate_t", "2018-06-01", "2024-03-01", 0.0), ("tight", "state_rebate_t", None, "2019-01-01", 500.0)]
    schedule = spark.createDataFrame(steps, "scenario string, name string, f string, t string, value double").select("scenario", "name", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"), "value")
    t = policy_scenario_table(scenarios, "1995-01-01", "2030-12-01", spread(D.prices(spark, d), "gas_price_t"), spread(_msrp(spark, d), "avg_msrp_ev_stock_t"), schedule, ("state_rebate_t",))
    return t.select("scenario", "date", "state_rebate_t", *r6("gas_price_t", "avg_msrp_t", "fed_credit_avg_t", "total_subsidy_t", "subsidy_share_t", "tco_adv_t"))


_CREDITS = f"with {_BINS}, {_CAL} select county, date, round(cast(case when date >= date '2023-01-01' then 0.30 * 7500 + 0.60 * 7500 * share + 0.10 * 4000 * 0.65 end as double), 6) as credit from e, cal"


@query("policy_scenarios", _CREDITS)
def policy_scenarios(spark, d):
    """The whole calendar of the policy table; both names are one query."""
    shares = policy.eligible_share(D.income_bins(spark, d), {"single": 3000.0, "joint": 7500.0, "hoh": 12000.0}, ["county"])
    months = S.month_calendar(spark, "1995-01-01", "2030-12-01")
    credit = F.when(F.col("date") >= F.to_date(F.lit("2023-01-01")), policy.effective_credit(F.col("share"), F.lit(0.65), lease=0.30, used=0.10))
    return shares.crossJoin(F.broadcast(months)).select("county", "date", F.round(credit, 6).alias("credit"))


@query(
    "price_coverage",
    f"with {_REG} select snapshot, count(*) filter (where k in ('BEV', 'PHEV')) as ev_count_total, count(*) filter (where k in ('BEV', 'PHEV') and pr is not null) as ev_count_priced, round(avg(pr) filter (where k in ('BEV', 'PHEV')), 6) as avg_msrp_ev_stock_t, round(avg(pr) filter (where k = 'BEV'), 6) as avg_msrp_bev_stock_t, round(avg(pr) filter (where k = 'PHEV'), 6) as avg_msrp_phev_stock_t, count(*) filter (where k = 'BEV' and pr is not null) as bev_count_priced, count(*) filter (where k = 'PHEV' and pr is not null) as phev_count_priced, round(100.0 * count(*) filter (where k in ('BEV', 'PHEV') and pr is not null) / nullif(count(*) filter (where k in ('BEV', 'PHEV')), 0), 6) as coverage_pct from (select reg.snapshot, case p_type when 'ECONOMY' then 'BEV' when 'SMALL' then 'PHEV' else 'ICE' end as k, case when p_partkey % 4 <> 0 then p_retailprice end as pr from reg join part on vin = cast(p_partkey as varchar) where snapshot is not null) x group by 1",
)
def price_coverage(spark, d):
    part = D.table(spark, d, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "BEV").when(F.col("p_type") == "SMALL", "PHEV").otherwise("ICE")
    priced = part.select(F.col("p_partkey").cast("string").alias("vin"), kind.alias("kind"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("price"))
    rows = regions.period_key(D.registrations(spark, d), "snapshot").where("period is not null").withColumnRenamed("period", "snapshot").join(priced, "vin")
    out = policy.price_coverage(rows, ["snapshot"])
    names = ["avg_msrp_ev_stock_t", "avg_msrp_bev_stock_t", "avg_msrp_phev_stock_t", "coverage_pct"]
    return out.select("snapshot", "ev_count_total", "ev_count_priced", "bev_count_priced", "phev_count_priced", *r6(*names))


# Panel and diffusion


@query(
    "panel",
    f"""with {_SERIES}, {_PRICES}, st as (select region, period as snapshot_id, cast(count(distinct case when is_ev then vin end) as double) as stock_ev_t, cast(count(distinct vin) as double) as stock_all_t from enr group by 1, 2),
    dt as (select st.*, (select cast(date '1995-01-01' + to_months(st.snapshot_id) as date) - 1) as date from st),
    j as (select dt.*, gas_price_t from dt asof left join pr on dt.date >= pr.date)
    select j.region, j.snapshot_id as "group", j.date, stock_ev_t, stock_all_t, cast(coalesce(new_ev, 0) as double) as flow_ev_t, coalesce(gas_price_t, (select arg_min(gas_price_t, date) from pr)) as gas_price_t,
      round(coalesce(gas_price_t, (select arg_min(gas_price_t, date) from pr)) / 28.0 - 0.22 * 0.30, 6) as tco_adv_t
    from j left join nr on nr.region = j.region and nr.snapshot_id = j.snapshot_id where stock_ev_t > 0 and j.date >= date '1996-01-01'""".replace("(select cast(date '1995-01-01' + to_months(st.snapshot_id) as date) - 1)", "cast(date '1995-01-01' + to_months(st.snapshot_id) as date) - 1"),
)
def panel(spark, d):
    rows = materialize(D.enriched(spark, d))
    # A few rows for each region and period, which several steps read: each is counted from all registrations once.
    counts = materialize(stock.stock_counts(rows, exact=True))
    new = materialize(flow.new_registrations(rows))
    calendar = counts.select(F.col("group").alias("snapshot_id")).distinct().withColumn("snapshot_date", F.expr("date_sub(add_months(date '1995-01-01', snapshot_id), 1)"))
    built = P.build_panel(counts, new, calendar, D.prices(spark, d), min_date="1996-01-01")
    return built.select("region", "group", "date", "stock_ev_t", "stock_all_t", "flow_ev_t", "gas_price_t", F.round("tco_adv_t", 6).alias("tco_adv_t"))


@query("panel_with_policy", f"with {_SERIES}, {_CAL}, po as (select date, {_steps('urgency_t')} as urgency_t, {_steps('state_rebate_t')} as state_rebate_t from cal where date >= date '1996-01-01') select region, snapshot_id, urgency_t, state_rebate_t from ser asof left join po on ser.date >= po.date")
def panel_with_policy(spark, d):
    months = S.month_calendar(spark, "1996-01-01", "2030-12-01")
    return P.attach_policy(D.series(spark, d), policy.apply_schedules(months, names=["urgency_t", "state_rebate_t"])).select("region", "snapshot_id", "urgency_t", "state_rebate_t")


@query("bass_one_step", f"with {_SERIES} select region, date, round((p + q * prev / m) * (m - prev), 4) as flow_hat, round(prev + (p + q * prev / m) * (m - prev), 4) as stock_hat from num join par using (region)")
def bass_one_step(spark, d):
    s = D.series(spark, d)
    return B.one_step(s, D.parameters(s), ["region"], "date", "stock").select("region", "date", F.round("flow_hat", 4).alias("flow_hat"), F.round("stock_hat", 4).alias("stock_hat"))


def _projection(rate: str) -> tuple[str, str]:
    """Recursive SQL of the free run and of the anchored projection; ``rate`` is p of row i + 1 (at most n)."""
    base = f"""with recursive {_SERIES}, rt as (select num.*, p, q, m, {rate} as pt from num join par using (region)),
    ix as (select region, n, q, m, max(date) as last_date from rt group by 1, 2, 3, 4)"""
    first = f"""{base}, r(region, i, y, f) as (select region, cast(1 as bigint), stock, cast(null as double) from rt where i = 1
      union all select r.region, r.i + 1, r.y + (x.pt + ix.q * r.y / ix.m) * (ix.m - r.y), (x.pt + ix.q * r.y / ix.m) * (ix.m - r.y) from r join ix on ix.region = r.region join rt x on x.region = r.region and x.i = least(r.i + 1, ix.n) where r.i < ix.n + 6)
    select r.region, case when r.i <= ix.n then d.date else cast(ix.last_date + to_months(cast(r.i - ix.n as integer)) as date) end as date, round(r.y, 4) as stock_hat, round(r.f, 4) as flow_hat from r join ix on ix.region = r.region left join rt d on d.region = r.region and d.i = r.i"""
    last = f"""{base}, r(region, h, y, f) as (select region, cast(0 as bigint), stock, cast(null as double) from rt where i = n
      union all select r.region, r.h + 1, r.y + (x.pt + ix.q * r.y / ix.m) * (ix.m - r.y), (x.pt + ix.q * r.y / ix.m) * (ix.m - r.y) from r join ix on ix.region = r.region join rt x on x.region = r.region and x.i = ix.n where r.h < 6)
    select region, date, round(stock, 4) as stock_hat, round((pt + q * prev / m) * (m - prev), 4) as flow_hat from rt
    union all select r.region, cast(ix.last_date + to_months(cast(h as integer)) as date), round(y, 4), round(f, 4) from r join ix using (region) where h > 0"""
    return first, last


_CONST, _COV = _projection("p"), _projection("exp(-6 + 0.01 * flow)")
for _kind, _sqls in (("constant", _CONST), ("covariate", _COV)):
    for _start, _sql in zip(("first", "last"), _sqls, strict=True):

        @query(f"bass_project_{_kind}_{_start}", _sql)
        def bass_project(spark, d, kind=_kind, start=_start):
            s = D.series(spark, d).withColumn("pt", B.innovation_rate(F.lit(-6.0), [F.col("flow")], [F.lit(0.01)]))
            out = B.project(s, D.parameters(s), ["region"], "date", "stock", 6, start, "pt" if kind == "covariate" else None)
            return out.select("region", "date", F.round("stock_hat", 4).alias("stock_hat"), F.round("flow_hat", 4).alias("flow_hat"))


def _holdout(spark, d):
    s = D.series(spark, d)
    return s, B.project_holdout(s, D.parameters(s), ["region"], "date", "stock", 3)


_HOLD = f"""with recursive {_SERIES}, rt as (select num.*, p, q, m, date < date '2000-01-01' as train from num join par using (region)),
ix as (select region, count(*) filter (where train) as k, n, q, m, p, max(date) as last_date from rt group by region, n, q, m, p),
r(region, i, y, f) as (select rt.region, k, stock, cast(null as double) from rt join ix on ix.region = rt.region and ix.k = rt.i
  union all select r.region, r.i + 1, r.y + (p + q * r.y / m) * (m - r.y), (p + q * r.y / m) * (m - r.y) from r join ix on ix.region = r.region where r.i < ix.n + 3),
al as (select region, i, date from rt union all select region, n + h, cast(last_date + to_months(cast(h as integer)) as date) from ix, (select unnest([1, 2, 3]) as h)),
ho as (select al.region, al.date, cast(al.i <= ix.k as integer) as is_train, case when al.i = 1 then rt.stock when al.i <= ix.k then prev + (rt.p + rt.q * prev / rt.m) * (rt.m - prev) end as stock_fit,
  case when al.i > 1 and al.i <= ix.k then (rt.p + rt.q * prev / rt.m) * (rt.m - prev) end as flow_fit, r.y as stock_anchor, r.f as flow_anchor, rt.flow, rt.stock
  from al join ix on ix.region = al.region left join rt on rt.region = al.region and rt.i = al.i left join r on r.region = al.region and r.i = al.i)"""


@query("bass_holdout", f"{_HOLD} select region, date, is_train, round(stock_fit, 4) as stock_fit, round(flow_fit, 4) as flow_fit, round(stock_anchor, 4) as stock_anchor, round(flow_anchor, 4) as flow_anchor from ho")
def bass_holdout(spark, d):
    _, h = _holdout(spark, d)
    return h.select("region", "date", "is_train", *[F.round(c, 4).alias(c) for c in ("stock_fit", "flow_fit", "stock_anchor", "flow_anchor")])


@query("holdout_metrics", f"{_HOLD} select region, 'baseline' as model, count(*) as n_test, min(date) as date_min_test, max(date) as date_max_test, round(sqrt(avg(pow(flow - flow_anchor, 2))), 4) as rmse_flow, round(100 * avg(abs((flow - flow_anchor) / flow)) filter (where abs(flow) > 1e-9), 4) as mape_flow_pct, round(sqrt(avg(pow(stock - stock_anchor, 2))), 4) as rmse_stock, round(100 * avg(abs((stock - stock_anchor) / stock)), 4) as mape_stock_pct from ho where is_train = 0 and stock is not null group by 1")
def holdout_metrics(spark, d):
    s, h = _holdout(spark, d)
    rows = h.join(s.select("region", "date", F.col("flow").alias("flow_obs"), F.col("stock").alias("stock_obs")), ["region", "date"], "left")
    rows = rows.select("region", F.lit("baseline").alias("model"), "date", "is_train", "flow_obs", "stock_obs", F.col("flow_anchor").alias("flow_hat"), F.col("stock_anchor").alias("stock_hat"))
    out = metrics.holdout_metrics(rows, ["region"])
    return out.select("region", "model", "n_test", "date_min_test", "date_max_test", *[F.round(c, 4).alias(c) for c in ("rmse_flow", "mape_flow_pct", "rmse_stock", "mape_stock_pct")])


@query("forecast_wide", f"with {_SERIES}, a as (select region, date, (p + q * prev / m) * (m - prev) as f, (2 * p + q * prev / m) * (m - prev) as g from num join par using (region)) select region, date, round(f, 4) as baseline_flow, round(g, 4) as double_p_flow from a")
def forecast_wide(spark, d):
    s = D.series(spark, d)
    par = D.parameters(s)
    both = None
    for model, p in (("baseline", 1.0), ("double_p", 2.0)):
        one = B.one_step(s, par.withColumn("p", F.col("p") * p), ["region"], "date", "stock").select("region", "date", F.lit(model).alias("model"), F.col("flow_hat").alias("flow"), "stock_hat")
        both = one if both is None else both.unionByName(one)
    wide = B.forecast_wide(both, ["region"], ["baseline", "double_p"], ["flow", "stock_hat"])
    return wide.select("region", "date", F.round("baseline_flow", 4).alias("baseline_flow"), F.round("double_p_flow", 4).alias("double_p_flow"))


_SLOW = _CONST[1].replace("cast(0.12 as double) as q", "cast(0.06 as double) as q")
_SCENARIOS = f"select 'base' as scenario, * from ({_CONST[1]}) union all select 'slow', * from ({_SLOW})"


@query("scenario_projection", _SCENARIOS)
def scenario_projection(spark, d):
    """Every scenario; both names are one query."""
    return _scenarios(spark, d)


def _scenarios(spark, d):
    s = D.series(spark, d)
    scenarios = D.parameters(s).withColumn("scenario", F.explode(F.array(F.lit("base"), F.lit("slow")))).withColumn("q", F.when(F.col("scenario") == "slow", F.col("q") / 2).otherwise(F.col("q")))
    keyed = s.crossJoin(F.broadcast(scenarios.select("scenario").distinct()))
    out = B.project(keyed, scenarios, ["region", "scenario"], "date", "stock", 6, "last")
    return out.select("scenario", "region", "date", F.round("stock_hat", 4).alias("stock_hat"), F.round("flow_hat", 4).alias("flow_hat"))


@query("feature_moments", f"with {_SERIES}, t as (select region, avg(flow) as m, stddev_pop(flow) + 1e-9 as s from ser group by 1) select region, snapshot_id, round(m, 6) as flow_mean, round(s, 6) as flow_std, round((flow - m) / s, 6) as z_flow, round((flow - m) / s * 2 + stock / 100 * 0.5, 6) as dot from ser join t using (region)")
def feature_moments(spark, d):
    s = D.series(spark, d)
    z = B.standardized(s, B.feature_moments(s, ["flow"], ["region"]), ["flow"], ["region"])
    dot = K.array_dot(F.array("z_flow", F.col("stock") / 100), F.array(F.lit(2.0), F.lit(0.5)))
    return z.select("region", "snapshot_id", F.round("flow_mean", 6).alias("flow_mean"), F.round("flow_std", 6).alias("flow_std"), F.round("z_flow", 6).alias("z_flow"), F.round(dot, 6).alias("dot"))


@query(
    "bass_fit_grid",
    f"""with {_SERIES}, t as (select region, max(stock) as top from ser group by 1), g as (select i as candidate, 1.01 * pow(10 / 1.01, i / 11.0) as g from (select unnest(range(12)) as i) union all select 12, 1.5),
    x as (select region, candidate, g, top, prev / top as u, flow / top as n from num join t using (region), g),
    s as (select region, candidate, g, top, sum((g - u) * (g - u)) as aa, sum((g - u) * u / g * (g - u)) as ab, sum(pow(u / g * (g - u), 2)) as bb, sum((g - u) * n) as an, sum(u / g * (g - u) * n) as bn, sum(n * n) as nn, count(*) as c from x group by 1, 2, 3, 4),
    o as (select *, unnest([(an * bb - bn * ab) / nullif(aa * bb - ab * ab, 0), 1e-6, 0.1, greatest(1e-6, least(0.1, (an - 1e-3 * ab) / aa)), greatest(1e-6, least(0.1, (an - 2.0 * ab) / aa))]) as p,
      unnest([(bn * aa - an * ab) / nullif(aa * bb - ab * ab, 0), greatest(1e-3, least(2.0, (bn - 1e-6 * ab) / bb)), greatest(1e-3, least(2.0, (bn - 0.1 * ab) / bb)), 1e-3, 2.0]) as q from s),
    e as (select region, candidate, g * top as m, p, q, (nn - 2 * p * an - 2 * q * bn + p * p * aa + 2 * p * q * ab + q * q * bb) / c * top * top as mse from o where p between 1e-6 and 0.1 and q between 1e-3 and 2.0),
    b as (select *, row_number() over (partition by region order by mse, candidate) as k from e)
    select region, round(p, 5) as p, round(q, 5) as q, round(m, 3) as "M", round(mse, 3) as mse from b where k = 1""",
)
def bass_fit_grid(spark, d):
    fit = B.fit_bass(D.series(spark, d), ["region"], "date", "stock", "flow", rounds=1)
    return fit.select("region", F.round("p", 5).alias("p"), F.round("q", 5).alias("q"), F.round("M", 3).alias("M"), F.round("mse", 3).alias("mse"))


def _fit_round(r: int, grid: str, drive: str, bounds: tuple[float, float]) -> str:
    """SQL of one grid round on ``num``: ``best{r}`` has the best candidate of each region. ``grid``: candidate, g, b (and region)."""
    lo, hi = bounds
    p = lambda q: f"greatest({lo}, least({hi}, (an - {q} * ab) / aa))"
    q = lambda p: f"greatest(1e-3, least(2.0, (bn - {p} * ab) / bb))"
    return f"""g{r} as ({grid}),
    x{r} as (select num.region, candidate, g, b, top, prev / top as u, flow / top as n, exp({drive}) as e from num join t using (region) join g{r} on g{r}.region is null or g{r}.region = num.region),
    s{r} as (select region, candidate, g, b, top, sum(pow(e * (g - u), 2)) as aa, sum(e * (g - u) * u / g * (g - u)) as ab, sum(pow(u / g * (g - u), 2)) as bb, sum(e * (g - u) * n) as an, sum(u / g * (g - u) * n) as bn, sum(n * n) as nn, count(*) as c from x{r} group by 1, 2, 3, 4, 5),
    o{r} as (select *, unnest([(an * bb - bn * ab) / nullif(aa * bb - ab * ab, 0), {lo}, {hi}, {p("1e-3")}, {p("2.0")}]) as p, unnest([(bn * aa - an * ab) / nullif(aa * bb - ab * ab, 0), {q(lo)}, {q(hi)}, 1e-3, 2.0]) as q from s{r}),
    e{r} as (select region, candidate, g, b, top, p, q, (nn - 2 * p * an - 2 * q * bn + p * p * aa + 2 * p * q * ab + q * q * bb) / c * top * top as mse from o{r} where p between {lo} and {hi} and q between 1e-3 and 2.0),
    best{r} as (select * from e{r} qualify row_number() over (partition by region order by mse, candidate) = 1)"""


_TOP = "t as (select region, max(stock) as top from ser group by 1)"
_GRID = "select null as region, i as candidate, 1.01 * pow(10 / 1.01, i / 11.0) as g, 0.0 as b from (select unnest(range(12)) as i) union all select null, 12, 1.5, 0.0"
_FINER = "select region, i as candidate, greatest(1.01, least(10.0, g * exp([0.0, -1.0, -0.6, -0.2, 0.2, 0.6, 1.0][i + 1] * ln(10 / 1.01) / 11))) as g, 0.0 as b from best1, (select unnest(range(7)) as i)"
_BETAS = "select null as region, i * 11 + j as candidate, 1.01 * pow(10 / 1.01, i / 11.0) as g, -5.0 + j as b from (select unnest(range(12)) as i), (select unnest(range(11)) as j) union all select null, 132, 1.5, 0.0"
_FIT_COLUMNS = 'round(p, 5) as p, round(q, 5) as q, round(g * top, 3) as "M", round(mse, 3) as mse'
_DRIVE = "b * (snapshot_id - 40) / 60.0"
_P_COV = (math.exp(-10.0), 1.0)


def _rounded(fit: DataFrame) -> DataFrame:
    return fit.withColumns({c: F.round(c, n) for c, n in (("p", 5), ("q", 5), ("M", 3), ("mse", 3))})


@query("bass_fit_two_rounds", f"with {_SERIES}, {_TOP}, {_fit_round(1, _GRID, '0.0', (1e-6, 0.1))}, {_fit_round(2, _FINER, '0.0', (1e-6, 0.1))} select region, {_FIT_COLUMNS} from best2")
def bass_fit_two_rounds(spark, d):
    return _rounded(B.fit_bass(D.series(spark, d), ["region"], "date", "stock", "flow", rounds=2)).select("region", "p", "q", "M", "mse")


@query("bass_fit_covariate", f"with {_SERIES}, {_TOP}, {_fit_round(1, _BETAS, _DRIVE, _P_COV)} select region, {_FIT_COLUMNS}, cast(b as double) as beta from best1")
def bass_fit_covariate(spark, d):
    rows = D.series(spark, d).withColumn("x", (F.col("snapshot_id") - 40) / 60.0)
    fit = B.fit_bass(rows, ["region"], "date", "stock", "flow", ["x"], rounds=1)
    return _rounded(fit).select("region", "p", "q", "M", "mse", F.col("betas")[0].alias("beta"))


@query(
    "bass_fit_model_set",
    f"with {_SERIES}, {_TOP}, mo as (select region, avg(snapshot_id) as mean, stddev_pop(snapshot_id) + 1e-9 as std from ser group by 1), {_fit_round(1, _GRID, '0.0', (1e-6, 0.1))}, "
    + f"{_fit_round(3, _BETAS, 'b * (snapshot_id - (select mean from mo where mo.region = num.region)) / (select std from mo where mo.region = num.region)', _P_COV)} select region, 'baseline' as model, {_FIT_COLUMNS}, null as beta from best1 union all select region, 'trend', {_FIT_COLUMNS}, cast(b as double) from best3",
)
def bass_fit_model_set(spark, d):
    fit = B.fit_models(D.series(spark, d), ["region"], "date", "stock", "flow", {"baseline": [], "trend": ["snapshot_id"]}, rounds=1)
    return _rounded(fit).select("region", "model", "p", "q", "M", "mse", F.try_element_at("betas", F.lit(1)).alias("beta"))


@query("bass_fit_refined")
def bass_fit_refined(spark, d):
    return B.fit_bass(D.series(spark, d), ["region"], "date", "stock", "flow")


_MODEL_ROWS = f"""{_SERIES}, {_PRICES}, {_TOP},
    f as (select num.*, coalesce(gas_price_t, (select arg_min(gas_price_t, date) from pr)) / 28.0 - 0.22 * 0.30 as x1,
            case when num.date >= date '1999-01-01' then 0.15 when num.date >= date '1997-03-01' then 0.2 else 0.1 end as x2 from num asof left join pr on num.date >= pr.date),
    w as (select region, avg(x1) as a1, stddev_pop(x1) + 1e-9 as s1, avg(x2) as a2, stddev_pop(x2) + 1e-9 as s2 from f group by 1),
    z as (select f.region, prev / top as u, flow / top as n, top, cast((x1 - a1) / s1 as double) as z1, cast((x2 - a2) / s2 as double) as z2 from f join w using (region) join t using (region)),
    gm as (select 1.01 * pow(10 / 1.01, i / 11.0) as g from (select unnest(range(12)) as i)), be as (select unnest(range(11)) - 5.0 as b),
    gr as (select 'baseline' as model, g, 0.0 as b1, 0.0 as b2, 1e-6 as lo, 0.1 as hi from gm union all select 'cov', g, b, 0.0, exp(-10.0), 1.0 from gm, be
           union all select 'cov_policy', g, x.b, y.b, exp(-10.0), 1.0 from gm, be x, be y union all select * from (values ('baseline', 1.5, 0.0, 0.0, 1e-6, 0.1), ('cov', 1.5, 0.0, 0.0, exp(-10.0), 1.0), ('cov_policy', 1.5, 0.0, 0.0, exp(-10.0), 1.0))),
    v as (select region, model, g, b1, b2, lo, hi, top, n, exp(b1 * z1 + b2 * z2) * (g - u) as a, u / g * (g - u) as b from z, gr),
    s as (select region, model, g, b1, b2, lo, hi, top, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * n) as an, sum(b * n) as bn, sum(n * n) as nn, count(*) as c from v group by all),
    o as (select *, unnest([(an * bb - bn * ab) / nullif(aa * bb - ab * ab, 0), lo, hi, greatest(lo, least(hi, (an - 1e-3 * ab) / aa)), greatest(lo, least(hi, (an - 2.0 * ab) / aa))]) as p,
      unnest([(bn * aa - an * ab) / nullif(aa * bb - ab * ab, 0), greatest(1e-3, least(2.0, (bn - lo * ab) / bb)), greatest(1e-3, least(2.0, (bn - hi * ab) / bb)), 1e-3, 2.0]) as q from s)"""


@query("bass_fit_models", f"with {_MODEL_ROWS} select region, model, round(min((nn - 2 * p * an - 2 * q * bn + p * p * aa + 2 * p * q * ab + q * q * bb) / c * top * top), 3) as grid_mse, true as lower, true as as_said from o where p between lo and hi and q between 1e-3 and 2.0 group by 1, 2")
def bass_fit_models(spark, d):
    """The published model set. ``grid_mse``: the best of the first grid. ``lower``: the fit's error is at most that; ``as_said``: one step ahead by its parameters has that error."""
    s = P.attach_price(D.series(spark, d), D.prices(spark, d))
    s = policy.cost_advantage(s).withColumn("subsidy_share_t", policy.step(F.col("date"), [(None, 0.1), ("1997-03-01", 0.2), ("1999-01-01", 0.15)]))
    s = materialize(s)
    fits = materialize(B.fit_models(s, ["region"], "date", "stock", "flow", fit=fit_bass_newton))
    grids = B.fit_models(s, ["region"], "date", "stock", "flow", rounds=1).select("region", "model", F.col("mse").alias("grid_mse"))
    said = None
    for model, features in B.MODELS.items():
        rows = B.standardized(s, B.feature_moments(s, features, ["region"]), features, ["region"]) if features else s
        own = fits.where(F.col("model") == model).select("region", "p", "q", "M", "betas", "mse")
        drive = F.exp(sum((F.col("betas")[i] * F.col(f"z_{c}") for i, c in enumerate(features)), F.lit(0.0)))
        step = B.one_step(rows.join(own, "region").withColumn("_rate", F.col("p") * drive).drop("p", "q", "M", "betas", "mse"), own, ["region"], "date", "stock", "_rate")
        checked = step.groupBy("region").agg(F.avg(F.pow(F.col("flow") - F.col("flow_hat"), 2)).alias("again"), F.first("mse").alias("mse")).withColumn("model", F.lit(model))
        said = checked if said is None else said.unionByName(checked)
    both = said.join(grids, ["region", "model"])
    return both.select("region", "model", F.round("grid_mse", 3).alias("grid_mse"), (F.col("mse") <= F.col("grid_mse") * (1 + 1e-12)).alias("lower"), (F.abs(F.col("mse") - F.col("again")) <= 1e-9 * F.col("again")).alias("as_said"))


# Files: stand-ins are written to the shared folder and read back through the readers and sinks


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files_{uuid.uuid4().hex}"


def _csv(df: DataFrame) -> str:
    path = _folder(df.sparkSession)
    df.write.option("header", True).csv(path)
    return path


@query(
    "read_registrations",
    f"""with {_REG}, f as (select l_orderkey % 103 = 0 as short_row, case when l_orderkey % 97 = 0 then '' when l_orderkey % 101 = 0 then '99999' when l_orderkey % 107 = 0 then '88888' else cast(s_nationkey as varchar) end as zip,
          case when l_orderkey % 89 <> 0 then (year(l_shipdate) - 1995) * 12 + month(l_shipdate) end as id from lineitem join supplier on l_suppkey = s_suppkey)
    select case when short_row then '' else zip end as zip, short_row, count(*) as n, cast(sum(case when not short_row then id end) as bigint) as ids from f group by 1, 2""",
)
def read_registrations(spark, d):
    r, path = D.registrations(spark, d), _folder(spark)
    none = F.lit("")
    whole = F.concat_ws(",", "vin", none, none, "zip", none, "dmv_id", none, "vin_key", "reg_month")
    r.select(F.when(F.col("short_row"), F.concat_ws(",", "vin", none, none)).otherwise(whole).alias("value")).write.text(path)
    rows = readers.flag_short_rows(readers.read_registrations(spark, path))
    return rows.groupBy(F.coalesce("zip", F.lit("")).alias("zip"), "short_row").agg(F.count(F.lit(1)).alias("n"), F.sum(K.snapshot_key(F.col("dmv_id")).cast("long")).alias("ids"))


_MONTHS = "mo as (select cast(date_trunc('month', o_orderdate) as date) as m, cast(count(*) as double) as n from orders group by 1)"


def _months(spark, d):
    return D.table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"))


@query("read_calendar", f"with {_MONTHS} select cast((year(m) - 1990) * 12 + month(m) as integer) as snapshot_id, case when month(m) <> 7 then m end as snapshot_date from mo where month(m) <> 2")
def read_calendar(spark, d):
    number = F.when(F.month("m") != 2, F.concat(F.lit(" "), ((F.year("m") - 1990) * 12 + F.month("m")).cast("string"))).otherwise("none")
    rows = _months(spark, d).select(number.alias(" dmv_id"), F.when(F.month("m") != 7, F.col("m").cast("string")).otherwise("soon").alias("DMV_Snapshot_Date"))
    return readers.read_calendar(spark, _csv(rows))


@query("read_price_series", f"with {_PRICES} select date, gas_price_t from pr")
def read_price_series(spark, d):
    """The first of two candidate tables is missing; the second has cents."""
    rows = D.prices(spark, d).select(F.col("date").alias("Date"), (F.col("gas_price_t") * 100).alias("Gas_Price_Cents_Per_Gallon"))
    return readers.read_price_series(spark, [_folder(spark), _csv(rows)]).withColumn("gas_price_t", F.round("gas_price_t", 6))


@query("read_list_prices", f"with {_MSRP} select date, case when month(date) <> 6 then round(price, 4) end as avg_msrp_ev_stock_t from ms where month(date) <> 9")
def read_list_prices(spark, d):
    price = F.when(F.month("date") != 6, F.col("avg_msrp_ev_stock_t").cast("string")).otherwise("n/a")
    rows = _msrp(spark, d).select(F.when(F.month("date") != 9, F.col("date").cast("string")).otherwise("-").alias("date"), price.alias("avg_msrp_ev_stock_t"))
    return readers.read_price_list_series(spark, _csv(rows)).withColumn("avg_msrp_ev_stock_t", F.round("avg_msrp_ev_stock_t", 4))


@query("read_policy", f"with {_MONTHS} select m as date, n as total_subsidy_t, n / 4 as subsidy_share_t, case when month(m) % 2 = 0 then cast(month(m) as double) end as urgency_t, cast(0.25 as double) as zev_index_t from mo")
def read_policy(spark, d):
    odd = F.when(F.month("m") % 2 == 0, F.month("m").cast("string")).otherwise("x")
    rows = _months(spark, d).select(F.col("m").alias("date"), F.lit("more").alias("note"), F.col("n").alias("total_subsidy_t"), (F.col("n") / 4).alias("subsidy_share_t"), odd.alias("urgency_t"), F.lit(0.25).alias("ZEV_Index_t"))
    return readers.read_policy(spark, _csv(rows))


@query(
    "read_income_bins",
    """with b as (select c_mktsegment as county, cast(least(floor(c_acctbal / 2000.0), 4) as integer) as k, c_custkey % 3 as s from customer where c_acctbal >= 0)
    select county, case k when 0 then 'Under $2,000' when 4 then '$8,000 or more' else '$' || 2 * k || ',000 under $' || 2 * (k + 1) || ',000' end as bracket, cast(k * 2000.0 as double) as lo, cast(case when k < 4 then (k + 1) * 2000.0 end as double) as hi,
      cast(count(*) filter (where s = 0) as double) as single, cast(count(*) filter (where s = 1) as double) as joint, cast(count(*) filter (where s = 2) as double) as hoh from b group by county, k""",
)
def read_income_bins(spark, d):
    k = (F.col("lo") / 2000).cast("int")
    label = F.when(k == 0, "Under $2,000").when(F.col("hi").isNull(), "$8,000 or more").otherwise(F.concat(F.lit("$"), (2 * k).cast("string"), F.lit(",000 under $"), (2 * (k + 1)).cast("string"), F.lit(",000")))
    bins = D.income_bins(spark, d)
    rows = bins.select(F.concat("county", (k + 1).cast("string")).alias("row_order"), label.alias("label"), F.lit(1).alias("total"), "single", "joint", "hoh")
    none = F.lit(None).cast("double")
    heads = bins.select("county").distinct().select(F.concat("county", F.lit("0")).alias("row_order"), F.concat("county", F.lit(" County")).alias("label"), F.lit(None).cast("int").alias("total"), none.alias("single"), none.alias("joint"), none.alias("hoh"))
    notes = heads.select(F.concat("row_order", F.lit("1")).alias("row_order"), F.lit("All returns").alias("label"), F.lit(9).alias("total"), "single", "joint", "hoh")
    return readers.read_income_bins(rows.unionByName(heads).unionByName(notes))


@query("sink_counts", ORACLES["stock_exact_month"])
def sink_counts(spark, d):
    path = _folder(spark)
    writers.write_counts(stock.stock_counts(D.enriched(spark, d, "month"), exact=True), path)
    return spark.read.option("header", True).schema('region string, "group" string, metric string, approx_unique_vins long'.replace('"', "`")).csv(path)


@query("sink_flow", f"with {_SERIES} select region, snapshot_id, new_all, new_ev, cast(printf('%.4f', 100.0 * new_ev / new_all) as double) as ev_share_pct from nr")
def sink_flow(spark, d):
    path = _folder(spark)
    writers.write_flow(flow.new_registrations(D.enriched(spark, d)), path)
    return spark.read.option("header", True).schema("region string, snapshot_id int, new_all long, new_ev long, ev_share_pct double").csv(path)


@query("sink_table", f"with {_MONTHS} select m, n, 'first' as tag from mo union all select m, 2 * n, 'second' from mo where month(m) = 1")
def sink_table(spark, d):
    """Two tags; the second is written twice and only its last version stays."""
    path, months = _folder(spark), _months(spark, d)
    writers.write_table(months, path, "first")
    for factor in (3, 2):
        writers.write_table(months.where("month(m) = 1").withColumn("n", F.col("n") * factor), path, "second")
    return spark.read.parquet(path)


@query("sink_parameters", f"with {_SERIES} select region, p, q, round(m, 4) as \"M\" from par")
def sink_parameters(spark, d):
    path = _folder(spark)
    writers.write_params(D.parameters(D.series(spark, d)), path)
    return spark.read.schema("region string, p double, q double, M double").json(path).withColumn("M", F.round("M", 4))


@query("sink_metrics", ORACLES["holdout_metrics"])
def sink_metrics(spark, d):
    path = _folder(spark)
    writers.write_metrics(holdout_metrics(spark, d), path)
    return spark.read.schema("region string, model string, n_test long, date_min_test date, date_max_test date, rmse_flow double, mape_flow_pct double, rmse_stock double, mape_stock_pct double").json(path)


@query("sink_run_summary", f"{ORACLES['row_outcomes_snapshot'].replace('select count(*) as rows_total', 'select count(*) as rows_total, (select max(upper(n_name)) from nation join region on n_regionkey = r_regionkey where r_name = (select min(r_name) from region)) as last_county')}")
def sink_run_summary(spark, d):
    counters = row_outcomes(spark, d, "snapshot").first().asDict()
    # One row for each county of the specification, a few dozen.
    spec: dict[str, list[str]] = {}
    for r in D.region_spec(spark, d).orderBy("region", "county").collect():
        spec.setdefault(r["region"], []).append(r["county"])
    path = _folder(spark)
    writers.write_run_summary(spark, path, spec, {"lineitem": f"{d}/lineitem.parquet"}, counters)
    row = spark.read.json(path)
    read = row.select(F.from_json("counters", ", ".join(f"{c} long" for c in counters)).alias("c"), F.from_json("regions", "map<string,array<string>>").alias("r"))
    return read.select("c.*", F.array_max(F.element_at("r", F.array_min(F.map_keys("r")))).alias("last_county"))


@query("new_registrations_by_vehicle", ORACLES["new_registrations"])
def new_registrations_by_vehicle(spark, d):
    """New registrations from a table in buckets of the VIN, whose rows are not shuffled."""
    # A bucket has a file for each period, so buckets go by the rows and not by the session's shuffle partitions.
    buckets = max(8, -(-D.table(spark, d, "lineitem").count() // (4 * TASK_ROWS)))
    name = layout.write_by_vehicle(D.enriched(spark, d), buckets)
    return flow.new_registrations(layout.read_by_vehicle(spark, name)).withColumn("ev_share_pct", F.round("ev_share_pct", 6))


@query(
    "stock_with_counters",
    f"""with s as ({ORACLES['stock_exact_snapshot']}), o as ({ORACLES['row_outcomes_snapshot']}) select s.*, o.* from s cross join o""",
)
def stock_with_counters(spark, d):
    """Stock and row counters from one scan: the counters are observed while the stock is written, then stored beside it."""
    rows, seen = regions.enrich_and_count(D.registrations(spark, d), D.vehicles(spark, d), D.crosswalk(spark, d), D.zips(spark, d), "snapshot", D.EV_TYPES)
    counts, summary = _folder(spark), _folder(spark)
    writers.write_counts(stock.stock_counts(rows, exact=True), counts)
    writers.write_run_summary(spark, summary, {}, {"lineitem": f"{d}/lineitem.parquet"}, seen.get)
    stored = spark.read.json(summary).select(F.from_json("counters", ", ".join(f"{c} long" for c in seen.get)).alias("c")).select("c.*")
    return spark.read.option("header", True).schema("region string, `group` int, metric string, approx_unique_vins long").csv(counts).join(F.broadcast(stored))


@query(
    "ingest_files",
    f"""with {_REG}, f as (select l_orderkey % 103 = 0 as short_row, cast(l_orderkey % 5 as integer) as source, case when l_orderkey % 89 <> 0 then (year(l_shipdate) - 1995) * 12 + month(l_shipdate) end as id from lineitem join supplier on l_suppkey = s_suppkey)
    select source, count(*) as rows, count(*) filter (where short_row) as short_rows, cast(sum(case when not short_row then id end) as bigint) as ids, case when source < 2 then 1 else 2 end as run from f group by 1""",
)
def ingest_files(spark, d):
    """Five folders of registration files, staged in two runs: first two of them, then a glob of all; nothing is taken twice."""
    r, path = D.registrations(spark, d).withColumn("source", F.col("l_orderkey") % 5), _folder(spark)
    none = F.lit("")
    whole = F.concat_ws(",", "vin", none, none, "zip", none, "dmv_id", none, "vin_key", "reg_month")
    r.select("source", F.when(F.col("short_row"), F.concat_ws(",", "vin", none, none)).otherwise(whole).alias("value")).write.partitionBy("source").text(f"{path}/in")
    staged = f"{path}/staged"
    ingest.ingest_registrations(spark, [f"{path}/in/source=0", f"{path}/in/source=1"], staged)
    early = spark.read.parquet(staged).select("file").distinct().withColumn("run", F.lit(1))
    early = materialize(early)
    ingest.ingest_registrations(spark, f"{path}/in/source=*", staged)
    rows = ingest.read_staged(spark, staged)
    ids = rows.groupBy("file").agg(F.sum(K.snapshot_key(F.col("dmv_id")).cast("long")).alias("ids"))
    files = ingest.rows_by_file(rows).join(ids, "file").join(early, "file", "left").withColumn("source", F.regexp_extract("file", r"source=(\d+)", 1).cast("int"))
    return files.groupBy("source").agg(F.sum("rows").alias("rows"), F.sum("short_rows").alias("short_rows"), F.sum("ids").alias("ids"), F.coalesce(F.max("run"), F.lit(2)).alias("run"))


# Streams


def _arrivals(df: DataFrame, batches: int, rows: int, by: list[str] | None = None) -> tuple[str, int]:
    """``df`` (of some ``rows`` rows) as files for a stream, of ranges of ``by`` if given, and how many files make one of ``batches`` batches."""
    path = f"{shared_dir(df.sparkSession)}/stream_{uuid.uuid4().hex}/in"
    each = max(1, -(-rows // (batches * TASK_ROWS)))
    (df.repartitionByRange(batches * each, *by) if by else df.repartition(batches * each)).write.parquet(path)
    return path, each


def _run(stream: DataFrame, path: str, write, mode: str = "append") -> list[int]:
    return T.run_available(stream, write, mode, f"{path.removesuffix('/in')}/checkpoint")


@query("stream_stock", ORACLES["stock_approx_snapshot"])
def stream_stock(spark, d):
    """Registrations arrive in four batches; each batch's sketches are united with the stored ones of the periods it brings."""
    rows = D.registrations(spark, d)
    # By order as well, so that a period with very many rows is several files.
    path, files = _arrivals(rows, 4, D.table(spark, d, "lineitem").count(), ["dmv_id", "l_orderkey"])
    out = f"{path.removesuffix('/in')}/sketches"
    stream = T.read_arrivals(spark, path, rows.schema, files)
    _run(regions.enrich(stream, D.vehicles(spark, d), D.zips(spark, d), "snapshot", D.EV_TYPES), path, T.merge_stock_sketches(out, buckets=16))
    exact = stock.stock_counts(D.enriched(spark, d), exact=True).withColumnRenamed("approx_unique_vins", "exact")
    both = T.read_stock_sketches(spark, out).join(exact, stock.KEYS, "full")
    near = F.abs(F.col("approx_unique_vins") - F.col("exact")) <= F.greatest(F.lit(3.0), F.col("exact") * 0.02)
    return both.select(*stock.KEYS, "exact", F.coalesce(near, F.lit(False)).alias("within"))


@query("stream_first_seen", "select cast(l_suppkey as varchar) as region, cast(l_partkey as varchar) as vin, min((year(l_shipdate) - 1995) * 12 + month(l_shipdate)) as snapshot_id from lineitem group by 1, 2")
def stream_first_seen(spark, d):
    """Four batches; vehicles that a batch brings are merged into the buckets it touches, as many buckets as the rows need tasks."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    rows = D.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("region"), F.col("l_partkey").cast("string").alias("vin"), month.cast("long").alias("snapshot_id"))
    count = rows.count()
    path, files = _arrivals(rows, 4, count)
    out = f"{path.removesuffix('/in')}/buckets"
    _run(T.read_arrivals(spark, path, rows.schema, files), path, T.upsert_min(out, buckets=max(16, -(-count // TASK_ROWS))))
    return read_buckets(spark, out, "region string, vin string, snapshot_id long")


_WEEK = "cast(date_diff('day', date '2024-01-01', cast(ts as date)) // 7 as integer)"


@query("stream_first_arrival", f"select event_id, user_id, event_type, {_WEEK} as week from events where event_id % 97 <> 0 or {_WEEK} >= 1")
def stream_first_arrival(spark, d):
    """A file for each week of events. Every fifth event is sent again with the next week's, which a delay of 13 days still recognizes.

    Events of the first week that are divisible by 97 come with the last one, when the watermark has passed them: late, they are dropped.
    """
    week = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    events = D.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), week.alias("week"))
    last = events.agg(F.max("week")).first()[0] or 0
    comes = F.when((F.col("event_id") % 97 == 0) & (F.col("week") < 1), F.lit(last)).otherwise(F.col("week"))
    sent = events.withColumn("_sent", comes)
    again = sent.where((F.col("event_id") % 5 == 0) & (F.col("_sent") == F.col("week"))).withColumn("_sent", F.least(F.col("week") + 1, F.lit(last)))
    path = f"{shared_dir(spark)}/stream_{uuid.uuid4().hex}/in"
    for n in range(last + 1):
        # One after the other, so that the stream finds them in this order.
        sent.union(again).where(F.col("_sent") == n).drop("_sent").coalesce(1).write.parquet(f"{path}/{n:04d}")
    out = f"{path.removesuffix('/in')}/out"
    first = T.stream_first_arrival(T.read_arrivals(spark, path, events.schema), ["event_id"], ("ts", "13 days"))
    epochs = _run(first, path, T.write_versions(out, ["event_id", "user_id", "event_type", "week"]))
    return spark.read.schema("event_id long, user_id long, event_type string, week int").parquet(*[f"{out}/v{n}" for n in epochs])
