"""Series tools: as-of join, fills, lags, calendars, splits and extensions. Order lives in windows, one per series."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.plans.staging import materialize


#: Rows that may meet in one window without keys, and points of a span, about; spans at most.
SPAN_ROWS, SPANS = 1_000_000, 1 << 16
#: Branches of the search among boundaries; buckets that keys are first counted in.
FAN, BUCKETS = 8, 1 << 16


def _w(by: list[str], order: str):
    if not by:
        raise ValueError("a window needs the keys of its series")
    return W.partitionBy(*by).orderBy(order)


def ffill(df: DataFrame, cols: list[str], by: list[str], order: str) -> DataFrame:
    """Nulls take the last earlier value of their series; without ``by`` all rows are one series."""
    return _fill(df, cols, by, order, True)


def bfill(df: DataFrame, cols: list[str], by: list[str], order: str) -> DataFrame:
    """Nulls take the next later value of their series; without ``by`` all rows are one series."""
    return _fill(df, cols, by, order, False)


def _fill(df: DataFrame, cols: list[str], by: list[str], order: str, forward: bool) -> DataFrame:
    """Without keys, more than ``SPAN_ROWS`` rows are cut into ranges of ``order`` that are filled apart, and each takes over from those before (or after)."""
    pick = F.last if forward else F.first
    span = (W.unboundedPreceding, 0) if forward else (0, W.unboundedFollowing)
    if by:
        return df.withColumns({c: pick(c, ignorenulls=True).over(_w(by, order).rowsBetween(*span)) for c in cols})
    kept = materialize(df)
    if kept.count() <= SPAN_ROWS:
        return kept.withColumns({c: pick(c, ignorenulls=True).over(W.partitionBy(F.lit(0)).orderBy(order).rowsBetween(*span)) for c in cols})
    ranged = materialize(kept.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    filled = ranged.withColumns({c: pick(c, ignorenulls=True).over(W.partitionBy("_range").orderBy(order).rowsBetween(*span)) for c in cols})
    # One row for each range.
    inside = lambda c: (F.max_by if forward else F.min_by)(c, F.when(F.col(c).isNotNull(), F.struct(order)))
    ends = ranged.groupBy(F.col("_range").alias("_r")).agg(*[inside(c).alias(f"_end_{c}") for c in cols])
    others = W.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(*((W.unboundedPreceding, -1) if forward else (1, W.unboundedFollowing)))
    ends = ends.select("_r", *[pick(f"_end_{c}", ignorenulls=True).over(others).alias(f"_from_{c}") for c in cols])
    joined = filled.join(ends, F.col("_range") == F.col("_r"))
    return joined.select(*[F.coalesce(c, f"_from_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def _number(time: Column, kind: T.DataType) -> Column:
    """A time as a number in its own order."""
    if isinstance(kind, T.DateType):
        return F.unix_date(time).cast("double")
    if isinstance(kind, T.NumericType):
        return time.cast("double")
    return F.unix_micros(time.cast("timestamp")).cast("double")


def span_bounds(points: DataFrame, number: Column, rows: int, span_rows: int) -> list[float]:
    """Boundaries between spans of about ``span_rows`` points each, from a quantile sketch of all of them."""
    spans = min(SPANS, -(-rows // span_rows))
    shares = [i / spans for i in range(1, spans)]
    found = points.agg(F.percentile_approx(number, shares, max(10_000, 10 * spans)).alias("b")).first()["b"] if shares else []
    return sorted(set(found or []))


def span_of(number: Column, bounds: list[float]) -> Column:
    """How many of ``bounds`` lie below: a search in a tree of ``FAN`` branches, so some ``FAN`` comparisons for each level."""
    if not bounds:
        return F.lit(0)
    n, stride, levels = len(bounds), 1, []
    while True:
        blocks = [bounds[q + stride - 1 : min(n, q + (FAN - 1) * stride) : stride] for q in range(0, n + 1, FAN * stride)]
        text = ", ".join("array(" + ", ".join(f"{x!r}D" for x in b) + ")" if b else "cast(array() as array<double>)" for b in blocks)
        levels.insert(0, f"named_struct('stride', {stride}, 'at', array({text}))")
        if len(blocks) == 1:
            break
        stride *= FAN
    below = lambda p, level: F.size(F.filter(F.get(level["at"], F.floor(p / (level["stride"] * FAN)).cast("int")), lambda b: b < number))
    return F.aggregate(F.expr(f"array({', '.join(levels)})"), F.lit(0), lambda p, level: p + level["stride"] * below(p, level))


def _hot_keys(rows: DataFrame, names: list[str], most: int) -> DataFrame | None:
    """The keys of more than ``most`` rows; None where there are none. Only keys of crowded buckets are counted one by one."""
    bucket = F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int")
    crowded = rows.groupBy(bucket.alias("_bucket")).count().where(F.col("count") > most).select("_bucket")
    found = [r["_bucket"] for r in crowded.collect()]
    if not found:
        return None
    some = F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in found], "_bucket int"))
    counted = rows.withColumn("_bucket", bucket).join(some, "_bucket", "left_semi").groupBy(*names).count()
    hot = materialize(counted.where(F.col("count") > most).select(*[F.col(n).alias(f"_h{n}") for n in names]))
    return None if hot.isEmpty() else hot


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, span_rows: int = SPAN_ROWS) -> DataFrame:
    """``left`` with the columns of the latest ``right`` row at or before it; null where there is none.

    Of several right rows at one time the one with the greatest values counts. Right rows without a time fit nothing, and a
    null key meets no right row. A null inside the latest right row stays null.

    Rows of a key meet in its window, sorted once. Keys of more than ``span_rows`` rows, and joins without keys, go by points
    (``_asof_by_points``), so neither a hot key nor a hot instant is one task.
    """
    by = by or []
    values = [c for c in right.columns if c not in (right_on, *by)]
    names = [f"_k{i}" for i in range(len(by))]
    keys = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    kind = left.schema[left_on].dataType
    known = right.select(*keys, F.col(right_on).cast(kind).alias("_t"), F.struct(*values).alias("_r")).na.drop(subset=[*names, "_t"])
    asked = left.select(*keys, F.col(left_on).alias("_t"), F.struct(*left.columns).alias("_l"))
    if not by:
        return _asof_by_points(asked, known, names, values, span_rows)
    known = materialize(known.groupBy(*names, "_t").agg(F.max("_r").alias("_r")))
    hot = _hot_keys(known.select(*names).unionByName(asked.na.drop(subset=[*names, "_t"]).select(*names)), names, span_rows)
    if hot is None:
        return _asof_by_keys(asked, known, names, values)
    same = functools.reduce(Column.__and__, [F.col(n) == F.col(f"_h{n}") for n in names])
    # At most one row for every ``span_rows`` of both sides.
    split = lambda df, how: df.join(F.broadcast(hot), same, how)
    cold = _asof_by_keys(split(asked, "left_anti"), split(known, "left_anti"), names, values)
    return cold.union(_asof_by_points(split(asked, "left_semi"), split(known, "left_semi"), names, values, span_rows))


def _asof_by_keys(asked: DataFrame, known: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """Both sides in one window for each key, the right row first; left rows without a key or a time stay in windows of their tasks."""
    real = {f.name for f in asked.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    lacking = functools.reduce(Column.__or__, [F.col(n).isNull() | (F.isnan(n) if n in real else F.lit(False)) for n in [*names, "_t"]])
    asked = asked.select("*", F.lit(None).cast(known.schema["_r"].dataType).alias("_r"), F.when(lacking, F.spark_partition_id()).alias("_apart"))
    known = known.select("*", F.lit(None).cast(asked.schema["_l"].dataType).alias("_l"), F.lit(None).cast("int").alias("_apart"))
    so_far = W.partitionBy(*names, "_apart").orderBy("_t", F.col("_l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = known.unionByName(asked).withColumn("_hit", F.last("_r", ignorenulls=True).over(so_far)).where("_l is not null")
    return met.select("_l.*", *[F.col(f"_hit.{v}").alias(v) for v in values])


def _asof_by_points(asked: DataFrame, known: DataFrame, names: list[str], values: list[str], span_rows: int) -> DataFrame:
    """What a row meets depends on its key and time alone, so both sides are first reduced to one point for each (key, time),
    in every task before rows move: an instant that very many rows share is one point. Over ``span_rows`` points are cut by
    time into spans of about as many, at the quantiles of both sides together, so that a crowded month or a hot key has many
    and an empty decade none. The last right row is carried forward inside a span, and from the spans before it; one row for
    each (key, span) meets in a key's window. The left rows then find their points by an equi-join.
    """
    kind = asked.schema["_t"].dataType
    times = asked.select(*names, "_t", F.lit(None).cast(known.schema["_r"].dataType).alias("_r"), F.lit(True).alias("_asked")).na.drop(subset=[*names, "_t"])
    both = known.withColumn("_asked", F.lit(False)).unionByName(times)
    points = materialize(both.groupBy(*names, "_t").agg(F.max("_r").alias("_r"), F.bool_or("_asked").alias("_asked")))
    rows = points.count()
    latest = lambda keys: F.last("_r", ignorenulls=True).over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("_t").rowsBetween(W.unboundedPreceding, 0))
    if rows <= span_rows:
        hits = points.withColumn("_hit", latest(names)).where("_asked")
    else:
        number = _number(F.col("_t"), kind)
        spanned = points.withColumn("_span", span_of(number, span_bounds(points, number, rows, span_rows)))
        within = spanned.withColumn("_hit", latest([*names, "_span"])).where("_asked")
        # Spans that hold no right row of a key take over too, so every span of a key that asks has a row here.
        spans = spanned.groupBy(*names, "_span").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_end"))
        earlier = W.partitionBy(*(names or [F.lit(0)])).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
        carried = materialize(spans.select(*names, "_span", F.last("_end", ignorenulls=True).over(earlier).alias("_carry")))
        hits = materialize(within.join(carried, [*names, "_span"], "left").withColumn("_hit", F.coalesce("_hit", "_carry")))
    hits = hits.select(*[F.col(n).alias(f"_h{n}") for n in names], F.col("_t").alias("_ht"), "_hit")
    same = F.col("_t") == F.col("_ht")
    for n in names:
        same = same & (F.col(n) == F.col(f"_h{n}"))
    return asked.join(hits, same, "left").select("_l.*", *[F.col(f"_hit.{v}").alias(v) for v in values])


def lag_stock(df: DataFrame, value: str, by: list[str], order: str, name: str = "y_prev", default: float = 0.0) -> DataFrame:
    """The value of the row before; ``default`` before the first."""
    return df.withColumn(name, F.lag(value, 1, default).over(_w(by, order)))


def stock_delta(df: DataFrame, value: str, by: list[str], order: str, name: str = "delta") -> DataFrame:
    """Change from the row before; null at the first."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(_w(by, order)))


def flow_stock_check(df: DataFrame, flow: str, stock: str, by: list[str], order: str) -> DataFrame:
    """``cum_flow`` and ``stock_growth`` since the first row, to be compared."""
    w = _w(by, order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("cum_flow", F.sum(flow).over(w)).withColumn("stock_growth", F.col(stock) - F.first(stock).over(w))


def densify_daily(df: DataFrame, date: str, cols: list[str], by: list[str]) -> DataFrame:
    """One row for each day between a series' first and last, values carried forward."""
    days = df.groupBy(*by).agg(F.explode(F.sequence(F.min(date), F.max(date), F.expr("interval 1 day"))).alias(date))
    return ffill(days.join(df.select(*by, date, *cols), [*by, date], "left"), cols, by, date)


def month_calendar(spark, first: str, last: str) -> DataFrame:
    """Month starts from ``first`` to ``last``."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("date"))


def allocate_to_months(df: DataFrame, flow: str, date: str, by: list[str]) -> DataFrame:
    """(by, month, flow): each interval's flow spread evenly over its days (from the row before, exclusive, to its own)."""
    prev = df.withColumn("_prev", F.lag(date).over(_w(by, date))).where("_prev is not null")
    days = prev.withColumn("_n", F.datediff(date, "_prev")).withColumn("_day", F.explode(F.sequence(F.date_add("_prev", 1), F.col(date), F.expr("interval 1 day"))))
    return days.groupBy(*by, F.trunc("_day", "MM").alias("month")).agg(F.sum(F.col(flow) / F.col("_n")).alias(flow))


def since(df: DataFrame, date: str, first: str) -> DataFrame:
    """Rows from ``first`` on; an error when there are none."""
    out = df.where(F.col(date) >= F.to_date(F.lit(first)))
    if out.isEmpty():
        raise ValueError(f"no rows since {first}")
    return out


def filter_series(df: DataFrame, series: list[str], col: str = "region") -> DataFrame:
    return df.where(F.col(col).isin(*series))


def positive_stock(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)


def train_flag(df: DataFrame, date: str, holdout_start: str) -> DataFrame:
    """``is_train``: 1 before ``holdout_start``, 0 from then on."""
    return df.withColumn("is_train", (F.col(date) < F.to_date(F.lit(holdout_start))).cast("int"))


def check_split(df: DataFrame, by: list[str]) -> DataFrame:
    """``df``; an error when a series has fewer than two training rows or no test row."""
    bad = df.groupBy(*by).agg(F.sum("is_train").alias("train"), F.count_if(F.col("is_train") == 0).alias("test")).where("train < 2 or test = 0").first()
    if bad:
        raise ValueError(f"series {[bad[c] for c in by]}: {bad['train']} training rows and {bad['test']} test rows")
    return df


def test_rows(df: DataFrame, observed: str) -> DataFrame:
    """Observed rows outside training."""
    return df.where((F.coalesce(F.col("is_train"), F.lit(0)) == 0) & F.col(observed).isNotNull())


def split_points(df: DataFrame, by: list[str], date: str, stock: str) -> DataFrame:
    """Last training and first holdout row of each series."""
    train, test = F.col("is_train") == 1, F.col("is_train") == 0
    return df.groupBy(*by).agg(
        F.max(F.when(train, F.col(date))).alias("last_train_date"),
        F.max_by(F.when(train, F.col(stock)), F.when(train, F.col(date))).alias("last_train_stock"),
        F.min(F.when(test, F.col(date))).alias("first_test_date"),
        F.min_by(F.when(test, F.col(stock)), F.when(test, F.col(date))).alias("first_test_stock"),
    )


def last_observed(df: DataFrame, by: list[str], date: str) -> DataFrame:
    """The last row of each series."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), date).alias("_last")).select(*by, *[F.col(f"_last.{c}").alias(c) for c in rest])


def extend_future(df: DataFrame, months: int, by: list[str], date: str, carry: list[str]) -> DataFrame:
    """``df`` and ``months`` rows more for each series: dates step from the last observed one, covariates stay, the rest is null."""
    future = last_observed(df, by, date).withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(months))))
    cols: list[Column] = []
    for c in df.columns:
        if c in by or c in carry:
            cols.append(F.col(c))
        elif c == date:
            cols.append(F.expr(f"add_months({date}, _h)").alias(date))
        else:
            cols.append(F.lit(None).cast(df.schema[c].dataType).alias(c))
    return df.unionByName(future.select(*cols)) if months else df
