"""Bass diffusion for many series at once: flows, projections, bounded fits.

A projection advances many series together, step by step, in arrays of doubles; a series is one row, with its steps in a list.
Parameters are a table with one row per series (and scenario or model).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcast.functions.keys import standardize

P_BOUNDS, Q_BOUNDS, M_BOUNDS = (1e-6, 0.1), (1e-3, 2.0), (1.01, 10.0)
ALPHA_BOUNDS, BETA_BOUNDS = (-10.0, 0.0), (-5.0, 5.0)
MODELS: dict[str, list[str]] = {"baseline": [], "cov": ["tco_adv_t"], "cov_policy": ["tco_adv_t", "subsidy_share_t"]}


def bass_flow(y: Column, p: Column, q: Column, m: Column) -> Column:
    """New adopters of a step from the stock before it."""
    return (p + q * y / m) * (m - y)


def innovation_rate(alpha: Column, features: list[Column], betas: list[Column]) -> Column:
    """exp(alpha + x . beta): the rate of innovation of a step."""
    total = alpha
    for x, b in zip(features, betas, strict=True):
        total = total + x * b
    return F.exp(total)


def feature_moments(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Mean and population deviation (+ 1e-9) of each feature of each series."""
    return df.groupBy(*by).agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), (F.stddev_pop(c) + F.lit(1e-9)).alias(f"{c}_std"))])


def standardized(df: DataFrame, moments: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``z_<feature>`` by stored moments."""
    joined = df.join(moments, by)
    return joined.withColumns({f"z_{c}": standardize(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std")) for c in cols})


def one_step(panel: DataFrame, params: DataFrame, by: list[str], date: str, stock: str, rate: str | None = None) -> DataFrame:
    """``flow_hat`` and ``stock_hat`` from the observed stock before each row (0 before the first)."""
    rows = panel.withColumn("_y", F.lag(stock, 1, 0.0).over(W.partitionBy(*by).orderBy(date))).join(params, by)
    flow = bass_flow(F.col("_y"), F.col(rate or "p"), F.col("q"), F.col("M"))
    return rows.withColumn("flow_hat", flow).withColumn("stock_hat", F.col("_y") + F.col("flow_hat")).drop("_y")


def _series(panel: DataFrame, params: DataFrame, by: list[str], date: str, stock: str, rate: str | None, flag: str | None, horizon: int) -> DataFrame:
    """One row per series: ``rows`` in order of date, ``dates`` and ``rates`` over history and horizon, and the parameters."""
    item = F.struct(F.col(date).alias("d"), F.col(stock).cast("double").alias("y"), (F.col(rate) if rate else F.lit(None)).cast("double").alias("r"), (F.col(flag) if flag else F.lit(1)).cast("int").alias("t"))
    wide = panel.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("rows")).join(params, by)
    last = F.element_at("rows", -1)
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.add_months(last["d"], h)) if horizon else F.array().cast("array<date>")
    rates = F.concat(F.transform("rows", lambda x: x["r"]), F.array_repeat(last["r"], horizon)) if rate else F.array_repeat(F.col("p"), F.size("rows") + horizon)
    return wide.withColumn("dates", F.concat(F.transform("rows", lambda x: x["d"].cast("date")), ahead)).withColumn("rates", rates)


def advanced(rates: pa.Array, start: pa.Array, q: pa.Array, m: pa.Array) -> pa.Array:
    """Stocks from ``start`` on, one more for each of a series' ``rates``: all series of a batch take each step together.

    Time and memory are linear in the steps. A null start or parameter gives nulls, and so does a null rate from its step on.
    """
    sizes = pc.fill_null(pc.list_value_length(rates), 0).to_numpy(zero_copy_only=False).astype("int64")
    number = lambda x: x.cast("float64").to_numpy(zero_copy_only=False)
    table = np.full((len(sizes), int(sizes.max(initial=0))), np.nan)
    table[np.arange(table.shape[1]) < sizes[:, None]] = number(rates.flatten())
    q, m, table = number(q), number(m), np.ascontiguousarray(table.T)
    stocks = np.empty((len(table) + 1, len(sizes)))
    stocks[0] = number(start)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for i, p in enumerate(table):
            y = stocks[i]
            stocks[i + 1] = y + (p + q * y / m) * (m - y)
    flat = stocks.T[np.arange(len(stocks)) <= sizes[:, None]]
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)]).astype("int32")
    return pa.ListArray.from_arrays(offsets, pa.array(flat, from_pandas=True))


def _fold(rates: Column, start: Column) -> Column:
    return F.arrow_udf(advanced, "array<double>")(rates, start.cast("double"), F.col("q").cast("double"), F.col("M").cast("double"))


def project(panel: DataFrame, params: DataFrame, by: list[str], date: str, stock: str, horizon: int, start: str = "first", rate: str | None = None) -> DataFrame:
    """(by, date, stock_hat, flow_hat) over history and ``horizon`` months more.

    ``start="first"``: iterated from the first stock, whose flow is null. ``start="last"``: one-step flows and observed
    stocks on history, iterated from the last observed stock. ``rate``: column of the panel with the step's innovation rate
    (the last one holds on); else the constant ``p``.
    """
    s = _series(panel, params, by, date, stock, rate, None, horizon)
    n, ys = F.size("rows"), F.transform("rows", lambda x: x["y"])
    if start == "first":
        s = s.withColumn("hat", _fold(F.slice("rates", F.lit(2), F.size("rates") - 1), F.element_at("rows", 1)["y"]))
        before = F.concat(F.array(F.lit(None).cast("double")), F.slice("hat", F.lit(1), F.size("hat") - 1))
    else:
        s = s.withColumn("ahead", _fold(F.slice("rates", n + 1, F.size("rates") - n), F.element_at("rows", -1)["y"]))
        s = s.withColumn("hat", F.concat(ys, F.slice("ahead", F.lit(2), F.size("ahead") - 1)))
        before = F.concat(F.array(F.lit(0.0)), F.slice("hat", F.lit(1), F.size("hat") - 1))
    s = s.withColumn("prev", before)
    out = s.select(*by, "q", "M", F.inline(F.arrays_zip("dates", "hat", "prev", "rates")))
    return out.select(*by, F.col("dates").alias("date"), F.col("hat").alias("stock_hat"), bass_flow(F.col("prev"), F.col("rates"), F.col("q"), F.col("M")).alias("flow_hat"))


def project_holdout(panel: DataFrame, params: DataFrame, by: list[str], date: str, stock: str, horizon: int, flag: str = "is_train", rate: str | None = None) -> DataFrame:
    """(by, date, is_train, stock_fit, flow_fit, stock_anchor, flow_anchor).

    Fit columns: one step ahead on training rows, the first with its observed stock. Anchor columns: iterated from the last
    training stock, which stands on its row, over holdout and horizon. A panel row's own rate is used in the holdout too.
    """
    s = _series(panel, params, by, date, stock, rate, flag, horizon)
    train = F.size(F.filter("rows", lambda x: x["t"] == 1))
    s = s.withColumn("n", train).withColumn("hat", _fold(F.slice("rates", F.col("n") + 1, F.size("rates") - F.col("n")), F.element_at("rows", F.col("n"))["y"]))
    flat = s.select(*by, "rows", "rates", "hat", "n", "q", "M", F.posexplode("dates").alias("i", "date"))
    y = lambda i: F.get("rows", i)["y"]
    p, q, m, i, n = F.get("rates", F.col("i")), F.col("q"), F.col("M"), F.col("i"), F.col("n")
    fit, hat = (i < n) & (i > 0), lambda k: F.get("hat", k)
    flow_fit = F.when(fit, bass_flow(y(i - 1), p, q, m))
    return flat.select(
        *by,
        "date",
        (i < n).cast("int").alias("is_train"),
        F.when(i == 0, y(i)).when(fit, y(i - 1) + bass_flow(y(i - 1), p, q, m)).alias("stock_fit"),
        flow_fit.alias("flow_fit"),
        F.when(i >= n - 1, hat(i - n + 1)).alias("stock_anchor"),
        F.when(i >= n, bass_flow(hat(i - n), p, q, m)).alias("flow_anchor"),
    )


def forecast_wide(forecasts: DataFrame, by: list[str], models: list[str], values: list[str]) -> DataFrame:
    """Long forecasts (by, model, date, values) as one wide row for each date."""
    return forecasts.groupBy(*by, "date").pivot("model", models).agg(*[F.first(v).alias(v) for v in values])


def candidate_grid(spark, features: int, m_steps: int = 12, beta_steps: int = 11) -> DataFrame:
    """(candidate, m, b1..bk): market sizes over max(y), spaced evenly in logarithm, times every combination of betas."""
    lo, hi = M_BOUNDS
    ms = [lo * (hi / lo) ** (i / (m_steps - 1)) for i in range(m_steps)]
    betas = [BETA_BOUNDS[0] + (BETA_BOUNDS[1] - BETA_BOUNDS[0]) * i / (beta_steps - 1) for i in range(beta_steps)]
    # The starting values M = 1.5 max(y) and beta = 0 are one candidate more.
    combos = [*itertools.product(ms, *[betas] * features), (1.5, *[0.0] * features)]
    names = "".join(f", b{j + 1} double" for j in range(features))
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(combos)], f"candidate int, m double{names}")


def score_candidates(panel: DataFrame, grid: DataFrame, by: list[str], date: str, stock: str, flow: str, features: list[str], p_bounds: tuple[float, float]) -> DataFrame:
    """The least mean squared error of each (series, candidate) over box-bounded (A, q), with A = p or exp(alpha).

    Given M and beta the model is linear in (A, q): five sums per candidate and a closed form. Stocks are scaled by max(y).
    ``grid`` is a bounded set of candidates, joined to the rows by broadcast; in refined rounds each series has its own,
    which join by its key.
    """
    top = panel.groupBy(*by).agg(F.max(stock).cast("double").alias("top"))
    rows = panel.withColumn("_y", F.lag(stock, 1, 0.0).over(W.partitionBy(*by).orderBy(date))).join(top, by).where("top > 0")
    rows = rows.select(*by, (F.col("_y") / F.col("top")).alias("u"), (F.col(flow).cast("double") / F.col("top")).alias("n"), "top", *features).where("u is not null and n is not null")
    shared = [c for c in by if c in grid.columns]
    pairs = rows.join(grid, shared) if shared else rows.crossJoin(F.broadcast(grid))
    drive = F.lit(0.0)
    for j, c in enumerate(features):
        drive = drive + F.col(c) * F.col(f"b{j + 1}")
    pairs = pairs.withColumn("a", F.exp(drive) * (F.col("m") - F.col("u"))).withColumn("b", F.col("u") / F.col("m") * (F.col("m") - F.col("u")))
    names = ["m", *[f"b{j + 1}" for j in range(len(features))]]
    sums = pairs.groupBy(*by, "candidate", *names, "top").agg(*[F.sum(F.col(x) * F.col(y)).alias(f"s{x}{y}") for x, y in ("aa", "ab", "bb", "an", "bn", "nn")], F.count(F.lit(1)).alias("rows"))
    (plo, phi), (qlo, qhi) = p_bounds, Q_BOUNDS
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    saa, sab, sbb, san, sbn = (F.col(c) for c in ("saa", "sab", "sbb", "san", "sbn"))
    det = saa * sbb - sab * sab
    safe = lambda num, den, other: F.when(F.abs(den) > 1e-18, num / den).otherwise(other)
    p0, q0 = safe(san * sbb - sbn * sab, det, F.lit(None)), safe(sbn * saa - san * sab, det, F.lit(None))
    inside = (p0 >= plo) & (p0 <= phi) & (q0 >= qlo) & (q0 <= qhi)
    edge_q = lambda p: clamp(safe(sbn - F.lit(p) * sab, sbb, F.lit(qlo)), qlo, qhi)
    edge_p = lambda q: clamp(safe(san - F.lit(q) * sab, saa, F.lit(plo)), plo, phi)
    options = [(F.when(inside, p0), F.when(inside, q0)), (F.lit(plo), edge_q(plo)), (F.lit(phi), edge_q(phi)), (edge_p(qlo), F.lit(qlo)), (edge_p(qhi), F.lit(qhi))]

    def error(p: Column, q: Column) -> Column:
        return (F.col("snn") - 2 * p * san - 2 * q * sbn + p * p * saa + 2 * p * q * sab + q * q * sbb) / F.col("rows")

    solved = F.array(*[F.struct(error(p, q).alias("e"), p.alias("p"), q.alias("q")) for p, q in options])
    best = F.array_min(F.filter(solved, lambda x: x["e"].isNotNull()))
    return sums.withColumn("_best", best).select(*by, "candidate", *names, "top", (F.col("_best.e") * F.col("top") ** 2).alias("mse"), F.col("_best.p").alias("p"), F.col("_best.q").alias("q"))


def fit_bass(panel: DataFrame, by: list[str], date: str, stock: str, flow: str, features: list[str] | None = None, m_steps: int = 12, beta_steps: int = 11, rounds: int = 3) -> DataFrame:
    """(by, p, q, M, betas, mse): the best candidate of each series after ``rounds`` grids, each finer around the last best.

    ``features`` are standardized columns. Ties go to the smaller candidate number.
    """
    features, spark = features or [], panel.sparkSession
    import math

    bounds = P_BOUNDS if not features else (math.exp(ALPHA_BOUNDS[0]), math.exp(ALPHA_BOUNDS[1]))
    grid = candidate_grid(spark, len(features), m_steps, beta_steps)
    step_m, step_b = math.log(M_BOUNDS[1] / M_BOUNDS[0]) / (m_steps - 1), (BETA_BOUNDS[1] - BETA_BOUNDS[0]) / (beta_steps - 1)
    names = ["m", *[f"b{j + 1}" for j in range(len(features))]]
    best = None
    for r in range(rounds):
        scored = score_candidates(panel, grid, by, date, stock, flow, features, bounds)
        best = scored.groupBy(*by).agg(F.min_by(F.struct(*names, "top", "mse", "p", "q"), F.struct("mse", "candidate")).alias("_b")).select(*by, "_b.*")
        if r + 1 == rounds:
            break
        # Around the best: one step of the last grid to either side, in fifths; the best itself is candidate 0.
        offsets = [-1.0, -0.6, -0.2, 0.2, 0.6, 1.0]
        combos = [tuple([0.0] * len(names)), *itertools.product(offsets, repeat=len(names))]
        local = spark.createDataFrame([(i, *c) for i, c in enumerate(combos)], "candidate int, " + ", ".join(f"o{j} double" for j in range(len(names))))
        finer = {"m": F.greatest(F.lit(M_BOUNDS[0]), F.least(F.lit(M_BOUNDS[1]), F.col("m") * F.exp(F.col("o0") * F.lit(step_m))))}
        for j, b in enumerate(names[1:], 1):
            finer[b] = F.greatest(F.lit(BETA_BOUNDS[0]), F.least(F.lit(BETA_BOUNDS[1]), F.col(b) + F.col(f"o{j}") * F.lit(step_b)))
        grid = best.select(*by, *names).crossJoin(F.broadcast(local)).withColumns(finer).select(*by, "candidate", *names)
        step_m, step_b = step_m * 0.4, step_b * 0.4
    betas = F.array(*[F.col(b) for b in names[1:]]).cast("array<double>").alias("betas")
    return best.select(*by, "p", "q", (F.col("m") * F.col("top")).alias("M"), betas, "mse")


def fit_models(panel: DataFrame, by: list[str], date: str, stock: str, flow: str, models: dict[str, list[str]] = MODELS, fit: Callable[..., DataFrame] = fit_bass, **options) -> DataFrame:
    """Fits of all models, one row for each (series, model); features are standardized on the given rows. ``fit``: by grids, or ``fit_bass_newton``."""
    out = None
    for name, features in models.items():
        rows = panel
        if features:
            rows = standardized(panel.dropna(subset=features), feature_moments(panel.dropna(subset=features), features, by), features, by)
        found = fit(rows, by, date, stock, flow, [f"z_{c}" for c in features], **options).withColumn("model", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out
