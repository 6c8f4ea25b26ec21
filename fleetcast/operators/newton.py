"""Bounded Bass fits with any number of features: variable projection and damped Gauss-Newton steps, a series a group.

For given market size and betas the model is linear in (A, q), with A = p or exp(alpha): a closed form inside its box. So the
search runs over (ln m, betas) alone. It starts from the best of a grid of candidates, all of one matrix product, and steps go on
while they lower the error. Rows are shuffled once, to their series; a series has some hundreds of rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.operators.bass import ALPHA_BOUNDS, BETA_BOUNDS, M_BOUNDS, P_BOUNDS, Q_BOUNDS

#: Candidates of the grid at most (its betas get coarser with more features), starts taken from it, steps of each.
CANDIDATES, STARTS, STEPS = 20_000, 4, 200


def projected(a: np.ndarray, b: np.ndarray, n: np.ndarray, box: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(error, A, q) of each candidate: the least mean square of n - A a - q b with A in ``box`` and q in its bounds.

    ``a``, ``b``: a row for each candidate. The optimum is the free one if it lies inside, else on an edge.
    """
    aa, ab, bb, an, bn, nn = (a * a).sum(1), (a * b).sum(1), (b * b).sum(1), a @ n, b @ n, n @ n
    div = lambda x, y: np.divide(x, y, out=np.full(len(y), np.nan), where=np.abs(y) > 1e-18)
    det = aa * bb - ab * ab
    free_a, free_q = div(an * bb - bn * ab, det), div(bn * aa - an * ab, det)
    inside = (free_a >= box[0]) & (free_a <= box[1]) & (free_q >= Q_BOUNDS[0]) & (free_q <= Q_BOUNDS[1])
    options = [(np.where(inside, free_a, np.nan), free_q)]
    for edge in box:
        options.append((np.full(len(aa), edge), np.clip(np.nan_to_num(div(bn - edge * ab, bb), nan=Q_BOUNDS[0]), *Q_BOUNDS)))
    for edge in Q_BOUNDS:
        options.append((np.clip(np.nan_to_num(div(an - edge * ab, aa), nan=box[0]), *box), np.full(len(aa), edge)))
    xs, qs = (np.stack(c) for c in zip(*options, strict=True))
    errors = (nn - 2 * xs * an - 2 * qs * bn + xs * xs * aa + 2 * xs * qs * ab + qs * qs * bb) / len(n)
    best = np.nanargmin(errors, 0), np.arange(len(aa))
    return errors[best], xs[best], qs[best]


def _drives(theta: np.ndarray, u: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.exp(theta[:, :1])
    return np.exp(theta[:, 1:] @ x.T) * (m - u), u / m * (m - u)


def grid(features: int) -> np.ndarray:
    """Starting candidates (ln m, betas): market sizes evenly in logarithm, betas evenly, and the usual start 1.5 and 0."""
    steps = max(2, min(11, int((CANDIDATES / 12) ** (1 / max(1, features)))))
    ms = np.linspace(math.log(M_BOUNDS[0]), math.log(M_BOUNDS[1]), 12)
    betas = np.linspace(*BETA_BOUNDS, steps) if features <= 10 else np.zeros(1)
    return np.array([*itertools.product(ms, *[betas] * features), (math.log(1.5), *[0.0] * features)])


def fit_series(u: np.ndarray, n: np.ndarray, x: np.ndarray, box: tuple[float, float]) -> tuple[float, float, float, np.ndarray, float]:
    """(A, q, m, betas, error) of one series, its stock before each row (``u``) and flow (``n``) in units of its largest stock."""
    low = np.array([math.log(M_BOUNDS[0]), *[BETA_BOUNDS[0]] * x.shape[1]])
    high = np.array([math.log(M_BOUNDS[1]), *[BETA_BOUNDS[1]] * x.shape[1]])
    candidates = grid(x.shape[1])
    errors = np.concatenate([projected(*_drives(part, u, x), n, box)[0] for part in np.array_split(candidates, -(-len(candidates) * len(u) // (1 << 20)))])
    best = (np.inf, 0.0, 0.0, candidates[0])
    for start in candidates[np.argsort(errors, kind="stable")[:STARTS]]:
        theta, damping = start.copy(), 1e-2
        error, a, q = (float(v[0]) for v in projected(*_drives(theta[None], u, x), n, box))
        for _ in range(STEPS):
            m = math.exp(theta[0])
            rate = np.exp(x @ theta[1:])
            left = m - u
            residual = n - a * rate * left - q * u / m * left
            # Derivatives by A, q, ln m and the betas; A and q answer within the same step, unless an edge holds them.
            inner = [rate * left * (box[0] < a < box[1]), u / m * left * (Q_BOUNDS[0] < q < Q_BOUNDS[1])]
            outer = [a * rate * m + q * u * u / m, *(a * (rate * left)[:, None] * x).T]
            jacobian = np.stack([*inner, *outer], 1)
            normal, gradient = jacobian.T @ jacobian, jacobian.T @ residual
            scale = np.maximum(np.diag(normal), 1e-12)
            moved = False
            while damping < 1e12:
                step = np.linalg.lstsq(normal + damping * np.diag(scale), gradient, rcond=None)[0][2:]
                trial = np.clip(theta + np.clip(step, -1.0, 1.0), low, high)
                e, ta, tq = (float(v[0]) for v in projected(*_drives(trial[None], u, x), n, box))
                if e < error:
                    moved, gain = True, error - e
                    theta, error, a, q, damping = trial, e, ta, tq, max(damping / 5, 1e-10)
                    break
                damping *= 4
            if not moved or gain <= 1e-13 * error:
                break
        if error < best[0]:
            best = (error, a, q, theta)
    error, a, q, theta = best
    return a, q, math.exp(theta[0]), theta[1:], error


def fit_bass_newton(panel: DataFrame, by: list[str], date: str, stock: str, flow: str, features: list[str] | None = None) -> DataFrame:
    """(by, p, q, M, betas, mse): the bounded least-squares fit of each series, with standardized ``features``.

    Bounds are those of the grid fits, and the error is at most that of their first grid (up to three features; with more the
    grid is coarser). Rows without stock, flow or a feature don't count; a series without any such row, or without a positive
    stock, has no fit. Null keys are a series like others. ``p`` is exp(alpha) where there are features.
    """
    features = features or []
    box = P_BOUNDS if not features else (math.exp(ALPHA_BOUNDS[0]), math.exp(ALPHA_BOUNDS[1]))
    rows = panel.withColumn("_y", F.lag(stock, 1, 0.0).over(W.partitionBy(*by).orderBy(date)))
    rows = rows.select(*by, F.col("_y").cast("double").alias("_y"), F.col(stock).cast("double").alias("_s"), F.col(flow).cast("double").alias("_n"), F.array(*[F.col(c).cast("double") for c in features]).cast("array<double>").alias("_x"))
    schema = T.StructType([*(panel.schema[c] for c in by), *(T.StructField(c, T.DoubleType()) for c in ("p", "q", "M")), T.StructField("betas", T.ArrayType(T.DoubleType())), T.StructField("mse", T.DoubleType())])

    def fitted(group: pa.Table) -> pa.Table:
        y, s, n = (group.column(c).to_numpy() for c in ("_y", "_s", "_n"))
        top = np.nanmax(np.where(np.isnan(s), 0.0, s), initial=0.0)
        x = np.array([[np.nan if v is None else v for v in r] for r in group.column("_x").to_pylist()], "float64").reshape(len(y), len(features))
        good = np.isfinite(y) & np.isfinite(n) & np.isfinite(x).all(1)
        keys = [group.column(c).slice(0, 1) for c in by]
        if top <= 0 or not good.any():
            return pa.table([*(k.slice(0, 0) for k in keys), *[pa.array([], "float64")] * 3, pa.array([], pa.list_(pa.float64())), pa.array([], "float64")], names=schema.names)
        a, q, m, betas, error = fit_series(y[good] / top, n[good] / top, x[good], box)
        values = [pa.array([v], "float64") for v in (a, q, m * top)]
        return pa.table([*keys, *values, pa.array([betas.tolist()], pa.list_(pa.float64())), pa.array([error * top**2], "float64")], names=schema.names)

    return rows.groupBy(*by).applyInArrow(fitted, schema)
