"""Newton fits against brute force: the grid, random searches around them, and parameters that made the rows."""

import datetime as dt
import math

import numpy as np
import pytest
from fleetcast.operators import bass as B
from fleetcast.operators.newton import fit_bass_newton, fit_series, grid

SCHEMA = "region string, date date, stock double, flow double, x1 double, x2 double, x3 double"


def made(region, p, q, m, betas, n=60, noise=0.0, seed=1):
    """Rows of a series that follows the model exactly, but for ``noise``."""
    rng = np.random.default_rng(seed)
    x, y, rows = rng.normal(size=(n, 3)), 0.0, []
    for i in range(n):
        flow = (p * math.exp(float(x[i, : len(betas)] @ betas)) + q * y / m) * (m - y)
        flow += noise * float(rng.normal()) * abs(flow)
        y += flow
        rows.append((region, dt.date(2015 + i // 12, i % 12 + 1, 1), y, flow, *map(float, x[i])))
    return rows


def error(rows, p, q, m, betas):
    before = [0.0, *(r[2] for r in rows[:-1])]
    return np.mean([(r[3] - (p * math.exp(float(np.dot(betas, r[4 : 4 + len(betas)]))) + q * y / m) * (m - y)) ** 2 for r, y in zip(rows, before, strict=True)])


@pytest.mark.parametrize("betas", [[], [0.4], [0.5, -0.3], [0.3, -0.6, 0.2]])
def test_parameters_are_found_again(spark, betas):
    """Without noise the fit gives back what made the rows, with three features too."""
    p, q, m = 0.01, 0.08, 5000.0
    df = spark.createDataFrame(made("a", p, q, m, betas), SCHEMA)
    r = fit_bass_newton(df, ["region"], "date", "stock", "flow", [f"x{i + 1}" for i in range(len(betas))]).first()
    assert (r.p, r.q, r.M) == (pytest.approx(p, rel=1e-3), pytest.approx(q, rel=1e-3), pytest.approx(m, rel=1e-3))
    assert r.betas == pytest.approx(betas, abs=1e-3)


@pytest.mark.parametrize("features", [0, 1, 2, 3])
def test_error_is_at_most_the_grids(spark, features):
    rows = [r for s in range(4) for r in made(f"r{s}", 0.004 * (s + 1), 0.05, 3000.0, [0.5, -0.4, 0.2], noise=0.3, seed=s)]
    df, names = spark.createDataFrame(rows, SCHEMA), [f"x{i + 1}" for i in range(features)]
    newton = {r.region: r for r in fit_bass_newton(df, ["region"], "date", "stock", "flow", names).collect()}
    rounds = 3 if features < 2 else 1
    grids = {r.region: r.mse for r in B.fit_bass(df, ["region"], "date", "stock", "flow", names, rounds=rounds, beta_steps=11 if features < 3 else 5).collect()}
    assert set(newton) == set(grids) == {"r0", "r1", "r2", "r3"}
    for k, r in newton.items():
        own = [x for x in rows if x[0] == k]
        assert r.mse <= grids[k] * (1 + 1e-9)
        assert r.mse == pytest.approx(error(own, r.p, r.q, r.M, r.betas), rel=1e-9)
        top = max(x[2] for x in own)
        assert 1.01 * top * (1 - 1e-12) <= r.M <= 10 * top * (1 + 1e-12) and 1e-3 <= r.q <= 2 and all(-5 <= b <= 5 for b in r.betas)


@pytest.mark.parametrize("seed", range(6))
def test_no_random_step_is_better(seed):
    """Two thousand bounded steps around a fit, near and far, none of them better."""
    rng = np.random.default_rng(seed)
    rows = made("a", 0.01, 0.06, 2000.0, [0.4, -0.5], noise=0.4, seed=seed)
    top = max(r[2] for r in rows)
    u, n = np.array([0.0, *(r[2] for r in rows[:-1])]) / top, np.array([r[3] for r in rows]) / top
    x = np.array([r[4:6] for r in rows])
    a, q, m, betas, best = fit_series(u, n, x, (math.exp(-10), 1.0))
    for _ in range(2000):
        size = 10 ** rng.uniform(-5, 0)
        p2, q2 = np.clip(a * math.exp(size * rng.normal()), math.exp(-10), 1.0), np.clip(q * math.exp(size * rng.normal()), 1e-3, 2.0)
        m2, b2 = np.clip(m * math.exp(size * rng.normal()), 1.01, 10.0), np.clip(betas + size * rng.normal(size=2), -5, 5)
        e = np.mean((n - (p2 * np.exp(x @ b2) + q2 * u / m2) * (m2 - u)) ** 2)
        assert e >= best * (1 - 1e-9)


def test_odd_series(spark):
    """Null features and flows don't count, series without stock have no fit, a null key is a series."""
    rows = made("a", 0.01, 0.05, 900.0, [], n=24) + [(None, *r[1:]) for r in made("b", 0.02, 0.05, 900.0, [], n=24)]
    rows += [("zero", dt.date(2020, 1, 1), 0.0, 0.0, 1.0, 1.0, 1.0), ("none", dt.date(2020, 1, 1), None, None, 1.0, 1.0, 1.0)]
    rows[5] = (*rows[5][:3], None, *rows[5][4:])
    got = {r.region: r for r in fit_bass_newton(spark.createDataFrame(rows, SCHEMA), ["region"], "date", "stock", "flow").collect()}
    assert set(got) == {"a", None} and got["a"].p == pytest.approx(0.01, rel=1e-2) and got[None].p == pytest.approx(0.02, rel=1e-2)
    assert fit_bass_newton(spark.createDataFrame([], SCHEMA), ["region"], "date", "stock", "flow", ["x1"]).collect() == []


def test_grids_are_bounded():
    assert [len(grid(k)) for k in (0, 1, 2, 3)] == [13, 133, 1453, 15_973]
    assert all(len(grid(k)) <= 20_001 for k in range(1, 14))
