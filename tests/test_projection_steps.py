"""Projections of many steps: equal to the recurrence step by step, linear in time, nulls where there is nothing to go on."""

import datetime as dt
import time

import numpy as np
import pyarrow as pa
import pytest
from fleetcast.operators import bass as B
from pyspark.sql import functions as F


def steps(y, rates, q, m):
    out = [y]
    for p in rates:
        out.append(out[-1] + (p + q * out[-1] / m) * (m - out[-1]))
    return out


def test_long_series_equal_the_recurrence():
    rng = np.random.default_rng(1)
    rates = [rng.uniform(1e-5, 1e-3, n).tolist() for n in (10_000, 3, 0, 1)]
    got = B.advanced(pa.array(rates), pa.array([1.0, 2.0, 3.0, None]), pa.array([0.01] * 4), pa.array([900.0] * 4)).to_pylist()
    assert got == [steps(1.0, rates[0], 0.01, 900.0), steps(2.0, rates[1], 0.01, 900.0), [3.0], [None, None]]
    assert B.advanced(pa.array([[0.1, None, 0.1]]), pa.array([1.0]), pa.array([0.1]), pa.array([9.0])).to_pylist()[0][2:] == [None, None]
    assert B.advanced(pa.array([], pa.list_(pa.float64())), pa.array([], "float64"), pa.array([], "float64"), pa.array([], "float64")).to_pylist() == []


def test_time_is_linear():
    """Eight times the steps take about eight times the time; copying the array at each step would take sixty-four."""

    def seconds(n):
        args = pa.array([[1e-4] * n] * 20), pa.array([1.0] * 20), pa.array([0.001] * 20), pa.array([900.0] * 20)
        began = time.process_time()
        B.advanced(*args)
        return time.process_time() - began

    short = min(seconds(20_000) for _ in range(3))
    assert min(seconds(160_000) for _ in range(2)) < 20 * short + 0.5


@pytest.mark.parametrize("start", ["first", "last"])
def test_project_over_ten_thousand_months(spark, start):
    """A series with a horizon of 10,000 steps beside a short one; ten thousand months stay within the calendar."""
    rows = [("a", dt.date(2000, 1, 1), 5.0), ("a", dt.date(2000, 2, 1), 9.0), ("b", dt.date(2001, 1, 1), 7.0)]
    panel = spark.createDataFrame(rows, "region string, date date, stock double")
    params = spark.createDataFrame([("a", 1e-4, 0.002, 800.0), ("b", 2e-4, 0.001, 900.0)], "region string, p double, q double, M double")
    got = B.project(panel, params, ["region"], "date", "stock", 10_000, start).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max_by("stock_hat", "date").alias("last")).collect()
    found = {r.region: (r.n, r.last) for r in got}
    first = steps(5.0, [1e-4] * 10_001, 0.002, 800.0)[-1] if start == "first" else steps(9.0, [1e-4] * 10_000, 0.002, 800.0)[-1]
    assert found == {"a": (10_002, first), "b": (10_001, steps(7.0, [2e-4] * 10_000, 0.001, 900.0)[-1])}
