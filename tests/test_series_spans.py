"""Joins and fills that are cut into spans give what a scan of the whole series gives."""

import datetime as dt
import random
import re

import pytest
from fleetcast.operators import policy
from fleetcast.operators.series import _number, asof_join, bfill, ffill, span_bounds, span_of
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)


def days(rng, n, span=900):
    return [DAY + dt.timedelta(days=rng.randrange(span)) for _ in range(n)]


@pytest.mark.parametrize("keyed", [True, False])
def test_asof_equals_scan(spark, keyed):
    rng = random.Random(3)
    left = [(i, rng.choice("abz") if rng.random() < 0.9 else None, d if rng.random() < 0.9 else None) for i, d in enumerate(days(rng, 150))]
    right = [(rng.choice("ab") if rng.random() < 0.9 else None, d if rng.random() < 0.9 else None, rng.choice([None, 1, 2, 3])) for d in days(rng, 60)]
    right += right[:5]
    l = spark.createDataFrame(left, "i int, k string, t date")
    r = spark.createDataFrame(right, "k string, u date, v int")
    if not keyed:
        r = r.drop("k")
    got = {x.i: x.v for x in asof_join(l, r, "t", "u", ["k"] if keyed else None).collect()}
    low = lambda v: -1 if v is None else v
    want = {}
    for i, k, t in left:
        fit = [(u, low(v)) for j, u, v in right if t and u and u <= t and (not keyed or (k is not None and j == k))]
        best = max(fit)[1] if fit else -1
        want[i] = None if best == -1 else best
    assert got == want
    assert asof_join(l, r.limit(0), "t", "u", ["k"] if keyed else None).where("v is not null").count() == 0
    assert asof_join(l.limit(0), r, "t", "u", ["k"] if keyed else None).count() == 0


@pytest.mark.parametrize("fill,step", [(ffill, 1), (bfill, -1)])
def test_fill_without_keys(spark, fill, step):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, None, None, i]), None if i < 150 else 7) for i in range(300)]
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "i int, a int, b int").repartition(7)
    got = {x.i: (x.a, x.b) for x in fill(shuffled, ["a", "b"], [], "i").collect()}
    held, want = [None, None], {}
    for i, *values in rows[::step]:
        held = [v if v is not None else h for v, h in zip(values, held, strict=True)]
        want[i] = tuple(held)
    assert got == want
    assert fill(shuffled.limit(0), ["a"], [], "i").count() == 0


def test_schedule_by_months_equals_every_step(spark):
    rng = random.Random(5)
    steps = []
    for name in ("x", "y"):
        cuts = sorted(set(days(rng, 6)))
        steps += [(name, a, b, float(i)) for i, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))]
    at = [DAY - dt.timedelta(days=400), *days(rng, 60), DAY + dt.timedelta(days=2000), None]
    table = spark.createDataFrame(steps, "name string, valid_from date, valid_to date, value double")
    got = {r.date: (r.x, r.y) for r in policy.apply_schedule(spark.createDataFrame([(d,) for d in at], "date date"), table).collect()}
    find = lambda name, d: next((v for n, a, b, v in steps if n == name and d and (a is None or a <= d) and (b is None or d < b)), None)
    assert got == {d: (find("x", d), find("y", d)) for d in at}


def test_blank_vehicle_keys_meet_nothing(spark):
    from fleetcast.operators.regions import join_drivetrain

    rows = spark.createDataFrame([(" ",), ("",), (None,), (" a ",)], "vin_key string")
    got = join_drivetrain(rows, spark.createDataFrame([("a", "BEV"), ("", "PHEV")], "vin_key string, drivetrain string"))
    assert sorted(r.drivetrain for r in got.select(F.col("drivetrain")).collect()) == ["BEV", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("span_rows", [1, 7, 40])
def test_sampled_spans_equal_one_window(spark, keyed, span_rows):
    """Dates, times and numbers, cut into spans of a few points, give what one window gives."""
    rng = random.Random(span_rows)
    by = ["k"] if keyed else None
    for make, kind in ((lambda d: DAY + dt.timedelta(days=d), "date"), (lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=977 * d), "timestamp"), (lambda d: d / 3, "double")):
        left = [(i, rng.choice("abz"), make(rng.randrange(300))) for i in range(200)]
        right = [(rng.choice("ab"), make(rng.randrange(300)), rng.choice([None, 1, 2])) for _ in range(80)]
        l, r = spark.createDataFrame(left, f"i int, k string, t {kind}"), spark.createDataFrame(right, f"k string, u {kind}, v int")
        r = r if keyed else r.drop("k")
        rows = lambda df: sorted((x.i, x.v is not None, x.v or 0) for x in df.collect())
        assert rows(asof_join(l, r, "t", "u", by, span_rows=span_rows)) == rows(asof_join(l, r, "t", "u", by))


def test_a_hot_month_is_cut(spark):
    """Nine of ten rows lie in one month and half of all on one instant of it: spans stay near their size, the instant is one point."""
    times = F.when(F.col("id") % 2 == 0, F.lit(1_600_000_000)).when(F.col("id") % 20 < 18, 1_599_000_000 + F.col("id") * 50).otherwise(F.col("id") * 70_000)
    points = spark.range(40_000).select(F.timestamp_seconds(times).alias("_t")).distinct()
    number = _number(F.col("_t"), points.schema["_t"].dataType)
    n = points.count()
    bounds = span_bounds(points, number, n, 1000)
    sizes = [r["count"] for r in points.groupBy(span_of(number, bounds)).count().collect()]
    assert n < 21_000 and len(sizes) >= 19 and max(sizes) <= 1300
    months = [r["count"] for r in points.groupBy(F.trunc("_t", "MM")).count().collect()]
    assert max(months) > 10_000


def test_places_among_many_boundaries(spark):
    """The two-step search is right below, on and above every boundary, for more than one block of 256."""
    for n in (1, 255, 256, 257, 600):
        bounds = [float(3 * i) for i in range(n)]
        got = spark.range(-2, 3 * n + 3).select("id", span_of(F.col("id").cast("double"), bounds).alias("s")).collect()
        assert [r.s for r in got] == [sum(b < r.id for b in bounds) for r in got]


def test_only_hot_keys_go_by_points(spark, monkeypatch):
    """Keys of few rows meet in one window each, however many rows there are; a hot key goes by points, with the same result."""
    from fleetcast.operators import series

    seen = []
    by_points = series._asof_by_points
    monkeypatch.setattr(series, "_asof_by_points", lambda asked, *rest: seen.append(sorted({r._k0 for r in asked.collect()})) or by_points(asked, *rest))
    rng = random.Random(8)
    left = [(i, rng.choice(["hot"] * 6 + ["a", "b", "c", None]), d if rng.random() < 0.9 else None) for i, d in enumerate(days(rng, 300))]
    right = [(rng.choice(["hot", "a", "b"]), d, rng.choice([None, 1, 2])) for d in days(rng, 60)]
    l, r = spark.createDataFrame(left, "i int, k string, t date"), spark.createDataFrame(right, "k string, u date, v int")
    rows = lambda df: sorted((x.i, x.v is not None, x.v or 0) for x in df.collect())
    want = rows(asof_join(l, r, "t", "u", ["k"]))
    assert len(want) == 300 and seen == []
    assert rows(asof_join(l, r, "t", "u", ["k"], span_rows=100)) == want and seen == [["hot"]]


def test_places_take_few_comparisons(spark):
    """A place among thousands of boundaries is found in a few dozen comparisons, on, below and above each of them."""
    bounds = [float(3 * i) for i in range(4097)]
    place = span_of(F.col("id").cast("double"), bounds)
    got = spark.range(-2, 3 * 4097 + 3).select("id", place.alias("s")).collect()
    assert [r.s for r in got] == [min(4097, max(0, -(-r.id // 3))) for r in got]
    # No list of boundaries that a row is compared with is longer than a node of the tree.
    tree = spark.range(1).select(place.alias("s"))._jdf.queryExecution().analyzed().toString()
    assert max(len(a.split(",")) for a in re.findall(r"array\(([-0-9.,E ]+)\)", tree)) <= 7


@pytest.mark.parametrize("span_rows", [1, 1000])
def test_not_a_number_meets_nothing(spark, span_rows):
    nan = float("nan")
    l = spark.createDataFrame([(1, 1.0, nan), (2, nan, 5.0), (3, 1.0, 5.0), (4, None, 5.0)], "i int, k double, t double")
    r = spark.createDataFrame([(1.0, 4.0, 7), (nan, 4.0, 8), (1.0, nan, 9), (1.0, 2.0, None)], "k double, u double, v int")
    assert {x.i: x.v for x in asof_join(l, r, "t", "u", ["k"], span_rows=span_rows).collect()} == {1: None, 2: None, 3: 7, 4: None}
