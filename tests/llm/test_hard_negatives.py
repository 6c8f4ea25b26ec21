import numpy as np
import pytest
from fleetcast.llm.hard_negatives import hard_negatives, mined, packed, unpacked
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string, anchor int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1.0, "x", 1) for i, v, c in rows], SCHEMA)


def brute(rows, positives, negatives, every=5):
    whole = [(i, c, np.floor(256 * np.array(v, "float32").astype("float64")).astype("int64")) for i, v, c in rows]
    out = []
    for a, label, q in whole:
        if a % every == 0:
            scored = sorted((-int(q @ v), i, c) for i, c, v in whole if i != a)
            for score, p in [(-s, i) for s, i, c in scored if c == label][:positives]:
                fits = [(i, -s) for s, i, c in scored if c != label and 30 * score <= -100 * s <= 90 * score][:negatives]
                out += [(a, p, r + 1, n, score, s) for r, (n, s) in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,copies,shard_rows", [(1, 0, 8192), (2, 70, 16), (3, 4, 5)])
def test_against_brute_force(spark, seed, copies, shard_rows):
    rng = np.random.default_rng(seed)
    rows = [(i, np.float32(v).tolist(), int(rng.integers(0, 3))) for i, v in enumerate(rng.normal(size=(160, 6)))]
    rows += [(1000 + i, rows[i % 2][1], i % 2) for i in range(copies)]
    found = hard_negatives(frame(spark, rows).repartition(3), F.col("vec_id") % 5 == 0, F.col("label"), positives=3, negatives=4, shard_rows=shard_rows)
    assert got(found) == brute(rows, 3, 4)


def test_odd_rows(spark):
    good = [(i, [float(i % 7), 1.0], i % 3) for i in range(40)]
    odd = [(None, [1.0, 1.0], 0), (100, None, 0), (105, [1.0, 1.0], None), (110, [1.0, None], 0), (115, [float("nan"), 1.0], 1), (120, [float("-inf")], 1), (5, [9.0, 9.0], 2), good[3]]
    found = hard_negatives(frame(spark, good + odd), F.col("vec_id") % 5 == 0, F.col("label"))
    assert got(found) == brute(good, 5, 10) != []


def test_scores_of_zero_and_below(spark):
    """A positive score of 0 takes the scores of 0, those with smaller ids too; one below 0 takes nothing."""
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (9, [0.0, 1.0], 0), (10, [0.0, -1.0], 1), (11, [-1.0, 0.0], 1), (12, [-1.0, 0.0], 0), (20, [0.0, 0.0], 2)]
    found = got(hard_negatives(frame(spark, rows), F.col("vec_id") == 0, F.col("label")))
    assert found == [r for r in brute(rows, 5, 10) if r[0] == 0] == [(0, 9, 1, 1, 0, 0), (0, 9, 2, 10, 0, 0), (0, 9, 3, 20, 0, 0)]


def test_empty(spark):
    assert got(hard_negatives(frame(spark, []), F.col("vec_id") % 5 == 0, F.col("label"))) == []
    assert got(hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)]), F.col("vec_id") % 5 == 0, F.col("label"))) == []


def test_packed_keys_sort_as_their_numbers():
    rng = np.random.default_rng(0)
    rows = [tuple(map(int, r)) for r in rng.integers(-(1 << 62), 1 << 62, (200, 3))] + [(-1, 0, -1), (-1, 0, 1), (0, -1, 5), (0, 1, 5)]
    keys = sorted(packed(a, s, k, i) for a, s, i in rows for k in (0, 1))
    assert [unpacked(k) for k in keys] == sorted(((a, s, k, i) for a, s, i in rows for k in (0, 1)), key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_one_anchor_streams():
    """Windows are all that is held: a million negatives of one anchor pass one by one."""
    keys = (packed(1, 1000 - i // 1000, 0 if i == 0 else 1, i) for i in range(1_000_000))
    found = list(mined(keys, 10, 30, 90))
    assert [r[2] for r in found] == list(range(1, 11)) and all(r[1] == 0 and 300 <= r[5] <= 900 for r in found)
