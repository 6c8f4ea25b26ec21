import datetime as dt

import numpy as np
import pytest
from fleetcast.llm.exact_topk import exact_topk
from fleetcast.llm.hamming_index import PART_BITS, Coder, learn_codes, nearest_by_codes, within
from fleetcast.llm.queries import op7_hamming_index
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, score double, vec array<int>"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, [1]) for i, v in rows], SCHEMA)


def brute(rows, k, key):
    """``key``: smaller is better."""
    out = []
    for q, v in rows:
        if q % 5 == 0:
            best = sorted((key(np.array(v), np.array(w)), i) for i, w in rows if i != q)[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("seed,copies,shard_rows", [(1, 0, 4096), (2, 60, 10), (3, 5, 4)])
def test_exact_topk(spark, seed, copies, shard_rows):
    rng = np.random.default_rng(seed)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rng.normal(size=(150, 8)))]
    rows += [(1000 + i, rows[0][1]) for i in range(copies)]
    whole = [(i, np.floor(1024 * np.array(v, "float32").astype("float64")).astype("int64").tolist()) for i, v in rows]
    found = exact_topk(frame(spark, rows), F.col("vec_id") % 5 == 0, k=7, shard_rows=shard_rows).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    assert all(7 <= r.scored <= len(rows) for r in found)
    assert got == [(q, r, i, -s) for q, r, i, s in brute(whole, 7, lambda a, b: -int(a @ b))]


def test_nearest_by_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rng.normal(size=(400, 24)))]
    got = nearest_by_codes(frame(spark, rows), F.col("vec_id") % 5 == 0, k=10).collect()
    want = brute(rows, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(want) and len(found & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    vectors = dict(rows)
    for r in got[:50]:
        assert r.score == pytest.approx(np.linalg.norm(np.array(vectors[r.query_id]) - np.array(vectors[r.vec_id])), abs=1e-12)


def test_clusters_are_eliminated(spark):
    """Where vectors lie in clusters, most rows are never scored, and the result is still that of brute force."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16)) * 4
    x = centers[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(x)]
    got = exact_topk(frame(spark, rows), F.col("vec_id") % 5 == 0, k=10, shard_rows=50).collect()
    whole = np.floor(1024 * np.array([v for _, v in rows], "float32").astype("float64")).astype("int64")
    scores = whole[::5] @ whole.T
    scores[np.arange(400), np.arange(0, 2000, 5)] = -(1 << 60)
    for r in got:
        better = (scores[r.query_id // 5] > r.score).sum() + ((scores[r.query_id // 5] == r.score) & (np.arange(2000) < r.vec_id)).sum()
        assert better == r.rank - 1
    assert len(got) == 4000
    assert np.mean([r.scored for r in got]) < 0.35 * 2000


def test_probing_retrieves_every_code_within_the_radius(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16))
    coder = learn_codes(v)
    codes = coder.substrings(v)
    assert codes.shape == (600, coder.parts) and codes.max() < 1 << PART_BITS
    fixed = Coder(coder.center, coder.rotation[:, : 8 * PART_BITS], 1)
    codes, masks = fixed.substrings(v), within(1)
    for query in range(20):
        apart = np.bitwise_count(codes ^ codes[query]).sum(1)
        met = (np.isin(codes ^ codes[query], masks)).any(1)
        assert fixed.radius == 15 and met[apart <= fixed.radius].all()


@pytest.mark.parametrize("seed", [8, 9])
def test_recall_and_retrieved_share_where_all_directions_are_alike(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(3000, 64)).astype("float32")
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert_recall(nearest_by_codes(df, F.col("vec_id") % 100 == 0).collect(), np.arange(3000), x.astype("float64"), 0.4)


def assert_recall(got, ids, x, most):
    at = {i: n for n, i in enumerate(ids.tolist())}
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, own in found.items():
        d = ((x - x[at[q]]) ** 2).sum(1)
        d[at[q]] = np.inf
        hits += len(own & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
    assert len(found) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(found)
    assert np.mean([r.retrieved for r in got]) <= most * len(ids)


@pytest.mark.parametrize("sf,most", [("sf0.01", 0.6), ("sf0.1", 0.35)])
def test_recall_of_the_registered_query(spark, sf, most):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").toArrow()
    x = np.stack([np.array(v, "float64") for v in table.column("embedding").to_pylist()])
    assert_recall(op7_hamming_index(spark, f"/root/testdata/{sf}").collect(), table.column("vec_id").to_numpy(), x, most)


@pytest.mark.parametrize("search", [exact_topk, nearest_by_codes])
def test_odd_rows(spark, search):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (5, None), (10, [nan, 1.0]), (15, [inf, 1.0]), (20, [None, 1.0]), (1, [1.0, 0.0]), (2, [1.0]), (3, [0.5, 0.5, 0.5]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    got = sorted(map(tuple, search(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert search(frame(spark, rows).limit(0), F.col("vec_id") % 5 == 0).collect() == []
    zero = search(frame(spark, [(0, [1.0, 1.0]), (1, [0.0, 0.0]), (2, [])]), F.col("vec_id") % 5 == 0).count()
    assert zero == (2 if search is exact_topk else 0)
