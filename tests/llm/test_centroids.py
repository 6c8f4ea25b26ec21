import hashlib

import numpy as np
import pytest
from fleetcast.llm.centroids import cluster_vectors
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType()), T.StructField("vec", T.LongType()), T.StructField("distance", T.LongType())]
)


def brute(rows, k, rounds, scale, width):
    kept = [(i, np.floor(scale * np.array(v, "float32").astype("float64")).astype("int64")) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), tuple(v)) for i, v in kept if i is not None)[:k]
    centroids = [np.array(v) for _, v in drawn]
    for r in range(rounds + 1):
        near = [min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == n]
                if own:
                    centroids[n] = np.array([sum(map(int, col)) // len(own) for col in zip(*own, strict=True)])
    total, sums = sum(d for d, _ in near), {}
    for d, n in near:
        sums[n] = sums.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i is not None, i or 0, n, d, sums[n], total, sha[n]) for (i, _), (d, n) in zip(kept, near, strict=True))


def got(df):
    return sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("seed,k", [(1, 5), (2, 12)])
def test_rounds(spark, seed, k):
    rng = np.random.default_rng(seed)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rng.normal(size=(120, 8)))]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [rows[5], rows[5]]
    assert got(cluster_vectors(frame(spark, rows).repartition(5), k=k, width=8)) == brute(rows, k, 3, 64, 8)


def test_odd_rows(spark):
    """Nulls, other widths, non-finite components, null and repeated ids, ties between equal centroids, fewer ids than clusters."""
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (2, [0.1, 0.2]), (None, [3.0, 4.0]), (3, None), (4, [1.0]), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [-0.01, 0.0]), (10, [1.0, 2.0, 3.0])]
    found = got(cluster_vectors(frame(spark, rows), width=2))
    assert found == brute(rows, 16, 3, 64, 2) and len(found) == 5


def test_empty(spark):
    assert cluster_vectors(frame(spark, [])).collect() == []
    assert cluster_vectors(frame(spark, [(1, None), (None, [1.0])]), width=1).collect() == []


def test_plan_stays_on_the_jvm(spark):
    plan = cluster_vectors(frame(spark, [(i, [float(i), 1.0]) for i in range(20)]), k=3, width=2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_components_that_are_too_large(spark):
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(frame(spark, [(1, [1e30, 1.0])]), width=2).collect()
