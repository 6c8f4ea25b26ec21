"""Centroid clustering of whole-number vectors, in JVM expressions only.

The centroids of a round are literal arrays of the plan: ``zip_with`` and ``aggregate`` give the distance to each, and the
least struct of (distance, number) is the row's cluster, so no row is shuffled or copied to be assigned. The next centroids
are plain column sums by cluster, added up in each task first: a round moves one row of sums for each task and cluster, and the
driver holds ``k`` rows of them, whatever the table's size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.plans.staging import materialize

#: Components may be so large that the squares of their differences, added up, fit a long for 2^10 components.
LARGEST = 1 << 25


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int, width: int) -> DataFrame:
    """(vec_id, vec array of long): rows with exactly ``width`` components, none null or non-finite, each floor(scale * x)."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = (F.size("vec") == width) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    too_large = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("bigint")
    whole = lambda x: F.when(F.abs(x * scale) <= LARGEST, F.floor(x * F.lit(float(scale)))).otherwise(too_large)
    return rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("vec", whole).alias("vec"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order; ties of repeated ids by vector."""
    drawn = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"), "vec")
    return [list(r["vec"]) for r in drawn.orderBy("hash", "vec").limit(k).collect()]


def literal(components: list[int]) -> Column:
    """An array literal; as text it takes one call into the JVM instead of one for each component."""
    return F.expr(f"array({', '.join(f'{x}L' for x in components)})")


def nearest(centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the centroid nearest to ``vec``; the smaller number among equally near ones."""

    def to(centroid: list[int]) -> Column:
        squares = F.zip_with("vec", literal(centroid), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, x: total + x)

    return F.array_min(F.array(*[F.struct(to(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of exact means; one without vectors stays where it is."""
    width = len(centroids[0])
    parts = vectors.select(nearest(centroids)["cluster"].alias("cluster"), "vec")
    sums = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(vec[{i}]) as x{i}") for i in range(width)]).collect()
    means = {r["cluster"]: [r[f"x{i}"] // r["n"] for i in range(width)] for r in sums}
    return [means.get(i, c) for i, c in enumerate(centroids)]


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid): each kept vector and its nearest centroid.

    Components become floor(scale * x); distances are squared Euclidean ones of whole numbers, ties go to the smaller cluster.
    ``k`` vectors drawn by a hash of their ids are the first centroids; each of ``rounds`` assigns all vectors and moves every
    centroid to the floor of the mean of its vectors; then all are assigned once more. ``cluster_inertia`` and ``inertia``
    add distances up over the cluster and over all; ``centroid_sha256`` is that of the final centroid's components joined by commas.

    Null vectors, vectors of another width, and vectors with a null or non-finite component take no part. Every other row is
    clustered by itself: rows that repeat an id or a vector count as often as they stand there, and rows with a null id are
    clustered but start no centroid. With fewer than ``k`` ids there are fewer centroids; without any, or in an empty table, the
    result is empty. Other columns are ignored, whatever their names. A component beyond 2^25 after scaling is an error.
    """
    kept = materialize(whole_vectors(vectors, id_col, vec_col, scale, width))
    centroids = first_centroids(kept, k, seed)
    columns = ["vec_id", "cluster", "distance"]
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<bigint>"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], result)
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    # Written once, as the sums below and the result read it: without that all distances would be computed twice.
    assigned = materialize(kept.select("vec_id", nearest(centroids).alias("_near")).select("vec_id", "_near.cluster", "_near.distance"))
    sums = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    own = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        *columns,
        own([sums.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        own(digests, "string").alias("centroid_sha256"),
        F.get(F.array(*[literal(c) for c in centroids]), F.col("cluster")).alias("centroid"),
    )
