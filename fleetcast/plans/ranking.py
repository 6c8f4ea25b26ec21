"""Dense ranks and prefix sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def salted_rank(df: DataFrame, group: list[str], order: list[Column], salt: Column, buckets: int, name: str, bucket: Column | None = None) -> DataFrame:
    """``name``: a gapless rank from 0 of each row within ``group``, ordered by (bucket of ``salt``, ``order``).

    A group is split into ``buckets`` parts that are numbered apart, so that one group with a third of all rows is
    still spread over the cluster; only the counts per (group, bucket) meet in one place.
    ``bucket`` replaces the hash of ``salt``; where it never falls along ``order``, ranks follow ``order`` alone.
    ``order`` must be total, or equal rows get their numbers in any order.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(salt), F.lit(buckets)).cast("int") if bucket is None else bucket)
    counts = df.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = df.withColumn("_r", F.row_number().over(W.partitionBy(*group, "_b").orderBy(*order)) - 1)
    keys = [*group, "_b"]
    right = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_before")
    same = [local[c].eqNullSafe(right[f"_k{i}"]) for i, c in enumerate(keys)]
    joined = local.join(right, same[0] if len(same) == 1 else _all(same), "left")
    return joined.withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_r", "_before", "_b", *[f"_k{i}" for i in range(len(keys))])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
