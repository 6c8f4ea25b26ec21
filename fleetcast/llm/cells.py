"""What both vector searches share: usable vectors, their matrices, and search in cells of a stated query set against all rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and queries of a cell, about.
SHARD_ROWS, BLOCK_QUERIES = 4096, 4096


def finite_vectors(df: DataFrame, id_col: str, vec_col: str, component: Callable[[Column], Column]) -> DataFrame:
    """(vec_id long, vec array of ``component`` of each entry as a double), without unusable rows.

    Rows with a null id or vector, or with a null or non-finite component, are left out. Of rows that repeat an id the
    one with the smallest vector (in array order) stays.
    """
    usable = F.coalesce(~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    rows = rows.withColumnRenamed("_v", vec_col).where(usable & F.col("vec_id").isNotNull())
    return rows.groupBy("vec_id").agg(F.min(vec_col).alias(vec_col)).select("vec_id", F.transform(vec_col, component).alias("vec"))


def without_surplus_copies(vectors: DataFrame, k: int) -> DataFrame:
    """``vectors`` less those of which k + 1 copies with smaller ids exist.

    Copies score alike and ties go to smaller ids, so no other row's best k can hold one of these. So a vector that a third of
    all rows share meets no search more than k + 1 times; the limit is applied in each task before rows are shuffled.
    """
    return vectors.withColumn("_n", F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))).where(F.col("_n") <= k + 1).drop("_n")


def bounded_sample(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, those with the smallest hash of their id, as a matrix; shorter ones padded with zeros."""
    return matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("vec").toArrow().column("vec"))


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A list column as a matrix, filled up with zeros."""
    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), "int64")
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = max([width, *sizes.max(keepdims=True, initial=0)])
    if len(sizes) * width == len(values):
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` cut or filled up with zeros to ``width`` columns."""
    out = np.zeros((len(x), width))
    out[:, : min(width, x.shape[1])] = x[:, :width]
    return out


def best_of(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest ``score`` of each query, ties to the smaller row id."""
    order = np.lexsort((row, score, query))
    first = np.concatenate([[True], query[order][1:] != query[order][:-1]]) if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    return order[np.arange(len(order)) - start < k]


def dealt(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(parts)).cast("int")


def parts_of(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def ranked(found: DataFrame, k: int, score: Column) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the first ``k`` by ``score``, then by id; each task keeps ``k`` before the shuffle."""
    order = F.row_number().over(W.partitionBy("query_id").orderBy(score, "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
