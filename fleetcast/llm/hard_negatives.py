"""Hard-negative mining by a secondary sort of pair scores.

Pairs of an anchor and a row travel as packed keys (anchor, descending score, kind, id) whose bytes sort in that order.
``repartitionAndSortWithinPartitions`` brings an anchor's pairs together, best first, and one pass over a partition opens a
window for each positive it meets and hands out the negatives that fall into open windows; of an anchor only its few open
windows are held, however many pairs it has.

Not every pair is packed. Scores are matrix products of cells (a block of anchors, a shard of rows); a cell first gives each
anchor's best rows of its own label. With the anchors' positives known, cells give for each window the best rows of other
labels in it. A window's first negatives are among the first ones of the cells, so nothing is lost, and pairs per anchor grow
with the number of shards only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcast.llm.cells import BLOCK_QUERIES, dealt, fitted, matrix, parts_of, ranked
from fleetcast.plans.staging import materialize

#: Rows of a shard, about, and anchors whose scores are held at once.
SHARD_ROWS, QUERIES = 8192, 256
#: Big-endian unsigned numbers compare like their bytes: anchor, negated score, kind (0: positive), id; signed ones are moved by 2^63.
_KEY, _HALF = struct.Struct(">QQBQ"), 1 << 63
POSITIVE, NEGATIVE = 0, 1


def packed(anchor: int, score: int, kind: int, row: int) -> bytes:
    """A key; equal scores put positives first, so that a window is open before a negative that scores like its positive."""
    return _KEY.pack(anchor + _HALF, _HALF - 1 - score, kind, row + _HALF)


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = _KEY.unpack(key)
    return anchor - _HALF, _HALF - 1 - score, kind, row - _HALF


def of_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def mined(keys: Iterable[bytes], negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from keys in their order."""
    now, windows = None, []
    for key in keys:
        anchor, score, kind, row = unpacked(key)
        if anchor != now:
            now, windows = anchor, []
        if kind == POSITIVE:
            windows.append([row, score, 0])
            continue
        for window in windows:
            if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], row, window[1], score


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: in doubles where these are exact."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1]) < 2.0**52:
        return (q @ v.T).astype("int64")
    return q.astype("int64") @ v.astype("int64").T


def cell(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """(query_id, vec_id, score): of each anchor the first ``k`` rows of its label or, where it has ``windows``, of other labels in each of them."""
    none = pa.table({"query_id": pa.array([], "int64"), "vec_id": pa.array([], "int64"), "score": pa.array([], "int64")})
    if not len(anchors) or not len(rows):
        return none
    rows = rows.sort_by("vec_id")
    q, v = matrix(anchors.column("vec")), matrix(rows.column("vec"))
    width = max(q.shape[1], v.shape[1])
    q, v, q_ids, v_ids = fitted(q, width), fitted(v, width), anchors.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
    labels = pa.concat_arrays([*anchors.column("label").chunks, *rows.column("label").chunks]).dictionary_encode().indices.to_numpy()
    q_labels, v_labels = labels[: len(q)], labels[len(q) :]
    windows = anchors.column("windows").to_pylist()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), QUERIES):
        part = slice(lo, lo + QUERIES)
        scores = _scores(q[part], v)
        # Rows come by id, so a stable sort settles ties.
        order = np.argsort(-scores, axis=1, kind="stable")
        scores = np.take_along_axis(scores, order, 1)
        same = v_labels[order] == q_labels[part][:, None]
        if windows[lo] is None:
            fits = same & (v_ids[order] != q_ids[part][:, None])
            picked = fits & (np.cumsum(fits, axis=1) <= k)
        else:
            picked = np.zeros(same.shape, bool)
            at = windows[part]
            for n in range(max(map(len, at))):
                has = np.array([n < len(w) for w in at])
                score = np.array([w[n] if n < len(w) else 0 for w in at], "int64")[:, None]
                fits = has[:, None] & ~same & (low * score <= 100 * scores) & (100 * scores <= high * score)
                picked |= fits & (np.cumsum(fits, axis=1) <= k)
        a, j = np.nonzero(picked)
        found.append((q_ids[part][a], v_ids[order[a, j]], scores[a, j]))
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def labelled_vectors(df: DataFrame, is_anchor: Column, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, vec, anchor) of rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = F.coalesce(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    once = rows.where(usable & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("vec", "label")).alias("row"))
    whole = F.transform("row.vec", lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    return once.select("vec_id", "row.label", whole.alias("vec")).withColumn("anchor", is_anchor)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a row's score is its inner product with the anchor, higher ones first, ties by
    smaller id. For each row that meets ``is_anchor`` (over ``vec_id``) and each of its first ``positives`` other rows of the same
    ``label`` (over the table's columns), the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths
    of the positive's, both included. A negative positive score leaves no window, one of 0 only scores of 0.

    Null ids, labels and vectors, and vectors with a null or non-finite component, take no part. Of rows that repeat an id the
    one with the smallest vector, then label, counts. Shorter vectors count as padded with zeros. Fewer rows than asked for:
    all of them; anchors without positives or negatives have no row, and an empty table gives an empty result. Other columns
    are ignored, whatever their names. Scores, a hundred times, must fit a long.

    Of rows that share a vector and a label only as many as a list can hold take part in a search, those with the smallest
    ids: others can't be on it. Anchors are a stated query set: cells of ``BLOCK_QUERIES`` anchors and ``shard_rows`` rows are scored
    whole, so work grows with anchors x rows, rows are copied once for each block of anchors, and the packed pairs of an
    anchor are at most ``positives`` + ``positives`` x ``negatives`` x shards.
    """
    spark = vectors.sparkSession
    usable = materialize(labelled_vectors(vectors, is_anchor, id_col, vec_col, label, scale))
    copy = F.row_number().over(W.partitionBy("vec", "label").orderBy("vec_id"))
    slim = materialize(usable.select("vec_id", "label", "vec").withColumn("_n", copy).where(F.col("_n") <= max(positives + 1, negatives)).drop("_n"))
    anchors = usable.where("anchor").select(F.col("vec_id").alias("query_id"), "label", "vec")
    shards, blocks = parts_of(slim.count(), shard_rows), parts_of(anchors.count(), BLOCK_QUERIES)
    spread = slim.withColumn("shard", dealt("vec_id", shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(queries: DataFrame, k: int) -> DataFrame:
        sent = queries.withColumn("block", dealt("query_id", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return sent.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInArrow(lambda a, b: cell(a, b, k, low, high), "query_id long, vec_id long, score long")

    first = materialize(ranked(best(anchors.withColumn("windows", F.lit(None).cast("array<long>")), positives), positives, F.col("score").desc()))
    opened = first.groupBy(F.col("query_id").alias("_q")).agg(F.collect_list("score").alias("windows"))
    others = best(anchors.join(opened, F.col("query_id") == F.col("_q")).drop("_q"), negatives)
    pairs = first.select("query_id", "vec_id", "score", F.lit(POSITIVE).alias("kind")).union(others.select("query_id", "vec_id", "score", F.lit(NEGATIVE)))
    keys = pairs.rdd.map(lambda r: (packed(r[0], r[2], r[3], r[1]), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = keys.repartitionAndSortWithinPartitions(parts, of_anchor).mapPartitions(lambda it: mined((k for k, _ in it), negatives, low, high))
    return spark.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
