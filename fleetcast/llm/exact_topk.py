"""Exact top-k inner-product search by pivot-table elimination.

Every row's distances to a set of pivots are tabulated once. For a query q and a row v the largest difference of their pivot
distances is a lower bound of |q - v|, and since 2 q.v = |q|^2 + |v|^2 - |q - v|^2 it gives an upper bound of the score.

Rows are grouped by their nearest pivot and cut into shards by their distance to it, so that a shard's range of that distance
bounds all its scores. A query is first searched in the shards with the greatest bounds; its k-th score there is a threshold.
Then it is sent only to shards whose bound reaches the threshold, and in a shard rows are scored in order of their own bounds
until the next is below the k-th score. So what is passed over can't be among the best, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.cells import BLOCK_QUERIES, SHARD_ROWS, best_of, bounded_sample, dealt, finite_vectors, fitted, matrix, parts_of, ranked, without_surplus_copies
from fleetcast.plans.staging import materialize

#: Rows scored at once for each query, queries handled at once, shards that give the threshold, shards at most.
STEP, QUERIES, SEEDS, SHARDS = 128, 256, 2, 1 << 16
#: A pivot after the first few is tried only while the last one eliminated this share of what was open.
FIRST_PIVOTS, PAYS = 8, 0.01


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those chosen before."""
    if not sample.size:
        return np.zeros((1, 1))
    chosen = [int(np.argmax(((sample - sample.mean(0)) ** 2).sum(1)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _tabled(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = matrix(b.column("vec"), pivots.shape[1])
        p = fitted(pivots, x.shape[1])
        table = np.stack([np.sqrt(((x - y) ** 2).sum(1)) for y in p], 1)
        lists = pa.ListArray.from_arrays(np.arange(0, table.size + 1, len(p), dtype="int32"), pa.array(table.reshape(-1)))
        near = table.argmin(1)
        columns = [*(b.column(c) for c in ("vec_id", "vec", "query")), lists, pa.array(near.astype("int32")), pa.array(table[np.arange(len(x)), near]), pa.array((x**2).sum(1))]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vec", "query", "table", "pivot", "apart", "square"])


def _bounds(square: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Upper bounds of scores from sums of squares and lower bounds of distances, with room for rounding."""
    return (square - gap**2) / 2 + 1e-9 * (np.abs(square) + 1)


def _routes(batches: Iterator[pa.RecordBatch], shards: dict[str, np.ndarray], seed: bool) -> Iterator[pa.RecordBatch]:
    """(shard, query_id, vec, table, square, least) of each shard that a query must be searched in: the seeds, or all others."""
    for b in batches:
        table, square, least = matrix(b.column("table")), b.column("square").to_numpy(), b.column("least").to_numpy()
        for lo in range(0, len(table), QUERIES):
            part = slice(lo, lo + QUERIES)
            own = table[part][:, shards["pivot"]]
            gap = np.maximum(0, np.maximum(shards["lo"] - own, own - shards["hi"]))
            bound = _bounds(square[part][:, None] + shards["square"], gap)
            top = np.argsort(-bound, axis=1, kind="stable")[:, :SEEDS]
            go = np.zeros(bound.shape, bool)
            if seed:
                np.put_along_axis(go, top, True, 1)
            else:
                go = bound >= least[part][:, None]
                np.put_along_axis(go, top, False, 1)
            q, s = np.nonzero(go)
            # As many rows as go to shards; a batch at a time keeps them few.
            for at in range(0, len(q), 4096):
                rows = b.take(pa.array(lo + q[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(s[at : at + 4096].astype("int32")), *(rows.column(c) for c in ("vec_id", "vec", "table", "square", "least"))], names=["shard", "query_id", "vec", "table", "square", "least"])


def pivot_search(queries: pa.Table, rows: pa.Table, k: int, integer: bool) -> pa.Table:
    """Of one cell, the k best rows of each query that reach its ``least`` score, and (with a null row) how many it scored."""
    empty = pa.table({"query_id": pa.array([], "int64"), "vec_id": pa.array([], "int64"), "score": pa.array([], "int64" if integer else "float64"), "scored": pa.array([], "int64")})
    if not len(queries) or not len(rows):
        return empty
    q, v = matrix(queries.column("vec")), matrix(rows.column("vec"))
    width = max(q.shape[1], v.shape[1])
    q, v, q_ids, v_ids = fitted(q, width), fitted(v, width), queries.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
    q_table, v_table = matrix(queries.column("table")), matrix(rows.column("table"))
    q_square, v_square, least = queries.column("square").to_numpy(), rows.column("square").to_numpy(), queries.column("least").to_numpy()
    exact = not integer or np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, width) < 2.0**52
    qs, vs = (q, v) if exact else (q.astype("int64"), v.astype("int64"))
    out: list[pa.Table] = []
    for lo in range(0, len(q), QUERIES):
        part = slice(lo, lo + QUERIES)
        gap, threshold = np.zeros((len(q[part]), len(v))), least[part].copy()
        square, open_ = q_square[part][:, None] + v_square, 1.0
        for p in range(q_table.shape[1]):
            np.maximum(gap, np.abs(q_table[part, p][:, None] - v_table[:, p]), out=gap)
            if p + 1 >= FIRST_PIVOTS and (p + 1) % FIRST_PIVOTS == 0:
                # Fewer pivots give a bound as well, only a weaker one.
                before, open_ = open_, float((_bounds(square, gap) >= threshold[:, None]).mean())
                if open_ > before * (1 - PAYS):
                    break
        bound = _bounds(square, gap)
        bound[v_ids == q_ids[part][:, None]] = -np.inf
        scored, found = np.zeros(len(bound), "int64"), []
        step = STEP if open_ < 0.5 else len(v)
        order = np.argsort(-bound, axis=1, kind="stable") if step < len(v) else np.broadcast_to(np.arange(len(v)), bound.shape)
        top = np.full((len(bound), k), -np.inf)
        active = np.arange(len(bound))
        for at in range(0, len(v), step):
            places = order[active, at : at + step]
            bounds = np.take_along_axis(bound[active], places, 1)
            # In order of bounds, the first one below the threshold ends a query's search; equal ones may still win a tie by id.
            on = bounds.max(1) >= threshold[active]
            active, places, bounds = active[on], places[on], bounds[on]
            if not len(active):
                break
            good = (bounds >= threshold[active][:, None]) & (bounds > -np.inf)
            # The whole shard at once is one matrix product.
            scores = qs[part][active] @ vs.T if step == len(v) else np.einsum("ijd,id->ij", vs[places], qs[part][active])
            scored[active] += good.sum(1)
            a, j = np.nonzero(good)
            found.append((active[a], v_ids[places[a, j]], scores[a, j]))
            merged = np.concatenate([top[active], np.where(good, scores, -np.inf)], 1)
            top[active] = -np.partition(-merged, k - 1, axis=1)[:, :k]
            threshold[active] = np.maximum(threshold[active], top[active].min(1))
        one, two, three = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, qs.dtype))
        keep = three >= threshold[one]
        one, two, three = one[keep], two[keep], three[keep]
        best = best_of(one, two, -three, k)
        ids = np.concatenate([q_ids[part][one[best]], q_ids[part]])
        none = pa.nulls(len(scored), "int64")
        out.append(
            pa.table(
                {
                    "query_id": ids,
                    "vec_id": pa.concat_arrays([pa.array(two[best]), none]),
                    "score": pa.concat_arrays([pa.array(three[best].astype("int64" if integer else "float64")), pa.nulls(len(scored), "int64" if integer else "float64")]),
                    "scored": pa.concat_arrays([pa.nulls(len(best), "int64"), pa.array(scored)]),
                }
            )
        )
    return pa.concat_tables(out)


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    scale: int | None = 1024,
    pivots: int = 48,
    sample_rows: int = 4096,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score, scored): for each row that meets ``is_query`` (over ``vec_id``) its ``k`` best other rows.

    ``scored``: rows whose score was computed for the query, of all; the others were eliminated by their bounds (or are
    surplus copies of a vector that many rows share).

    ``scale``: components become floor(scale * x) and scores are whole numbers; None: plain doubles.
    ``sample_rows``: pivots are chosen among so many rows at most; only the order of evaluation depends on them.

    Null ids and vectors, and vectors with a null or non-finite component, take no part. Of rows with the same id, one
    counts. Shorter vectors count as padded with zeros, an empty one as all zeros. Ties go to the smaller id; fewer than
    ``k`` other rows: all of them. An empty table gives an empty result. Other columns are ignored. Whole-number
    scores must fit a long. The driver holds a few numbers for each shard, of which there are 65,536 or little more at most.
    """
    integer = scale is not None
    score_type = "long" if integer else "double"
    component = (lambda x: F.floor(F.lit(float(scale)) * x).cast("double")) if integer else (lambda x: x)
    usable = materialize(finite_vectors(vectors, id_col, vec_col, component).withColumn("query", is_query))
    slim = without_surplus_copies(usable.select("vec_id", "vec"), k).withColumn("query", F.lit(False))
    chosen = choose_pivots(bounded_sample(usable, sample_rows), pivots)
    tabled = lambda df: df.select("vec_id", "vec", "query").mapInArrow(lambda it: _tabled(it, chosen), "vec_id long, vec array<double>, query boolean, table array<double>, pivot int, apart double, square double")
    rows, asked = materialize(tabled(slim)), materialize(tabled(usable.where("query")))
    spark, n = vectors.sparkSession, rows.count()
    size = max(shard_rows, -(-n // SHARDS))

    # Rings of about equal numbers of rows around each pivot; where distances tie, a ring is dealt out by ids.
    counts = {r[0]: r[1] for r in rows.groupBy("pivot").count().collect()}
    cuts = {p: parts_of(c, size) for p, c in counts.items()}
    ends = {p: [] for p in cuts}
    if any(c > 1 for c in cuts.values()):
        most = max(cuts.values())
        shares = {c: [i / c for i in range(1, c)] for c in set(cuts.values()) if c > 1}
        for c, at in shares.items():
            of = [p for p in cuts if cuts[p] == c]
            for r in rows.where(F.col("pivot").isin(*of)).groupBy("pivot").agg(F.percentile_approx("apart", at, max(10_000, 20 * most))).collect():
                ends[r[0]] = sorted(r[1])
    limits = spark.createDataFrame([(p, [float(x) for x in e]) for p, e in ends.items()], "_p int, _ends array<double>")
    ring = F.size(F.filter("_ends", lambda x: x < F.col("apart")))
    ringed = rows.join(limits, F.col("pivot") == F.col("_p")).withColumn("ring", ring).drop("_p", "_ends", "query")
    ranges = ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("apart").alias("lo"), F.max("apart").alias("hi"), F.max("square").alias("square")).orderBy("pivot", "ring").collect()
    shards = [(r, i) for r in ranges for i in range(parts_of(r["n"], 2 * size))]
    known = {c: np.array([r[c] for r, _ in shards], "int64" if c == "pivot" else "float64") for c in ("pivot", "lo", "hi", "square")}
    first, at = [], 0
    for r in ranges:
        first.append((r["pivot"], r["ring"], at, parts_of(r["n"], 2 * size)))
        at += first[-1][3]
    first = spark.createDataFrame(first, "_p int, _r int, _first int, _parts int")
    number = F.col("_first") + F.pmod(F.xxhash64("vec_id", F.lit(17)), F.col("_parts")).cast("int")
    right = ringed.join(first, (F.col("pivot") == F.col("_p")) & (F.col("ring") == F.col("_r"))).select(number.alias("shard"), "vec_id", "vec", "table", "square")
    blocks = parts_of(asked.count(), BLOCK_QUERIES)

    def searched(queries: DataFrame, seed: bool) -> DataFrame:
        sent = queries.select("vec_id", "vec", "table", "square", "least").mapInArrow(lambda it: _routes(it, known, seed), "shard int, query_id long, vec array<double>, table array<double>, square double, least double")
        left = sent.withColumn("block", dealt("query_id", blocks))
        spread = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return left.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInArrow(lambda a, b: pivot_search(a, b, k, integer), f"query_id long, vec_id long, score {score_type}, scored long")

    seeds = materialize(searched(asked.withColumn("least", F.lit(float("-inf"))), True))
    kth = ranked(seeds.where("vec_id is not null"), k, F.col("score").desc()).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").cast("double").alias("_kth"))
    # A double may lie above the whole number that it stands for.
    least = F.coalesce(F.col("_kth") - F.abs("_kth") * 1e-12 - (1 if integer else 0), F.lit(float("-inf")))
    rest = searched(asked.join(kth, F.col("vec_id") == F.col("_q"), "left").withColumn("least", least), False)
    found = materialize(seeds.union(rest))
    scored = found.where("vec_id is null").groupBy("query_id").agg(F.sum("scored").alias("scored"))
    return ranked(found.where("vec_id is not null"), k, F.col("score").desc()).join(scored, "query_id")
