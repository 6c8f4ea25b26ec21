"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: principal axes of a bounded sample, then several rotations, each fitted by iterative quantization from its own
start; the sign bits are cut into substrings of 16. Every vector is indexed under each of its substrings. The index is a table,
written once: a row for each shard of vectors, with the sorted values of each substring and the vectors that have them. A
query asks for each substring's value and all values within ``flips`` bits of it. By the pigeonhole principle that retrieves
every code within the Hamming radius parts * (flips + 1) - 1, as a code that differs in more than ``flips`` bits in every
substring is farther. What is retrieved is ranked by true distances, and a shard passes on k rows a query: the pairs of queries
and retrieved rows, whose number grows with both, never become rows of a table.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.cells import BLOCK_QUERIES, SHARD_ROWS, best_of, bounded_sample, dealt, finite_vectors, fitted, matrix, parts_of, ranked, without_surplus_copies
from fleetcast.plans.staging import materialize

#: Bits of a substring; (flips, most substrings) in the order in which they are tried.
PART_BITS, SHAPES = 16, ((1, 128), (2, 128), (3, 64), (4, 32))
#: Pairs whose distances are computed at once, and queries probed at once.
STEP, QUERIES = 1 << 15, 256


@dataclass
class Coder:
    """Learned codes: ``center`` and ``rotation`` (width x bits); ``flips`` allowed in a substring, so that ``radius`` is covered."""

    center: np.ndarray
    rotation: np.ndarray
    flips: int

    @property
    def parts(self) -> int:
        return self.rotation.shape[1] // PART_BITS

    @property
    def radius(self) -> int:
        return self.parts * (self.flips + 1) - 1

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """The substrings of each row as numbers: (rows, parts)."""
        # Components beyond the sample's width have no part in the codes; distances are those of whole vectors.
        bits = (fitted(x, len(self.center)) - self.center) @ self.rotation > 0
        return bits.reshape(len(x), self.parts, PART_BITS) @ (1 << np.arange(PART_BITS))


def within(flips: int) -> list[int]:
    """All masks of at most ``flips`` of a substring's bits."""
    return sorted(sum(1 << b for b in bits) for n in range(flips + 1) for bits in itertools.combinations(range(PART_BITS), n))


def rotations(sample: np.ndarray, many: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's mean, and ``many`` rotations of its principal axes side by side, each fitted to the signs it gives."""
    rng, center = np.random.default_rng(seed), sample.mean(0)
    z, width = sample - center, sample.shape[1]
    axes = np.linalg.eigh(z.T @ z)[1]
    z, made = z @ axes, []
    for _ in range(many):
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(10):
            u, _, vt = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ vt).T
        made.append(axes @ r)
    return center, np.concatenate(made, 1)


def learn_codes(sample: np.ndarray, k: int = 10, target: float = 0.96, seed: int = 7) -> Coder:
    """The first shape, and the fewest substrings, that retrieve ``target`` of the sample's own k nearest neighbours.

    Neighbours among all rows are nearer than those in the sample, so more of them are retrieved. Where no shape does, the
    last one is taken whole.
    """
    width = sample.shape[1] if sample.ndim == 2 and sample.size else 1
    if len(sample) <= k + 1:
        return Coder(np.zeros(width), np.random.default_rng(seed).normal(size=(width, PART_BITS)), 0)
    most = max(parts for flips, parts in SHAPES)
    center, rotation = rotations(sample, -(-most * PART_BITS // width), seed)
    coder = Coder(center, rotation[:, : most * PART_BITS], 0)
    codes, asked = coder.substrings(sample).astype("uint16"), np.arange(0, len(sample), max(1, len(sample) // 256))
    apart = np.zeros((len(asked), min(k, len(sample) - 1), most), "uint8")
    for at, i in enumerate(asked):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, apart.shape[1] - 1)[: apart.shape[1]]
        apart[at] = np.bitwise_count(codes[near] ^ codes[i])
    for flips, parts in SHAPES:
        found = np.logical_or.accumulate(apart[:, :, :parts] <= flips, 2).mean((0, 1))
        if found[-1] >= target:
            parts = int(np.argmax(found >= target)) + 1
            break
    return Coder(center, rotation[:, : parts * PART_BITS], flips)


def _indexed(shard: pa.Table, coder: Coder) -> pa.Table:
    """The index of one shard, as one row: ids, vectors, and for each substring its sorted values and whose they are."""
    x, ids = matrix(shard.column("vec")), shard.column("vec_id").to_numpy()
    codes = coder.substrings(x).T
    order = np.argsort(codes, axis=1, kind="stable")
    row = {"shard": shard.column("shard")[0].as_py(), "ids": ids, "vectors": x.reshape(-1), "values": np.take_along_axis(codes, order, 1).astype("<u2").tobytes(), "places": order.astype("<u4").tobytes()}
    return pa.table({"shard": pa.array([row["shard"]], "int32"), "ids": pa.array([row["ids"]], pa.list_(pa.int64())), "vectors": pa.array([row["vectors"]], pa.list_(pa.float64())), "values": pa.array([row["values"]], pa.binary()), "places": pa.array([row["places"]], pa.binary())})


INDEX = "shard int, ids array<long>, vectors array<double>, values binary, places binary"


def probe(codes: np.ndarray, values: np.ndarray, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which rows of a shard the queries' probes meet: (queries, rows). ``values``, ``places``: (parts, rows)."""
    seen = np.zeros((len(codes), values.shape[1]), bool)
    for j in range(len(values)):
        starts = np.searchsorted(values[j], np.arange((1 << PART_BITS) + 1))
        asked = (codes[:, j, None] ^ masks).reshape(-1)
        first = starts[asked]
        many = starts[asked + 1] - first
        hit = np.nonzero(many)[0]
        first, many = first[hit], many[hit]
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        seen[np.repeat(hit // len(masks), many), places[j, at]] = True
    return seen


def _searched(queries: pa.Table, index: pa.Table, k: int, coder: Coder) -> pa.Table:
    """Of one shard, the k nearest of what each query's probes meet, and (with a null row) how many those were.

    Queries that are ``wide`` meet every row.
    """
    out = []
    if len(queries) and len(index):
        q_ids, q, wide = queries.column("query_id").to_numpy(), matrix(queries.column("vec")), queries.column("wide").to_numpy()
        ids = index.column("ids").combine_chunks().flatten().to_numpy()
        v = index.column("vectors").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        width = max(q.shape[1], v.shape[1])
        codes, q, v = coder.substrings(q), fitted(q, width), fitted(v, width)
        values = np.frombuffer(index.column("values")[0].as_py(), "<u2").reshape(-1, len(ids))
        places, masks = np.frombuffer(index.column("places")[0].as_py(), "<u4").reshape(values.shape), np.array(within(coder.flips))
        for lo in range(0, len(q), QUERIES):
            part = slice(lo, lo + QUERIES)
            seen = probe(codes[part], values, places, masks) | wide[part][:, None]
            seen &= ids[None, :] != q_ids[part][:, None]
            a, b = np.nonzero(seen)
            score = np.zeros(len(a))
            for at in range(0, len(a), STEP):
                i, j = a[at : at + STEP], b[at : at + STEP]
                score[at : at + STEP] = np.sqrt(((v[j] - q[part][i]) ** 2).sum(1))
            best = best_of(a, ids[b], score, k)
            met = seen.sum(1)
            out.append(
                pa.table(
                    {
                        "query_id": np.concatenate([q_ids[part][a[best]], q_ids[part]]),
                        "vec_id": pa.concat_arrays([pa.array(ids[b[best]]), pa.nulls(len(met), "int64")]),
                        "score": pa.concat_arrays([pa.array(score[best]), pa.nulls(len(met), "float64")]),
                        "met": pa.concat_arrays([pa.nulls(len(best), "int64"), pa.array(met.astype("int64"))]),
                    }
                )
            )
    return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], "int64"), "vec_id": pa.array([], "int64"), "score": pa.array([], "float64"), "met": pa.array([], "int64")})


def nearest_by_codes(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, sample_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score, retrieved): for each row that meets ``is_query`` (over ``vec_id``) the ``k`` nearest found.

    ``score``: Euclidean distance in double precision. ``retrieved``: rows that the query's probes met, of which distances were
    computed; of a vector that many rows share only the k + 1 smallest ids are met. ``sample_rows``: codes are fitted on so
    many rows at most; every other row is indexed all the same. A query whose probes meet fewer than ``k`` rows is widened
    once, to all rows.

    Null ids and vectors, zero or empty vectors, and vectors with a null or non-finite component take no part. Of rows
    with the same id, one counts. Shorter vectors count as padded with zeros. Ties go to the smaller id; fewer than
    ``k`` other rows: all of them. An empty table gives an empty result. Other columns are ignored.
    """
    usable = finite_vectors(vectors, id_col, vec_col, lambda x: x).where(F.exists("vec", lambda x: x != 0.0))
    usable = materialize(usable.withColumn("query", is_query))
    rows = materialize(without_surplus_copies(usable.select("vec_id", "vec"), k))
    queries = usable.where("query").select(F.col("vec_id").alias("query_id"), "vec")
    coder = learn_codes(bounded_sample(rows, sample_rows), k)

    shards, blocks = parts_of(rows.count(), SHARD_ROWS), parts_of(queries.count(), BLOCK_QUERIES)
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = materialize(rows.withColumn("shard", dealt("vec_id", shards)).groupBy("shard").applyInArrow(lambda t: _indexed(t, coder), INDEX))

    def searched(asking: DataFrame, wide: bool) -> DataFrame:
        """Queries in blocks against every shard of the index."""
        left = asking.select("query_id", "vec", F.lit(wide).alias("wide"), dealt("query_id", blocks).alias("block"), every(shards).alias("shard"))
        right = index.withColumn("block", every(blocks))
        found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
        return materialize(found.applyInArrow(lambda a, b: _searched(a, b, k, coder), "query_id long, vec_id long, score double, met long"))

    found = searched(queries, False)
    retrieved = lambda df: df.where("vec_id is null").groupBy("query_id").agg(F.sum("met").alias("retrieved"))
    few = retrieved(found).where(F.col("retrieved") < k).select("query_id")
    if not few.isEmpty():
        few = materialize(few)
        found = found.join(few, "query_id", "left_anti").unionByName(searched(queries.join(few, "query_id", "left_semi"), True))
    best = ranked(found.where("vec_id is not null").select("query_id", "vec_id", "score"), k, F.col("score").asc())
    return best.join(retrieved(found), "query_id").select("query_id", "rank", "vec_id", "score", "retrieved")
