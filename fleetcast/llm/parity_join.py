"""N-gram Jaccard join by parity sketches.

Every shingle flips one bit of a sketch, so the Hamming distance of two sketches is at most the symmetric difference of the
two sets. Sets that reach the threshold differ in at most D shingles, D being fixed for a band of sizes. A band's sketch is
cut into more than D parts, of which one at least is then equal in both sets (pigeonhole). A part is a huge and nearly
empty bit string, so it is kept as the XOR of the hashes of its set bits. Rows are joined on equal parts, filtered by the
Hamming distance of a folded sketch (``folded``), and verified on the sets themselves.

Only the groups that links form are wanted, so two rounds suffice:

1. of the pairs that the filter leaves in a part, those of a spanning forest, nearest first, are verified, and components
   are formed;
2. all pairs that share a part, pass the filter and are still in different components are verified.

Equal sets are one class throughout and never make pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.components import components
from fleetcast.llm.words import mix, shingle_sets
from fleetcast.plans.staging import materialize

#: Keys handled by one task, rows of them at once, and sets of one part compared by one task, about.
TASK_KEYS, RUN_ROWS, CELL_ROWS = 2_000_000, 4_000_000, 2048
#: Bits of the sketch that all pairs of a part are filtered by, and of the table of wanted documents (512 KB, always).
NARROW, SLOTS = 512, 1 << 22


class Bands:
    """Size bands for Jaccard >= num / den. A set of size n belongs to group band(n), and to the next one if it can link there."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        ratio = max(1.7, 1.1 * den / num)
        self.edges = [1]
        while self.edges[-1] <= largest:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * ratio)))
        self.limits, self.parts = [], []
        for low, high in zip(self.edges[:-1], self.edges[1:], strict=True):
            limit = self.difference(high - 1, high - 1)
            smallest, m = max(1, -(-num * low // den)), limit + 1
            # More parts until those that aren't empty outnumber the limit in nearly every set.
            while m < 2 * limit and (e := m * math.exp(-smallest / m)) + 3 * math.sqrt(e) > m - limit - 1:
                m += max(1, limit // 64)
            self.limits.append(limit)
            self.parts.append(m)

    def difference(self, a, b):
        """The largest symmetric difference with which sizes a and b reach the threshold."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def groups(self, n: int) -> list[int]:
        g = int(np.searchsorted(self.edges, n, "right")) - 1
        return [g, g + 1] if n * self.den >= self.num * self.edges[g + 1] else [g]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One key for each part of each group. Empty parts are left out where the others outnumber the limit."""
        out = []
        for g in self.groups(len(hashes)):
            m = self.parts[g]
            part = (hashes % np.uint64(m)).astype("int64")
            order = np.argsort(part, kind="stable")
            counts = np.bincount(part, minlength=m)
            full = np.nonzero(counts)[0]
            value = np.zeros(m, "uint64")
            value[full] = np.bitwise_xor.reduceat(hashes[order], (np.cumsum(counts) - counts)[full])
            kept = full if len(full) > self.limits[g] else np.arange(m)
            out.append(mix(value[kept] ^ mix((kept + (g << 40)).astype("uint64"))))
        return np.concatenate(out)


def folded(hashes: np.ndarray, width: int = 0) -> bytes:
    """A parity sketch of 2^w bits, at least four for each shingle; halves XORed give the sketch of half the width."""
    width = width or 1 << max(8, min(15, int(4 * len(hashes) - 1).bit_length()))
    bits = (np.bincount((hashes >> np.uint64(20)).astype("int64") & (width - 1), minlength=width) & 1).astype("uint8")
    return np.packbits(bits).tobytes()


def _class_id(hashes: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(hashes)) ^ np.uint64(len(hashes))], "uint64")).view("int64")[0]) if len(hashes) else 0


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b.column("text"), shingle)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                pa.array([len(s) for s in sets], "int64"),
                pa.array([_class_id(s) for s in sets], "int64"),
                pa.array([folded(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([folded(s, NARROW) if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "class_id", "sketch", "narrow"],
        )


def _keys(batches: Iterator[pa.RecordBatch], shingle: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = {_class_id(s): s for s in shingle_sets(b.column("text"), shingle) if len(s)}
        made = [bands.keys(s) for s in sets.values()]
        if made:
            owner = np.repeat(np.fromiter(sets, "int64", len(sets)), [len(k) for k in made])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view("int64")), pa.array(owner)], names=["key", "class_id"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition, the (key, class) rows whose key has two classes at least.

    Rows of keys that are known to be shared are passed on at once, so a task holds ``RUN_ROWS`` rows and the keys it has met,
    however many rows one key has. A row that repeats in the input may come twice.
    """
    key, owner, shared = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64")
    read, rows = [], 0
    for b in itertools.chain(batches, [None]):
        if b is not None:
            read.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            rows += len(b)
        if not read or (b is not None and rows < RUN_ROWS):
            continue
        key, owner = (np.concatenate([held, *new]) for held, new in zip((key, owner), zip(*read, strict=True), strict=True))
        read, rows = [], 0
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        count = np.diff(np.append(start, len(key)))
        many = count > 1
        if len(shared):
            many |= np.isin(key[start], shared)
        if b is not None:
            shared = np.union1d(shared, key[start][many])
        many = np.repeat(many, count)
        yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(owner[many])], names=["key", "class_id"])
        key, owner = key[~many], owner[~many]


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slot = b.column("slot").to_numpy()
        b = b.filter(pa.array(wanted[slot >> 6] >> (slot & 63).astype("uint64") & np.uint64(1) == 1))
        sets = {_class_id(s): s for s in shingle_sets(b.column("text"), shingle) if len(s)}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sets), "int64"), pa.array([s.view("int64") for s in sets.values()], pa.list_(pa.int64()))], names=["class_id", "shingles"]
        )


def _fold(sketch: bytes, width: int) -> np.ndarray:
    bits = np.frombuffer(sketch, "uint64")
    while len(bits) * 8 > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _within(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and sketches, those that the Hamming distance leaves possible."""
    for b in batches:
        na, nb, sa, sb = (b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))
        near = []
        for m, n, x, y in zip(na, nb, sa, sb, strict=True):
            width = min(len(x), len(y))
            near.append(min(m, n) * bands.den >= bands.num * max(m, n) and int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum()) <= bands.difference(m, n))
        yield b.select(["a", "b", "na", "nb"]).filter(pa.array(near, pa.bool_()))


def _forest(left: np.ndarray, right: np.ndarray, distance: np.ndarray) -> list[int]:
    """Edges of a spanning forest, nearest first."""
    parent: dict[int, int] = {}
    chosen = []
    for e in np.argsort(distance, kind="stable").tolist():
        ends = []
        for x in (int(left[e]), int(right[e])):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            ends.append(x)
        if ends[0] != ends[1]:
            parent[ends[1]] = ends[0]
            chosen.append(e)
    return chosen


def _near_pairs(batches: Iterator[pa.RecordBatch], bands: Bands, forest: bool) -> Iterator[pa.RecordBatch]:
    """Of each cell of one partition, the pairs of different components that pass size and Hamming filters; or a forest of them."""
    table = [b for b in batches if len(b)]
    if not table:
        return
    table = pa.Table.from_batches(table).combine_chunks()
    key, x, y, side, own, n, comp = (table.column(c).to_numpy() for c in ("key", "x", "y", "side", "class_id", "n", "component"))
    bits = np.frombuffer(b"".join(table.column("narrow").to_pylist()), "uint64").reshape(len(key), NARROW // 64)
    order = np.lexsort((y, x, key))
    new = np.nonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]))[0]
    out: set[tuple[int, int]] = set()
    for lo, hi in zip(new, np.append(new[1:], len(key)), strict=True):
        rows = order[lo:hi]
        left, right = rows[side[rows] == x[rows[0]]], rows[side[rows] == y[rows[0]]]
        found = []
        for at, i in enumerate(left):
            j = right[at + 1 :] if x[i] == y[i] else right
            j = j[(comp[j] != comp[i]) & (np.minimum(n[j], n[i]) * bands.den >= bands.num * np.maximum(n[j], n[i]))]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
                near = apart <= bands.difference(n[j], n[i])
                if near.any():
                    found.append((np.full(near.sum(), i), j[near], apart[near]))
        if found:
            a, b, apart = (np.concatenate(c) for c in zip(*found, strict=True))
            if forest:
                kept = _forest(a, b, apart)
                a, b = a[kept], b[kept]
            out.update(zip(np.minimum(own[a], own[b]).tolist(), np.maximum(own[a], own[b]).tolist(), strict=True))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, "int64") for c in zip(*out, strict=True)], names=["a", "b"])


def jaccard_groups(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents link when den * |A and B| >= num * |A or B|.

    Words: maximal runs of characters other than ASCII white space, A-Z lower-cased; sets of ``shingle``-word shingles
    of the whole text. A text of fewer words is one shingle; null and empty texts, and those without words, have empty
    sets and link with nothing. ``component_id``: the smallest id reachable over links, the row's own included.

    Repeated rows each stay. A row with a null id stays with a null component and links with nothing. An empty table
    gives an empty result. Other columns are ignored. Shingles are compared by 64-bit hashes.
    """
    bands = Bands(num, den)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(base.mapInArrow(lambda it: _signatures(it, shingle), "doc_id long, n_shingles long, class_id long, sketch binary, narrow binary"))
    known = base.where("doc_id is not null")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("class_id").agg(F.min("doc_id").alias("first_id"))

    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, int(total) * (den - num) * 2 // den // TASK_KEYS)
    keys = known.mapInArrow(lambda it: _keys(it, shingle, bands), "key long, class_id long")
    shared = materialize(keys.repartition(tasks, "key").mapInArrow(_runs, "key long, class_id long"))

    by_class = linkable.join(shared.select("class_id").distinct(), "class_id", "left_semi").groupBy("class_id")
    sketches = materialize(by_class.agg(F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"), F.min("narrow").alias("narrow")))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that link: first by their sketches, then by their sets."""
        a, b = (sketches.select(F.col("class_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        near = materialize(pairs.join(a, "a").join(b, "b").mapInArrow(lambda it: _within(it, bands), "a long, b long, na long, nb long"))
        ids = near.select(F.col("a").alias("class_id")).union(near.select("b")).distinct().join(classes, "class_id").select(F.col("first_id").alias("doc_id"))
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")
        bits = F.expr("shiftleft(cast(1 as bigint), cast(slot % 64 as int))")
        wanted = np.zeros(SLOTS // 64, "uint64")
        for word, value in ids.select(slot).groupBy(F.expr("slot div 64")).agg(F.bit_or(bits)).collect():
            wanted[word] = value & (2**64 - 1)
        held = docs.sparkSession.sparkContext.broadcast(wanted)
        sets = known.select("text", slot).mapInArrow(lambda it: _sets(it, shingle, held.value), "class_id long, shingles array<long>")
        sets = materialize(sets)
        a, b = (sets.select(F.col("class_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
        fits = near.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return materialize(fits.where(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).select("a", "b").distinct())

    def candidates(labels: DataFrame, forest: bool) -> DataFrame:
        """Pairs (a, b) of classes with different ``component`` that share a part and pass the filters."""
        labelled = shared.join(labels, "class_id")
        split = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi")
        sides = F.ceil(F.col("rows") / CELL_ROWS).cast("int")
        open_rows = labelled.join(split.select("key", sides.alias("sides")), "key").withColumn("side", F.pmod(F.xxhash64("class_id"), F.col("sides")).cast("int"))
        slim = open_rows.join(sketches.select("class_id", "n", "narrow"), "class_id")
        other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
        cells = slim.select("key", "class_id", "n", "narrow", "component", "side", other).select(
            "key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "class_id", "n", "narrow", "component"
        )
        return cells.repartition(tasks, "key", "x", "y").mapInArrow(lambda it: _near_pairs(it, bands, forest), "a long, b long").distinct()

    alone = sketches.select("class_id", F.col("class_id").alias("component"))
    links = verified(candidates(alone, forest=True))
    grouped = components(links).withColumnRenamed("node", "class_id")
    labels = sketches.select("class_id").join(grouped, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    grouped = components(links.union(verified(candidates(labels, forest=False)))).withColumnRenamed("node", "class_id")

    per_class = classes.join(grouped, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    smallest = per_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    final = per_class.join(smallest, "component").select("class_id", "component_id")
    joined = signed.select("doc_id", "n_shingles", "class_id").join(final, "class_id", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.cast("long").alias("component_id"))
