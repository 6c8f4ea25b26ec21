"""Suffix-array dedup by run-length indexes: bytes of long strings that stand more than once in a corpus.

A corpus has no one index. Every window of ``length`` bytes is filed under its anchor, the least hash among its grams of ``GRAM``
bytes, so equal windows share an anchor wherever they stand. Consecutive windows of one anchor are a phrase; a window lies in
exactly one phrase. Phrases whose anchor stands only once in the corpus can match nothing and leave. The others, each distinct one once with
its number of occurrences, are dealt out by anchor, and each few megabytes of them become a run-compressed
Burrows-Wheeler index (``run_index``). From the samples at its runs' ends a stream over the phrases gives matching
statistics: the longest match of what follows each byte anywhere else. Windows that match ``length`` bytes are marked, and
marks are carried back to all texts.

A group of one anchor with very many different phrases (a passage in many contexts) is split into blocks with an index each.
Windows that are different inside a block are then compared with those of the group's other blocks by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.run_index import build_index
from fleetcast.llm.words import Powers, mix
from fleetcast.plans.staging import materialize

#: Bytes of a gram; windows of a phrase at most; text parsed at once; phrase bytes of an index; phrases of an anchor in a block.
GRAM, PHRASE_WINDOWS, CHUNK_BYTES, INDEX_BYTES, GROUP_PHRASES = 48, 256, 1 << 19, 2 << 20, 2048
#: Low bits of a gram's hash that give way to its place in the text that is parsed at once.
_PLACE = np.uint64(20)
_VALUES = np.random.default_rng(7919).integers(0, 2**64, (2, 256), dtype="uint64")
_PARSED = "d1 long, d2 long, phrases array<struct<anchor: long, hash: long, start: int, windows: int, anchors: int>>"
_WANTED = "anchor long, block int, hash long, windows int, uses long, bytes binary"
_MARKS = "anchor long, hash long, windows int, first int, last int, w1 long, w2 long, open boolean"


def _sums(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of which any substring's hash is a difference, and the factors that make it independent of its place."""
    up, down = Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, "uint64")
    np.cumsum(values[data] * up[:-1], out=sums[1:])
    return sums, down


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive entries."""
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return x if n == width else np.minimum(x[: len(x) - (width - n)], x[width - n :])


def phrases_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, hash, start, windows, anchors) of the phrases of pieces that end at ``ends``; pieces have ``length`` bytes at least.

    ``anchors`` is 2 where a phrase goes on from one place of its anchor to the next: only then can it match itself, as the
    first place of the anchor in two equal windows is never the same.
    """
    begins = np.concatenate([[0], ends[:-1]])
    sums, down = _sums(data, _VALUES[0])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    place = (_least((grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype="uint64"), length - gram + 1) & np.uint64((1 << 20) - 1)).astype("int64")
    least = grams[place]
    first = np.zeros(len(least), bool)
    first[begins] = True
    valid = np.ones(len(least), bool)
    for d in range(1, len(ends)):
        valid[ends[d - 1] - length + 1 : ends[d - 1]] = False
    change = first.copy()
    change[1:] |= least[1:] != least[:-1]
    start = np.nonzero(change & valid)[0]
    until = np.minimum(np.append(start[1:], len(least)), ends[np.searchsorted(ends, start, "right")] - length + 1)
    # Runs longer than a phrase may be are cut.
    parts = -(-(until - start) // PHRASE_WINDOWS)
    run = np.repeat(np.arange(len(start)), parts)
    start = start[run] + PHRASE_WINDOWS * (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts))
    windows = np.minimum(until[run] - start, PHRASE_WINDOWS)
    anchors = 1 + (place[start] != place[start + windows - 1])
    return least[start], mix((sums[start + windows + length - 1] - sums[start]) * down[start]), start, windows, anchors


def _parse(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The phrases of each text, a megabyte of text at a time; a longer text is parsed in pieces that overlap."""
    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], "int64", len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", "uint8")
        pieces = [(r, at, min(CHUNK_BYTES + length - 1, hi - at)) for r, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)) for at in range(lo, hi - length + 1, CHUNK_BYTES)]
        found: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (size == 0 or size + pieces[to][2] <= CHUNK_BYTES):
                size += pieces[to][2]
                to += 1
            part = pieces[at:to]
            ends = np.cumsum([p[2] for p in part])
            anchor, hash_, start, windows, anchors = phrases_of(np.concatenate([data[a : a + s] for _, a, s in part]), ends, length, gram)
            piece = np.searchsorted(ends, start, "right")
            row, place, begin = np.array([p[0] for p in part]), np.array([p[1] for p in part]), np.concatenate([[0], ends[:-1]])
            found.append((row[piece], anchor.astype("int64"), hash_.astype("int64"), (start - begin[piece] + place[piece] - offsets[row[piece]]).astype("int32"), windows.astype("int32"), anchors.astype("int32")))
            at = to
        rows, *columns = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in ("int64", "int64", "int64", "int32", "int32", "int32"))
        lists = pa.ListArray.from_arrays(np.searchsorted(rows, np.arange(len(texts) + 1)).astype("int32"), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["anchor", "hash", "start", "windows", "anchors"]))
        yield pa.RecordBatch.from_arrays([b.column("d1"), b.column("d2"), lists], names=["d1", "d2", "phrases"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted phrase of a text."""
    for b in batches:
        lists, texts = b.column("wanted"), b.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], "int64", len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", "uint8")
        of, items = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        start = offsets[of] + items.field("start").to_numpy()
        sizes = items.field("windows").to_numpy() + length - 1
        for lo in range(0, len(of), 4096):
            s, n = start[lo : lo + 4096], sizes[lo : lo + 4096]
            ends = np.concatenate([[0], np.cumsum(n)])
            places = np.repeat(s - ends[:-1], n) + np.arange(ends[-1])
            cut = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends.astype("int32")), pa.py_buffer(data[places])])
            yield pa.RecordBatch.from_arrays([*(items.field(c).slice(lo, len(s)) for c in ("anchor", "block", "hash", "windows", "uses")), cut], names=["anchor", "block", "hash", "windows", "uses", "bytes"])


def _indexed(batches: Iterator[pa.RecordBatch], length: int, index_bytes: int) -> Iterator[pa.RecordBatch]:
    """Marks of phrases that come sorted by (anchor, block): an index for each few megabytes, cut between groups."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        anchor, block = b.column("anchor").to_numpy(), b.column("block").to_numpy()
        last = (held[-1].column("anchor")[-1].as_py(), held[-1].column("block")[-1].as_py()) if held else (None, None)
        new = np.nonzero((anchor != np.concatenate([[last[0]], anchor[:-1]])) | (block != np.concatenate([[last[1]], block[:-1]])))[0] if len(anchor) else []
        sizes = np.concatenate([[0], np.cumsum(b.column("windows").to_numpy() + length - 1)])
        lo = 0
        for at in new:
            if size + sizes[at] - sizes[lo] >= index_bytes:
                if at > lo:
                    held.append(b.slice(lo, at - lo))
                if held:
                    yield from _marks(pa.Table.from_batches(held), length)
                held, size, lo = [], 0, at
        held.append(b.slice(lo))
        size += int(sizes[-1] - sizes[lo])
    if held and sum(map(len, held)):
        yield from _marks(pa.Table.from_batches(held), length)


def _marks(phrases: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Runs of marked windows (first to last) of each phrase, and of split groups each distinct window's digest and whether it is still open."""
    phrases = phrases.combine_chunks()
    cut = pa.concat_arrays(phrases.column("bytes").chunks)
    offsets = np.frombuffer(cut.buffers()[1], "int32", len(cut) + 1, cut.offset * 4).astype("int64")
    data, starts = np.frombuffer(cut.buffers()[2], "uint8")[offsets[0] : offsets[-1]], offsets - offsets[0]
    windows, uses, block = (phrases.column(c).to_numpy() for c in ("windows", "uses", "block"))
    index = build_index(data, starts)
    marked = index.matches() >= length
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = np.arange(len(data)) - starts[of]
    window = inside < windows[of]
    marked = (marked | (uses[of] > 1)) & window
    edge = np.diff(np.concatenate([[0], marked.astype("int8"), [0]]))
    # A phrase ends in bytes at which no window starts, so runs never pass from one to the next.
    lo, hi = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1
    none = lambda n: [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())]
    names = ["anchor", "hash", "windows", "first", "last", "w1", "w2", "open"]
    key = lambda p: [phrases.column(c).combine_chunks().take(pa.array(p)) for c in ("anchor", "hash", "windows")]
    yield from pa.Table.from_arrays([*key(of[lo]), pa.array(inside[lo].astype("int32")), pa.array(inside[hi].astype("int32")), *none(len(lo))], names=names).to_batches()
    split = np.nonzero(window & (block[of] > 0))[0]
    if len(split):
        digests = []
        for values in _VALUES:
            sums, down = _sums(data, values)
            digests.append(mix((sums[split + length] - sums[split]) * down[split]).astype("int64"))
        # Of equal windows of this block one speaks for all: only whether a window is still open needs the others.
        order = np.lexsort((digests[1], digests[0]))
        again = np.concatenate([[False], (digests[0][order][1:] == digests[0][order][:-1]) & (digests[1][order][1:] == digests[1][order][:-1])])
        one = order[~again]
        at = split[one]
        yield from pa.Table.from_arrays([*key(of[at]), *[pa.array(inside[at].astype("int32"))] * 2, *[pa.array(d[one]) for d in digests], pa.array(~marked[at])], names=names).to_batches()


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cut in zip(texts, spans, strict=True):
        if not cut.is_valid or not text.is_valid:
            out.append(None)
            continue
        whole, at, parts = memoryview(text.as_buffer()), 0, []
        for lo, hi in zip(cut.values.field("start").to_numpy().tolist(), cut.values.field("end").to_numpy().tolist(), strict=True):
            parts.append(whole[at:lo])
            at = hi
        out.append(b"".join([*parts, whole[at:]]))
    return pa.array(out, pa.binary())


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjoining spans of each text as one."""
    for b in batches:
        found = []
        for s in b.column("spans"):
            lo, hi = s.values.field("start").to_numpy(), s.values.field("end").to_numpy()
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            new = np.nonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))[0]
            found.append([{"start": int(x), "end": int(y)} for x, y in zip(lo[new], hi[np.append(new[1:], len(lo)) - 1], strict=True)])
        yield pa.RecordBatch.from_arrays([b.column("d1"), b.column("d2"), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["d1", "d2", "spans"])


def repeated_spans(texts: DataFrame, length: int = 200, gram: int = GRAM, group_phrases: int = GROUP_PHRASES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(d1, d2, spans array of (start, end)): of each text, known by its digest, the maximal runs of bytes that strings of
    ``length`` bytes cover which start anywhere else too. ``texts``: d1, d2, text; texts without such bytes have no row."""
    long_enough = texts.where(F.octet_length("text") >= length).select("d1", "d2", "text")
    parsed = long_enough.mapInArrow(lambda it: _parse(it, length, gram), _PARSED)
    # Copies of a text are one from here on; each task drops those it holds before rows move.
    once = materialize(parsed.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.first("phrases").alias("phrases")))
    places = once.select("d1", "d2", F.inline("phrases"))
    repeated = materialize(places.groupBy("anchor").agg(F.sum("anchors").alias("n")).where("n > 1").select("anchor"))
    # Both sides are plain tables, so that the rows of a very common anchor are split over tasks.
    shared = materialize(places.join(repeated, "anchor", "left_semi").drop("anchors"))
    distinct = materialize(shared.groupBy("anchor", "hash", "windows").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("d1", "d2", "start")).alias("at")))
    crowded = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_phrases))
    block = F.coalesce(1 + F.pmod("hash", F.ceil(F.col("n") / group_phrases)), F.lit(0)).cast("int")
    wanted = distinct.join(crowded, "anchor", "left").select("at.d1", "at.d2", F.struct("at.start", "windows", "anchor", block.alias("block"), "hash", "uses").alias("w"))
    by_text = wanted.groupBy("d1", "d2").agg(F.collect_list("w").alias("wanted"))
    holders = long_enough.groupBy("d1", "d2").agg(F.first("text").alias("text")).join(by_text, ["d1", "d2"]).select("text", "wanted")
    dealt = holders.mapInArrow(lambda it: _cut(it, length), _WANTED).repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    marks = materialize(dealt.mapInArrow(lambda it: _indexed(it, length, index_bytes), _MARKS))
    keys = ["anchor", "hash", "windows"]
    runs = marks.where("w1 is null").select(*keys, "first", "last")
    if not crowded.isEmpty():
        digests = marks.where("w1 is not null")
        again = materialize(digests.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"))
        runs = runs.union(digests.where("open").join(again, ["w1", "w2"], "left_semi").select(*keys, "first", "last"))
    found = shared.join(runs, keys).select("d1", "d2", F.struct(F.col("start") + F.col("first"), (F.col("start") + F.col("last") + length).cast("int")).cast("struct<start: int, end: int>").alias("span"))
    size = F.array_max(F.transform("phrases", lambda p: p["start"] + p["windows"])) + (length - 1)
    whole = once.where("copies > 1").select("d1", "d2", F.struct(F.lit(0), size).cast("struct<start: int, end: int>").alias("span"))
    return found.union(whole).groupBy("d1", "d2").agg(F.collect_list("span").alias("spans")).mapInArrow(_merged, "d1 long, d2 long, spans array<struct<start: int, end: int>>")


def dedup_suffixes(docs: DataFrame, length: int = 200, text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` with ``removed_spans`` (start, end in bytes) and ``kept``, the bytes of the text that are left.

    A byte is removed if a string of ``length`` bytes that covers it also starts at another place of the corpus, the same text
    included; overlaps count, all copies go, and strings are judged on the texts as they come in. Texts are their UTF-8
    bytes, so ``kept`` is binary: a cut may fall inside a character. Spans are sorted, apart and as long as they can be.

    Null texts have no bytes: ``kept`` is null and no span; texts shorter than ``length`` stay whole. Rows with equal texts are copies of
    each other, whatever their ids, and go whole if long enough; so ids, null or repeated, play no part. An empty table
    gives an empty result. All other columns stay (columns ``removed_spans`` and ``kept`` are replaced). Texts of up to 2 GB;
    they are known by 128-bit digests, phrases by two 64-bit hashes.
    """
    names = [c for c in docs.columns if c not in ("removed_spans", "kept")]
    digest = [F.xxhash64(text_col).alias("d1"), F.xxhash64(F.lit("second"), F.col(text_col)).alias("d2")]
    removed = materialize(repeated_spans(docs.select(*digest, F.col(text_col).alias("text")), length, **options)).withColumnsRenamed({"d1": "_d1", "d2": "_d2"})
    # The input's columns travel in one struct, so that none can clash; copies of one text are split over tasks.
    rows = docs.select(F.struct(*names).alias("_row"), *digest)
    joined = rows.join(removed, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & F.col("_row").getField(text_col).isNotNull(), "left")
    text = F.encode(F.col("_row").getField(text_col), "UTF-8")
    cut = F.arrow_udf(_kept, "binary")(F.when(F.col("spans").isNotNull(), text), "spans")
    return joined.select(*[F.col("_row").getField(c).alias(c) for c in names], F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("removed_spans"), F.coalesce(cut, text).alias("kept"))
