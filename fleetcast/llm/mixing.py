"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks of equal size. With weight w, block j of a source is released at slot floor(j / w) and due at
slot ceil((j + 1) / w); in each slot the released block with the earliest deadline goes next. Then after any t slots a
source has had less than one block more or less than w * t.

Weights are exact fractions: 0.1 is 1/10. Their common denominator is a period after which the schedule repeats, every source
having had exactly its share. So one period is scheduled at most, and every block finds its slot by a join on (source, place in
the period). When a source has no blocks left, the weights of the others are scaled up and a new phase starts; a phase that
ends within its first period is scheduled only up to there. All rows are kept.

A period is scheduled in spans, each by itself in some task, so that long periods (weights of many decimals) cost the driver
nothing. What a source has had by a span's border is known in closed form: floor(w * t) blocks, and one more for some of the
sources whose next block is released but not yet due. ``counts`` chooses these: earliest deadlines first, as long as the slots
since each release can hold what must go in them. The sets that fit are the independent sets of a matroid (nested bounds), in
which that greedy choice has the most blocks of every deadline; so, as some schedule exists, the slots after the border can
hold the rest. A span is no shorter than the longest window, so that no block is open at two borders.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.plans.ranking import salted_rank
from fleetcast.plans.staging import materialize

RANK_BUCKETS = 512
#: Slots of a span, and blocks of a key of the join with phases.
SPAN = 1 << 16
KEY_BLOCKS = 1 << 12
#: Tables of the plan of up to so many rows are broadcast; more join by a shuffle. The driver holds up to so many rows at once.
BROADCAST_ROWS = 200_000
BOUNDS = "_s string, _phase int, _first long, _end long, _at long, _period long, _share long, _lacking long"
PLACES = "_s2 string, _phase2 int, _place2 long, _slot long, _release long, _deadline long"


def whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """The smallest whole numbers in the proportions of the weights; their sum is the period."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    return reduced({s: int(x * unit) for s, x in exact.items()})


def reduced(shares: dict[str, int]) -> dict[str, int]:
    common = math.gcd(*shares.values())
    return {s: x // common for s, x in shares.items()}


def one_period(shares: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one period: earliest deadline first among released blocks.

    Ties in deadlines go to the source with the larger share, then by name.
    """
    names = sorted(shares)
    numbers = [shares[s] for s in names]
    return [(names[i], *row) for i, *row in span_slots(numbers, 0, sum(numbers))]


def counts(shares: list[int], t: int) -> list[int]:
    """The blocks that each source has had before slot ``t`` of a period: floor(share * t / period), or one more."""
    period = sum(shares)
    if t in (0, period):
        return list(shares) if t else [0] * len(shares)
    kind = "int64" if max(shares) * t + 2 * period < 1 << 62 else object
    share = np.array(shares, kind)
    done, rest = share * t // period, share * t % period
    more = t - int(done.sum())
    if not more:
        return [int(x) for x in done]
    open_ = np.nonzero(rest)[0]
    release, due = done[open_] * period // share[open_], -(-(done[open_] + 1) * period // share[open_])
    # At each slot since the first release: slots from there to t, less those that blocks released since and due by t need.
    first = int(release.min())
    j = -(-share * first // period)
    n = np.maximum(done - j, 0).astype("int64")
    j = np.repeat(j, n) + (np.arange(n.sum()) - np.repeat(n.cumsum() - n, n))
    needed = np.bincount((j * period // np.repeat(share, n) - first).astype("int64"), minlength=t - first)
    spare = np.arange(t - first, 0, -1) - needed[::-1].cumsum()[::-1]
    # The blocks released since a start must fit at every slot after the start before it.
    starts = np.unique((release - first).astype("int64"))
    spare = np.minimum.reduceat(spare[: starts[-1] + 1], np.append(0, starts[:-1] + 1))
    level = np.searchsorted(starts, (release - first).astype("int64"), "right")
    for x in sorted(range(len(open_)), key=lambda x: (due[x], -share[open_[x]], x)):
        if more and spare[: level[x]].min() > 0:
            spare[: level[x]] -= 1
            done[open_[x]] += 1
            more -= 1
    return [int(x) for x in done]


def span_slots(shares: list[int], start: int, stop: int | None) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) of the slots from ``start`` to ``stop`` of a period, sources by number.

    Earliest deadline first among released blocks; what ``counts`` has done by ``stop`` is due by then. Without ``stop`` it
    goes on to the period's end, bound by nothing but the deadlines.
    """
    period = sum(shares)
    end = period if stop is None else stop
    given, until = counts(shares, start), counts(shares, end)
    waiting = [(max(start, j * period // s), i, j) for i, (s, j, last) in enumerate(zip(shares, given, until, strict=True)) if j < last]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int, int]] = []
    for slot in range(start, end):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            deadline = -(-(j + 1) * period // shares[i])
            heapq.heappush(ready, (min(deadline, end), deadline, -shares[i], i, j))
        _, deadline, _, i, j = heapq.heappop(ready)
        yield i, j, slot, j * period // shares[i], deadline
        if j + 1 < until[i]:
            heapq.heappush(waiting, ((j + 1) * period // shares[i], i, j + 1))


def phase_end(shares: list[int], left: list[int], span: int) -> tuple[int, list[int], int | None]:
    """(slots until some source has had all blocks it has left, the blocks of each source by then, length of a span).

    The length is None where the phase is so short that it is one span. Only the span in which it ends is worked through.
    """
    period = sum(shares)
    span = max(span, period // min(shares) + 2)
    latest = min(-(-n * period // s) for n, s in zip(left, shares, strict=True))
    if latest <= span < period:
        turn, slots, given, span = 0, span_slots(shares, 0, None), [0] * len(shares), None
    else:
        each = -(-period // span)

        def border(x: int) -> tuple[int, int]:
            return x // each, min(x % each * span, period)

        def some_done(x: int) -> bool:
            turn, t = border(x)
            return any(turn * s + n >= m for s, n, m in zip(shares, counts(shares, t), left, strict=True))

        earliest = min((n - 1) * period // s for n, s in zip(left, shares, strict=True))
        lo = earliest // period * each + earliest % period // span
        hi = latest // period * each + latest % period // span + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if some_done(mid) else (mid, hi)
        turn, start = border(lo)
        slots, given = span_slots(shares, start, min(start + span, period)), counts(shares, start)
    for i, j, slot, _, _ in slots:
        given[i] = j + 1
        if turn * shares[i] + j + 1 == left[i]:
            return turn * period + slot + 1, [turn * s + n for s, n in zip(shares, given, strict=True)], span
    raise AssertionError("a phase ends within its last span")


def phase_plan(rows: dict[str, int], units: dict[str, int], block_rows: int, span: int) -> Iterator[tuple[list[tuple], tuple[int, int, int | None]]]:
    """Of each phase its (source, phase, first block, end block, first slot, period, share, rows lacking before) and (phase, slots
    of its first period, length of a span).

    ``first`` to ``end`` are a source's blocks of a phase. A phase ends with the last block of some source, the only one that
    may lack rows.
    """
    blocks = {s: -(-n // block_rows) for s, n in sorted(rows.items()) if n}
    used, at, lacking, phase = dict.fromkeys(blocks, 0), 0, 0, 0
    while blocks:
        shares = reduced({s: units[s] for s in blocks})
        period = sum(shares.values())
        end, took, step = phase_end(list(shares.values()), [blocks[s] - used[s] for s in blocks], span)
        took = dict(zip(shares, took, strict=True))
        yield [(s, phase, used[s], used[s] + n, at, period, shares[s], lacking) for s, n in took.items() if n], (phase, min(end, period), step)
        for s, n in took.items():
            used[s] += n
        at += end
        phase += 1
        for s in [s for s in took if used[s] == blocks[s]]:
            lacking += blocks.pop(s) * block_rows - rows[s]


def spans(run: tuple[int, int, int | None]) -> list[tuple[int, int, int | None, int]]:
    """(phase, start, slots to schedule, length of a span) of each span of a phase's first period."""
    phase, slots, step = run
    return [(phase, start, min(step or slots, slots - start), step) for start in range(0, slots, step or slots)]


def places(todo: Iterator[tuple[int, int, int, int | None]], units: dict[str, int], dry: dict[str, int]) -> Iterator[tuple]:
    """(source, phase, place, slot in period, release, deadline) of the slots of spans; ``dry``: the phase that a source ends."""
    for phase, start, slots, step in todo:
        shares = reduced({s: units[s] for s in sorted(units) if dry[s] >= phase})
        names, numbers = list(shares), list(shares.values())
        for i, j, slot, release, deadline in span_slots(numbers, start, step and min(start + step, sum(numbers))):
            if slot >= start + slots:
                break
            yield names[i], phase, j, slot, release, deadline


def phases(rows: dict[str, int], weights: dict[str, float], block_rows: int, span: int = SPAN) -> tuple[list[tuple], list[tuple]]:
    """A small plan as two lists: bounds as ``phase_plan`` has them, and the places of all spans."""
    units = whole_shares({s: weights[s] for s, n in rows.items() if n})
    bounds, runs = zip(*phase_plan(rows, units, block_rows, span), strict=True)
    bounds = [r for part in bounds for r in part]
    return bounds, list(places((x for run in runs for x in spans(run)), units, ended(bounds)))


def ended(bounds: list[tuple]) -> dict[str, int]:
    """The last phase of each source in ``bounds``."""
    out: dict[str, int] = {}
    for s, phase, *_ in bounds:
        out[s] = max(phase, out.get(s, 0))
    return out


def _place_batches(batches: Iterator[pa.RecordBatch], units: dict[str, int], dry: dict[str, int]) -> Iterator[pa.RecordBatch]:
    kinds = ["string", "int32", "int64", "int64", "int64", "int64"]
    made = places((tuple(r.values()) for b in batches for r in b.to_pylist()), units, dry)
    while part := list(islice(made, 1 << 15)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=["_s2", "_phase2", "_place2", "_slot", "_release", "_deadline"])


def _plan(spark: SparkSession, rows: dict[str, int], weights: dict[str, float], block_rows: int, span: int) -> tuple[DataFrame, DataFrame]:
    """The tables of bounds, a row for each key of blocks (``_key``), and of places; broadcast where they are small."""
    units = whole_shares(weights) if weights else {}
    tables, bounds, runs, dry, slots, keys = [], [], [], {}, 0, 0
    for part, run in phase_plan(rows, units, block_rows, span):
        bounds += part
        runs += spans(run)
        slots += run[1]
        keys += sum((end - 1) // KEY_BLOCKS - first // KEY_BLOCKS + 1 for _, _, first, end, *_ in part)
        dry |= ended(part)
        if len(bounds) > BROADCAST_ROWS:
            tables.append(materialize(spark.createDataFrame(bounds, BOUNDS)))
            bounds = []
    tables.append(spark.createDataFrame(bounds, BOUNDS))
    key = F.explode(F.sequence(F.floor(F.col("_first") / KEY_BLOCKS), F.floor((F.col("_end") - 1) / KEY_BLOCKS)))
    bounds = reduce(DataFrame.union, tables).withColumn("_key", key)
    todo = spark.createDataFrame(runs, "phase int, start long, slots long, step long").repartition(max(1, min(len(runs), spark.sparkContext.defaultParallelism * 8)))
    placed = todo.mapInArrow(lambda it: _place_batches(it, units, dry), PLACES)
    return F.broadcast(bounds) if keys <= BROADCAST_ROWS else bounds, F.broadcast(placed) if slots <= BROADCAST_ROWS else materialize(placed)


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 16, id_col: str = "doc_id", source_col: str = "source", span: int = SPAN
) -> DataFrame:
    """``docs`` with ``position`` (gapless from 0), ``block``, ``slot``, ``release`` and ``deadline``: the order of the mixture.

    ``weights``: target weight by source, read as decimals; without it all sources weigh the same. Sources that are not named
    share the smallest named weight. While every source has rows, its blocks among the first t slots number less than one from
    weight * t; then the same holds for those that still have rows. ``block_rows`` rows make a block, only a source's last may
    be shorter; within a source, rows go by a hash of the id, a random order. ``span``: slots that a task schedules at once; it is
    raised to the longest window of a block.

    All rows stay, repeated ones and those with null ids too. A null source counts as the source "". Weights must be
    positive. An empty table gives an empty result. Columns named like an output are replaced. The driver holds numbers by
    source and a row for each span; slots are made in tasks, and what sources have in a phase is written in parts.
    """
    made = ["position", "block", "slot", "release", "deadline"]
    names = [c for c in docs.columns if c not in made]
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    # The input's columns travel in one struct, so that none can clash.
    rows = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"))
    counted = {r[0]: r[1] for r in rows.groupBy("_source").count().collect()}
    least = min(weights.values()) if weights else 1.0
    bounds, placed = _plan(docs.sparkSession, counted, {s: (weights or {}).get(s, least) for s in counted}, block_rows, span)
    ranked = salted_rank(rows, ["_source"], [F.col("_id")], F.col("_id"), RANK_BUCKETS, "_rank").withColumn("block", F.floor(F.col("_rank") / block_rows).cast("long"))
    same = (F.col("_source") == F.col("_s")) & (F.floor(F.col("block") / KEY_BLOCKS) == F.col("_key"))
    phased = ranked.join(bounds, same & (F.col("block") >= F.col("_first")) & (F.col("block") < F.col("_end")))
    inside = F.col("block") - F.col("_first")
    phased = phased.withColumns({"_turn": F.floor(inside / F.col("_share")).cast("long"), "_place": inside % F.col("_share")})
    slotted = phased.join(placed, (F.col("_source") == F.col("_s2")) & (F.col("_phase") == F.col("_phase2")) & (F.col("_place") == F.col("_place2")))
    shift = F.col("_at") + F.col("_turn") * F.col("_period")
    slotted = slotted.withColumns({"slot": shift + F.col("_slot"), "release": shift + F.col("_release"), "deadline": shift + F.col("_deadline")})
    position = F.col("slot") * block_rows + F.col("_rank") % block_rows - F.col("_lacking")
    return slotted.withColumn("position", position.cast("long")).select("_row.*", *made)
