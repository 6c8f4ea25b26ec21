"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest configurations, in
fractions, that hold every length as often as it occurs. Multiplicative weights solve it: each length has a price, a knapsack
over the prices (dynamic programming) says what the dearest configuration is worth, and a batch of configurations within
``SLACK`` of that is drawn, in proportion to what the rounds before left short. Prices of what a batch holds too often fall,
others rise. The solution is the average of all batches; demand times prices over the dearest worth bounds every packing from
below, so the gap is known; rounds go on until ``GAP`` is reached or they no longer lower what is short.

Rounding: configurations are used in whole numbers as long as their lengths last; what is left is solved again, ``PHASES``
times in all. Lengths below an eighth of a sequence are left out of the program, as is usual: they, and what rounding
leaves, go by best fit into the fullest sequence with room. If best fit alone makes fewer sequences of all, its plan is taken.

Planning sees only the histogram (as many counts as a sequence has tokens). Pieces get a rank among those of their length,
and the plan maps (length, rank) to a sequence and an offset.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.plans.ranking import salted_rank
from fleetcast.plans.staging import materialize

#: A length's pieces are numbered in so many parts at once.
RANK_BUCKETS = 512
#: Batches are drawn among configurations worth so little less than the dearest: two tokens of a sequence, or where the solution is
#: to be rounded less than half a token, so that hardly any room is lost. A round moves a price by so little, and by so much at most.
SLACK, ROUNDED_SLACK, STEP, MOST_STEP = 0.001, 0.0002, 0.00003, 0.1
#: Rounds go on until so little of the demand is short, or until so many of them lower what is short by less than such a share of it.
GAP, TRIES, PAYS = 0.005, 10, 0.02
#: Configurations of a batch, solutions of what is left in all.
BATCH, PHASES = 1024, 3


class Tokens:
    """Ids of byte-level BPE from a tokenizer file, as ``tokenizers`` gives them with ``add_special_tokens=False``.

    With ``special``, as for a tokenizer loaded from the file and left as it is, the file's added tokens that stand in a text
    become their ids. Without, as with ``encode_special_tokens``, they are read like any other text.

    The ids come from ``tiktoken`` fed with the same file's vocabulary, whose merge order is its id order. It is three
    times as fast; ``tests/llm`` holds the two against each other.
    """

    def __init__(self, file: str, special: bool = False):
        """``file``: the content of the tokenizer file."""
        model = json.loads(file)
        split = model["pre_tokenizer"] or {}
        if model["model"]["type"] != "BPE" or model["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level BPE with the usual split pattern and without a normalizer is known")
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in model["model"]["vocab"].items() if i not in added.values()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added if special else {})
        self.allowed = set(added) if special else set()

    def ids(self, text: str | None) -> np.ndarray:
        return self.coder.encode_to_numpy(text or "", allowed_special=self.allowed, disallowed_special=())


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter than ``capacity``."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((s, capacity) for s in range(first, length, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], file: str, capacity: int) -> Iterator[pa.RecordBatch]:
    tokens = Tokens(file, special=True)
    for b in batches:
        out: list[tuple] = []
        for doc, text, at in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("order").to_pylist(), strict=True):
            ids = np.append(tokens.ids(text.as_py()), 0).astype("<u4")
            out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes()), at) for i, (s, n) in enumerate(cut(len(ids), capacity))]
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ("int64", "int32", "int64", "int64", "int64", "int64"), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "order"])


def dearest(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """What the dearest configuration of each room 0..capacity is worth: a knapsack by dynamic programming."""
    least = int(lengths.min())
    backward = np.full(capacity + 1, -np.inf)
    backward[capacity - lengths] = prices
    worth = np.zeros(capacity + 1)
    for room in range(least, capacity + 1):
        worth[room] = max(worth[room - 1], (worth[: room - least + 1] + backward[capacity - room : capacity - least + 1]).max())
    return worth


def draw(prices: np.ndarray, worth: np.ndarray, lengths: np.ndarray, wanted: np.ndarray, capacity: int, batch: int, rng: np.random.Generator, within: float) -> np.ndarray:
    """``batch`` configurations near the dearest, as rows of places in ``lengths`` (-1: none); lengths go in proportion to ``wanted``."""
    slack, room, value = within * worth[capacity], np.full(batch, capacity), np.zeros(batch)
    steps, live = [], np.arange(batch)
    while len(live):
        step = np.full(batch, -1)
        by_room = live[np.argsort(room[live], kind="stable")]
        rooms, first = np.unique(room[by_room], return_index=True)
        for r, lo, hi in zip(rooms.tolist(), first, np.append(first[1:], len(by_room)), strict=True):
            fit = int(np.searchsorted(lengths, r, "right"))
            if fit:
                near = np.cumsum(wanted[:fit] * (prices[:fit] + worth[r - lengths[:fit]] >= worth[r] - slack))
                step[by_room[lo:hi]] = np.minimum(np.searchsorted(near, rng.random(hi - lo) * near[-1], "right"), fit - 1)
        has = step >= 0
        steps.append(step)
        room = room - np.where(has, lengths[step], 0)
        value += np.where(has, prices[step], 0)
        live = np.nonzero(has & (worth[room] > slack))[0]
    return np.stack(steps, 1)[value >= worth[capacity] - 2 * slack]


@dataclass
class Fractional:
    """A solution of the program: configurations (rows of ``lengths`` places) with their amounts, what they leave ``short`` of each length.

    ``bound``: no packing of the lengths has fewer sequences. ``value``: sequences of the solution, the short rest by best fit.
    ``rounds``: how many it took.
    """

    configurations: list[tuple[np.ndarray, float]]
    short: np.ndarray
    bound: float
    value: float
    rounds: int


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP, batch: int = BATCH, seed: int = 1, slack: float = SLACK) -> Fractional:
    """Multiplicative weights on the covering program, starting from prices in proportion to the lengths."""
    rng, demand, prices = np.random.default_rng(seed), counts.astype("float64"), lengths / capacity
    held, bound, made = np.zeros(len(lengths)), 0.0, []
    # The more draws a length gets in a batch, the more its share in the batch says.
    rate = np.minimum(MOST_STEP, STEP * np.maximum(1, batch * demand / max(1.0, prices @ demand)))
    t, shares = 0, [1.0]
    while True:
        worth = dearest(prices, lengths, capacity)
        bound = max(bound, float(prices @ demand / worth[capacity]))
        wanted = np.maximum((t + 1) * demand - held, 0) + 0.02 * demand
        rows = draw(prices, worth, lengths, wanted, capacity, batch, rng, slack)
        got = np.bincount(rows[rows >= 0], minlength=len(lengths)) * (bound / max(1, len(rows)))
        held += got
        made.append(rows)
        prices = prices * np.exp(-rate * np.clip(got / demand - 1, -1, 3))
        t += 1
        short = np.maximum(0, demand - held / t)
        if t % TRIES == 0:
            shares.append(float(lengths @ short / (lengths @ demand)))
            if shares[-1] <= gap or shares[-1] > (1 - PAYS) * shares[-2]:
                break
    rest: list[list] = []
    best_fit(rest, {int(n): int(c) for n, c in zip(lengths, np.ceil(short), strict=True)}, capacity)
    return Fractional([(rows, bound / t / max(1, len(rows))) for rows in made], short, bound, bound + sum(times for _, times in rest), t)


@dataclass
class Plan:
    """``sequences``: (configuration, how many). ``programmed``: pieces that the program placed, of ``pieces`` in all; ``bound`` as above."""

    sequences: list[tuple[dict[int, int], int]]
    pieces: int
    programmed: int
    bound: float
    value: float


def plan(histogram: dict[int, int], capacity: int, seed: int = 1) -> Plan:
    """Sequences that hold every length exactly as often as ``histogram`` says."""
    rest = Counter({int(n): int(c) for n, c in histogram.items() if c > 0})
    pieces, total = sum(rest.values()), sum(n * c for n, c in rest.items())
    bins: list[list] = []
    if full := rest.pop(capacity, 0):
        bins.append([{capacity: 1}, full])
    lengths = np.array(sorted(n for n in rest if 8 * n >= capacity), "int64")
    left, rng = np.array([rest[n] for n in lengths.tolist()], "int64"), np.random.default_rng(seed)
    programmed, bound, value = full, total / capacity, 0.0
    for phase in range(PHASES):
        at = np.nonzero(left)[0]
        if not len(at):
            break
        found = solve(lengths[at], left[at], capacity, seed=seed + phase, slack=ROUNDED_SLACK)
        if not phase:
            bound, value = max(bound, full + found.bound), full + found.value
        # Amounts are rounded so that sums over the shuffled configurations are off by less than one.
        rows = [(row, amount) for table, amount in found.configurations for row in table]
        carried = rng.random()
        for i in rng.permutation(len(rows)).tolist():
            row, amount = rows[i]
            times = int(carried + amount)
            carried += amount - times
            if times:
                used, each = np.unique(at[row[row >= 0]], return_counts=True)
                times = min(times, int((left[used] // each).min()))
            if times:
                left[used] -= times * each
                programmed += times * int(each.sum())
                bins.append([dict(zip(lengths[used].tolist(), each.tolist(), strict=True)), times])
    for n, c in zip(lengths.tolist(), left.tolist(), strict=True):
        rest[n] = c
    best_fit(bins, rest, capacity)
    # A plan in whole numbers is a solution in fractions too, so the better of both plans is the least known value.
    alone: list[list] = [[{capacity: 1}, full]] if full else []
    best_fit(alone, {int(n): int(c) for n, c in histogram.items() if c > 0 and n != capacity}, capacity)
    if sum(times for _, times in alone) < sum(times for _, times in bins):
        bins, programmed = alone, full
    value = min(value, float(sum(times for _, times in bins)))
    return Plan([(bins[i][0], bins[i][1]) for i in rng.permutation(len(bins)).tolist()], pieces, programmed, bound, value)


def best_fit(bins: list[list], rest: dict[int, int], capacity: int) -> None:
    """Adds ``rest`` to ``bins`` ([configuration, how many]), longest first, each to the fullest that have room; equal ones are filled together."""
    by_room: dict[int, list[int]] = {}
    for i, (config, _) in enumerate(bins):
        by_room.setdefault(capacity - sum(n * c for n, c in config.items()), []).append(i)
    for n in sorted((n for n, c in rest.items() if c), reverse=True):
        count = rest[n]
        while count:
            room = next((r for r in range(n, capacity) if by_room.get(r)), None)
            each = min((capacity if room is None else room) // n, count)
            if room is None:
                config, times, room = {}, count // each, capacity
            else:
                i = by_room[room].pop()
                config, times = bins[i][0], min(bins[i][1], count // each)
                bins[i][1] -= times
                if bins[i][1]:
                    by_room[room].append(i)
            bins.append([dict(Counter(config) + Counter({n: each})), times])
            by_room.setdefault(room - each * n, []).append(len(bins) - 1)
            count -= times * each
    bins[:] = [b for b in bins if b[1]]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then id 0. One longer than ``capacity`` is cut into pieces of ``capacity``, of which
    the first may be shorter; others stay whole. Offsets within a sequence have no gaps and start at 0.

    With ``order_col``, a whole number from 0, sequences follow that order: pieces of one length fill the plan in that order, and
    sequences are numbered by the mean place of their pieces. Null counts as 0. Without it, pieces of one length go in random order.

    Added tokens of the tokenizer file that stand in a text are one id each. Null and empty texts are the single id 0. Repeated
    rows and null ids are each packed. Very long texts make as many pieces as they need. An empty table gives an empty result.
    Other columns are ignored. ``tokenizer_path`` is read on the driver.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(order_col).cast("long"), F.lit(0)).alias("order") if order_col else F.lit(0).cast("long").alias("order"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    with open(tokenizer_path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    pieces = materialize(base.mapInArrow(lambda it: _pieces(it, file.value, capacity), f"{schema}, order long"))
    found = pieces.groupBy("length").agg(F.count(F.lit(1)), F.max("order")).collect()
    histogram, last = {r[0]: r[1] for r in found}, max((r[2] for r in found), default=0)
    planned = plan(histogram, capacity).sequences
    slots, first = {"length": [], "from": [], "each": [], "sequence": [], "offset": []}, 0
    taken: Counter[int] = Counter()
    for config, times in planned:
        offset = 0
        for n, each in config.items():
            for name, x in zip(slots, (n, taken[n], each, first, offset), strict=True):
                slots[name].append(x)
            taken[n] += each * times
            offset += n * each
        first += times
    table = {k: np.array(v, "int64") for k, v in slots.items()}
    order = np.lexsort((table["from"], table["length"]))
    table = {k: v[order] for k, v in table.items()}
    wide = np.int64(1 << 48)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table["length"] * wide + table["from"]
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(starts, n * wide + rank, "right") - 1
            inside = rank - table["from"][at]
            sequence = table["sequence"][at] + inside // table["each"][at]
            offset = table["offset"][at] + inside % table["each"][at] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema_names), pa.array(sequence), pa.array(offset)], names=[*schema_names, "sequence_id", "offset"])

    schema_names = ["doc_id", "piece", "start", "length", "ids_crc32", "order"]
    # With an order, parts are its stretches, so that ranks follow it.
    part = F.floor(F.col("order") / (last + 1) * RANK_BUCKETS).cast("int") if order_col else None
    order = [F.col(c) for c in ("order", "doc_id", "piece", "start", "ids_crc32")]
    ranked = salted_rank(pieces, ["length"], order, F.struct("doc_id", "piece"), RANK_BUCKETS, "rank", part)
    placed = ranked.select(*schema_names, "rank").mapInArrow(place, f"{schema}, order long, sequence_id long, offset long")
    if not order_col:
        return placed.drop("order")
    # Where few pieces share a length, the plan leaves no choice; so sequences are numbered by the mean place of their pieces.
    placed = materialize(placed)
    means = placed.groupBy("sequence_id").agg(F.avg("order").alias("mean"))
    part = F.floor(F.col("mean") / (last + 1) * RANK_BUCKETS).cast("int")
    numbers = salted_rank(means, [], [F.col("mean"), F.col("sequence_id")], F.col("sequence_id"), RANK_BUCKETS, "number", part)
    numbered = placed.join(numbers.select("sequence_id", "number"), "sequence_id")
    return numbered.select(*[c for c in schema_names if c != "order"], F.col("number").alias("sequence_id"), "offset")
