import random
from collections import Counter
from fractions import Fraction

import pytest
from fleetcast.llm.mixing import counts, mix_sources, one_period, phase_plan, phases, spans, whole_shares


def simulate(blocks, weights):
    """Earliest deadline first, slot by slot, without the periodic table."""
    used, out, at = Counter(), [], 0
    while any(used[s] < n for s, n in blocks.items()):
        open_ = [s for s in blocks if used[s] < blocks[s]]
        shares = whole_shares({s: weights[s] for s in open_})
        total, given, t = sum(shares.values()), Counter(), 0
        while all(used[s] < blocks[s] for s in open_):
            ready = [s for s in open_ if given[s] * total // shares[s] <= t]
            s = min(ready, key=lambda s: (-(-(given[s] + 1) * total // shares[s]), -shares[s], s))
            out.append((s, used[s], at + t))
            given[s] += 1
            used[s] += 1
            t += 1
        at += t
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lag_stays_below_one_block(seed):
    rng = random.Random(seed)
    shares = whole_shares({f"s{i}": rng.choice([1, 2, 3.5, 10, 0.25]) for i in range(rng.randint(1, 12))})
    total, had = sum(shares.values()), Counter()
    for s, _, slot, release, deadline in one_period(shares):
        assert release <= slot < deadline
        had[s] += 1
        assert all(abs(had[x] - Fraction(n, total) * (slot + 1)) < 1 for x, n in shares.items())
    assert had == shares


@pytest.mark.parametrize("seed", range(3))
def test_equals_slot_by_slot_simulation(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([1, 3, 17, 60, 200]) for i in range(5)}
    weights = {s: rng.choice([1.0, 2.0, 5.0]) for s in sizes}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=4).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert sorted({(r.source, r.block, r.slot) for r in got}) == sorted(simulate({s: -(-n // 4) for s, n in sizes.items()}, weights))
    assert [r.slot for r in sorted(got, key=lambda r: r.position)] == sorted(r.slot for r in got)
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "a"), (2, "a"), (3, "")]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, source string, slot int, first_block string")
    got = mix_sources(df).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3, 4]
    assert {r.first_block for r in got} == {"x"}
    assert mix_sources(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mix_sources(df, {"a": 0.0})


def expanded(bounds, places):
    """(source, block) by slot."""
    at, out = {(s, phase, j): slot for s, phase, j, slot, *_ in places}, {}
    for s, phase, first, end, start, period, share, _ in bounds:
        for b in range(first, end):
            out[start + (b - first) // share * period + at[(s, phase, (b - first) % share)]] = (s, b)
    return [out[i] for i in range(len(out))]


def test_phases_cover_all_blocks():
    rows = {"a": 1000, "b": 3, "c": 77, "d": 0}
    made = expanded(*phases(rows, dict.fromkeys("abcd", 1.0) | {"c": 2.0}, 1))
    assert sorted(made) == sorted((s, b) for s, n in rows.items() for b in range(n))


def test_many_blocks_stay_within_one_block_of_the_given_weights():
    """Each phase against the exact weights, with as many blocks as make rounded weights drift by tens of blocks."""
    weights = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.05, "src4": 0.05, "x": 0.05, "y": 0.05}
    rows = dict(zip(weights, [30000, 9000, 700, 6000, 9999, 20000, 4100], strict=True))
    left, had, exact, t = dict(rows), Counter(), None, 0
    for s, _ in expanded(*phases(rows, weights, 1)):
        if exact is None:
            total = sum(Fraction(str(weights[x])) for x in left)
            exact, had, t = {x: Fraction(str(weights[x])) / total for x in left}, Counter(), 0
        had[s], t = had[s] + 1, t + 1
        assert abs(had[s] - exact[s] * t) < 1
        if t % 97 == 0:
            assert all(abs(had[x] - w * t) < 1 for x, w in exact.items())
        left[s] -= 1
        if not left[s]:
            del left[s]
            exact = None
    assert not left


def test_many_sources():
    rows = {f"s{i}": 1 + i % 5 for i in range(3000)}
    bounds, places = phases(rows, {s: 0.1 + 0.01 * (i % 7) for i, s in enumerate(rows)}, 1)
    made = expanded(bounds, places)
    assert sorted(made) == sorted((s, b) for s, n in rows.items() for b in range(n))
    assert len(places) <= 2 * sum(rows.values())


def check_windows(order, rows, weights):
    """Each phase, slot by slot, against exact weights: every source within a block of its share."""
    left, exact = {s: n for s, n in rows.items() if n}, None
    for s in order:
        if exact is None:
            total = sum(Fraction(str(weights[x])) for x in left)
            exact, had, t = {x: Fraction(str(weights[x])) / total for x in left}, Counter(), 0
        had[s], t = had[s] + 1, t + 1
        assert all(abs(had[x] - w * t) < 1 for x, w in exact.items())
        left[s] -= 1
        if not left[s]:
            del left[s]
            exact = None
    assert not left


@pytest.mark.parametrize("seed", range(60))
def test_spans_keep_the_windows(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.choice([1, 2, 3.5, 10, 0.25, 0.37, 7.77]) for i in range(rng.randint(1, 9))}
    rows = {s: rng.randint(1, 300) for s in weights}
    bounds, places = phases(rows, weights, 1, span=rng.choice([1, 4, 16, 64]))
    assert all(r <= slot < d for *_, slot, r, d in places)
    assert len({(s, phase, j) for s, phase, j, *_ in places}) == len(places)
    check_windows([s for s, _ in expanded(bounds, places)], rows, weights)


def test_a_span_over_a_whole_period_is_plain_earliest_deadline_first():
    shares = whole_shares({"a": 0.37, "b": 0.2, "c": 0.43})
    bounds, places = phases(dict(shares), {"a": 0.37, "b": 0.2, "c": 0.43}, 1)
    first = [(s, j, slot, r, d) for s, phase, j, slot, r, d in places if phase == 0]
    assert first and first == one_period(shares)[: len(first)]


def test_counts_of_shares_beyond_64_bits():
    shares = [3 * 10**18 + 1, 5 * 10**18 + 7, 2 * 10**18 + 3]
    period = sum(shares)
    for t in (1, 2, 10**9 + 7, period // 3):
        had = counts(shares, t)
        assert sum(had) == t and all(abs(n * period - s * t) < period for n, s in zip(had, shares, strict=True))


def test_long_periods_cost_the_driver_a_row_for_each_span():
    rows = {"a": 16_000_000, "b": 16_000_000, "c": 16_000_000}
    plan = list(phase_plan(rows, whole_shares({"a": 0.3333333, "b": 0.2718281, "c": 0.3948386}), 16, 1 << 16))
    assert sum(run[1] for _, run in plan) > 2_000_000
    assert sum(len(part) + len(spans(run)) for part, run in plan) < 100


def test_spans_in_tasks_joined_to_rows(spark):
    """Weights of seven decimals, a hot source, spans and tables of bounds that are written and joined by shuffles."""
    weights = {"hot": 0.3333333, "b": 0.2718281, "c": 0.3948386}
    rows = {"hot": 4000, "b": 1500, "c": 1700}
    df = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in rows.items() for _ in range(n))], "doc_id long, source string")
    from fleetcast.llm import mixing

    kept = mixing.BROADCAST_ROWS, mixing.KEY_BLOCKS
    mixing.BROADCAST_ROWS, mixing.KEY_BLOCKS = 2, 64
    try:
        got = mix_sources(df, weights, block_rows=1, span=128).collect()
    finally:
        mixing.BROADCAST_ROWS, mixing.KEY_BLOCKS = kept
    assert sorted(r.doc_id for r in got) == list(range(7200))
    assert sorted(r.position for r in got) == list(range(7200))
    assert all(r.release <= r.slot < r.deadline for r in got)
    check_windows([r.source for r in sorted(got, key=lambda r: r.position)], rows, weights)
