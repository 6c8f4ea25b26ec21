import numpy as np
import pytest
from fleetcast.llm.run_index import build_index
from fleetcast.llm.suffix_dedup import dedup_suffixes
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, d1 long, kept int, spans string, uses int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in texts], SCHEMA)


def brute(texts, length):
    """(id, spans, kept) of each text, by counting every string of ``length`` bytes."""
    raw = [(i, None if t is None else t.encode()) for i, t in texts]
    count: dict[bytes, int] = {}
    for _, t in raw:
        for a in range(len(t or b"") - length + 1):
            count[t[a : a + length]] = count.get(t[a : a + length], 0) + 1
    out = []
    for i, t in raw:
        gone = np.zeros(len(t or b"") + 2, "int8")
        for a in range(len(t or b"") - length + 1):
            if count[t[a : a + length]] > 1:
                gone[a + 1 : a + length + 1] = 1
        edge = np.diff(gone)
        spans = tuple(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))
        out.append((i, spans, None if t is None else bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, tuple((s.start, s.end) for s in r.removed_spans), None if r.kept is None else bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_matches_of_an_index(seed):
    rng = np.random.default_rng(seed)
    phrases = [bytes(rng.integers(0, rng.integers(1, 4), rng.integers(1, 60)).astype("uint8")) for _ in range(6)]
    phrases += phrases[:1] * (seed % 3 == 0)
    index = build_index(np.frombuffer(b"".join(phrases), "uint8"), np.cumsum([0, *map(len, phrases)]), keep_order=True)
    want = []
    for p, x in enumerate(phrases):
        for i in range(len(x)):
            rest = [y[j:] for q, y in enumerate(phrases) for j in range(len(y)) if (q, j) != (p, i)]
            want.append(max((next((n for n, (a, b) in enumerate(zip(x[i:], r, strict=False)) if a != b), min(len(x) - i, len(r))) for r in rest), default=0))
    assert index.matches().tolist() == want
    assert index.lengths.sum() == len(want) == len(index.order) and len(index.symbols) == len(index.lengths) == len(index.heads[0]) == len(index.tails[0])


def test_repetitive_phrases_have_few_runs():
    """Runs follow the differences, not the length: thirty variants of one phrase take little more than one."""
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, 400).astype("uint8")
    variants = []
    for _ in range(30):
        x = base.copy()
        x[rng.integers(0, 400)] = 65
        variants.append(x)
    one, many = build_index(base, np.array([0, 400])), build_index(np.concatenate(variants), np.arange(31) * 400)
    assert len(many.data) == 30 * len(one.data) and len(many.symbols) < 4 * len(one.symbols)


@pytest.mark.parametrize("seed,group_phrases", [(1, 2048), (2, 3), (3, 1)])
def test_against_brute_force(spark, seed, group_phrases):
    """Passages, periodic texts, copies and near copies; small groups, so that the second and third are split into blocks."""
    rng = np.random.default_rng(seed)
    letters = lambda n: "".join(rng.choice(list("abcdeé "), n))
    passage, texts = letters(70), []
    for i in range(60):
        t = letters(int(rng.integers(0, 120)))
        if i % 3 == 0:
            at = int(rng.integers(0, len(t) + 1))
            t = t[:at] + passage[: int(rng.integers(20, 71))] + t[at:]
        if i % 7 == 0:
            t += "ab" * int(rng.integers(1, 60)) + "xyz" * 20
        texts.append((i, t))
    texts += [(100 + i, texts[0][1]) for i in range(3)] + [(200 + i, texts[3][1][:20] + str(i) + texts[3][1][20:]) for i in range(8)]
    found = dedup_suffixes(frame(spark, texts).repartition(4), length=40, gram=12, group_phrases=group_phrases, index_bytes=4000)
    assert got(found) == brute(texts, 40) and sum(len(s) for _, s, _ in got(found)) > 20


def test_odd_rows(spark):
    same = "the same long text that two rows hold, with one id or with none at all"
    texts = [(1, None), (2, ""), (3, "short"), (None, same), (None, same), (4, "x" * 300), (4, "y" * 39), (5, "y" * 40), (6, "z" * 41), (None, None), (7, same[:45] + "!")]
    found = dedup_suffixes(frame(spark, texts), length=40, gram=12)
    assert got(found) == brute(texts, 40)
    assert found.columns == ["doc_id", "text", "d1", "spans", "uses", "removed_spans", "kept"]
    assert dedup_suffixes(frame(spark, []), length=40).collect() == []


def test_long_text(spark):
    """A text of several parsed pieces: a passage repeated across their borders goes, the rest stays."""
    rng = np.random.default_rng(9)
    whole = bytes(rng.integers(97, 123, 1_300_000).astype("uint8")).decode()
    passage = whole[524_100:524_700]
    rows = got(dedup_suffixes(frame(spark, [(1, whole), (2, "A" + passage + "B"), (3, whole[:1000].upper() + passage[100:350])])))
    assert [r[1] for r in rows] == [((524_100, 524_700),), ((1, 601),), ((1000, 1250),)]
    assert rows[1][2] == b"AB"


def test_one_passage_in_many_contexts(spark):
    """A third of all texts share a passage: its group is split, and every copy is found."""
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefgh"), 90))
    texts = [(i, "".join(rng.choice(list("abcdefgh"), 60)) + (passage if i % 3 == 0 else "") + "".join(rng.choice(list("abcdefgh"), 60))) for i in range(300)]
    found = dedup_suffixes(frame(spark, texts), length=40, gram=12, group_phrases=8, index_bytes=8000).where(F.size("removed_spans") > 0)
    assert got(found) == [r for r in brute(texts, 40) if r[1]] and found.count() == 100
