import random
import re

import numpy as np
import pytest
from fleetcast.llm import parity_join
from fleetcast.llm.parity_join import Bands, jaccard_groups
from fleetcast.llm.words import shingle_sets
import pyarrow as pa


def word_shingles(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, num, den):
    sets = [(d, word_shingles(t, n)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 150, 400]))] for _ in range(12)]
    for d in range(docs):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words = words[: max(1, int(len(words) * rng.uniform(0.8, 1)))]
        rows.append((d, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("seed,n,num", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_equals_brute_force(spark, seed, n, num):
    rows = corpus(seed)
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()
    assert sorted(map(tuple, got)) == brute(rows, n, num, 100)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c d e"), (6, "a b c d e"), (None, "a b c d e"), (7, "É b"), (8, "é b"), (9, "x" * 300_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, class_id string, key int")
    got = sorted(map(tuple, jaccard_groups(df, 4, 85, 100).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (6, 2, 6), (None, 2, None), (7, 1, 7), (8, 1, 8), (9, 1, 9)], key=str)
    assert jaccard_groups(df.limit(0)).collect() == []


def test_hot_group(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(words)) for d in range(300)] + [(300 + d, " ".join([*words, f"x{d}"])) for d in range(300)] + [(600 + d, f"other {d} text with its own words {d}") for d in range(300)]
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {r.component_id for r in got if r.doc_id < 600} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 600)


def test_every_linked_pair_of_sizes_shares_a_group():
    bands = Bands(85, 100)
    for a in [*range(1, 300), 1000, 5000]:
        for b in range(a, a * 100 // 85 + 1):
            if 85 * b <= 100 * a:
                assert set(bands.groups(a)) & set(bands.groups(b))


def test_shingles_count_whole_texts():
    texts = ["a b c d e f", None, "a  B\x0bc", "É É É É É"]
    assert [len(s) for s in shingle_sets(pa.array(texts), 4)] == [3, 0, 1, 1]


def test_shared_keys_are_found_in_small_portions(monkeypatch):
    """A task that may hold few rows passes on the same rows as one that holds all."""
    rng = np.random.default_rng(2)
    key, owner = rng.integers(0, 300, 5000), rng.integers(0, 40, 5000)
    key[rng.random(5000) < 0.3] = 7
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 50]), pa.array(owner[i : i + 50])], names=["key", "class_id"]) for i in range(0, 5000, 50)]
    batches += [pa.RecordBatch.from_arrays([pa.array([10_000 + i]), pa.array([i])], names=["key", "class_id"]) for i in range(9)]

    def found(rows):
        monkeypatch.setattr(parity_join, "RUN_ROWS", rows)
        return {r for b in parity_join._runs(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}

    assert found(1 << 30) == found(200) == {(k, o) for k, o in zip(key.tolist(), owner.tolist()) if len(set(owner[key == k])) > 1}
    assert list(parity_join._runs(iter([]))) == []
