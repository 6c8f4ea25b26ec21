"""Toxicity scores by a factorization machine over hashed terms.

Terms are the words of a text and their first four, five and six bytes, each hashed into a table of 2^29 slots a kind; a text has a
term or has it not. score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>): the pair part learns combinations that additive
weights miss. Terms get weights if they go with the label, alone or in a pair: an insult and a group's name may each be
harmless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.words import LETTERS, Words, chunks

PREFIXES = (4, 5, 6)
_SHIFT, _TABLE_BITS = np.uint64(33), 20
#: Pairs are looked for among whole words in at least this share of the sample's texts, and in at most that, a block at a time.
PAIR_SHARES, BLOCK = (0.02, 0.6), 512


def _terms(words: Words) -> np.ndarray:
    """Hashes of the terms of each word: (words, 1 + prefixes); the two lowest bits are 0 for whole words."""
    kinds = [words.hashes(), *(words.hashes(n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & 2**64 - 1) for n in PREFIXES)]
    return (np.stack(kinds, 1) >> _SHIFT).astype("int32") & -4 | np.arange(len(kinds), dtype="int32")


def term_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct terms of each text."""
    out = []
    for _, part in chunks(texts):
        words = Words(part, LETTERS)
        terms = _terms(words)
        out += [np.unique(terms[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    return out


@dataclass
class Machine:
    """``terms`` (sorted) with weights ``w`` and factors ``v``; ``bias``."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        # A first look in a table of 2^20 slots rules out most terms that have no weight.
        self.slot = np.zeros(1 << _TABLE_BITS, bool)
        self.slot[self.terms & ((1 << _TABLE_BITS) - 1)] = True

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for row, part in chunks(texts):
            words = Words(part, LETTERS)
            terms = _terms(words)
            doc = np.repeat(np.arange(len(part)), np.diff(words.first))
            maybe = self.slot[terms & ((1 << _TABLE_BITS) - 1)]
            t, d = terms[maybe], np.broadcast_to(doc[:, None], terms.shape)[maybe]
            at = np.minimum(np.searchsorted(self.terms, t), max(0, len(self.terms) - 1))
            known = self.terms[at] == t if len(self.terms) else np.zeros(len(t), bool)
            pairs = np.unique(d[known].astype("int64") * max(1, len(self.terms)) + at[known])
            d, at = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
            linear = np.bincount(d, self.w[at], len(part)) if len(at) else 0.0
            cross = np.zeros(len(part))
            for f in range(self.v.shape[1] if len(at) else 0):
                x = self.v[at, f]
                cross += np.bincount(d, x, len(part)) ** 2 - np.bincount(d, x**2, len(part))
            out[row : row + len(part)] = 1 / (1 + np.exp(-np.clip(self.bias + linear + cross / 2, -30, 30)))
        return out


def _chi(hits, n, bad, total):
    """Chi-square of a term (or pair) in ``n`` of ``total`` texts, ``hits`` of them among the ``bad`` ones of label 1."""
    gap = hits * (total - bad) - (n - hits) * bad
    return total * gap**2 / (bad * (total - bad) * np.maximum(1, n) * np.maximum(1, total - n))


def _table(term_lists: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Which of the ``chosen`` terms (sorted) each text has."""
    x = np.zeros((len(term_lists), len(chosen)), "float32")
    for row, own in enumerate(term_lists):
        at = np.minimum(np.searchsorted(chosen, own), len(chosen) - 1)
        x[row, at[chosen[at] == own]] = 1
    return x


def paired_terms(term_lists: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """Places of ``terms`` that stand in some pair whose presence goes with the label clearly more than either term does."""
    total, bad, kept = len(labels), labels.sum(), np.zeros(len(terms), bool)
    if len(terms) < 2:
        return np.zeros(0, "int64")
    x = _table(term_lists, terms)
    marked = x[labels > 0]
    least = 2 * np.log(10 * len(terms) ** 2)
    for lo in range(0, len(terms), BLOCK):
        part = slice(lo, lo + BLOCK)
        both, hits = x[:, part].T @ x, marked[:, part].T @ marked
        pair = _chi(hits.astype("float64"), both.astype("float64"), bad, total)
        clear = pair > np.maximum(chi[part][:, None], chi[None, :]) + least
        kept[part] |= clear.any(1)
        kept |= clear.any(0)
    return np.nonzero(kept)[0]


def fit_machine(term_lists: list[np.ndarray], labels: np.ndarray, rank: int = 4, least_texts: int = 4, steps: int = 360, seed: int = 5) -> Machine:
    """Terms in ``least_texts`` texts that go with the label, alone or in a pair (chi-square); then gradient steps on the log loss.

    Bias, weights and factors are learned together. The bias is held near half the prior.
    Without both labels, or without terms that go with one, it gives half the share of label 1 (0.025 where there are no rows).
    """
    share = float(labels.mean()) if len(labels) else 0.05
    # Half the prior, as for a text without terms: what nothing speaks against stays below the threshold of common use.
    half = float(np.log(max(share, 1e-3) / (2 - share)))
    none = Machine(np.zeros(0, "int32"), half, np.zeros(0), np.zeros((0, rank)))
    if not len(labels) or not 0 < share < 1:
        return none
    # Sorted in place and dropped at once: the driver holds the sample's terms and one copy.
    every = np.concatenate(term_lists)
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))[: len(every)]
    terms, n = every[first], np.diff(np.append(first, len(every)))
    del every, first
    hits = np.zeros(len(terms), "int64")
    found, times = np.unique(np.concatenate([t for t, y in zip(term_lists, labels, strict=True) if y]), return_counts=True)
    hits[np.searchsorted(terms, found)] = times
    total, bad = len(labels), labels.sum()
    able = np.nonzero((n >= least_texts) & (n < total))[0]
    terms, n, chi = terms[able], n[able], _chi(hits[able].astype("float64"), n[able].astype("float64"), bad, total)
    # So high that of many terms that don't go with the label hardly one gets past.
    kept = np.nonzero(chi >= 2 * np.log(10 * max(1, len(able))))[0]
    often = np.nonzero((terms & 3 == 0) & (n >= max(least_texts, PAIR_SHARES[0] * total)) & (n <= PAIR_SHARES[1] * total))[0]
    kept = np.union1d(kept, often[paired_terms(term_lists, labels, terms[often], chi[often])])
    if not len(kept):
        return none
    x = _table(term_lists, terms[kept])
    rng = np.random.default_rng(seed)
    p = {"b": np.array([half]), "w": np.zeros(len(kept)), "v": rng.normal(0, 0.05, (len(kept), rank))}
    m, s = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    y = labels.astype("float64")
    # Rows of label 1 count more, so that 0.3 lies well between the labels.
    weight = np.where(y > 0, min(4.0, (1 - share) / share), 1.0)
    weight /= weight.sum()
    # Steps of the pair part shrink with its gradient: where the linear part suffices, pairs must not drift.
    for t in range(1, steps + 1):
        v = p["v"].astype("float32")
        xv = x @ v
        z = p["b"] + x @ p["w"].astype("float32") + ((xv**2).sum(1) - x @ (v**2).sum(1)) / 2
        err = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype("float32")
        by_term = x.T @ err
        # Free, the bias would sink with the many clear texts, and a single insult would no longer reach the threshold.
        g = {"b": err.sum(keepdims=True) + 0.3 * (p["b"] - half), "w": by_term + 1e-6 * p["w"], "v": x.T @ (err[:, None] * xv) - by_term[:, None] * v + 1e-3 * v}
        for k in g:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            p[k] -= (0.02 if k == "v" else 0.05) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + (1e-3 if k == "v" else 1e-8))
    return Machine(terms[kept], float(p["b"][0]), p["w"], p["v"])


def learn_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_rows: int = 5_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on at most ``sample_rows`` labelled texts whose id meets ``may_learn``, those with the smallest hash of the id.

    Labels other than 0 and 1, null ids and labels without a text are passed over. Of several labels of an id the largest
    counts. Nothing but the text is an input; very long texts are read whole. No rows, or labels of one kind: a machine without terms.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y")).withColumnRenamed("_id", id_col)
    chosen = marked.where(may_learn).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).collect()
    rows = F.broadcast(docs.sparkSession.createDataFrame([(r[0], int(r[1])) for r in chosen], f"{id_col} long, _y int"))
    sample = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).join(rows, id_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_y"), b.column(id_col), pa.array(term_sets(b.column("text")), pa.list_(pa.int32()))], names=["y", "id", "terms"])

    got = sample.mapInArrow(of, "y int, id long, terms array<int>").toArrow().sort_by("id")
    lists = got.column("terms").combine_chunks()
    ends = lists.offsets.to_numpy() if len(got) else np.zeros(1, "int32")
    values = lists.values.to_numpy()
    return fit_machine([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], got.column("y").to_numpy().astype("int64"))


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1), the score of each whole text.

    Null and empty texts get the score of a text without terms. Repeated rows each stay, as do null ids; no rows, no
    scores. A column named ``score_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts))

    return docs.withColumn(score_col, score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
