"""A run-length Burrows-Wheeler index of a few megabytes of phrases, and matching statistics streamed from its samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a suffix that the first sorting compares.
FIRST = 7


def _ranked(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Dense ranks from 0 of ``keys``, which ``order`` sorts."""
    ranks, sorted_ = np.empty(len(keys), "int64"), keys[order]
    ranks[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
    return ranks


@dataclass
class RunIndex:
    """Runs of the transform (symbol and length), and where a run begins or ends the suffix there with its neighbour in suffix order and their common length.

    ``data``: all phrases, one behind the other; ``starts``: where each begins, and the end of the last. Every phrase ends in
    a symbol of its own (-1 in ``symbols``), so no match passes its end. Samples are sorted by position.
    """

    data: np.ndarray
    starts: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    heads: tuple[np.ndarray, np.ndarray]
    tails: tuple[np.ndarray, np.ndarray]
    #: The suffix order itself, kept on request only.
    order: np.ndarray | None = None

    def matches(self) -> np.ndarray:
        """Of each position the longest match of what follows, within its phrase, with what follows any other position.

        One stream over the positions: a suffix whose predecessor in suffix order is preceded by the same symbol is one shorter
        in common with it than the position before; all others are sampled. The same holds for successors.
        """
        at = np.arange(len(self.data))
        best = np.zeros(len(at), "int64")
        for where, common in (self.heads, self.tails):
            last = np.searchsorted(where, at, "right") - 1
            np.maximum(best, common[last] - (at - where[last]), out=best)
        return best


def build_index(data: np.ndarray, starts: np.ndarray, keep_order: bool = False) -> RunIndex:
    """The index of the phrases data[starts[i]:starts[i + 1]], none of them empty.

    Suffixes are sorted by prefix doubling; only runs and samples of their ends outlive this call.
    """
    n, phrases = len(data), len(starts) - 1
    owner = np.repeat(np.arange(phrases), np.diff(starts))
    left = starts[1:][owner] - np.arange(n)
    padded = np.concatenate([data, np.zeros(FIRST, "uint8")])
    keys = np.zeros(n, "uint64")
    for j in range(FIRST):
        keys = (keys << np.uint64(8)) | np.where(left > j, padded[j : n + j], 0).astype("uint64")
    keys = (keys << np.uint64(8)) | np.minimum(left, FIRST).astype("uint64")
    order = np.argsort(keys, kind="stable")
    levels, depth = [_ranked(keys, order).astype("int32")], FIRST
    while int(levels[-1].max()) < n - 1:
        rank = levels[-1]
        inside = left > depth
        behind = np.where(inside, rank[np.minimum(np.arange(n) + depth, n - 1)] + np.int64(phrases), owner)
        keys = rank.astype("int64") * (n + phrases) + behind
        order = np.argsort(keys, kind="stable")
        levels.append(_ranked(keys, order).astype("int32"))
        depth *= 2
    before = np.where(np.isin(np.arange(n), starts[:-1], assume_unique=True), -1, data[order * 0 + np.arange(n) - 1].astype("int16"))
    symbols = before[order]
    change = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (symbols[1:] < 0)])
    head = np.nonzero(change)[0]
    tail = np.concatenate([head[1:] - 1, [n - 1]])

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common lengths of suffixes, from the deepest level of the doubling to single bytes."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), "int64")
        here, there = starts[1:][owner[a]], starts[1:][owner[b]]
        for level in range(len(levels) - 1, -1, -1):
            step, rank = FIRST << level, levels[level]
            fits = (a + step <= here) & (b + step <= there)
            same = fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            a, b, total = a + step * same, b + step * same, total + step * same
        going = np.ones(len(a), bool)
        for _ in range(FIRST - 1):
            going &= (a < here) & (b < there)
            going &= data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)]
            a, b, total = a + going, b + going, total + going
        return total

    def samples(places: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        other = np.clip(places + step, 0, n - 1)
        found = np.where(other != places, common(order[places], order[other]), 0)
        sort = np.argsort(order[places])
        return order[places][sort], found[sort]

    return RunIndex(data, starts, symbols[head], np.diff(np.concatenate([head, [n]])), samples(head, -1), samples(tail, 1), order if keep_order else None)
