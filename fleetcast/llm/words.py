"""Words of Arrow text columns and their 64-bit hashes, whole columns at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_VALUES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype="uint64")
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z
#: Bytes of words that white space separates, and of words of ASCII letters, digits and all other letters.
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Text handled at once; a longer document is handled alone.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were needed so far."""

    up = down = np.zeros(0, "uint64")

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, CHUNK_BYTES + 1)
            up, down = np.full(size, _BASE, "uint64"), np.full(size, _INVERSE, "uint64")
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


class Words:
    """Words of ``texts`` (nulls as empty): ``start`` and ``end`` in the bytes; document d has words first[d]..first[d+1]-1."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        texts = pa.concat_arrays([texts]) if texts.offset else texts
        offsets = np.frombuffer(texts.buffers()[1], "int64", len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, "int64")
        data = np.frombuffer(texts.buffers()[2] or b"", "uint8")[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = is_word[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start, self.end = np.nonzero(inside & ~before)[0], np.nonzero(inside & ~after)[0] + 1
        self.first = np.searchsorted(self.start, offsets)
        up, self._down = Powers.of(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, "uint64")
        np.cumsum(_VALUES[data] * up[:-1], out=self._sums[1:])

    def hashes(self, length: int | None = None) -> np.ndarray:
        """A hash of each word, A-Z as a-z; of its first ``length`` bytes at most."""
        end = self.end if length is None else np.minimum(self.end, self.start + length)
        return mix((self._sums[end] - self._sums[self.start]) * self._down[self.start])


def chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of about ``CHUNK_BYTES`` of text each."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64"))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text its distinct ``size``-word shingles as sorted 64-bit hashes.

    With fewer words the whole sequence is one shingle; without words or text the set is empty.
    """
    out: list[np.ndarray] = []
    factors = np.array([pow(0xD1B54A32D192ED03, j + 1, 2**64) for j in range(size)], "uint64")
    for _, part in chunks(texts):
        words = Words(part, NOT_SPACE)
        h, first = words.hashes(), words.first
        n = max(0, len(h) - size + 1)
        rolled = np.zeros(n, "uint64")
        for j in range(size):
            rolled += h[j : j + n] * factors[j]
        rolled = mix(rolled)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            else:
                own = (h[a:b] * factors[: b - a]).sum(dtype="uint64", keepdims=True) ^ np.uint64(b - a)
                out.append(mix(own) if b > a else np.zeros(0, "uint64"))
    return out
