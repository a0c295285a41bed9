"""A minimal perfect hash over 128-bit line hashes, with a fingerprint and two values per key.

Levels of bit arrays: a key's bit is set on the first level where no other remaining key
wants it; a key's index is the count of set bits before its own. About 3 bits a key, built
and probed with NumPy alone. A 64-bit fingerprint, independent of the position, tells
strangers from keys.
"""

from __future__ import annotations

import io

import numpy as np

_LOAD, _LEVELS = 2.0, 64
_A, _B, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def _slots(h: np.ndarray, fp: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (fp * _STEP) ^ (np.uint64(level + 1) * _A)
        x = (x ^ (x >> _S33)) * _A
        x = (x ^ (x >> _S33)) * _B
        x ^= x >> _S33
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Built from distinct (h, fp) pairs; ``values`` are int64 arrays in the same order."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, fp: np.ndarray, values: np.ndarray):
        self.sizes, self.words, self.fp, self.values = sizes, words, fp, values
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.nbytes = words.nbytes + fp.nbytes + values.nbytes + self.rank.nbytes

    @classmethod
    def build(cls, h: np.ndarray, fp: np.ndarray, values: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.arange(len(h))
        for level in range(_LEVELS):
            if not len(left):
                break
            size = -(-int(_LOAD * len(left) + 1) // 64) * 64
            at = _slots(h[left], fp[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("equal keys cannot be told apart")
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        words = np.packbits(bits, bitorder="little").view("<u8")
        out = cls(np.array(sizes, np.int64), words, np.zeros(len(h), np.uint64), np.zeros((len(values), len(h)), np.int64))
        index = out.positions(h, fp)
        out.fp[index] = fp
        out.values[:, index] = values
        return out

    def positions(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Index of each key; -1 where no level has a bit for it (then it is no key)."""
        found, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            bit = base + _slots(h[left], fp[left], level, size)
            word, inside = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.words[word] >> inside) & np.uint64(1) == 1
            w, i = word[hit], inside[hit]
            below = self.words[w] & ((np.uint64(1) << i) - np.uint64(1))
            found[left[hit]] = self.rank[w] + np.bitwise_count(below)
            left, base = left[~hit], base + size
        return found

    def probe(self, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values of each): fingerprints decide."""
        at = self.positions(h, fp)
        found = at >= 0
        found[found] = self.fp[at[found]] == fp[found]
        return found, self.values[:, np.where(found, at, 0)] if len(self.fp) else np.zeros((len(self.values), len(h)), np.int64)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.sizes, words=self.words, fp=self.fp, values=self.values)
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> PerfectHash:
        with np.load(io.BytesIO(raw)) as z:
            return cls(z["sizes"], z["words"], z["fp"], z["values"])
