"""Operator 5: exact top-k by integer inner product, with a KD-tree per shard.

Every component x becomes floor(1024 x). Each shard builds a KD-tree by median splits of the
widest dimension; every node keeps the tight box of its points. The largest product that a box
can reach is, per dimension, the larger of the products with its two sides. Nodes are visited
best bound first until no bound reaches the k-th score. That threshold does not start empty:
each query brings its k-th score among the rows of a bounded sample that have another vec_id, a
number that the final k-th score reaches at least, so shards return only rows that may be results.

Edge cases: null and non-finite vectors, null vec_id, and vectors of another length than most of
the table take no part (zero vectors do); rows with the query's own vec_id are no candidates;
ties go to the smaller vec_id; products too large for doubles are computed in whole numbers,
and scores beyond a long are set to its end; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synapta.llm import vectors as V

LEAF, SCALE = 128, 1024.0
_EXACT, _LONG = 2.0**53, (1 << 63) - 1


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of q with the rows of v (whole numbers held as doubles)."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * len(q) < _EXACT:
        return (v @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in v]
    return np.array([max(-_LONG - 1, min(_LONG, x)) for x in exact], np.int64)


class KDTree:
    """Median splits; ``order`` lists the points leaf by leaf."""

    def __init__(self, v: np.ndarray, leaf: int = LEAF):
        self.v, self.order = v, np.arange(len(v))
        self.low, self.high, self.span, self.child = [], [], [], []
        self._build(0, len(v), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, a: int, b: int, leaf: int) -> int:
        rows = self.order[a:b]
        low, high = self.v[rows].min(0), self.v[rows].max(0)
        node = len(self.span)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, b))
        self.child.append(None)
        widest = int(np.argmax(high - low))
        if b - a > leaf and high[widest] > low[widest]:
            middle = (b - a) // 2
            self.order[a:b] = rows[np.argpartition(self.v[rows, widest], middle)]
            self.child[node] = (self._build(a, a + middle, leaf), self._build(a + middle, b, leaf))
        return node

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, reached: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best points but ``own`` that score ``reached`` at least."""
        bounds = np.maximum(self.low * q, self.high * q).sum(1)
        if bounds[0] >= _EXACT:
            bounds = bounds * (1 + 1e-9) + 1  # rounded sums
        queue, kth = [(-bounds[0], 0)], reached
        top_ids, top_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while queue and -queue[0][0] >= kth:
            _, node = heapq.heappop(queue)
            if self.child[node]:
                for c in self.child[node]:
                    if bounds[c] >= kth:
                        heapq.heappush(queue, (-bounds[c], c))
                continue
            a, b = self.span[node]
            rows = self.order[a:b]
            scores = products(q, self.v[rows])
            take = (scores >= kth) & (ids[rows] != own)
            if take.any():
                top_ids, top_scores = np.concatenate([top_ids, ids[rows[take]]]), np.concatenate([top_scores, scores[take]])
                at = np.lexsort((top_ids, -top_scores))[:k]
                top_ids, top_scores = top_ids[at], top_scores[at]
                if len(at) == k:
                    kth = max(kth, int(top_scores[-1]))
        return top_ids, top_scores


def top_products(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vec_id divisible by ``every`` the k rows of the largest product."""
    usable = V.valid(vectors, zero=True)
    d, n = V.usual_length(usable)
    sample_ids, sample = V.fitted_sample(usable, d, n)
    sample = np.floor(sample * SCALE)

    def reached(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        # Rows with the query's own id are no candidates, so they must not raise its k-th score.
        out = np.full(len(q), -_LONG - 1, np.int64)
        for i, (own, x) in enumerate(zip(ids, np.floor(q * SCALE), strict=True)):
            scores = products(x, sample)[sample_ids != own]
            if len(scores) >= k:
                out[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
        return out

    blocks = V.write_queries(usable, every, d, reached)

    def index(ids: np.ndarray, v: np.ndarray):
        tree = KDTree(np.floor(v * SCALE))

        def ask(own: np.ndarray, q: np.ndarray, bounds: np.ndarray):
            found = [tree.search(x, ids, o, k, b) for o, x, b in zip(own.tolist(), np.floor(q * SCALE), bounds.tolist(), strict=True)]
            counts = [len(f) for f, _ in found]
            return np.repeat(own, counts), np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])

        return ask

    found = V.search(usable, d, blocks, index, "long")
    return V.best(found, k, F.desc("score"), F.asc("vec_id"))
