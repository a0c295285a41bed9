"""Operator 4: approximate nearest neighbours by multi-index hashing of learnt binary codes.

Rotations are learnt on a bounded sample (iterative quantization: alternate the signs of the
rotated vectors and the orthogonal matrix that comes closest to them) and turn each vector into
a code, split into substrings of ``PIECE`` bits. Each shard indexes every substring of its codes.
A query probes each index with all values within t bits of its own substring. Codes within
Hamming distance m (t + 1) - 1 agree with it that well in one of the m substrings (pigeonhole),
so probing retrieves all of them, and some beyond. All that is retrieved is reranked by the exact
cosine of the original vectors: nothing retrieved is thrown away for its Hamming distance, which
says less than the cosine does.

t and m are fitted: of all t, with the fewest substrings that retrieve ``COVER`` of the sample's
true neighbours, the pair that probes least. True neighbours among all rows are nearer than those
among the sample, so a larger table is searched better, and more narrowly. A query that finds
fewer than k rows in a shard probes one bit further there, so k results are returned whenever
there are k.

Edge cases: null, zero and non-finite vectors, null vec_id, and vectors of another length than
most of the table take no part; rows with the query's own vec_id are no candidates; equal rows
are candidates each, equal vectors have equal scores, ties go to the smaller vec_id; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synapta.llm import vectors as V

#: Bits of a substring, substrings of a code at most, rounds of quantization, and the share of the sample's neighbours to retrieve.
PIECE, MOST_PIECES = 16, 96
ROUNDS, COVER = 8, 0.975
#: Sampled vectors whose neighbours the fit looks at; vectors that are encoded at a time.
FITTED, ENCODED = 512, 4_096


def learn_rotations(sample: np.ndarray, bits: int = PIECE * MOST_PIECES) -> np.ndarray:
    """A matrix (d, bits) whose product's signs are the code."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    d = unit.shape[1]
    values, axes = np.linalg.eigh(unit.T @ unit)
    axes = axes[:, np.argsort(-values, kind="stable")[: min(d, bits)]]
    x, rng, parts = unit @ axes, np.random.default_rng(7), []
    while sum(p.shape[1] for p in parts) < bits:
        r, _ = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ w).T
        parts.append(axes @ r)
    return np.concatenate(parts, 1)[:, :bits]


def encode(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    parts = [np.packbits(vectors[a : a + ENCODED] @ rotations >= 0, axis=1, bitorder="little").view("<u2") for a in range(0, len(vectors), ENCODED)]
    return np.concatenate(parts) if parts else np.zeros((0, rotations.shape[1] // PIECE), "<u2")


def cosines(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """In double precision, summed the same way for every row, so equal vectors score equally."""
    return (vectors * q).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((q * q).sum()))


def ball(t: int) -> np.ndarray:
    """All 16-bit values with at most t bits."""
    return np.array([sum(1 << b for b in c) for n in range(t + 1) for c in combinations(range(PIECE), n)], np.uint16)


def fit_probing(sample: np.ndarray, rotations: np.ndarray, k: int) -> tuple[int, int]:
    """(m, t): substrings, and bits that a probe may differ in, that retrieve ``COVER`` of the sample's k nearest neighbours with the least work."""
    pieces = rotations.shape[1] // PIECE
    if len(sample) <= k + 1:
        return 1, PIECE
    codes, unit = encode(sample, rotations), sample / np.linalg.norm(sample, axis=1, keepdims=True)
    distances = []
    for i in range(min(len(sample), FITTED)):
        near = unit @ unit[i]
        near[i] = -2
        top = np.argpartition(-near, k)[:k]
        distances.append(np.bitwise_count(codes[top] ^ codes[i]))
    least = np.minimum.accumulate(np.concatenate(distances), axis=1)  # of the first m substrings
    best = (1, PIECE)
    for t in range(PIECE):
        enough = np.flatnonzero((least <= t).mean(0) >= COVER)
        if len(enough) and (m := int(enough[0]) + 1) * len(ball(t)) < best[0] * len(ball(best[1])):
            best = (m, t)
    return min(best[0], pieces), best[1]


class MultiIndex:
    """Codes of a shard, with a directory of each of their substrings."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.pieces = codes, codes.shape[1]
        self.order = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(self.pieces)]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << PIECE))]).astype(np.int32) for j in range(self.pieces)]
        self.balls: dict[int, np.ndarray] = {}
        self.seen = np.zeros(len(codes), bool)

    def probe(self, q: np.ndarray, t: int) -> np.ndarray:
        """Places of all codes that agree with code q in a substring but for t bits; among them all within distance pieces * (t + 1) - 1."""
        if t not in self.balls:
            self.balls[t] = ball(t).astype(np.int64)
        self.seen[:] = False
        for j in range(self.pieces):
            near = self.balls[t] ^ int(q[j])
            a, n = self.starts[j][near], self.starts[j][near + 1]
            held = n > a
            a, n = a[held], (n - a)[held]
            if len(a):
                ends = np.cumsum(n)
                self.seen[self.order[j][np.arange(ends[-1]) + np.repeat(a - ends + n, n)]] = True
        return np.flatnonzero(self.seen)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vec_id divisible by ``every`` the k nearest rows found, by cosine.

    ``probed``, of each row, is how many codes its query retrieved in the shard where the row was found, and ``held`` how many that shard holds.
    """
    usable = V.valid(vectors, zero=False)
    d, n = V.usual_length(usable)
    _, sample = V.fitted_sample(usable, d, n)
    rotations = learn_rotations(sample) if len(sample) else np.zeros((d, PIECE * MOST_PIECES))
    pieces, t = fit_probing(sample, rotations, k)
    rotations = rotations[:, : pieces * PIECE].copy()
    blocks = V.write_queries(usable, every, d)

    def index(ids: np.ndarray, v: np.ndarray):
        codes = MultiIndex(encode(v, rotations))

        def ask(own: np.ndarray, q: np.ndarray, _):
            out_q, out_v, out_s, out_n = [], [], [], []
            for query, x, code in zip(own.tolist(), q, encode(q, rotations), strict=True):
                for wide in range(t, PIECE + 1):
                    at = codes.probe(code, wide)
                    probed = len(at)
                    at = at[ids[at] != query]
                    if len(at) >= k:
                        break
                scores = cosines(x, v[at])
                top = V.first(scores, ids[at], k)
                out_q.append(np.full(len(top), query))
                out_v.append(ids[at[top]])
                out_s.append(scores[top])
                out_n.append(np.full(len(top), probed))
            return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s), np.concatenate(out_n), np.full(sum(map(len, out_q)), len(ids))

        return ask

    found = V.search(usable, d, blocks, index, "double", ("probed", "held"))
    return V.best(found, k, F.desc("score"), F.asc("vec_id"))
