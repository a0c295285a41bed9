"""Operator 10: document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score comes from binned features of the line and of the lines
before and after it; transitions tie neighbours. The field is trained on a bounded sample of
labelled documents whose lines take the document's label; of a document with more than
``SAMPLE_LINES`` lines the sample holds a stretch of so many, at a place that a hash of its
doc_id chooses. Forward-backward gives each line's marginal probability of being good. The means
of these marginals and of their log odds (which are clipped, and tell apart what a mean near 0 or
1 no longer does), both weighted by line length, and a logistic curve make the document's score.
Documents are scored whole and on their own, many at a time.

Edge cases: null text counts as empty, and an empty text is one empty line; null labels and
labels of unknown documents teach nothing; of two labels for a document the larger holds; with
no or one-sided labels every score is the share of good labels, or 1; clashing columns are
replaced.
"""

from __future__ import annotations

from operator import eq, ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synapta.llm.learning import logistic, sample
from synapta.llm.tokens import text_groups

#: Labelled documents that are learnt from, per class, in the order of a hash of doc_id, and lines of each at most.
MOST_EACH, SAMPLE_LINES = 2_000, 128
BINS, STEPS = 8, 120
#: Typographic marks that running text seldom repeats.
MARKS = "|!#$%&*<>{}[]=_~^/\\@+"
FEATURES = ("length", "words", "upper", "marks", "distinct", "repeated", "word_length", "short", "digits", "seen", "end", "longest")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``FEATURES`` per line, and the lines' lengths (at least 1)."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        n, words = len(line), line.split()
        m, lower = len(words) or 1, line.lower()
        lengths = list(map(len, words))
        rows.append((
            np.log1p(n),
            np.log1p(len(words)),
            sum(map(ne, line, lower)) / (n or 1),
            sum(map(line.count, MARKS)) / m,
            len(set(words)) / m,
            sum(map(eq, words, words[1:])) / m,
            sum(lengths) / m,
            sum(x <= 3 for x in lengths) / m,
            sum(map(line.count, "0123456789")) / (n or 1),
            float(line in seen),
            float(line[-1:] in ".?!:;"),
            max(lengths, default=0),
        ))
        seen.add(line)
        sizes.append(max(1, n))
    return np.array(rows, np.float64), np.array(sizes, np.float64)


class Chains:
    """Forward-backward over many documents at once; ``lengths`` are their line counts."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        self.lengths = lengths[self.order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), "left")  # chains longer than t
        self.last = self.starts + self.lengths - 1

    def marginals(self, e: np.ndarray, trans: np.ndarray, pairs: bool = False):
        """Per line P(good) and its log odds, log Z summed, and (if asked for) expected counts of transitions."""
        alpha, beta = np.zeros((len(e), 2)), np.zeros((len(e), 2))
        own = np.stack([np.zeros(len(e)), e], 1)
        for t, k in enumerate(self.active):
            at = self.starts[:k] + t
            alpha[at] = own[at] + (np.logaddexp(alpha[at - 1, :1] + trans[0], alpha[at - 1, 1:] + trans[1]) if t else 0)
        for t in range(len(self.active) - 2, -1, -1):
            at = self.starts[: self.active[t + 1]] + t
            after = beta[at + 1] + own[at + 1]
            beta[at] = np.logaddexp(trans[:, 0] + after[:, :1], trans[:, 1] + after[:, 1:])
        both = alpha + beta
        z = np.logaddexp(both[:, 0], both[:, 1])
        p = np.exp(both[:, 1] - z)
        counts = np.zeros((2, 2))
        if pairs:
            first = np.zeros(len(e), bool)
            first[self.starts] = True
            b = np.flatnonzero(~first)
            for i in (0, 1):
                for j in (0, 1):
                    counts[i, j] = np.exp(alpha[b - 1, i] + trans[i, j] + own[b, j] + beta[b, j] - z[b]).sum()
        return p, both[:, 1] - both[:, 0], float(z[self.last].sum()), counts


class Model:
    """Fitted on (features, sizes, label) of documents; one of label y stands for ``stands[y]`` labels."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray, int]], stands: dict[int, float] | None = None):
        labels = np.array([y for _, _, y in examples], np.float64)
        stands = stands or {0: 1.0, 1: 1.0}
        rows = np.where(labels == 1, stands[1], stands[0])
        self.base = float(labels @ rows / rows.sum()) if len(labels) else 1.0
        self.fitted = 0 < self.base < 1
        if not self.fitted:
            return
        x = np.concatenate([f for f, _, _ in examples])
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        lengths = np.array([len(f) for f, _, _ in examples])
        bins, chains, y = self.bins(x, lengths), Chains(lengths), np.repeat(labels, lengths)
        # Every document counts alike, however many lines it has.
        share = np.repeat(1 / np.sqrt(lengths), lengths)
        self.weights = np.zeros(int(bins.max()) + 1 + BINS)
        self.trans = np.zeros((2, 2))
        mean, square = np.zeros(len(self.weights) + 4), np.zeros(len(self.weights) + 4)
        within = np.ones(len(x), bool)
        within[np.cumsum(lengths) - lengths] = False
        seen = np.array([[np.sum(within & (y == 0)), 0], [0, np.sum(within & (y == 1))]], np.float64)
        for step in range(1, STEPS + 1):  # Adam on the penalized likelihood
            p, _, _, counts = chains.marginals(self.emissions(bins), self.trans, pairs=True)
            miss = (y - p) * share
            g = sum(np.bincount(b, miss, len(self.weights)) for b in bins.T) / len(examples) - 1e-3 * self.weights
            g = np.concatenate([g, ((seen - counts) / len(x) - 1e-2 * self.trans).ravel()])
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            self.weights += move[:-4]
            self.trans += move[-4:].reshape(2, 2)
        self.curve = logistic(self.document(self.emissions(bins), lengths, np.concatenate([s for _, s, _ in examples])), labels, counts=rows)

    def bins(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of the active weights of each line: its own bins, and those of its neighbours in the document."""
        f, width = x.shape[1], BINS + 1
        own = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)
        ends = np.cumsum(lengths)
        before, after = np.full_like(own, BINS), np.full_like(own, BINS)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[ends - lengths], after[ends - 1] = BINS, BINS
        place = np.arange(f) * width
        return np.concatenate([own + place, before + place + f * width, after + place + 2 * f * width], 1).astype(np.int16)

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        return sum(self.weights[b] for b in bins.T)

    def document(self, e: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Length-weighted means of the lines' marginals and of their log odds."""
        p, odds, _, _ = Chains(lengths).marginals(e, self.trans)
        starts = np.cumsum(lengths) - lengths
        total = np.add.reduceat(sizes, starts)
        mean = lambda v: np.add.reduceat(v * sizes, starts) / total
        return np.stack([mean(p), mean(np.clip(odds, -20, 20)) / 4], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.base)
        parts = [line_features(t) for t in texts]
        lengths = np.array([len(f) for f, _ in parts])
        e = self.emissions(self.bins(np.concatenate([f for f, _ in parts]), lengths))
        d = self.document(e, lengths, np.concatenate([s for _, s in parts]))
        return 1 / (1 + np.exp(-(np.column_stack([np.ones(len(d)), d]) @ self.curve)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of ``labels`` (doc_id, quality)."""

    def features(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc = batch.column("doc_id")[i].as_py()
                f, s = line_features(batch.column("text")[i].as_py())
                at = xxhash.xxh3_64_intdigest(str(doc)) % (len(f) - SAMPLE_LINES + 1) if len(f) > SAMPLE_LINES else 0
                f, s = f[at : at + SAMPLE_LINES], s[at : at + SAMPLE_LINES]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("label").slice(i, 1), pa.array([f.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["doc_id", "label", "f", "s"])

    picked, stands = sample(docs, labels, "quality", {0: MOST_EACH, 1: MOST_EACH})
    rows = picked.mapInArrow(features, "doc_id long, label int, f binary, s binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["f"])))
    return Model([(np.frombuffer(r["f"]).reshape(-1, len(FEATURES)), np.frombuffer(r["s"]), r["label"]) for r in rows], stands)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of good quality."""
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches):
        for batch in batches:
            for a, b in text_groups(batch.column("text"), 2_000_000):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column("text").to_pylist()))], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("score", T.DoubleType())]))
