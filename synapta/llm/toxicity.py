"""Operator 9: toxicity from the nearest labelled examples.

A bounded sample of labelled documents becomes TF-IDF vectors over words and word beginnings
(insults are inflected), restricted to the terms whose shares differ between the classes (with
an error of one in a thousand). They lie in a block-max inverted index: per term its postings,
and per term and block of examples the largest weight. A document's bound for a block is the sum
of these maxima; blocks are scored from the largest bound down until no bound reaches the k-th
cosine, which makes the k nearest exact. Neighbours vote with the square of their cosine; a
logistic curve fitted on leave-one-out votes of the sample turns the vote and the mass behind it
into a probability. The neighbours are the evidence.

Terms are counted and chosen in Spark, and the votes of the sample are taken on the executors;
the driver gets the chosen terms, the examples' sparse vectors and two numbers an example. The
index (a few MB, bounded by the sample) goes to the executors once; each document is scored on
its own, so neither skew nor copies matter.

Edge cases: null, empty or strange texts match no term and get the calibrated score of an empty
vote; null labels and labels of unknown documents teach nothing; of two labels for a document
the larger holds; equal rows of a labelled document are examples each; with no or one-sided
labels every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synapta.llm.learning import logistic, sample
from synapta.llm.memos import claim
from synapta.llm.shared import save
from synapta.llm.tokens import text_groups

#: Labelled documents that are learnt from, per class, in the order of a hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 1_500, 3_000
#: Examples per block, neighbours.
BLOCK, NEIGHBOURS = 64, 16
#: A term is kept if this many examples hold it and its log-likelihood ratio is this large (an error of 0.001).
LEAST_EXAMPLES, LEAST_GAIN = 3, 10.83
BEGINNINGS = (4, 5, 6, 7)
#: Words of at most so many characters that a worker keeps, and how many.
MEMO_CHARS, MEMO = 64, 300_000
_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    """A word and its beginnings (marked, so that ``lose~`` is no word)."""
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) > n)]


def word_counts(text: str | None) -> Counter:
    claim("terms")  # its own memo goes with the broadcast model
    return Counter(_WORD.findall(text.lower())) if text else Counter()


class BlockMaxIndex:
    """Unit vectors of examples, searched exactly for the largest cosines."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        """``vectors``: term numbers and weights of each example."""
        sizes = [len(t) for t, _ in vectors]
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.blocks = -(-len(vectors) // block)
        self.block, self.size = block, len(vectors)
        self.example = np.repeat(np.arange(len(vectors)), sizes)[order]
        self.weight = (np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0))[order]
        owner = term[order]
        # Entries: runs of one term in one block.
        where = owner * self.blocks + self.example // block
        starts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
        self.entry_start = np.concatenate([starts, [len(where)]])
        self.entry_block = where[starts] % self.blocks if len(where) else starts
        self.entry_most = np.maximum.reduceat(self.weight, starts) if len(where) else np.zeros(0)
        self.term_start = np.searchsorted(where[starts] // self.blocks if len(where) else starts, np.arange(terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest positive cosines (ties: smaller number first)."""
        counts = self.term_start[terms + 1] - self.term_start[terms]
        entries = _ranges(self.term_start[terms], counts)
        if not len(entries):
            return np.zeros(0, np.int64), np.zeros(0)
        query = np.repeat(weights, counts)
        bound = np.bincount(self.entry_block[entries], query * self.entry_most[entries], self.blocks)
        scores = np.zeros(self.size)
        order = np.argsort(-bound, kind="stable")
        done, kth, first = np.zeros(self.blocks, bool), 0.0, max(2, 2 * k // self.block + 1)
        for picked in (order[:first], order[first:]):
            picked = picked[bound[picked] * (1 + 1e-9) >= max(kth, 1e-12)]
            if not len(picked):
                break
            done[:] = False
            done[picked] = True
            take = done[self.entry_block[entries]]
            own = entries[take]
            lengths = self.entry_start[own + 1] - self.entry_start[own]
            at = _ranges(self.entry_start[own], lengths)
            scores += np.bincount(self.example[at], self.weight[at] * np.repeat(query[take], lengths), self.size)
            if without >= 0:
                scores[without] = 0
            kth = np.partition(scores, -k)[-k] if len(scores) >= k else 0.0
        scores = np.round(scores, 12)  # equal vectors tie, whatever the order of their sums
        found = np.flatnonzero(scores >= max(round(float(kth), 12), 1e-12))
        found = found[np.lexsort((found, -scores[found]))][:k]
        return found, scores[found]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of start..start+count."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - ends + counts, counts)


class _Terms(dict):
    """Word to the numbers of its terms; bounded."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        get = self.vocabulary.get
        found = tuple(t for x in terms_of(word) if (t := get(x)) is not None)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


class Model:
    """Terms with their inverse document frequencies, and once they are there the examples' index and the curve.

    ``base``: the share of toxic labels. Without examples of both classes it is the score of every text.
    """

    def __init__(self, base: float, terms: list[str], idf: np.ndarray, neighbours: int = NEIGHBOURS):
        self.base, self.k, self.idf = base, neighbours, idf
        self.vocabulary = {t: i for i, t in enumerate(terms)}
        self.words = _Terms(self.vocabulary)
        self.index = self.curve = None

    def learn(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Takes the examples in."""
        self.ids, self.labels = ids, labels.astype(np.float64)
        self.index = BlockMaxIndex(vectors, len(self.vocabulary))

    def vector(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector: term numbers and weights."""
        counts: dict[int, int] = {}
        get = self.words.__getitem__
        for word, n in words.items():
            for t in get(word):
                counts[t] = counts.get(t, 0) + n
        terms = np.fromiter(counts.keys(), np.int64, len(counts))
        weights = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.idf[terms]
        return terms, weights / (np.linalg.norm(weights) or 1.0)

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> tuple[float, float]:
        """Distance-weighted share of toxic neighbours, drawn to the base rate, and their nearness."""
        w = cosines**2
        return float((w @ self.labels[found] + 0.02 * self.base) / (w.sum() + 0.02)), float(np.tanh(w.sum()))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """Probability of being toxic, and the neighbours (doc_id, cosine, label)."""
        if self.curve is None:
            return self.base, []
        found, cosines = self.index.search(*self.vector(word_counts(text)), self.k)
        z = float(self.curve @ np.array([1.0, *self.vote(found, cosines)]))
        evidence = [(int(self.ids[i]), float(c), int(self.labels[i])) for i, c in zip(found, cosines, strict=True)]
        return float(1 / (1 + np.exp(-z))), evidence

    def __getstate__(self):
        return {**self.__dict__, "words": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words = _Terms(self.vocabulary)


def gain(a: Column, b: Column, n0: int, n1: int) -> Column:
    """Log-likelihood ratio of a term's counts in clean (a of n0) and toxic (b of n1) examples."""
    def part(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.ln(1 - p)).otherwise(0.0)

    clean, toxic, p = F.lit(n0), F.lit(n1), (a + b) / (n0 + n1)
    return 2 * (part(a, clean, a / n0) + part(b, toxic, b / n1) - part(a, clean, p) - part(b, toxic, p))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of ``labels`` (doc_id, toxic)."""
    picked, stands = sample(docs, labels, "toxic", {1: MOST_TOXIC, 0: MOST_CLEAN})

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = word_counts(batch.column("text")[i].as_py())
                terms = {t for w in words for t in terms_of(w)}
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), batch.column("label").slice(i, 1), pa.array([list(words)], pa.list_(pa.string())), pa.array([list(words.values())], pa.list_(pa.int32())), pa.array([list(terms)], pa.list_(pa.string()))],
                    names=["doc_id", "label", "words", "counts", "terms"],
                )

    counted = save(picked.mapInArrow(count, "doc_id long, label int, words array<string>, counts array<int>, terms array<string>"), "toxic-words")
    shares = {r["label"]: r["count"] for r in counted.groupBy("label").count().collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    toxic, clean = n1 * stands[1], n0 * stands[0]
    base = toxic / (toxic + clean) if toxic + clean else 0.0
    if not n0 or not n1:
        return Model(base, [], np.zeros(0))
    df = counted.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("b"))
    kept = df.filter(F.col("a") + F.col("b") >= LEAST_EXAMPLES).filter(gain(F.col("a"), F.col("b"), n0, n1) > LEAST_GAIN)
    kept = kept.select("term", (F.col("a") + F.col("b")).alias("df")).toArrow().sort_by("term")
    model = Model(base, kept["term"].to_pylist(), np.log((1 + n0 + n1) / (1 + kept["df"].to_numpy())) + 1)
    spark = docs.sparkSession
    chosen = spark.sparkContext.broadcast(model)

    def vectors(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = dict(zip(batch.column("words")[i].as_py(), batch.column("counts")[i].as_py(), strict=True))
                terms, weights = chosen.value.vector(words)
                order = np.argsort(terms)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("label").slice(i, 1), pa.array([terms[order].tobytes()], pa.binary()), pa.array([weights[order].tobytes()], pa.binary())], names=["doc_id", "label", "terms", "weights"])

    sparse = save(counted.select("doc_id", "label", "words", "counts").mapInArrow(vectors, "doc_id long, label int, terms binary, weights binary"), "toxic-vectors")
    rows = sparse.toArrow().sort_by([("label", "ascending"), ("doc_id", "ascending"), ("terms", "ascending"), ("weights", "ascending")])
    pairs = [(np.frombuffer(t.as_buffer(), np.int64), np.frombuffer(w.as_buffer())) for t, w in zip(rows["terms"], rows["weights"], strict=True)]
    model.learn(rows["doc_id"].to_numpy(), rows["label"].to_numpy(), pairs)
    chosen.destroy()

    # Leave-one-out votes of the examples, by their places in the index.
    shared = spark.sparkContext.broadcast((model, pairs))

    def votes(batches):
        fitted, examples = shared.value
        for batch in batches:
            ids = batch.column("id").to_pylist()
            found = [fitted.vote(*fitted.index.search(*examples[i], fitted.k, without=i)) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v for v, _ in found], pa.float64()), pa.array([m for _, m in found], pa.float64())], names=["id", "vote", "mass"])

    parts = max(1, min(len(pairs) // 64, spark.sparkContext.defaultParallelism))
    got = spark.range(0, len(pairs), 1, parts).mapInArrow(votes, "id long, vote double, mass double").toArrow().sort_by("id")
    shared.destroy()
    # The sample holds classes in other shares than the labels do: each example counts for the labels it stands for.
    x = np.column_stack([got["vote"].to_numpy(), got["mass"].to_numpy()])
    model.curve = logistic(x, model.labels, counts=np.where(model.labels == 1, stands[1], stands[0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``evidence`` (doc_id, cosine, toxic of the nearest examples); clashing columns are replaced."""
    docs = docs.drop("score", "evidence").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    proof = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("evidence", proof)])
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for a, b in text_groups(batch.column("text"), 8_000_000):
                part = batch.slice(a, b - a)
                got = [fitted.score(t) for t in part.column("text").to_pylist()]
                proofs = [[{"doc_id": d, "cosine": c, "toxic": y} for d, c, y in e] for _, e in got]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s for s, _ in got], pa.float64()), pa.array(proofs, kind)], names=[*part.schema.names, "score", "evidence"])

    return docs.mapInArrow(run, schema)
