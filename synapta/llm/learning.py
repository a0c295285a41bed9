"""What the learnt operators share: a bounded sample of labelled documents, and a logistic curve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synapta.llm.shared import first_ids, free, save


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression with intercept (which the ridge spares), by Newton's method; ``counts``: how many rows each stands for."""
    share = np.ones(len(y)) if counts is None else counts * (len(y) / counts.sum())
    x = np.column_stack([np.ones(len(x)), x])
    w, held = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    held[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (share * (y - p)) - held * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int]) -> tuple[DataFrame, dict[int, float]]:
    """Up to ``most[y]`` documents of each label y, as (doc_id, text, label), and how many labels each stands for."""
    known = save(labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label")), "labels")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    stands = {y: max(1.0, totals.get(y, 0) / n) for y, n in most.items()}
    rows = [(i, y) for y, n in most.items() for i in first_ids(known.filter(F.col("label") == y).select(F.col("doc_id").cast("long").alias("id")), n)]
    free(known)
    few = docs.sparkSession.createDataFrame(rows, "doc_id long, label int")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id"), stands
