"""Evaluation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, and the values at places floor(n/2) and floor(.95 n) of the sorted list, per group."""
    w = Window.partitionBy(by)
    ranked = rows.select(by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.floor(F.col("n") * q), F.col(value)))
    return ranked.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def dataset(messages: DataFrame) -> DataFrame:
    n, s = F.count(F.lit(1)), F.count_distinct("session_id")
    return messages.groupBy("role").agg(n.alias("turns"), s.alias("sessions"), F.round(n / s, 6).alias("mean"))
