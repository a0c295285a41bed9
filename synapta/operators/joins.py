"""Joins that Spark has no equality for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synapta.storage import small


def holding(texts: DataFrame, text: str, needles: DataFrame, needle: str, gram: int = 4) -> DataFrame:
    """Rows of ``texts`` with every row of ``needles`` whose ``needle`` their ``text`` holds.

    A few needles go to every task. Many meet the texts by their first characters (as many as the
    shortest needle has, ``gram`` at most), among the distinct character runs of each text. Null and
    empty needles match nothing; columns of both sides must have different names.
    """
    needles = needles.filter(F.length(needle) > 0)
    if small(needles, 1_000):
        return texts.join(F.broadcast(needles), F.contains(F.col(text), F.col(needle)))
    k = needles.agg(F.least(F.min(F.length(needle)), F.lit(gram))).first()[0]
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(F.col(text), i, F.lit(k))))
    cut = texts.filter(F.length(text) >= k).withColumn("_run", F.explode(runs))
    met = cut.join(needles.withColumn("_run", F.substring(needle, 1, k)), "_run")
    return met.filter(F.contains(F.col(text), F.col(needle))).drop("_run")
