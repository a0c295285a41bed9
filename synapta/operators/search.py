"""Full-text search: postings, BM25 in two length modes, phrase, fuzzy, and pattern terms.

Ranking a handful of terms needs no index and no shuffle of documents: every document counts
its query terms in place, the counts are written, one row of corpus statistics is aggregated from
them with partial sums, and the top k come from a bounded heap per task. ``postings`` builds the persistent index for the rest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.functions.text import tokens
from synapta.storage import saved


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) of ``docs`` (doc_id, content)."""
    terms = docs.select("doc_id", F.posexplode(tokens(F.col("content"))).alias("pos", "term"))
    return terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``docs`` without content, with dl (tokens) and tf (count of each query term, in order): texts are split once."""
    count = lambda w, t: F.size(F.filter(w, lambda x: x == t)).cast("long")
    held = F.transform(F.array(tokens(F.col("content"))), lambda w: F.struct(F.size(w).cast("long").alias("dl"), F.array(*[count(w, t) for t in terms]).alias("tf")))
    return docs.withColumn("_held", held[0]).select(*[c for c in docs.columns if c != "content"], "_held.dl", "_held.tf")


def corpus_stats(counted: DataFrame, n_terms: int) -> DataFrame:
    """One row: n, avgdl and df of every query term."""
    df = F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(n_terms)])
    return counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), df.alias("df"))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, length: str = "doc", where: Column | None = None, min_score: float = 0.0, most: float | None = None) -> DataFrame:
    """``docs`` (without content) that hold a term, with score. ``length``: what is normalised by the average document
    length, the document's tokens ("doc") or the term's own count ("tf"). ``where`` restricts the
    hits; statistics stay those of all ``docs``. One pass over the texts writes the counts, which
    statistics and hits both read."""
    counted = saved(term_counts(docs, terms), "counts")
    stats = F.broadcast(corpus_stats(counted, len(terms)))
    hits = counted.filter(F.exists("tf", lambda x: x > 0))
    if where is not None:
        hits = hits.filter(where)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col("tf")[i], F.col("df")[i]
        idf = F.greatest(F.lit(0.0), F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1))
        long = F.col("dl") if length == "doc" else tf
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * long / F.col("avgdl")))).otherwise(0.0)
    out = hits.crossJoin(stats).withColumn("score", score if most is None else F.least(score, F.lit(most)))
    return out.filter(F.col("score") > min_score).drop("tf", "n", "avgdl", "df")


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct terms of a query text, by the tokenizer of the index, in order."""
    return spark.range(1).select(F.array_distinct(tokens(F.lit(query)))).first()[0]


def search(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best documents for a query text (limits as in ``clamp_limit``); none for a text without terms."""
    terms = query_terms(docs.sparkSession, query)
    hits = bm25(docs, terms) if terms else docs.drop("content").withColumns({"dl": F.lit(0).cast("long"), "score": F.lit(0.0)}).filter(F.lit(False))
    return top(hits, clamp_limit(limit))


def clamp_limit(limit: int) -> int:
    """Limits of the native index: 1 to 100."""
    return max(1, min(100, limit))


def top(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best, ties to the smaller id."""
    return hits.orderBy(*(order or (F.desc("score"), F.asc("doc_id")))).limit(k)


#: Orders by name.
ORDERS = {
    "score": lambda: (F.desc("score"), F.asc("doc_id")),
    "timestamp_asc": lambda: (F.asc("ts"), F.asc("doc_id")),
    "timestamp_desc": lambda: (F.desc("ts"), F.asc("doc_id")),
    "doc_id": lambda: (F.asc("doc_id"),),
}


def phrase(docs: DataFrame, phrase_terms: list[str]) -> DataFrame:
    """Documents in which the terms follow one another, with the number of occurrences."""
    marked = F.concat(F.lit(" "), F.array_join(tokens(F.col("content")), "  "), F.lit(" "))
    sought = "(?= " + "  ".join(re.escape(t) for t in phrase_terms) + " )"
    return docs.withColumn("matches", F.regexp_count(marked, F.lit(sought)).cast("long")).filter("matches > 0")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, df, cf) of all documents."""
    terms = docs.select("doc_id", F.explode(tokens(F.col("content"))).alias("term"))
    return terms.groupBy("term", "doc_id").count().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("count").alias("cf"))


def fuzzy_terms(docs: DataFrame, term: str, distance: int = 1, prefix: int = 0, most: int = 50) -> DataFrame:
    """Up to ``most`` terms of the corpus within ``distance`` (0 to 2) that share a prefix."""
    d = max(0, min(2, distance))
    words = vocabulary(docs).filter(F.col("term").startswith(term[:prefix]) & F.length("term").between(len(term) - d, len(term) + d))
    near = words.withColumn("distance", F.levenshtein("term", F.lit(term)).cast("long")).filter(F.col("distance") <= d)
    return near.orderBy("distance", F.desc("df"), "term").limit(most)


def regex_terms(docs: DataFrame, pattern: str) -> DataFrame:
    return vocabulary(docs).filter(F.col("term").rlike(pattern))


def multipart_text(parts: Column) -> Column:
    """Text parts joined by line feeds; other parts are empty."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise("")), "\n")


def without_sessions(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """The index's documents after its sessions were deleted; statistics follow from the result."""
    return docs.join(sessions.select("session_id"), "session_id", "left_anti")
