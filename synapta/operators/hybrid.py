"""Rank fusion and query routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.storage import saved


def with_rank(hits: DataFrame, most: int) -> DataFrame:
    """The ``most`` best hits (a bounded heap per task) with their rank from 1, written once: fusion reads a list several times."""
    best = hits.orderBy(F.desc("score"), F.asc("doc_id")).limit(most)
    return saved(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("doc_id")))), "ranked")


def _sides(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    k = keyword.select("doc_id", F.col("rank").alias("k_rank"), F.col("score").alias("k_score"))
    s = semantic.select("doc_id", F.col("rank").alias("s_rank"), F.col("score").alias("s_score"))
    both = k.join(s, "doc_id", "full_outer")
    side = F.when(F.col("k_rank").isNotNull() & F.col("s_rank").isNotNull(), "both").when(F.col("k_rank").isNotNull(), "keyword").otherwise("semantic")
    return both.withColumn("source", side)


def rrf(keyword: DataFrame, semantic: DataFrame, k: int = 60, w_keyword: float = 0.5, w_semantic: float = 0.5) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (doc_id, rank, score)."""
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    return _sides(keyword, semantic).select("doc_id", "source", (part(w_keyword, "k_rank") + part(w_semantic, "s_rank")).alias("score"))


def weighted(keyword: DataFrame, semantic: DataFrame, w_keyword: float = 0.5, w_semantic: float = 0.5) -> DataFrame:
    """Sum of scores, each divided by its list's best (0.001 at least)."""
    def normal(hits):
        return hits.crossJoin(F.broadcast(hits.agg(F.greatest(F.max("score"), F.lit(0.001)).alias("_best")))).withColumn("score", F.col("score") / F.col("_best")).drop("_best")

    both = _sides(normal(keyword), normal(semantic))
    score = w_keyword * F.coalesce("k_score", F.lit(0.0)) + w_semantic * F.coalesce("s_score", F.lit(0.0))
    return both.select("doc_id", "source", score.alias("score"))


def interleave(keyword: DataFrame, semantic: DataFrame, most: int) -> DataFrame:
    """Lists in turn, keyword first, cut at ``most`` before repeated ids go."""
    both = keyword.select("doc_id", "rank", F.lit(0).alias("side"), "score").unionByName(semantic.select("doc_id", "rank", F.lit(1).alias("side"), "score"))
    cut = both.orderBy("rank", "side").limit(most)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "side"))
    return cut.withColumn("_n", first).filter("_n = 1").drop("_n")


def route(query: Column, automatic: bool = True) -> Column:
    """keyword, semantic or hybrid for a query text."""
    if not automatic:
        return F.lit("hybrid")
    n = F.size(F.filter(F.split(query, r"\s+"), lambda x: x != ""))
    exact = query.contains("exact") | query.contains("quote") | query.contains('"')
    return F.when(exact, "keyword").when(n < 3, "keyword").when(n > 5, "semantic").otherwise("hybrid")


def explain(query: Column, strategy: Column) -> Column:
    """Why a strategy is recommended for a query."""
    n = F.size(F.filter(F.split(query, r"\s+"), lambda x: x != ""))
    exact = query.contains("exact") | query.contains("quote") | query.contains('"')
    line = lambda head, tail: F.concat(F.lit(f"{head} ("), n, F.lit(f" words){tail}"))
    return (
        F.when((strategy == "keyword") & exact, line("Keyword search recommended: query contains exact-match indicators", ""))
        .when(strategy == "keyword", line("Keyword search recommended: short query", " benefits from exact matching"))
        .when(strategy == "semantic", line("Semantic search recommended: natural language query", " benefits from conceptual matching"))
        .otherwise(line("Hybrid search recommended: balanced query", " benefits from both exact and conceptual matching"))
    )


# Words that mark a temporal or a relational question.
TEMPORAL_WORDS = ("when", "what time", "what year", "what month", "date", "how long", "how many years")
RELATION_WORDS = ("friend", "colleague", "manager", "sibling", "parent", "child", "who")


def route_question(question: Column, category: Column) -> Column:
    from synapta.functions.text import has_any

    return (
        F.when(has_any(question, TEMPORAL_WORDS), "temporal").when(has_any(question, RELATION_WORDS), "multihop")
        .when(category == 3, "temporal").when(category == 2, "multihop").otherwise("standard")
    )


# Keyword and vector weights by question category, 1 to 5.
CATEGORY_WEIGHTS = {1: (0.7, 0.3), 2: (0.5, 0.5), 3: (0.4, 0.6), 4: (0.3, 0.7), 5: (0.5, 0.5)}


def overlap_score(query_words: Column, text_words: Column) -> Column:
    return F.size(F.array_intersect(query_words, text_words)) / (F.size(query_words) + 1)


def chunks(text: Column, size: int = 512, step: int = 384, least: int = 100) -> Column:
    """Overlapping character windows as structs (start, chunk); those of at most ``least`` characters go."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda s: F.struct(s.cast("long").alias("start"), F.substr(text, s + 1, F.lit(size)).alias("chunk")))
    return F.filter(cut, lambda c: F.length(c["chunk"]) > least)


def pages(turns: DataFrame, budget: int = 512, overlap: int = 50) -> DataFrame:
    """Greedy pages of a session's turns (session_id, seq, content): at most ``budget`` estimated tokens, the
    tail of a page of at most ``overlap`` tokens carried to the next. An ordered fold, so one session per group."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out, page, used = [], [], 0
        for text in pdf["content"].fillna(""):
            n = len(text) // 4
            if page and used + n > budget:
                out.append(page)
                kept, carried = [], 0
                for t in reversed(page):
                    if carried + len(t) // 4 > overlap:
                        break
                    kept.insert(0, t)
                    carried += len(t) // 4
                page, used = kept, carried
            page.append(text)
            used += n
        if page:
            out.append(page)
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "page": range(len(out)), "pages": len(out), "content": ["\n".join(p) for p in out]})

    return turns.groupBy("session_id").applyInPandas(fold, "session_id long, page long, pages long, content string")
