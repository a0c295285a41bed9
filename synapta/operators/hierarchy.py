"""Hierarchical retrieval: a summary and key turns per session, and a context by the kind of question under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Word boundaries of every script.
START, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# What marks a fact, a key turn and a name; shares of the budget for summaries, key turns and facts.
FACT = START + (
    r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|May|June|July|August|September|October|November|December"
    r"|on\s+(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)|last\s+(week|month|year)|in\s+\d{4})"
) + END
KEY = START + r"(?i)(when|date|time|year|month|day)" + END
NAME = START + r"[A-Z][a-z]+\s+[A-Z][a-z]+" + END + "|" + START + "[A-Z][a-z]+" + END
SUMMARIES, KEY_TURNS, FACTS = 0.3, 0.4, 0.2
FACT_CHARS, SUMMARY_FACTS, MOST_FACTS, MOST_NAMES, MOST_TURNS, TURNS_USED = 200, 3, 5, 10, 5, 2


def summaries(turns: DataFrame) -> DataFrame:
    """Per session of ``turns`` (conversation_id, session_id, seq, content): summary, facts, names and key turns.

    Facts are the beginnings of turns with a mark of time, the first five; a summary joins three of
    them. Names are the first ten distinct ones. Key turns are the first and the last turn (a single
    turn is both) and those between with a word of time, five in all. Null texts count as empty.
    """
    text = F.coalesce("content", F.lit(""))
    place = Window.partitionBy("session_id").orderBy("seq")
    size = Window.partitionBy("session_id")
    t = turns.select("conversation_id", "session_id", "seq", text.alias("text"), F.row_number().over(place).alias("i"), F.count(F.lit(1)).over(size).alias("n"))
    # Only the turns that may be kept travel on; the key turn that is last comes second, as in the order of choice.
    fact = F.when(F.col("text").rlike(FACT), F.struct("i", F.substring("text", 1, FACT_CHARS).alias("v")))
    middle = (F.col("i") > 1) & (F.col("i") < F.col("n")) & F.col("text").rlike(KEY)
    key = F.when(F.col("i") == 1, F.struct(F.lit(0).alias("i"), F.col("text").alias("v"))).when(middle, F.struct("i", F.col("text").alias("v")))
    last = F.when(F.col("i") == F.col("n"), F.struct(F.lit(1).alias("i"), F.col("text").alias("v")))
    names = F.struct("i", F.regexp_extract_all("text", F.lit(NAME), F.lit(0)).alias("v"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    s = t.groupBy("conversation_id", "session_id").agg(
        listed(fact).alias("facts"), F.transform(F.array_sort(F.concat(F.collect_list(key), F.collect_list(last))), lambda x: x["v"]).alias("keys"),
        F.slice(F.array_distinct(F.flatten(listed(names))), 1, MOST_NAMES).alias("names"),
    )
    summary = F.concat(F.lit("Session "), F.col("session_id").cast("string"), F.lit(": "), F.array_join(F.slice("facts", 1, SUMMARY_FACTS), "; "))
    return s.select("conversation_id", "session_id", summary.alias("summary"), F.slice("facts", 1, MOST_FACTS).alias("facts"), "names", F.slice("keys", 1, MOST_TURNS).alias("keys"))


def contexts(sessions: DataFrame, questions: DataFrame, budget: int = 2048) -> DataFrame:
    """Per question (question_id, conversation_id, category): tokens and context from the sessions' ``summaries``.

    Single-hop questions (1) take the first key turns, multi-hop ones (2) summaries, temporal ones (3)
    summaries and then facts, all others summaries under the whole budget: in the order of the sessions,
    each part that keeps the tokens so far (a quarter of the characters) below its share. An ordered fold
    over a conversation's parts in the JVM.
    """
    part = lambda stage, share: lambda v: F.struct(F.lit(stage).alias("stage"), F.lit(budget * share).alias("cap"), v.alias("v"))
    one = lambda share: F.array(part(0, share)(F.col("summary")))
    chosen = (
        F.when(F.col("category") == 1, F.transform(F.slice("keys", 1, TURNS_USED), part(0, KEY_TURNS)))
        .when(F.col("category") == 2, one(SUMMARIES)).when(F.col("category") == 3, F.concat(one(SUMMARIES), F.transform("facts", part(1, FACTS))))
        .otherwise(one(1.0))
    )
    parts = questions.join(sessions, "conversation_id").select("question_id", "session_id", F.posexplode(chosen).alias("pos", "p"))
    order = F.array_sort(F.collect_list(F.struct("p.stage", "session_id", "pos", "p.cap", "p.v")))
    start = F.struct(F.lit(0).cast("long").alias("tokens"), F.array().cast("array<string>").alias("parts"))

    def step(acc, x):
        n = F.floor(F.length(x["v"]) / 4)
        fits = acc["tokens"] + n < x["cap"]
        return F.struct(F.when(fits, acc["tokens"] + n).otherwise(acc["tokens"]).alias("tokens"), F.when(fits, F.concat(acc["parts"], F.array(x["v"]))).otherwise(acc["parts"]).alias("parts"))

    folded = parts.groupBy("question_id").agg(F.aggregate(order, start, step).alias("f"))
    return folded.select("question_id", "f.tokens", F.array_join("f.parts", "\n").alias("context"))
