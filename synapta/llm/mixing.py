"""Operator 7: mix sources to target weights by weighted fair queueing. DataFrame functions only.

Sources sorted by code point (null last) weigh ``weights`` in turn and share the budget, all
words; no target exceeds ``epochs`` times its source, the excess going to the others by weight
(water filling). Every document of every epoch has a virtual finish time: the words of its
source up to and with it, in a pseudo-random order, divided by the source's target. The mix
takes documents by finish time until the next one would exceed the budget; what would begin
when its source has reached its target does not queue, so no source is off by more than a document.

All running totals come from a range exchange (``shared.running_total``), never from a window
over a source, so a source with a third of all rows is spread like any other. What finishes by
time 1 fits in the budget by construction; only later documents are sorted to find the cut,
and of the result one row, the last one taken, goes to the driver.

Edge cases: null text has size 0; equal rows are separate documents, told apart by a number that
is written beside them, so a row that is repeated very often is spread as well; a null ``doc_id``
is ordered as the text ``null``; sources of size 0 have target 0; empty tables give empty tables;
other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.llm.shared import bounded, running_total, save

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def schedule(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies (times the mix takes it), taken (copies * size)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(0).cast("long").alias("look"), F.monotonically_increasing_id().alias("row"))
    return _schedule(save(sized, "mix-sizes"), weights, epochs).drop("row")


def _schedule(sized: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """The same with ``row``, of a saved table (doc_id, source, size, look, row); rows of a document come by look and row."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running_total(sources, [F.col("source").isNull(), F.col("source")], ["one", "source_size"], "mix-sources")
    turn = F.pmod(F.col("before_one"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1)
    ranked = ranked.select("source", "source_size", F.col("before_source_size").alias("start"), F.col("before_one").alias("rank"), weight.alias("weight"))
    budget, weight_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = F.lit(budget or 0).cast("long")

    # Water level: sources in the order in which a rising level reaches their ceiling.
    reach = F.col("source_size").cast("double") / F.col("weight")
    filled = running_total(ranked, [reach, F.col("rank")], ["source_size", "weight"], "mix-levels")
    at = (budget - epochs * F.col("before_source_size")).cast("double") / (F.lit(weight_sum or 1) - F.col("before_weight"))
    afloat = filled.withColumn("level", at).filter(F.col("weight") * F.col("level") <= epochs * F.col("source_size"))
    found = afloat.orderBy(reach, "rank").select("level").first()
    target = F.least(F.lit(float(epochs)) * F.col("source_size"), F.col("weight") * F.lit(found["level"] if found else 0.0))
    targets = ranked.select("source", "source_size", "start", target.alias("target"))

    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    placed = running_total(sized.withColumn("key", key), [F.col("source").isNull(), F.col("source"), F.col("key"), F.col("size"), F.col("look"), F.col("row")], ["size"], "mix-order")
    joined = placed.alias("d").join(bounded(save(targets, "mix-targets")).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    within = F.col("before_size") - F.col("start") + F.col("size")
    times = [
        F.when(F.col("target") > 0, (e * F.col("source_size") + within).cast("double") / F.col("target")).otherwise(0.0).alias(f"time{e}")
        for e in range(epochs)
    ]
    timed = save(joined.select("d.doc_id", "d.source", "row", "size", "source_size", "target", "key", (within - F.col("size")).alias("begin"), *times), "mix-times")

    # All that finishes by time 1 fits: it is at most the sum of the targets. The rest is sorted to find the cut.
    in_time = sum((F.when(F.col(f"time{e}") <= 1, F.col("size")).otherwise(0) for e in range(epochs)), F.lit(0))
    left = budget - F.lit(timed.agg(F.sum(in_time)).first()[0] or 0)
    late = timed.select("size", "key", "row", "begin", "source_size", "target", F.posexplode(F.array(*[f"time{e}" for e in range(epochs)])).alias("epoch", "time"))
    late = late.filter("time > 1 and epoch * source_size + begin < target").select("size", "key", "row", "epoch", "time")
    late = running_total(late, [F.col("time"), F.col("key"), F.col("epoch"), F.col("size"), F.col("row")], ["size"], "mix-cut")
    last = late.filter(F.col("before_size") + F.col("size") <= left).orderBy(F.desc("time"), F.desc("key"), F.desc("epoch")).first()
    copies = F.lit(0)
    for e in range(epochs):
        time = F.col(f"time{e}")
        taken = time <= 1
        if last:
            tied = (F.col("key") < last["key"]) | ((F.col("key") == last["key"]) & F.lit(e <= last["epoch"]))
            begins = e * F.col("source_size") + F.col("begin") < F.col("target")
            taken = taken | (begins & ((time < last["time"]) | ((time == last["time"]) & tied)))
        copies = copies + F.when(taken, 1).otherwise(0)
    return timed.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the schedule takes it, with unchanged columns.

    The rows are written once with a number each; the schedule sees their sizes alone, and its
    copies meet the texts again by that number.
    """
    held = save(docs.select(F.struct("*").alias("held"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    text = F.col("held.text")
    sized = held.select("held.doc_id", "held.source", word_count(text).alias("size"), F.xxhash64(text).alias("look"), "row")
    plan = _schedule(save(sized, "mix-sizes"), weights, epochs).filter("copies > 0").select("row", "copies")
    taken = held.join(plan, "row").select("held", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("held.*")
