"""Versioned history: content-addressed objects, commits, refs, merges, logs, worktrees, skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.operators.joins import holding
from synapta.storage import free, saved


def put(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Objects (kind, payload) by the hash of their payload; each is stored once."""
    fresh = new.withColumn("oid", F.sha2("payload", 256)).dropDuplicates(["oid"])
    return objects.unionByName(fresh.join(objects.select("oid"), "oid", "left_anti").select(*objects.columns)) if "oid" in objects.columns else fresh


def merge_commits(parents: DataFrame) -> DataFrame:
    """Commits with more than one parent, from (oid, parent) links."""
    return parents.groupBy("oid").agg(F.count("parent").alias("parents")).filter("parents > 1")


def ancestors(parents: DataFrame, heads: DataFrame, depth: int | None = None) -> DataFrame:
    """(head, oid, depth) of everything reachable from ``heads`` (head), itself at 0; nearest depth of each.

    Pointer doubling: ``jump`` leads 2^k generations up, so round k adds the depths from 2^k to 2^(k+1) - 1, until a
    round reaches nothing new. ``depth`` may bound the walk.
    """
    jump = saved(parents.filter("parent IS NOT NULL").select(F.col("oid").alias("low"), F.col("parent").alias("high")).distinct(), "jumps")
    walk = saved(heads.filter("head IS NOT NULL").select("head", F.col("head").alias("oid"), F.lit(0).alias("depth")).distinct(), "walk")
    step, size = 1, walk.count()
    while depth is None or step <= depth:
        further = walk.join(jump, F.col("oid") == F.col("low")).select("head", F.col("high").alias("oid"), (F.col("depth") + step).alias("depth"))
        longer = saved(walk.unionByName(further).groupBy("head", "oid").agg(F.min("depth").alias("depth")), "walk")
        free(walk)
        walk, before, size = longer, size, longer.count()
        if size == before:
            break
        up = jump.select(F.col("low").alias("high"), F.col("high").alias("_up"))
        twice, step = saved(jump.join(up, "high").select("low", F.col("_up").alias("high")).distinct(), "jumps"), 2 * step
        free(jump)
        jump = twice
    free(jump)
    return walk if depth is None else walk.filter(F.col("depth") <= depth)


def merge_base(mine: DataFrame, other: DataFrame) -> DataFrame:
    """The ancestor of ``other`` nearest to it that is one of mine as well; ties to the smaller id."""
    return other.join(mine.select("oid"), "oid", "left_semi").orderBy("depth", "oid").limit(1)


def fast_forward(source: DataFrame, target: int) -> Column:
    """Whether the target is an ancestor of the source, so that it may move there."""
    return F.lit(not source.filter(F.col("oid") == target).isEmpty())


def current_refs(log: DataFrame) -> DataFrame:
    """Latest oid of every ref in an append-only log (name, oid, seq); deleted refs (null oid) are gone."""
    return log.groupBy("name").agg(F.max_by("oid", "seq").alias("oid")).filter("oid IS NOT NULL")


def resolve_ref(refs: DataFrame, name: str) -> int | None:
    """Follows symbolic refs (target) to an oid; null for a missing one."""
    for _ in range(10):
        row = refs.filter(F.col("name") == name).first()
        if row is None or row["target"] is None:
            return row["oid"] if row else None
        name = row["target"]
    return None


def added(side: DataFrame, base: DataFrame, key: str = "memory_id") -> DataFrame:
    return side.join(base.select(key), key, "left_anti")


def conflicts(pairs: DataFrame) -> DataFrame:
    """Kind of each similar pair (similarity, opposed) of both sides' additions, and what becomes of it."""
    kind = F.when(F.col("similarity") > 0.85, "duplication").when((F.col("similarity") > 0.7) & F.col("opposed"), "contradiction")
    out = pairs.withColumn("kind", kind).filter("kind IS NOT NULL")
    return out.withColumn("resolution", F.when(F.col("kind") == "duplication", "auto_resolved").otherwise("unresolved"))


def merge(base: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The target with what the source added and the target does not have."""
    return target.unionByName(added(added(source, base), target))


def replay(log: DataFrame) -> DataFrame:
    """Records of a write-ahead log in order, as far as their checksums hold and all before them."""
    w = Window.partitionBy("tx").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.max((F.crc32("payload") != F.col("crc")).cast("int")).over(w)
    return log.withColumn("_broken", broken).filter("_broken = 0").drop("_broken")


def transactions(log: DataFrame) -> DataFrame:
    return log.groupBy("tx").agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("last"))


def prune(worktrees: DataFrame, now: Column, idle_seconds: int = 86_400) -> DataFrame:
    """Worktrees to prune: idle for longer and not merging."""
    return worktrees.filter((F.unix_timestamp(now) - F.unix_timestamp("last_activity") > idle_seconds) & (F.col("status") != "merging"))


def triggered(skills: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, slug) of every skill one of whose patterns a query holds, in any case."""
    patterns = skills.select("slug", F.explode(F.transform("patterns", F.lower)).alias("pattern"))
    low = queries.select("query", F.lower("query").alias("low"))
    return holding(low, "low", patterns, "pattern").select("query", "slug").distinct()


def next_steps(steps: DataFrame) -> DataFrame:
    """Steps of a skill in order up to and with the first failure whose policy is to stop."""
    w = Window.partitionBy("slug").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.max((F.col("failed") & (F.col("on_failure") == "stop")).cast("int")).over(w)
    return steps.withColumn("_s", F.coalesce(stopped, F.lit(0))).filter("_s = 0").drop("_s")
