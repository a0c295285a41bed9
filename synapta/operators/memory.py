"""Memory retrieval, lifecycle, context assembly, consolidation and evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.functions.similarity import cosine
from synapta.functions.text import negated
from synapta.operators import pairs
from synapta.storage import bounded, saved

# Token limits by tier, ages in seconds after which a tier is left, order of block types.
TIER_LIMITS = {"working": 4096, "short": 16384, "long": 1048576}
TIER_AGES = {"working": 3600, "short": 86400}
BLOCK_ORDER = ("system", "working", "conversation", "episodic", "semantic", "procedural", "entity")
HEADERS = {"working": "[Working Memory]", "episodic": "[Previous Conversation]", "semantic": "[Relevant Information]", "procedural": "[Skill]", "entity": "[Entity]"}


def case_map(column: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[column]


def retrieve(memories: DataFrame, keywords: list[str], tags: list[str], least: float, limit: int = 0) -> DataFrame:
    """Memories with all keywords (any case), all tags and this confidence, most important first."""
    hits = memories.filter(F.col("confidence") >= least)
    for k in keywords:
        hits = hits.filter(F.lower("content").contains(k.lower()))
    if tags:
        hits = hits.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    hits = hits.orderBy(F.desc("importance"), "memory_id")
    return hits.limit(limit) if limit > 0 else hits


def promotion(accesses: Column, importance: Column) -> Column:
    return F.when(accesses >= 3, "access_count").when(importance >= 0.7, "importance")


def demotion(tier: Column, age_seconds: Column) -> Column:
    limit = case_map(tier, TIER_AGES)
    return F.coalesce(age_seconds > limit, F.lit(False))


def current_state(transitions: DataFrame) -> DataFrame:
    """Latest state of each memory in an append-only log (memory_id, seq, to_state)."""
    return transitions.groupBy("memory_id").agg(F.max_by("to_state", "seq").alias("state"))


def tier_usage(memories: DataFrame, states: DataFrame) -> DataFrame:
    """Tokens per tier of the memories that have a state; archived and tombstoned ones count as long."""
    tier = F.when(F.col("state").isin("archived", "tombstoned"), "long").otherwise(F.col("tier"))
    held = memories.join(states, "memory_id").withColumn("tier", tier)
    used = held.groupBy("tier").agg(F.sum(F.coalesce("token_estimate", F.lit(0))).alias("tokens"))
    return used.withColumn("exceeded", F.col("tokens") > case_map(F.col("tier"), TIER_LIMITS))


def compaction(memories: DataFrame, tier: str, n: int) -> DataFrame:
    return memories.filter(F.col("tier") == tier).orderBy("importance", "last_accessed", "memory_id").limit(n)


def coherence(candidates: DataFrame, least: float = 0.95) -> DataFrame:
    """0 for candidates of which an earlier one of the session (by ord) is a near copy, else 1.

    Near copies are found between classes of equal words (``pairs``); of each, the first memory alone decides.
    """
    members, sets, words = pairs.classes(candidates, least)
    links = pairs.class_pairs(sets, words, least).select("a", "b")
    first = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("class")).agg(F.min("b").alias("_first"))
    later = members.join(first, "class", "left").filter(F.col("memory_id") > F.least("class", "_first")).select("memory_id").distinct().withColumn("_copy", F.lit(0.0))
    return candidates.join(later, "memory_id", "left").withColumn("coherence", F.coalesce("_copy", F.lit(1.0))).drop("_copy")


def similar_pairs(memories: DataFrame, above: float, *facets: str) -> DataFrame:
    """Pairs a < b of one session whose word sets have a Jaccard similarity above ``above``: (a, b, similarity, held: the share of
    b's words that a has, and the columns ``facets`` of both, with the suffixes _a and _b).

    Exact: memories of equal words are one class, classes are joined by bitmaps and counted word by word, and pairs are
    expanded last, with no shuffle of texts or word sets by pairs (``pairs``).
    """
    members, sets, words = pairs.classes(memories, above, *facets)
    return pairs.expanded(members, pairs.class_pairs(sets, words, above), *facets)


def pack_budget(scored: DataFrame, budget: int, reserve: float = 0.25, system: int = 512, most: int = 20) -> DataFrame:
    """Greedy choice per session in score order, skipping what does not fit: (session_id, used, chosen, skipped, ids).

    ``scored``: session_id, memory_id, score, tokens. One ordered fold over an array per session; the fold stops
    taking at ``most`` blocks.
    """
    available = budget - int(budget * reserve) - system
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("memory_id").alias("i"), F.col("tokens").cast("long").alias("t"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("skipped"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc, x):
        fits = (acc["used"] + x["t"] <= available) & (F.size(acc["ids"]) < most)
        return F.struct(
            F.when(fits, acc["used"] + x["t"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, acc["skipped"]).otherwise(acc["skipped"] + 1).alias("skipped"),
            F.when(fits, F.concat(acc["ids"], F.array(x["i"]))).otherwise(acc["ids"]).alias("ids"),
        )

    folded = scored.groupBy("session_id").agg(F.aggregate(order, start, step).alias("f"))
    return folded.select("session_id", "f.used", F.size("f.ids").cast("long").alias("chosen"), "f.skipped", "f.ids")


def block_rank(kind: Column) -> Column:
    return case_map(kind, {k: i for i, k in enumerate(BLOCK_ORDER)})


def format_blocks(blocks: DataFrame) -> DataFrame:
    """One text per session from blocks (session_id, kind, score, content) in type order, best first."""
    kind, text = F.col("kind"), F.col("content")
    header = F.coalesce(F.concat(case_map(kind, HEADERS), F.lit("\n")), F.lit(""))
    part = F.concat(header, text, F.when(kind == "conversation", "\n").otherwise("\n\n"))
    listed = F.sort_array(F.collect_list(F.struct(block_rank(kind).alias("r"), (-F.col("score")).alias("s"), F.col("memory_id").alias("i"), part.alias("p"))))
    return blocks.groupBy("session_id").agg(F.trim(F.regexp_replace(F.array_join(F.transform(listed, lambda x: x["p"]), ""), r"^\s+|\s+$", "")).alias("context"))


def context_digests(blocks: DataFrame) -> DataFrame:
    """(session_id, context_sha256) of the texts of ``format_blocks``, null where no block has a text.

    A session's blocks are sorted by Spark and stream through one digest, so no session need fit in a task's memory."""
    kind, text = F.col("kind"), F.col("content")
    header = F.coalesce(F.concat(case_map(kind, HEADERS), F.lit("\n")), F.lit(""))
    part = F.concat(header, text, F.when(kind == "conversation", "\n").otherwise("\n\n"))
    order = ["session_id", "r", "s", "i"]
    parts = blocks.select("session_id", block_rank(kind).alias("r"), (-F.col("score")).alias("s"), F.col("memory_id").alias("i"), part.alias("p"))
    parts = parts.repartition(max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "session_id").sortWithinPartitions(*order).select("session_id", "p")

    def digest(batches):
        import hashlib

        import pyarrow as pa

        space, none = " \t\n\f\r\v", object()
        head, sha, held, seen, kind = none, None, [], False, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([head], kind), pa.array([sha.hexdigest() if seen else None], pa.string())], names=["session_id", "context_sha256"])

        for batch in batches:
            kind = batch.column(0).type
            for session, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if session != head:
                    if head is not none:
                        yield row()
                    head, sha, held, seen, begun = session, hashlib.sha256(), [], False, False
                p = p.as_py()
                if p is None:
                    continue
                seen = True
                p = p if begun else p.lstrip(space)
                body = p.rstrip(space)
                if body:  # white space that was held back is inside the text
                    begun = True
                    for h in held:
                        sha.update(h)
                    sha.update(body.encode())
                    held = []
                if begun and len(body) < len(p):
                    held.append(p[len(body) :].encode())
        if head is not none:
            yield row()

    from pyspark.sql.types import StringType, StructType

    return parts.mapInArrow(digest, StructType().add("session_id", blocks.schema["session_id"].dataType).add("context_sha256", StringType()))


def context_blocks(memories: DataFrame, skills: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Blocks (session_id, kind, memory_id, score, content) of all sources of a context.

    ``memories`` are blocks already; ``skills`` (session_id, slug, body, score), ``entities`` (session_id, entity_id,
    name, entity_type, score) and ``relationships`` (session_id, subject_name, predicate, object_name, score)
    become one block each, of the kinds procedural and entity, without a memory_id.
    """
    none = F.lit(None).cast("long").alias("memory_id")
    block = lambda df, kind, text: df.select("session_id", F.lit(kind).alias("kind"), none, "score", text.alias("content"))
    parts = [
        block(skills, "procedural", F.concat_ws("\n", "slug", "body")), block(entities, "entity", F.concat("name", F.lit(" ("), "entity_type", F.lit(")"))),
        block(relationships, "entity", F.concat_ws(" ", "subject_name", "predicate", "object_name")),
    ]
    out = memories.select("session_id", "kind", "memory_id", "score", "content")
    for part in parts:
        out = out.unionByName(part)
    return out


def contradictions(blocks: DataFrame, most: int = 20) -> DataFrame:
    """(session_id, a, b) of selected blocks (session_id, memory_id, score, content) just one of which is negated: an optional
    check after packing. A context holds at most ``most`` blocks; of more, the best count, so pairs are bounded."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "memory_id"))
    held = blocks.select("session_id", "memory_id", negated(F.col("content")).alias("neg"), n.alias("n")).filter(F.col("n") <= most)
    x, y = held.filter("neg"), held.filter("NOT neg").select("session_id", F.col("memory_id").alias("other"))
    met = x.join(y, "session_id")
    return met.select("session_id", F.least("memory_id", "other").alias("a"), F.greatest("memory_id", "other").alias("b"))


def replaces(kind: Column, score: Column, old_kind: Column, old_score: Column) -> Column:
    """Whether a new block should replace a conflicting one: the same kind, and a higher score."""
    return (kind == old_kind) & (score > old_score)


def contradictory(a: Column, b: Column) -> Column:
    """Whether just one of two selected texts is negated."""
    return negated(a) != negated(b)


def cluster_sessions(memories: DataFrame, least: float = 0.3) -> DataFrame:
    """Single-pass clusters (memory_id, cluster): in order of memory_id a memory joins the first cluster of its session and
    type with a member of a larger Jaccard similarity, else it begins one. One without words, session or type is alone.

    Which classes of equal words are similar is found in tiles (``pairs``); the ordered fold sees ids and links alone, and
    only of classes that have a link: one group per session and type. Members of another class join its first."""
    import numpy as np
    import pyarrow as pa

    of = F.concat(F.length("memory_type").cast("string"), F.lit(":"), "memory_type", F.col("session_id").cast("string"))
    keyed = memories.select("memory_id", "content", of.alias("session_id"), of.alias("_of"))
    members, sets, words = pairs.classes(keyed, least, "_of", bitmaps=False)
    links = saved(pairs.class_pairs(sets, words, least).select("a", "b"), "links")
    some = saved(links.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "linked")
    linked, apart = (members.join(bounded(some), "class", how) for how in ("left_semi", "left_anti"))
    heads = linked.filter("memory_id = class").select(F.col("class").alias("a"), F.col("_of").alias("_in")).distinct()

    def fold(own, met):
        ids, cls = (own.column(c).to_numpy() for c in ("memory_id", "class"))
        order = np.argsort(ids, kind="stable")
        ids, (names, cls) = ids[order], np.unique(cls[order], return_inverse=True)
        a, b = (np.searchsorted(names, met.column(c).to_numpy()) for c in "ab")
        start, end = np.concatenate((a, b)), np.concatenate((b, a))
        by = np.argsort(start, kind="stable")
        end, at = end[by], np.searchsorted(start[by], np.arange(len(names) + 1))
        none = np.iinfo(np.int64).max
        first, near, out = np.full(len(names), none), np.full(len(names), none), np.empty(len(ids), np.int64)  # of a class's members; of all similar ones
        for i, (mid, c) in enumerate(zip(ids.tolist(), cls.tolist(), strict=True)):
            out[i] = to = near[c] if near[c] < none else mid
            if to < first[c]:
                first[c] = to
                near[c] = min(near[c], to)
                others = end[at[c] : at[c + 1]]
                near[others] = np.minimum(near[others], to)
        return pa.table({"memory_id": ids, "cluster": out})

    folded = linked.groupBy("_of").cogroup(links.join(heads, "a").groupBy("_in")).applyInArrow(fold, "memory_id long, cluster long")
    alone = keyed.filter(~F.coalesce(F.col("content").rlike(r"\S") & F.col("_of").isNotNull(), F.lit(False)))
    return folded.unionByName(apart.select("memory_id", F.col("class").alias("cluster"))).unionByName(alone.select("memory_id", F.col("memory_id").alias("cluster")))


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("long")


def summarize(clusters: DataFrame, least_tokens: int = 50) -> DataFrame:
    """Per cluster of (cluster, memory_id, content, importance, tags): size, mean importance, all tags, and a
    summary of the three most important members, or the top member alone for small clusters."""
    return _summaries(clusters.withColumn("_words", _n_words(F.col("content"))), least_tokens)


def _summaries(clusters: DataFrame, least_tokens: int = 50) -> DataFrame:
    """As ``summarize``, of rows that have their count of words; no cluster's texts but three are gathered."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(-F.col("importance"), "memory_id"))
    top = clusters.select("cluster", "memory_id", "content", "importance").withColumn("r", rank).filter("r <= 3")
    top = top.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", F.col("content").alias("c")))).alias("best"))
    out = clusters.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg("importance").alias("importance"), F.sum("_words").alias("words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    out = out.join(top.withColumnRenamed("cluster", "_c"), F.col("cluster").eqNullSafe(F.col("_c")))
    small = (F.col("size") < 2) | (F.col("words") < least_tokens)
    text = F.when(small, F.col("best")[0]["c"]).otherwise(F.array_join(F.transform("best", lambda b: b["c"]), " "))
    return out.select("cluster", "size", "importance", "words", "tags", text.alias("summary"))


def token_saving(summaries: DataFrame) -> DataFrame:
    after = _n_words(F.col("summary"))
    return summaries.agg(F.sum("words").alias("before"), F.sum(after).alias("after"), (F.sum("words") - F.sum(after)).alias("saved"))


# Names of the consolidation strategies.
STRATEGIES = ("hierarchical_summary", "topic_clustering", "semantic_deduplication", "full_reconstruction")


def consolidate(memories: DataFrame, strategy: str = "topic_clustering") -> DataFrame:
    """One consolidation cycle: clusters, their summaries, and what stays of each. A job names one of ``STRATEGIES``;
    by decision all four cluster by topic, as in the original, where the name is kept with the job and never consulted."""
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy} is none of {', '.join(STRATEGIES)}")
    clusters = saved(cluster_sessions(memories), "clusters")
    return _summaries(clusters.join(memories.withColumn("_words", _n_words(F.col("content"))), "memory_id"))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """FIFO place (from 0) of every queued job (job_id, status, created)."""
    w = Window.partitionBy("status").orderBy("created", "job_id")
    return jobs.filter("status = 'queued'").withColumn("position", F.row_number().over(w).cast("long") - 1)


# Confidence of a link by kind, and what a support adds to both sides.
LINK_CONFIDENCE = {"supersedes": 0.8, "elaborates": 0.7, "supports": 0.75, "contradicts": 0.9}
SUPPORT = 0.05


def neighbours(new: DataFrame, old: DataFrame, above: float = 0.7) -> DataFrame:
    """(new, old, similarity) of old memories near a new one of the same session: by cosine if the new one has an
    embedding, else by words. New memories are the query set: words meet by ``similar_pairs``, embeddings of one
    session by its id, the new ones broadcast if they are few."""
    plain = new.filter("embedding IS NULL").select("memory_id", "session_id", "content").withColumn("_new", F.lit(True))
    both = plain.unionByName(old.select("memory_id", "session_id", "content").join(plain.select("memory_id"), "memory_id", "left_anti").withColumn("_new", F.lit(False)))
    is_new = both.filter("_new").select("memory_id")
    found = similar_pairs(both, above).select("a", "b", "similarity")
    turned = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    told = old.select(F.col("memory_id").alias("old"))
    words = turned.join(is_new.withColumnRenamed("memory_id", "a"), "a", "left_semi").select(F.col("a").alias("new"), F.col("b").alias("old"), "similarity").join(told, "old", "left_semi")
    n = bounded(new.filter("embedding IS NOT NULL").select(F.col("memory_id").alias("new"), "session_id", F.col("embedding").alias("_e")))
    o = old.filter("embedding IS NOT NULL").select(F.col("memory_id").alias("old"), "session_id", F.col("embedding").alias("_f"))
    met = o.join(n, "session_id").filter("new <> old").withColumn("similarity", cosine(F.col("_e"), F.col("_f"))).filter(F.col("similarity") > above)
    return words.select("new", "old", "similarity").unionByName(met.select("new", "old", "similarity"))


def relation(similarity: Column, contained: Column, newer: Column, longer: Column, opposed: Column) -> Column:
    """How a new memory relates to an old one: the first rule that holds."""
    return (
        F.when(newer & (similarity > 0.8), "supersedes").when(longer & (contained > 0.7), "elaborates").when(similarity > 0.6, "supports")
        .when((similarity > 0.4) & opposed, "contradicts").otherwise("unrelated")
    )


def effects(links: DataFrame) -> DataFrame:
    """Per new memory of links (new, old, kind, confidence): raised confidence, what it supersedes, its conflicts."""
    supports = F.count_if(F.col("kind") == "supports")
    return links.groupBy("new").agg(
        F.least(F.lit(1.0), F.first("confidence") + SUPPORT * supports).alias("confidence"), F.max(F.when(F.col("kind") == "supersedes", F.col("old"))).alias("supersedes"),
        F.count_if(F.col("kind") == "contradicts").alias("conflicts"),
    )


def fact_action(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """UPDATE of the first memory that holds a fact (any case), else ADD: (fact_id, action, memory_id)."""
    held = facts.join(memories, F.lower("content").contains(F.lower("fact")), "left")
    return held.groupBy("fact_id").agg(F.when(F.min("memory_id").isNotNull(), "UPDATE").otherwise("ADD").alias("action"), F.min("memory_id").alias("memory_id"))
