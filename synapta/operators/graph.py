"""Knowledge graph: entities and relationships as two tables; every change is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.functions import scoring
from synapta.functions.similarity import jaccard_ci, jaccard_sets
from synapta.storage import bounded, free, saved

EDGE = ["subject_id", "predicate", "object_id"]


def active(entities: DataFrame) -> DataFrame:
    return entities.filter(~F.col("is_deprecated") & (F.col("relevance") > 0.1))


def find(entities: DataFrame, kind: str | None = None, name: str | None = None, least: float = 0.0, limit: int = 0) -> DataFrame:
    """Entities by type, part of the name (any case) and confidence, most important first; deprecated ones included."""
    hits = entities.filter(F.col("confidence") >= least)
    if kind:
        hits = hits.filter(F.col("entity_type") == kind)
    if name:
        hits = hits.filter(F.lower("name").contains(name.lower()))
    hits = hits.withColumn("importance", scoring.entity_importance(F.col("confidence"), F.col("access_count"))).orderBy(F.desc("importance"), "entity_id")
    return hits.limit(limit) if limit else hits


def stale(entities: DataFrame, below: float, skip_stable: bool = False) -> DataFrame:
    """The graph's rule skips deprecated entities, the decay engine's (``skip_stable``) stable ones."""
    keep = ~F.col("is_stable") if skip_stable else ~F.col("is_deprecated")
    return entities.filter(keep & (F.col("relevance") < below))


def resolve(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends; edges without an end are dropped."""
    end = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("entity_type").alias(f"{side}_type"))
    return edges.join(end("subject"), "subject_id").join(end("object"), "object_id")


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that refer to an unknown entity: none may be added."""
    ids = entities.select("entity_id")
    known = edges.join(ids.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("entity_id", "object_id"), "object_id", "left_semi")
    return edges.join(known.select(*EDGE).distinct(), EDGE, "left_anti")


def remove(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the entities in ``gone`` (entity_id)."""
    ids = gone.select("entity_id")
    return edges.join(ids.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left_anti").join(ids.withColumnRenamed("entity_id", "object_id"), "object_id", "left_anti").select(*EDGE)


def migrate(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges of entities in ``mapping`` (from_id, to_id) moved to their targets; what exists already is not doubled."""
    end = lambda side: mapping.select(F.col("from_id").alias(f"{side}_id"), F.col("to_id").alias(f"_{side}"))
    mapped = edges.join(end("subject"), "subject_id", "left").join(end("object"), "object_id", "left")
    moved = F.col("_subject").isNotNull() | F.col("_object").isNotNull()
    stay = mapped.filter(~moved).select(*EDGE)
    go = mapped.filter(moved).select(F.coalesce("_subject", "subject_id").alias("subject_id"), "predicate", F.coalesce("_object", "object_id").alias("object_id")).distinct()
    return stay.unionByName(go.join(edges.select(*EDGE), EDGE, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def update_where(entities: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Bulk update of the columns given."""
    return entities.withColumns({n: F.when(where, v).otherwise(F.col(n)) for n, v in values.items()})


def decay(entities: DataFrame, days: Column, floor: float = 0.01, least_days: float = 0.01) -> DataFrame:
    """Relevance after ``days`` without access; stable entities and tiny spans are skipped. Adds decayed."""
    fresh = F.greatest(F.lit(floor), scoring.decay(F.col("relevance"), days, F.col("half_life_days")))
    applies = ~F.col("is_stable") & (days >= least_days)
    out = entities.withColumn("_new", F.when(applies, fresh).otherwise(F.col("relevance")))
    return out.withColumn("decayed", applies & (F.col("_new") < F.col("relevance"))).withColumn("relevance", F.col("_new")).drop("_new")


def decay_stats(before: DataFrame, days: Column, below: float = 0.1) -> DataFrame:
    after = decay(before, days)
    return after.agg(F.count_if(~F.col("is_stable") & (days >= 0.01)).alias("processed"), F.count_if("decayed").alias("decayed"), F.count_if(F.col("relevance") < below).alias("below"))


def merge_score(a: Column, b: Column, attributes: Column | None) -> Column:
    """Names weigh a half, the common type a fifth, attributes three tenths; without attributes the rest fills up."""
    names = 0.5 * jaccard_ci(a, b) + 0.2
    return names / 0.7 if attributes is None else names + 0.3 * attributes


def _name_classes(entities: DataFrame, *facets: str) -> tuple[DataFrame, DataFrame]:
    """Live entities as members (entity_id, ord, class, facets) of classes of one type, attribute and set of words, and the classes (class, entity_type, attribute, w)."""
    live = entities.filter(~F.col("is_deprecated")).select("entity_id", "ord", "entity_type", "attribute", F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda x: x != "")).alias("w"), *facets)
    live = live.filter("w IS NOT NULL AND ord IS NOT NULL AND entity_type IS NOT NULL").withColumn("key", F.array_join(F.sort_array("w"), " "))
    kind = F.sha2(F.concat_ws("\0", F.length("entity_type").cast("string"), "entity_type", F.when(F.col("attribute").isNotNull(), F.concat(F.length("attribute"), F.lit(":"), "attribute")).otherwise("-"), "key"), 256)
    members = saved(live.withColumn("class", kind).drop("key"), "names")
    return members.drop("entity_type", "attribute", "w"), saved(members.groupBy("class").agg(F.first("entity_type").alias("entity_type"), F.first("attribute").alias("attribute"), F.first("w").alias("w")), "name-classes")


def _class_links(live: DataFrame, least: float) -> DataFrame:
    """Pairs of classes (ca, cb, similarity) of a merge score of at least ``least``, each class with itself too.

    The score bounds the Jaccard similarity of the names from below, by more where the attributes
    differ. Pairs with equal attributes meet on type, attribute and a word, others on type and a
    word; of the words only so many of a name's rarest as the bound needs (prefix filter). Where
    no common word is needed at all, equal attributes alone make a pair.
    """
    words = live.select("class", "entity_type", F.size("w").alias("n"), F.explode("w").alias("word"))
    freq = words.groupBy("entity_type", "word").agg(F.count(F.lit(1)).alias("f"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy("f", "word"))
    ranked = saved(words.join(freq, ["entity_type", "word"]).select("class", "word", "n", rank.alias("r")).join(live.drop("w"), "class"), "name-words")

    def met(needed: float, same: bool) -> DataFrame:
        least_j = max(0.0, needed - 1e-9)
        if least_j <= 0:
            x, y = live.alias("x"), live.alias("y")
            on = F.lit(True)
        else:
            head = ranked.filter(F.col("r") <= F.col("n") - F.ceil(least_j * F.col("n")) + 1)
            x, y = head.alias("x"), head.alias("y")
            on = (F.col("x.word") == F.col("y.word")) & (F.col("x.n") >= least_j * F.col("y.n")) & (F.col("y.n") >= least_j * F.col("x.n"))
        on = on & (F.col("x.entity_type") == F.col("y.entity_type")) & (F.col("x.class") < F.col("y.class"))
        on = on & (F.col("x.attribute") == F.col("y.attribute")) if same else on & ~F.coalesce(F.col("x.attribute") == F.col("y.attribute"), F.lit(False))
        return x.join(y, on).select(F.col("x.class").alias("ca"), F.col("y.class").alias("cb"), F.lit(1.0 if same else 0.0).alias("own")).distinct()

    pairs = met((least - 0.5) / 0.5, True)
    if least <= 1 - 0.3:
        pairs = pairs.unionByName(met((least - 0.2) / 0.5, False))
    pairs = pairs.unionByName(live.select(F.col("class").alias("ca"), F.col("class").alias("cb"), F.col("attribute").isNotNull().cast("double").alias("own")))
    side = lambda n: live.select(F.col("class").alias(f"c{n}"), F.col("w").alias(f"w{n}"))
    full = pairs.join(side("a"), "ca").join(side("b"), "cb").withColumn("similarity", 0.5 * jaccard_sets(F.col("wa"), F.col("wb")) + 0.2 + 0.3 * F.col("own"))
    return saved(full.filter(F.col("similarity") >= least).select("ca", "cb", "similarity"), "class-links")


def merge_candidates(entities: DataFrame, least: float = 0.85, *facets: str) -> DataFrame:
    """Pairs (a, b, similarity, facets of both with the suffixes _a and _b) of one type, a before b by ord, live both, of a merge
    score of at least ``least``. Classes of equal names and attributes meet; pairs are expanded last, and shuffled no more."""
    members, live = _name_classes(entities, *facets)
    side = lambda c, n: members.select(F.col("class").alias(c), F.col("entity_id").alias(n), F.col("ord").alias(f"ord_{n}"), *[F.col(f).alias(f"{f}_{n}") for f in facets])
    links = _class_links(live, least)
    both = links.unionByName(links.filter("ca <> cb").select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "similarity"))
    return both.join(side("ca", "a"), "ca").join(side("cb", "b"), "cb").filter("ord_a < ord_b").select("a", "b", "similarity", *[f"{f}_{n}" for f in facets for n in "ab"])


def best_keeps(entities: DataFrame, least: float) -> DataFrame:
    """(keep, gone) for every entity that a candidate of larger importance ``i`` (ties: of smaller ord) would take in: the most important, ties to the larger id.

    That is decided by classes: the best of a class for all below it, and the best of those before it for its equals; pairs are not expanded."""
    members, live = _name_classes(entities, "i")
    links = _class_links(live, least).select("ca", "cb")
    links = links.unionByName(links.filter("ca <> cb").select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
    tops = members.groupBy(F.col("class").alias("cb")).agg(F.max(F.struct("i", "entity_id")).alias("top"))
    x = members.select(F.col("class").alias("ca"), F.col("entity_id").alias("gone"), "ord", "i").join(links.join(tops, "cb"), "ca")
    below = x.filter("i < top.i").select("gone", F.col("top.i").alias("i"), F.col("top.entity_id").alias("keep"))
    equal = x.filter("i = top.i").select("ca", "cb", "ord", F.lit(0).alias("kept"), "gone", "i", F.lit(None).cast("string").alias("keep"))
    best = members.select(F.col("class").alias("cb"), F.col("entity_id").cast("string").alias("keep"), "ord", "i").join(tops, "cb").filter("i = top.i").join(links, "cb")
    best = best.select("ca", "cb", "ord", F.lit(1).alias("kept"), F.lit(None).cast("string").alias("gone"), "i", "keep")
    before = F.max("keep").over(Window.partitionBy("ca", "cb").orderBy("ord", "kept").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    equal = equal.unionByName(best).withColumn("keep", before).filter("kept = 0 AND keep IS NOT NULL").select("gone", "i", "keep")
    return below.unionByName(equal).groupBy("gone").agg(F.max(F.struct("i", "keep")).alias("m")).select("m.keep", "gone")


def keep_first(a_importance: Column, b_importance: Column) -> Column:
    return a_importance >= b_importance


def apply_merges(entities: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``merges`` (keep, gone): confidence min(1, c + half of each gone), accesses added, gone deprecated, edges moved."""
    gone = merges.join(entities.select(F.col("entity_id").alias("gone"), F.col("confidence").alias("_c"), F.col("access_count").alias("_a")), "gone")
    plus = gone.groupBy(F.col("keep").alias("entity_id")).agg(F.sum("_c").alias("_c"), F.sum("_a").alias("_a"))
    out = entities.join(plus, "entity_id", "left").join(merges.select(F.col("gone").alias("entity_id"), F.lit(True).alias("_gone")), "entity_id", "left")
    out = out.withColumns({
        "confidence": F.least(F.lit(1.0), F.col("confidence") + 0.5 * F.coalesce("_c", F.lit(0.0))), "access_count": F.col("access_count") + F.coalesce("_a", F.lit(0)),
        "is_deprecated": F.col("is_deprecated") | F.coalesce("_gone", F.lit(False)),
    }).drop("_c", "_a", "_gone")
    return out, migrate(edges, merges.select(F.col("gone").alias("from_id"), F.col("keep").alias("to_id")))


def roots(merges: DataFrame) -> DataFrame:
    """(keep, gone) with chains followed to their ends: each round halves what is left of a chain. Chains must have ends."""
    m = saved(merges.select("keep", "gone"), "merges")
    while True:
        up = m.select(F.col("gone").alias("keep"), F.col("keep").alias("_up"))
        further = saved(m.join(up, "keep", "left").select(F.coalesce("_up", "keep").alias("keep"), "gone", F.col("_up").isNotNull().alias("_moved")), "merges")
        free(m)
        if further.filter("_moved").isEmpty():
            return further.drop("_moved")
        m, m._saved_at = further.drop("_moved"), further._saved_at


def evolve(entities: DataFrame, edges: DataFrame, least: float = 0.8, deprecate_below: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """One cycle: merge candidates resolved to their roots, applied in one batch, and stale entities deprecated."""
    best = best_keeps(entities.withColumn("i", scoring.entity_importance(F.col("confidence"), F.col("access_count")) * F.col("relevance")), least)
    merged, moved = apply_merges(entities, edges, bounded(roots(best)))
    return update_where(merged, F.col("relevance") < deprecate_below, is_deprecated=F.lit(True)), moved


#: No letter, digit or underscore of any script before or after, as in the reference (Python); Java's own boundary differs by version.
_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: White space of any script.
_SPACE = r"[\s\x{85}\p{Z}]"


def graph_from_phrases(memories: DataFrame, stop: tuple[str, ...], most: int = 5) -> DataFrame:
    """Nodes (label, type) of capitalized phrases: the first ``most`` per memory and single words of three letters."""
    text = F.regexp_replace(F.regexp_replace("content", rf"Round \p{{Nd}}+:{_SPACE}*User:{_SPACE}*", ""), rf"{_SPACE}*\|{_SPACE}*Assistant:{_SPACE}*", " ")
    phrases = F.slice(F.regexp_extract_all(text, F.lit(rf"{_START}([A-Z][a-zA-Z]+(?:{_SPACE}+[A-Z][a-zA-Z]+)*){_END}"), F.lit(1)), 1, most)
    singles = F.regexp_extract_all(text, F.lit(rf"{_START}([A-Z][a-zA-Z]{{2,}}){_END}"), F.lit(1))
    seen = memories.select("memory_id", F.posexplode(F.concat(phrases, singles)).alias("pos", "label")).withColumn("key", F.lower(F.trim("label")))
    seen = seen.filter(~F.col("key").isin(*stop))
    return seen.groupBy("key").agg(F.min_by("label", F.struct("memory_id", "pos")).alias("label"), F.min(F.struct("memory_id", "pos")).alias("at"))


def hub_edges(nodes: DataFrame, hubs: int = 3) -> DataFrame:
    """The first nodes relate to every later one; only the hubs meet all."""
    w = Window.orderBy("at")
    first = nodes.orderBy("at").limit(hubs).withColumn("i", F.row_number().over(w))
    return F.broadcast(first).alias("h").join(nodes.alias("n"), F.col("h.at") < F.col("n.at")).select(F.col("h.key").alias("from"), F.col("n.key").alias("to"))


def records_for(records: DataFrame, entity_id: str) -> DataFrame:
    """Evolution records (entity_ids, seq, ...) that touch an entity, in order."""
    return records.filter(F.array_contains("entity_ids", entity_id)).orderBy("seq")
