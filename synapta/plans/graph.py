"""B5 to B9, C2 to C7, D1, D2, D9, F5, P*, Q*: the knowledge graph."""

from pyspark.sql import functions as F

from synapta import views as V
from synapta.functions import scoring as C
from synapta.functions.text import word_set
from synapta.operators import graph as G
from synapta.operators import grid as P
from synapta.plans import query
from synapta.plans.scalars import jaccard_sql, words_sql

# Words that are no entities.
STOP = (
    "round user assistant system role content timestamp message session memory context response request here there where when what which who "
    "whom whose why how can will would could should may might must shall need dare ought used please thanks thank sorry yes no okay ok sure great "
    "good well also too very just only even still actually basically literally essentially generally typically usually often sometimes always never "
    "first second third last next previous new old big small large long short high low many much few little more less most least other another such "
    "same different various"
).split()


def _e(spark, d):
    return V.entities(spark, d)


@query(V.sql("SELECT entity_id, round(confidence * (1 + 0.1e0 * access_count), 6) AS importance FROM entities WHERE entity_type = 'part' AND contains(lower(name), 'ring') AND confidence >= 0.6 ORDER BY confidence * (1 + 0.1e0 * access_count) DESC, entity_id LIMIT 40", "entities"))
def b5_find_entities(spark, d):
    return G.find(_e(spark, d), "part", "RING", 0.6, 40).select("entity_id", F.round("importance", 6).alias("importance"))


@query(V.sql("SELECT entity_id FROM entities WHERE NOT is_deprecated AND relevance > 0.1", "entities"))
def b6_active(spark, d):
    return G.active(_e(spark, d)).select("entity_id")


@query(V.sql("SELECT entity_type, count(*) FILTER (WHERE NOT is_deprecated AND relevance < 0.2) AS stale, count(*) FILTER (WHERE is_deprecated) AS deprecated, count(*) FILTER (WHERE NOT is_deprecated) AS active FROM entities GROUP BY entity_type", "entities"))
def b7_stale_counts(spark, d):
    e = _e(spark, d)
    return e.groupBy("entity_type").agg(F.count_if(~F.col("is_deprecated") & (F.col("relevance") < 0.2)).alias("stale"), F.count_if("is_deprecated").alias("deprecated"), F.count_if(~F.col("is_deprecated")).alias("active"))


@query(V.sql("SELECT entity_id, relevance FROM entities WHERE NOT is_stable AND relevance < 0.1", "entities"))
def b8_stale_for_decay(spark, d):
    return G.stale(_e(spark, d), 0.1, skip_stable=True).select("entity_id", "relevance")


@query(V.sql("SELECT entity_id, name FROM entities WHERE name ILIKE '%ing%' ORDER BY entity_id LIMIT 50", "entities"))
def b9_name_like(spark, d):
    return _e(spark, d).filter(F.col("name").ilike("%ing%")).orderBy("entity_id").limit(50).select("entity_id", "name")


_RES = "SELECT r.subject_id, s.name AS subject_name, predicate, r.object_id, o.name AS object_name FROM relationships r JOIN entities s ON r.subject_id = s.entity_id JOIN entities o ON r.object_id = o.entity_id"


def _resolved(edges, e):
    return G.resolve(edges, e).select("subject_id", "subject_name", "predicate", "object_id", "object_name")


@query(V.sql(_RES + " WHERE r.subject_id IN ('c1', 's2', 'n3')", "entities", "relationships"))
def c2_outgoing(spark, d):
    return _resolved(V.relationships(spark, d).filter(F.col("subject_id").isin("c1", "s2", "n3")), _e(spark, d))


@query(V.sql(_RES + " WHERE predicate = 'supplies' AND r.object_id = 'p5' ORDER BY r.subject_id LIMIT 10", "entities", "relationships"))
def c3_filtered_edges(spark, d):
    return _resolved(V.relationships(spark, d).filter("predicate = 'supplies' AND object_id = 'p5'"), _e(spark, d)).orderBy("subject_id").limit(10)


@query(V.sql("SELECT predicate, s.entity_type AS subject_type, o.entity_type AS object_type, count(*) AS n FROM relationships r JOIN entities s ON r.subject_id = s.entity_id JOIN entities o ON r.object_id = o.entity_id GROUP BY ALL", "entities", "relationships"))
def c4_all_edges(spark, d):
    return G.resolve(V.relationships(spark, d), _e(spark, d)).groupBy("predicate", "subject_type", "object_type").agg(F.count(F.lit(1)).alias("n"))


@query(V.sql(_RES + " WHERE r.subject_id = 'c7' AND predicate = 'located_in'", "entities", "relationships"))
def c5_edge_by_key(spark, d):
    return _resolved(V.relationships(spark, d).filter("subject_id = 'c7' AND predicate = 'located_in'"), _e(spark, d))


@query(V.sql("SELECT r.* FROM relationships r WHERE predicate = 'located_in' AND (NOT EXISTS (SELECT 1 FROM entities WHERE entity_id = r.subject_id AND key % 10 <> 0) OR NOT EXISTS (SELECT 1 FROM entities WHERE entity_id = r.object_id AND key % 10 <> 0))", "entities", "relationships"))
def c6_dangling(spark, d):
    known = _e(spark, d).filter("key % 10 <> 0")
    return G.dangling(V.relationships(spark, d).filter("predicate = 'located_in'"), known).select("subject_id", "predicate", "object_id")


@query(V.sql("SELECT r.* FROM relationships r WHERE subject_id NOT IN ('c1', 'p2', 'n3') AND object_id NOT IN ('c1', 'p2', 'n3')", "relationships"))
def c7_cascade_delete(spark, d):
    gone = spark.createDataFrame([("c1",), ("p2",), ("n3",)], "entity_id string")
    return G.remove(V.relationships(spark, d), F.broadcast(gone))


@query(V.sql("SELECT 'node' AS kind, entity_type AS name, count(*) AS n FROM entities GROUP BY entity_type UNION ALL SELECT 'edge', predicate, count(*) FROM relationships GROUP BY predicate", "entities", "relationships"))
def d1_graph_stats(spark, d):
    n = _e(spark, d).groupBy(F.lit("node").alias("kind"), F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(V.relationships(spark, d).groupBy(F.lit("edge").alias("kind"), F.col("predicate").alias("name")).agg(F.count(F.lit(1)).alias("n")))


@query(V.sql("SELECT round(coalesce(avg(relevance), 0), 6) AS relevance FROM entities", "entities"))
def d2_mean_relevance(spark, d):
    return _e(spark, d).agg(F.round(F.coalesce(F.avg("relevance"), F.lit(0.0)), 6).alias("relevance"))


@query(V.sql("SELECT entity_id, relevance FROM entities WHERE NOT is_deprecated ORDER BY relevance DESC, entity_id LIMIT 100", "entities"))
def f5_by_relevance(spark, d):
    return _e(spark, d).filter(~F.col("is_deprecated")).orderBy(F.desc("relevance"), "entity_id").limit(100).select("entity_id", "relevance")


_MIG = """, m AS (SELECT subject_id AS s0, object_id AS o0, predicate, CASE WHEN subject_id IN ('s1', 's2') THEN 's0' ELSE subject_id END AS s, CASE WHEN object_id IN ('s1', 's2') THEN 's0' ELSE object_id END AS o FROM relationships),
r AS (SELECT s0 AS subject_id, predicate, o0 AS object_id FROM m WHERE s = s0 AND o = o0 UNION ALL
  SELECT DISTINCT s, predicate, o FROM m WHERE (s <> s0 OR o <> o0) AND (s, predicate, o) NOT IN (SELECT (subject_id, predicate, object_id) FROM relationships)) """


@query(V.sql(_MIG + "SELECT subject_id, predicate, object_id FROM r", "relationships"))
def p1_migrate_edges(spark, d):
    moves = spark.createDataFrame([("s1", "s0"), ("s2", "s0")], "from_id string, to_id string")
    return G.migrate(V.relationships(spark, d), F.broadcast(moves))


@query(V.sql("SELECT entity_id, name FROM entities WHERE entity_id NOT IN ('r1', 'r9') AND entity_type = 'region' UNION ALL SELECT * FROM (VALUES ('r1', 'New'), ('r9', 'Ninth'))", "entities"))
def p2_upsert_entities(spark, d):
    new = spark.createDataFrame([("r1", "New"), ("r9", "Ninth")], "entity_id string, name string")
    return G.upsert(_e(spark, d).filter("entity_type = 'region'").select("entity_id", "name"), new, "entity_id")


@query(V.sql("SELECT entity_id, CASE WHEN entity_type = 'part' THEN least(1e0, relevance + 0.1e0) ELSE relevance END AS relevance FROM entities", "entities"))
def p3_bulk_update(spark, d):
    return G.update_where(_e(spark, d), F.col("entity_type") == "part", relevance=C.boosted(F.col("relevance"))).select("entity_id", "relevance")


#: White space of any script, and words with a letter or digit beyond ASCII: they become a mark, and then ASCII's word boundaries are those of every script.
_SP, _FOREIGN = "[\\s\\x0B\\x{85}\\p{Z}]", "[\\p{L}\\p{N}_]*(?:[^\\P{L}a-zA-Z]|[^\\P{N}0-9])[\\p{L}\\p{N}_]*"
_PH = f""", t AS (SELECT memory_id, regexp_replace(regexp_replace(regexp_replace(content, 'Round \\p{{Nd}}+:{_SP}*User:{_SP}*', '', 'g'), '{_SP}*\\|{_SP}*Assistant:{_SP}*', ' ', 'g'), '{_FOREIGN}', '0', 'g') AS x FROM memories),
l AS (SELECT memory_id, list_slice(regexp_extract_all(x, '\\b([A-Z][a-zA-Z]+(?:{_SP}+[A-Z][a-zA-Z]+)*)\\b', 1), 1, 5) || regexp_extract_all(x, '\\b([A-Z][a-zA-Z]{{2,}})\\b', 1) AS ls FROM t),
u AS (SELECT memory_id, unnest(ls) AS label, generate_subscripts(ls, 1) AS pos FROM l),
n AS (SELECT lower(trim(label)) AS key, min(memory_id * 1000000 + pos) AS place FROM u WHERE lower(trim(label)) NOT IN ({", ".join(f"'{w}'" for w in STOP)}) GROUP BY 1) """


@query(V.sql(_PH + ", h AS (SELECT * FROM n ORDER BY place LIMIT 3) SELECT h.key AS \"from\", n.key AS \"to\" FROM h JOIN n ON h.place < n.place", "memories"))
def p4_graph_from_memories(spark, d):
    return G.hub_edges(G.graph_from_phrases(V.memories(spark, d), tuple(STOP)))


_DEC = "CASE WHEN is_stable OR days_since_decay < 0.01 THEN relevance ELSE greatest(0.01e0, relevance * pow(0.5e0, days_since_decay / half_life_days)) END"


@query(V.sql(f"SELECT entity_id, round({_DEC}, 6) AS relevance FROM entities", "entities"))
def q1_decay(spark, d):
    return G.decay(_e(spark, d), F.col("days_since_decay")).select("entity_id", F.round("relevance", 6).alias("relevance"))


@query(V.sql(f"SELECT count(*) FILTER (WHERE NOT is_stable AND days_since_decay >= 0.01) AS processed, count(*) FILTER (WHERE {_DEC} < relevance) AS decayed, count(*) FILTER (WHERE {_DEC} < 0.1) AS below, (SELECT count(*) FROM relationships) AS edges FROM entities", "entities", "relationships"))
def q2_d9_decay_stats(spark, d):
    s = G.decay_stats(_e(spark, d), F.col("days_since_decay"))
    return s.crossJoin(V.relationships(spark, d).agg(F.count(F.lit(1)).alias("edges")))


def _parts(spark, d):
    p = V.table(spark, d, "part")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("attribute"), F.lit(False).alias("is_deprecated"), ((F.col("p_partkey") * 53 % 51 + 50) / 100.0).alias("confidence"), (F.col("p_partkey") % 7).alias("access_count"), ((F.col("p_partkey") * 37 % 101) / 100.0).alias("relevance"))


_J = jaccard_sql(words_sql("lower(a.p_name)"), words_sql("lower(b.p_name)"))
_CAND = f"c AS (SELECT 'p' || a.p_partkey AS a, 'p' || b.p_partkey AS b, a.p_partkey AS ka, b.p_partkey AS kb, 0.5e0 * {_J} + 0.2e0 + 0.3e0 * (a.p_brand = b.p_brand)::INT AS s FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey < b.p_partkey)"


@query(f"WITH {_CAND} SELECT a, b, round(s, 6) AS similarity FROM c WHERE s >= 0.6")
def q3_c10_merge_candidates(spark, d):
    return G.merge_candidates(_parts(spark, d), 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("WITH p AS (SELECT v.vec_id, v.label, embedding::DOUBLE[] AS e, list_extract(['red ring', 'red bolt', 'blue ring'], v.vec_id % 3 + 1) AS name FROM embeddings v), c AS (SELECT a.vec_id AS a, b.vec_id AS b, 0.7e0 * list_cosine_similarity(a.e, b.e) + 0.3e0 * CASE WHEN a.name = b.name THEN 1e0 WHEN a.vec_id % 3 + b.vec_id % 3 = 3 THEN 0e0 ELSE 1e0 / 3 END AS s FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, round(s, 6) AS similarity FROM c WHERE s >= 0.3")
def q4_semantic_candidates(spark, d):
    names = F.array(*map(F.lit, ("red ring", "red bolt", "blue ring")))
    name = F.element_at(names, (F.col("vec_id") % 3 + 1).cast("int"))
    v = V.table(spark, d, "embeddings").withColumn("v", F.struct(F.col("embedding").alias("e"), word_set(F.lower(name)).alias("w")))

    def tile(left, right):
        import numpy as np

        one, two = P.vectors([v["e"] for v in left]), P.vectors([v["e"] for v in right])
        x, y, n, m, both = P.common_words([v["w"] for v in left], [v["w"] for v in right])
        j = P.jaccard_matrix(n, m, both)

        def score(part, mask):
            s = 0.7 * P.cosines(one, two, part) + 0.3 * j[np.ix_(x[part], y)]
            for i, k in zip(*np.nonzero(mask & (np.abs(s - 0.3) < 1e-9)), strict=True):  # at the bound the order of the sum matters
                s[i, k] = 0.7 * P.cosine(left[part.start + i]["e"], right[k]["e"]) + 0.3 * j[x[part.start + i], y[k]]
            mask = mask & (s >= 0.3)
            return mask, [P.rounded(s[mask])]

        return score

    return P.all_pairs(v, "label", "vec_id", "v", tile, "a long, b long, similarity double")


_IMP = "(({k} * 53 % 51 + 50) / 100.0e0) * (1 + 0.1e0 * ({k} % 7)) * (({k} * 37 % 101) / 100.0e0)"


@query(f"WITH {_CAND} SELECT a, b, CASE WHEN {_IMP.format(k='ka')} >= {_IMP.format(k='kb')} THEN a ELSE b END AS keep FROM c WHERE s >= 0.6")
def q5_keep_side(spark, d):
    p = _parts(spark, d).withColumn("i", C.entity_importance(F.col("confidence"), F.col("access_count")) * F.col("relevance"))
    c = G.merge_candidates(p, 0.6, "i")
    return c.select("a", "b", F.when(G.keep_first(F.col("i_a"), F.col("i_b")), F.col("a")).otherwise(F.col("b")).alias("keep"))


_MERGES = [("s0", "s1"), ("s0", "s2"), ("s5", "s6")]


@query(V.sql("SELECT entity_id, round(CASE entity_id WHEN 's0' THEN least(1e0, confidence + 0.5e0 * (SELECT sum(confidence) FROM entities WHERE entity_id IN ('s1', 's2'))) WHEN 's5' THEN least(1e0, confidence + 0.5e0 * (SELECT confidence FROM entities WHERE entity_id = 's6')) ELSE confidence END, 6) AS confidence, access_count + CASE entity_id WHEN 's0' THEN (SELECT sum(access_count) FROM entities WHERE entity_id IN ('s1', 's2'))::BIGINT WHEN 's5' THEN (SELECT access_count FROM entities WHERE entity_id = 's6') ELSE 0 END AS access_count, is_deprecated OR entity_id IN ('s1', 's2', 's6') AS is_deprecated FROM entities WHERE entity_type = 'supplier'", "entities"))
def q6_apply_merge(spark, d):
    merges = F.broadcast(spark.createDataFrame(_MERGES, "keep string, gone string"))
    out, _ = G.apply_merges(_e(spark, d).filter("entity_type = 'supplier'"), V.relationships(spark, d), merges)
    return out.select("entity_id", F.round("confidence", 6).alias("confidence"), "access_count", "is_deprecated")


@query(V.sql("SELECT entity_id, is_deprecated OR relevance < 0.05 AS is_deprecated FROM entities", "entities"))
def q7_deprecate(spark, d):
    return G.update_where(_e(spark, d), F.col("relevance") < 0.05, is_deprecated=F.lit(True)).select("entity_id", "is_deprecated")


@query(V.sql("SELECT CASE WHEN subject_id = 's3' THEN 's3a' ELSE subject_id END AS subject_id, predicate, CASE WHEN object_id = 's3' THEN 's3a' ELSE object_id END AS object_id FROM relationships", "relationships"))
def q8_split(spark, d):
    return G.migrate(V.relationships(spark, d), F.broadcast(spark.createDataFrame([("s3", "s3a")], "from_id string, to_id string")))


@query(V.sql("SELECT entity_id, CASE WHEN entity_id = 'r2' THEN 'Renamed' ELSE name END AS name, CASE WHEN entity_id = 'r2' THEN 0.9e0 ELSE confidence END AS confidence FROM entities WHERE entity_type = 'region'", "entities"))
def q9_update_entity(spark, d):
    return G.update_where(_e(spark, d).filter("entity_type = 'region'"), F.col("entity_id") == "r2", name=F.lit("Renamed"), confidence=F.lit(0.9)).select("entity_id", "name", "confidence")


_PARTS = "e AS (SELECT 'p' || p_partkey AS entity_id, (p_partkey * 53 % 51 + 50) / 100.0e0 AS confidence, (p_partkey * 37 % 101) / 100.0e0 AS relevance FROM part)"
_CYCLE = f"""WITH RECURSIVE {_CAND}, {_PARTS}, k AS (SELECT CASE WHEN {_IMP.format(k='ka')} >= {_IMP.format(k='kb')} THEN a ELSE b END AS keep, CASE WHEN {_IMP.format(k='ka')} >= {_IMP.format(k='kb')} THEN b ELSE a END AS gone, greatest({_IMP.format(k='ka')}, {_IMP.format(k='kb')}) AS i FROM c WHERE s >= 0.9),
m AS (SELECT gone, max_by(keep, (i, keep)) AS keep FROM k GROUP BY gone),
r AS (SELECT gone, keep FROM m UNION ALL SELECT r.gone, m.keep FROM r JOIN m ON m.gone = r.keep),
t AS (SELECT gone, keep FROM r WHERE keep NOT IN (SELECT gone FROM m)),
u AS (SELECT keep, sum(confidence) AS plus FROM t JOIN e ON e.entity_id = gone GROUP BY keep)
SELECT entity_id, entity_id IN (SELECT gone FROM m) OR relevance < 0.05 AS is_deprecated, round(least(1e0, confidence + 0.5e0 * coalesce(plus, 0)), 6) AS confidence FROM e LEFT JOIN u ON keep = entity_id"""


@query("SELECT o_orderkey AS seq, o_custkey AS customer FROM orders WHERE o_custkey = 7")
def b17_records_of_entity(spark, d):
    """Every order is a record that touches its customer and itself."""
    records = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("customer"), F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")).alias("entity_ids"))
    return G.records_for(records, "c7").select("seq", "customer")


@query(_CYCLE)
def q10_evolution_cycle(spark, d):
    none = spark.createDataFrame([], "subject_id string, predicate string, object_id string")
    out, _ = G.evolve(_parts(spark, d), none, 0.9)
    return out.select("entity_id", "is_deprecated", F.round("confidence", 6).alias("confidence"))
