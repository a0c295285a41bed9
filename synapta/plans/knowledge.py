"""D12, E8, H20, R*: extraction of facts, entities and relations."""

from pyspark.sql import functions as F

from synapta import views as V
from synapta.operators import extract as E
from synapta.plans import query
from synapta.plans.scalars import CHATS, _any_sql, values
from synapta.functions import text as X


def _messages(spark):
    return spark.createDataFrame(CHATS, "message_id long, content string")


_RULES = " UNION ALL ".join(f"SELECT id::BIGINT AS message_id, trim(substring(t, len(regexp_extract(lower(t), '(?s)^(.*?)(?:{p})', 1)) + 1)) AS content, '{c}' AS category, {x}e0 AS confidence FROM {values(CHATS, 'id, t')} WHERE regexp_matches(lower(t), '{p}')" for p, c, x in E.FACT_RULES)


@query(_RULES)
def r1_rule_facts(spark, d):
    return E.rule_facts(_messages(spark))


_CAPS = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w), e AS (SELECT doc_id, pos, regexp_replace(word, '[!-/:-@\\[-`{-~]+$', '') AS name FROM u WHERE regexp_matches(word, '^[A-Z]')), f AS (SELECT * FROM e WHERE strlen(name) > 1) "


@query(_CAPS + "SELECT doc_id, count(*) AS n, count(DISTINCT name) AS names FROM f GROUP BY doc_id")
def r2_rule_entities(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return E.rule_entities(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


@query(_CAPS + ", l AS (SELECT doc_id, lag(name) OVER (PARTITION BY doc_id ORDER BY pos) AS subject, name AS object FROM f) SELECT subject, object, count(*) AS n FROM l WHERE subject IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def e8_adjacent_entities(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return E.neighbours_related(E.rule_entities(docs)).groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


ANSWERS = [
    (1, '{"facts": [{"content": "likes tea", "category": "preference", "confidence": 0.9}, {"content": "maybe", "confidence": 0.2}, {"content": "lives here"}]}'),
    (2, 'Sure: {"facts": [{"content": "plans a trip", "category": "plan", "confidence": 0.5}]} Done.'),
    (3, "no json"),
]
_FACTS = [(1, 0, "likes tea", "preference", 0.9), (1, 2, "lives here", "unknown", 0.5), (2, 0, "plans a trip", "plan", 0.5)]


@query(f"SELECT a::BIGINT AS answer_id, i::BIGINT AS i, content, category, c AS confidence FROM {values(_FACTS, 'a, i, content, category, c')}")
def r3_parse_facts(spark, d):
    return E.parse_facts(spark.createDataFrame(ANSWERS, "answer_id long, text string")).withColumn("i", F.col("i").cast("long"))


GRAPHS = [
    (1, '```json\n{"entities": [{"name": "Neo", "type": "person", "confidence": 0.9, "temporal_relevance": "permanent"}, {"name": "Spoon", "type": "thing", "confidence": 0.3}], "relationships": [{"subject": "Neo", "predicate": "knows", "object": "Trinity", "confidence": 0.7}], "events": [{"name": "call", "confidence": 0.8, "timestamp": "2024-01-02T03:04:05Z"}, {"name": "odd", "confidence": 0.8, "timestamp": "soon"}]}\n```'),
    (2, '{"entities": [], "relationships": []}'),
]


def _graphs(spark):
    return E.parse_graph(spark.createDataFrame(GRAPHS, "answer_id long, text string"))


@query("SELECT * FROM (VALUES (1::BIGINT, 'Neo', 'knows', 'Trinity')) t(answer_id, subject, predicate, object)")
def r4_parse_relations(spark, d):
    return _graphs(spark).select("answer_id", F.explode("relationships").alias("r")).select("answer_id", "r.subject", "r.predicate", "r.object")


@query("SELECT * FROM (VALUES (1::BIGINT, 'call', 1704164645::BIGINT), (1, 'odd', -1)) t(answer_id, name, ts)")
def r5_event_times(spark, d):
    return E.event_times(_graphs(spark)).select("answer_id", "name", F.coalesce(F.unix_timestamp("ts"), F.lit(-1).cast("long")).alias("ts"))


@query("SELECT * FROM (VALUES (1::BIGINT, 0.8e0), (2, 0e0)) t(answer_id, confidence)")
def d12_extraction_confidence(spark, d):
    return _graphs(spark).select("answer_id", F.round("confidence", 6).alias("confidence"))


_NAMES = [("License", "Legal"), ("Apache", "Organization"), ("Nicht", "Word")]


@query(f"SELECT doc_id, name, kind AS entity_type, 0.85e0 AS confidence FROM documents JOIN {values(_NAMES, 'name, kind')} ON contains(text, name)")
def r6_dictionary(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return E.dictionary_entities(docs, spark.createDataFrame(_NAMES, "name string, entity_type string"))


@query(f"SELECT doc_id, count(name) AS entities, strlen(any_value(text)) + 50 * count(name) AS tokens_used FROM documents LEFT JOIN {values(_NAMES, 'name, kind')} ON contains(text, name) GROUP BY doc_id")
def r7_extraction_jobs(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return E.extraction_jobs(docs, E.dictionary_entities(docs, spark.createDataFrame(_NAMES, "name string, entity_type string")))


@query(V.sql("SELECT session_id, count(*) AS n FROM messages, (VALUES ('The'), ('And'), ('Der')) t(name) WHERE contains(content, name) AND content <> '' GROUP BY session_id", "messages"))
def r10_session_extraction(spark, d):
    m = V.messages(spark, d).filter("content <> ''").select("session_id", F.col("message_id").alias("doc_id"), "content")
    names = spark.createDataFrame([("The", "w"), ("And", "w"), ("Der", "w")], "name string, entity_type string")
    return E.dictionary_entities(m, names).join(m.select("doc_id", "session_id"), "doc_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


_KEEP = f"CASE WHEN {_any_sql('content', X.IMPORTANT)} THEN true WHEN {_any_sql('content', X.NOISE)} THEN false ELSE len(trim(content)) > 100 END"


@query(V.sql(f", f AS (SELECT * FROM messages WHERE lower(role) <> 'system' AND content <> '' QUALIFY row_number() OVER (PARTITION BY substring(trim(lower(content)), 1, 100) ORDER BY message_id) = 1) SELECT message_id, len(content) AS size FROM f WHERE {_KEEP}", "messages"))
def r11_reload_memories(spark, d):
    return E.reload_memories(V.messages(spark, d)).select("message_id", F.length("content").cast("long").alias("size"))


@query(V.sql(f", r AS (SELECT session_id, seq, role, trim(content) AS content FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 20), s AS (SELECT session_id, string_agg(CASE WHEN len(content) > 100 THEN substring(content, 1, 100) || '...' ELSE content END, ' ' ORDER BY seq) AS s FROM r WHERE lower(role) = 'user' AND content <> '' AND {_KEEP} GROUP BY session_id) SELECT session_id, CASE WHEN len(s) > 500 THEN substring(s, 1, 500) || '...' ELSE s END AS summary FROM s", "messages"))
def r12_session_summary(spark, d):
    return E.session_summary(V.messages(spark, d))
