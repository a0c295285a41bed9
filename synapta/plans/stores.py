"""A*, B1 to B3, B10 to B16, C1, C8, C9, C13 to C16, D5 to D8, E*, F1 to F3, F7, G*: tables, logs, sets and windows."""

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from synapta import views as V
from synapta.operators import extract as X
from synapta.operators import history as G
from synapta.operators import hybrid as H
from synapta.operators import search as S
from synapta.plans import query
from synapta.plans.memory import _JOBS, jobs
from synapta.plans.scalars import values
from synapta.plans.search import _T, TERMS, _docs, _keyword, _LISTS, _semantic
from synapta.sources import stores as A
from synapta.storage import work_folder


def _m(spark, d):
    return V.messages(spark, d)


@query(V.sql("SELECT session_id, min(ts) AS created FROM messages GROUP BY session_id", "messages"))
def a2_sessions(spark, d):
    return _m(spark, d).groupBy("session_id").agg(F.min(F.unix_timestamp("ts")).alias("created"))


@query(V.sql("SELECT session_id, count(*) AS message_count, sum(len(content) // 4)::BIGINT AS token_count FROM messages GROUP BY session_id", "messages"))
def a3_message_counts(spark, d):
    return A.session_counts(_m(spark, d))


@query(V.sql("SELECT message_id, role, content FROM messages WHERE session_id = 7 ORDER BY seq", "messages"))
def a4_message_scan(spark, d):
    return _m(spark, d).filter("session_id = 7").orderBy("seq").select("message_id", "role", "content")


@query(V.sql("SELECT session_id, message_id, role, strlen(content) AS byte_length, coalesce(sum(strlen(content)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM messages", "messages"))
def a5_e3_message_index(spark, d):
    return A.message_index(_m(spark, d))


@query(V.sql("SELECT op_id, op_kind, json_extract(input, '$.k')::BIGINT AS k FROM operations WHERE session_id = 8", "operations"))
def a6_operation_log(spark, d):
    return V.operations(spark, d).filter("session_id = 8").select("op_id", "op_kind", F.get_json_object("input", "$.k").cast("long").alias("k"))


@query(V.sql("SELECT memory_id, session_id FROM memories WHERE tier = 'short'", "memories"))
def a7_tier_scan(spark, d):
    return V.memories(spark, d).filter("tier = 'short'").select("memory_id", "session_id")


@query(V.sql("SELECT memory_id, tier FROM memories WHERE memory_id = 42", "memories"))
def a8_point_lookup(spark, d):
    return A.point_lookup(V.memories(spark, d), 42).select("memory_id", "tier")


@query("SELECT o_custkey AS id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def a10_upsert(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("latest"), F.struct("o_orderdate", "o_orderkey").alias("version"))
    return A.latest(o, "id", "version").drop("version")


@query(V.sql("SELECT DISTINCT session_id FROM messages WHERE session_id NOT IN (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0)", "messages"))
def a13_session_sync(spark, d):
    known = V.table(spark, d, "events").filter("user_id % 3 = 0").select(F.col("user_id").alias("session_id"))
    return A.missing(_m(spark, d).select("session_id").distinct(), known, "session_id")


_OPS = "WHERE op_kind IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"


@query(V.sql(f"SELECT op_id, op_kind FROM operations {_OPS} ORDER BY ts, op_id LIMIT 100", "operations"))
def b1_operation_filter(spark, d):
    return A.filter_operations(V.operations(spark, d), ["click", "error"], "2024-01-05", "2024-01-20 12:00:00", 100).select("op_id", "op_kind")


@query(V.sql("SELECT op_id FROM operations WHERE op_kind = 'error'", "operations"))
def b2_by_type(spark, d):
    return A.filter_operations(V.operations(spark, d), ["error"]).select("op_id")


@query(V.sql("SELECT op_id FROM (SELECT * FROM operations ORDER BY ts, op_id LIMIT 200) WHERE op_kind = 'click'", "operations"))
def b3_trace(spark, d):
    return A.trace(V.operations(spark, d), "click", 200).select("op_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey DESC LIMIT 20")
def b10_session_metadata(spark, d):
    c = V.table(spark, d, "customer").filter("c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
    return c.orderBy(F.desc("c_custkey")).limit(20).select("c_custkey", "c_name")


@query(V.sql("SELECT message_id, 0.9e0 AS score FROM messages WHERE regexp_matches(content, '(?i)th[aeiou]n\\b')", "messages"))
def b11_regex_scan(spark, d):
    return A.scan_messages(_m(spark, d), r"th[aeiou]n\b", "regex").select("message_id", "score")


@query(V.sql("SELECT message_id, 1.0e0 AS score, substring(content, 1, 200) AS snippet FROM messages WHERE contains(lower(content), 'than')", "messages"))
def b12_text_scan(spark, d):
    return A.scan_messages(_m(spark, d), "Than", "text").select("message_id", "score", "snippet")


@query(V.sql("SELECT memory_id, 0.8e0 AS score FROM memories WHERE tier IN ('working', 'long') AND contains(lower(content), 'license')", "memories"))
def b13_tier_retrieve(spark, d):
    return A.scan_messages(V.memories(spark, d).filter(F.col("tier").isin("working", "long")), "license", "memory").select("memory_id", "score")


@query(V.sql(_JOBS + "SELECT job_id FROM j WHERE status = 'running'", "operations"))
def b14_jobs_by_status(spark, d):
    return jobs(spark, d).filter("status = 'running'").select("job_id")


@query(V.sql("SELECT subject_id, predicate, object_id FROM relationships WHERE subject_id = 's3' OR object_id = 's3'", "relationships"))
def b16_links_touching(spark, d):
    return V.relationships(spark, d).filter("subject_id = 's3' OR object_id = 's3'")


@query(f"WITH d AS (SELECT doc_id, text AS content FROM documents), t AS (SELECT doc_id, unnest({_T}) AS term FROM d) SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN ('from', 'ther', 'thon') GROUP BY ALL")
def c1_postings_lookup(spark, d):
    terms = F.broadcast(spark.createDataFrame([(t,) for t in TERMS], "term string"))
    return S.postings(_docs(spark, d)).join(terms, "term").select("term", "doc_id", "tf")


@query(_LISTS + "SELECT e.doc_id, coalesce(d.source, '') AS source FROM e LEFT JOIN documents d ON d.doc_id = e.doc_id AND d.doc_id % 2 = 0")
def c8_hit_info(spark, d):
    info = V.table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id", "source")
    return _semantic(spark, d).join(info, "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))


@query(_LISTS + "SELECT doc_id, coalesce(kr, 0) AS kr, coalesce(er, 0) AS er FROM f")
def c9_full_outer(spark, d):
    k = _keyword(spark, d).select("doc_id", F.col("rank").cast("long").alias("kr"))
    e = _semantic(spark, d).select("doc_id", F.col("rank").cast("long").alias("er"))
    return k.join(e, "doc_id", "full_outer").na.fill(0, ["kr", "er"])


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def c14_duplicate_skip(spark, d):
    t = V.table(spark, d, "documents")
    return t.filter("doc_id % 2 = 1").join(t.filter("doc_id % 2 = 0").select("text").distinct(), "text", "left_anti").select("doc_id")


_MENTIONS = [("nation_3",), ("REGION_1",), ("nowhere",)]


@query(V.sql(f"SELECT m.q AS mention, coalesce(min(entity_id), '') AS entity_id FROM {values(_MENTIONS, 'q').replace(' t(', ' m(')} LEFT JOIN entities ON lower(name) = lower(m.q) GROUP BY m.q", "entities"))
def c15_r13_link_mentions(spark, d):
    m = F.broadcast(spark.createDataFrame(_MENTIONS, "mention string"))
    e = V.entities(spark, d).select(F.lower("name").alias("low"), "entity_id")
    return m.join(e, F.lower("mention") == F.col("low"), "left").groupBy("mention").agg(F.coalesce(F.min("entity_id"), F.lit("")).alias("entity_id"))


_TRIPLES = [("NATION_1", "near", "NATION_2"), ("NATION_1", "in", "Atlantis"), ("REGION_0", "holds", "NATION_3")]


@query(V.sql(f", n AS (SELECT name, max_by(entity_id, key) AS id FROM entities GROUP BY name) SELECT a.id AS subject_id, t.p AS predicate, b.id AS object_id FROM {values(_TRIPLES, 's, p, o')} JOIN n a ON a.name = t.s JOIN n b ON b.name = t.o", "entities"))
def c16_resolve_triples(spark, d):
    t = F.broadcast(spark.createDataFrame(_TRIPLES, "s string, p string, o string"))
    n = V.entities(spark, d).groupBy("name").agg(F.max_by("entity_id", "key").alias("id"))
    a, b = n.select(F.col("name").alias("s"), F.col("id").alias("subject_id")), n.select(F.col("name").alias("o"), F.col("id").alias("object_id"))
    return t.join(a, "s").join(b, "o").select("subject_id", F.col("p").alias("predicate"), "object_id")


@query(f"WITH d AS (SELECT doc_id, text AS content FROM documents), t AS (SELECT doc_id, {_T} AS w FROM d) SELECT count(*) AS n, round(avg(len(w)), 6) AS avgdl, (SELECT count(DISTINCT term) FROM (SELECT unnest(w) AS term FROM t)) AS terms FROM t")
def d5_d6_corpus_stats(spark, d):
    c = S.term_counts(_docs(spark, d), TERMS).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))
    return c.crossJoin(S.vocabulary(_docs(spark, d)).agg(F.count(F.lit(1)).alias("terms")))


@query(V.sql("SELECT (SELECT count(DISTINCT session_id) FROM messages) AS sessions, (SELECT count(*) FROM messages) AS messages, count(*) FILTER (WHERE tier = 'working') AS working, count(*) FILTER (WHERE tier = 'short') AS short, count(*) FILTER (WHERE tier = 'long') AS long FROM memories", "messages", "memories"))
def d7_store_stats(spark, d):
    m = V.memories(spark, d).agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("working", "short", "long")])
    return _m(spark, d).agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("messages")).crossJoin(m)


@query(V.sql(_JOBS + "SELECT status, count(*) AS n FROM j GROUP BY status", "operations"))
def d8_scheduler_stats(spark, d):
    return jobs(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(V.sql("SELECT op_kind, count(*) AS total, count(*) FILTER (WHERE duration >= 5) AS ok, count(*) FILTER (WHERE duration < 5) AS failed, min(op_id) AS first, max(op_id) AS last FROM operations GROUP BY op_kind", "operations"))
def d10_history_stats(spark, d):
    o = V.operations(spark, d)
    return o.groupBy("op_kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("duration") >= 5).alias("ok"), F.count_if(F.col("duration") < 5).alias("failed"), F.min("op_id").alias("first"), F.max("op_id").alias("last"))


@query(V.sql("SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relationships) AS relationships, 0::BIGINT AS arguments", "entities", "relationships"))
def d11_kg_stats(spark, d):
    n = lambda t, c: t.agg(F.count(F.lit(1)).alias(c))
    return n(V.entities(spark, d), "entities").crossJoin(n(V.relationships(spark, d), "relationships")).withColumn("arguments", F.lit(0).cast("long"))


@query(_LISTS + "SELECT doc_id, rank, round(score / greatest((SELECT max(score) FROM k), 0.001), 6) AS share FROM k")
def e1_e2_rank_and_share(spark, d):
    k = _keyword(spark, d)
    best = F.broadcast(k.agg(F.greatest(F.max("score"), F.lit(0.001)).alias("best")))
    return k.crossJoin(best).select("doc_id", F.col("rank").cast("long").alias("rank"), F.round(F.col("score") / F.col("best"), 6).alias("share"))


@query(V.sql("SELECT session_id, message_id FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3", "messages"))
def e4_last_messages(spark, d):
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    return _m(spark, d).withColumn("n", n).filter("n <= 3").select("session_id", "message_id")


@query(V.sql("SELECT session_id, op_id FROM operations QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, op_id DESC) <= 10", "operations"))
def e5_ring_buffer(spark, d):
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("op_id")))
    return V.operations(spark, d).withColumn("n", n).filter("n <= 10").select("session_id", "op_id")


@query(V.sql(", o AS (SELECT session_id, (duration >= 5)::INT AS ok, row_number() OVER (PARTITION BY session_id ORDER BY ts, op_id) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM operations) SELECT session_id, round(pow(0.9e0, max(n)) + sum(0.1e0 * pow(0.9e0, n - i) * ok), 6) AS rate FROM o GROUP BY session_id", "operations"))
def e6_success_rate(spark, d):
    o = V.operations(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("ts", "op_id", (F.col("duration") >= 5).cast("double").alias("ok")))).alias("o"))
    return o.select("session_id", F.round(F.aggregate("o", F.lit(1.0), lambda s, x: 0.9 * s + 0.1 * x["ok"]), 6).alias("rate"))


@query(V.sql("SELECT session_id, op_id, CASE WHEN row_number() OVER w <= 20 THEN 'working' WHEN row_number() OVER w <= 100 THEN 'short' ELSE 'long' END AS tier FROM operations WINDOW w AS (PARTITION BY session_id ORDER BY ts DESC, op_id DESC)", "operations"))
def e7_recency_tiers(spark, d):
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("op_id")))
    return V.operations(spark, d).select("session_id", "op_id", F.when(n <= 20, "working").when(n <= 100, "short").otherwise("long").alias("tier"))


@query(_LISTS + "SELECT doc_id, round(score, 6) AS score FROM k ORDER BY rank LIMIT 1")
def f1_f2_clamped_limit(spark, d):
    return S.top(_keyword(spark, d), S.clamp_limit(0)).select("doc_id", F.round("score", 6).alias("score"))


@query(V.sql("SELECT message_id FROM messages ORDER BY session_id, seq LIMIT 15 OFFSET 30", "messages"))
def f3_page(spark, d):
    return _m(spark, d).orderBy("session_id", "seq").offset(30).limit(15).select("message_id")


@query(_LISTS + "SELECT doc_id FROM k UNION SELECT doc_id FROM e")
def g1_union_of_ids(spark, d):
    return _keyword(spark, d).select("doc_id").union(_semantic(spark, d).select("doc_id")).distinct()


@query(_LISTS + ", u AS (SELECT doc_id, rank, 0 AS side FROM k UNION ALL SELECT doc_id, rank, 1 FROM e) SELECT doc_id, side FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, side) = 1")
def g2_keep_first(spark, d):
    return H.interleave(_keyword(spark, d), _semantic(spark, d), 1000).select("doc_id", "side")


@query(V.sql("SELECT memory_id FROM memories WHERE tier = 'long' UNION ALL SELECT memory_id FROM memories WHERE tier = 'working'", "memories"))
def g3_tiers_together(spark, d):
    m = V.memories(spark, d)
    return m.filter("tier = 'long'").unionByName(m.filter("tier = 'working'")).select("memory_id")


@query("SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['small', 'ring'])) AS common, len(list_distinct(string_split(p_name, ' ') || ['small', 'ring'])) AS united FROM part")
def g4_token_sets(spark, d):
    w, q = F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring"))
    return V.table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(w, q)).cast("long").alias("common"), F.size(F.array_union(w, q)).cast("long").alias("united"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substring(trim(lower(text)), 1, 100) ORDER BY doc_id) = 1")
def g7_prefix_dedup(spark, d):
    n = F.row_number().over(Window.partitionBy(F.substring(F.trim(F.lower("text")), 1, 100)).orderBy("doc_id"))
    return V.table(spark, d, "documents").select("doc_id", n.alias("n")).filter("n = 1").select("doc_id")


def _store(spark):
    return A.Store.init(spark, work_folder(spark, "store"))


@query("SELECT 'documents' AS name, 1 AS version, count(*) AS n FROM documents")
def a1_open_store(spark, d):
    """A table written to a new store and read after the store was opened again."""
    store = _store(spark)
    store.write("documents", V.table(spark, d, "documents").select("doc_id"))
    again = A.Store.open(spark, store.path)
    return again.read("documents").agg(F.lit("documents").alias("name"), F.lit(again.versions("documents")[-1]).alias("version"), F.count(F.lit(1)).alias("n")).select("name", "version", "n")


@query(V.sql("SELECT 'node' AS kind, entity_id AS id, name AS label, entity_type AS other FROM entities UNION ALL SELECT 'edge', subject_id, predicate, object_id FROM relationships", "entities", "relationships"))
def a9_graph_round_trip(spark, d):
    store = _store(spark)
    A.save_graph(store, V.entities(spark, d), V.relationships(spark, d))
    nodes, edges = A.load_graph(store)
    n = nodes.select(F.lit("node").alias("kind"), F.col("entity_id").alias("id"), F.col("name").alias("label"), F.col("entity_type").alias("other"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("subject_id").alias("id"), F.col("predicate").alias("label"), F.col("object_id").alias("other")))


@query("SELECT 'good' AS name, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT 'also', r_regionkey FROM region")
def a11_transaction(spark, d):
    """Two tables in one commit; a commit with a failing table leaves no trace in the other."""
    store = _store(spark)
    ids = lambda t, c: V.table(spark, d, t).select(F.col(c).cast("long").alias("id"))
    store.transaction({"good": ids("nation", "n_nationkey"), "also": ids("region", "r_regionkey")})
    try:
        store.transaction({"good": ids("region", "r_regionkey"), "also": ids("nation", "n_nationkey").select("id", "id")})
    except AnalysisException as e:
        if "COLUMN_ALREADY_EXISTS" not in str(e):
            raise
    return store.read("good").select(F.lit("good").alias("name"), "id").unionByName(store.read("also").select(F.lit("also").alias("name"), "id"))


@query("SELECT c_mktsegment AS user_id, count(*) AS sessions, sum(c_nationkey)::BIGINT AS messages FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_mktsegment")
def a12_metadata(spark, d):
    """Users, settings and sessions; sessions of an unknown user are refused."""
    store, now, none = _store(spark), V.now(), F.lit(None).cast("string")
    settings = spark.createDataFrame([(1, "{}", "{}", "{}", None)], "id int, llm string, embedding string, server string, kg_extraction string").withColumn("updated_at", now)
    A.init_metadata(store, settings)
    c = V.table(spark, d, "customer")
    users = c.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("id")).distinct()
    store.write("users", users.select("id", F.col("id").alias("name"), none.alias("avatar"), now.alias("created_at"), F.lit("{}").alias("settings")))
    sessions = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("user_id"), F.col("c_name").alias("name"), F.lit("chat").alias("session_type"), F.lit("m").alias("model"), F.lit("").alias("store_path"), now.alias("created_at"), now.alias("updated_at"), F.col("c_nationkey").cast("int").alias("message_count"), none.alias("tags"))
    A.add_sessions(store, sessions)
    return store.read("sessions").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"))


@query("SELECT 'c' || conv_id AS sample_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no, role AS speaker, sha256(text) AS text_sha256 FROM conversations")
def a14_dialogues(spark, d):
    """Nested dialogues written as JSON and read as turns."""
    c = V.table(spark, d, "conversations")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("text"), t["turn"].cast("string").alias("dia_id")))
    path = work_folder(spark, "dialogues")
    c.groupBy("conv_id").agg(F.array(turns).alias("sessions")).select(F.concat(F.lit("c"), "conv_id").alias("sample_id"), "sessions").write.json(path)
    t, _ = A.read_dialogues(spark, path, whole=False)
    return t.select("sample_id", F.col("turn_no").cast("long").alias("turn_no"), "speaker", F.sha2("text", 256).alias("text_sha256"))


_ONTOLOGY = [("领域情报类", "科技情报", "人工智能"), ("领域情报类", "科技情报", "半导体芯片"), ("领域情报类", "一级分类", "x"), ("领域情报类", "产业情报", "y"), ("要素情报类", "人物追踪", "z"), ("要素情报类", "---------", "z"), ("other", "a b", "c")]
_ONT = f"SELECT t || '-' || f || '-' || s AS id, t, f, s FROM {values([(t, f.replace(' ', '-'), s) for t, f, s in _ONTOLOGY if f not in A.TEMPLATE_ROWS], 't, f, s')}"


def _ontology(spark):
    path = work_folder(spark, "ontology")
    spark.createDataFrame(_ONTOLOGY, "top_category string, first_category string, second_category string").coalesce(1).write.json(path)
    return A.read_ontology(spark, path, whole=False)


@query(f"SELECT id FROM ({_ONT})")
def a15_ontology(spark, d):
    return _ontology(spark).select("id")


@query(f"SELECT id FROM ({_ONT}) WHERE t = '领域情报类' AND f = '科技情报'")
def b15_category(spark, d):
    return A.find_category(_ontology(spark), "领域情报类", "科技情报").select("id")


@query(f"SELECT id, CASE WHEN s = '人工智能' THEN 'ai' WHEN s = '半导体芯片' THEN 'semiconductor' WHEN f = '产业情报' THEN 'industry' WHEN f = '人物追踪' THEN 'person' ELSE 'generic' END AS domain FROM ({_ONT})")
def r8_domain(spark, d):
    return A.domain(_ontology(spark)).select("id", "domain")


@query("SELECT doc_id, lang, sha256(regexp_replace(text, '^[\\s\\x0B]+', '')) AS body_sha256 FROM documents WHERE text IS NOT NULL")
def a16_markdown(spark, d):
    """Documents as Markdown with a head of JSON, and back."""
    t = V.table(spark, d, "documents").filter("text IS NOT NULL")
    back = t.select("doc_id", A.from_markdown(A.to_markdown(F.struct("lang", "source"), F.col("text")), "lang string, source string").alias("m"))
    return back.select("doc_id", "m.frontmatter.lang", F.sha2("m.content", 256).alias("body_sha256"))


@query("SELECT item_id, text FROM benchmark")
def a17_results_sink(spark, d):
    path = work_folder(spark, "results")
    A.write_results(V.table(spark, d, "benchmark").select("item_id", "text"), path)
    return spark.read.schema("item_id long, text string").json(path)


@query(V.sql("SELECT memory_id, tier FROM memories WHERE memory_id % 2 = 0", "memories"))
def m4_restored_checkpoint(spark, d):
    """The first version, after a second one was written and the first restored."""
    store, m = _store(spark), V.memories(spark, d).select("memory_id", "tier")
    first = store.write("memories", m.filter("memory_id % 2 = 0"), ("tier",))
    store.append("memories", m.filter("memory_id % 2 = 1"))
    store.restore("memories", first)
    return store.read("memories").select("memory_id", "tier")


@query("SELECT item_id, sha256('You extract.' || chr(10) || chr(10) || '## Entities' || chr(10) || chr(10) || 'person' || chr(10) || chr(10) || 'Stage 1' || chr(10) || chr(10) || '## Text' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || 'Answer with the JSON only.') AS prompt_sha256 FROM benchmark")
def r9_prompts(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", F.sha2(X.prompt(F.col("text"), "You extract.", {"Entities": "person"}, "Stage 1"), 256).alias("prompt_sha256"))


@query(V.sql("SELECT 'HEAD' AS name, max_by(oid, seq) AS oid FROM commits WHERE branch = 7 UNION ALL SELECT 'branch-9', max_by(oid, seq) FROM commits WHERE branch = 9 AND branch % 5 <> 0", "commits"))
def s5_refs(spark, d):
    """A symbolic head and a branch; refs of every fifth branch were deleted."""
    c = V.commits(spark, d)
    log = c.select(F.concat(F.lit("branch-"), "branch").alias("name"), "oid", "seq").unionByName(c.filter("branch % 5 = 0").select(F.concat(F.lit("branch-"), "branch").alias("name"), F.lit(None).cast("long").alias("oid"), F.lit(1 << 30).alias("seq")))
    refs = G.current_refs(log).withColumn("target", F.lit(None).cast("string")).unionByName(spark.createDataFrame([("HEAD", None, "branch-7")], "name string, oid long, target string"))
    return spark.createDataFrame([(n, G.resolve_ref(refs, n)) for n in ("HEAD", "branch-9")], "name string, oid long")
