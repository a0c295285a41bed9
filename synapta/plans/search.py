"""I*, J*, K*: text search, vector search, fusion, routing and retrieval strategies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from synapta import views as V
from synapta.functions import text as X
from synapta.operators import hybrid as H
from synapta.operators import search as S
from synapta.operators import vector as VS
from synapta.operators import hierarchy as R
from synapta.plans import query
from synapta.plans.graph import _FOREIGN
from synapta.sources import stores as A
from synapta.storage import work_folder

TERMS = ["from", "ther", "thon"]
_T = "list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^\\p{L}\\p{M}\\p{N}\\s]', '', 'g'), '\\s+'), lambda x: strlen(x) >= 2)"
_C = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}'))" for t in TERMS)


def _bm25(long: str, where: str = "true", tail: str = "", source: str = "documents", k1: float = 1.2, b: float = 0.75, most: str = "s") -> str:
    docs = "SELECT doc_id, source AS session_id, text AS content, 'memory' AS doc_type FROM documents" if source == "documents" else "SELECT * FROM search_docs"
    parts = " + ".join(
        f"CASE WHEN tf[{i}] > 0 THEN greatest(0e0, ln((n - df{i} + 0.5e0) / (df{i} + 0.5e0) + 1)) * tf[{i}] * {k1 + 1}e0 / (tf[{i}] + {k1}e0 * ({1 - b}e0 + {b}e0 * {long.format(i=i)} / avgdl)) ELSE 0e0 END" for i in (1, 2, 3)
    )
    return f"""d AS ({docs}), t AS (SELECT *, {_T} AS toks FROM d), c AS (SELECT doc_id, session_id, doc_type, len(toks) AS dl, [{_C}] AS tf FROM t),
      st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf[1] > 0) AS df1, count(*) FILTER (WHERE tf[2] > 0) AS df2, count(*) FILTER (WHERE tf[3] > 0) AS df3 FROM c),
      h AS (SELECT doc_id, session_id, doc_type, dl, {parts} AS s FROM c, st WHERE (tf[1] > 0 OR tf[2] > 0 OR tf[3] > 0) AND ({where}))
    SELECT doc_id, round({most}, 6) AS score FROM h WHERE s > 0 {tail}"""


def _docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.col("source").alias("session_id"), F.col("text").alias("content"), F.lit("memory").alias("doc_type"))


def _out(df):
    return df.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH d AS (SELECT doc_id, text AS content FROM documents), t AS (SELECT doc_id, unnest({_T}) AS term FROM d), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM p GROUP BY term")
def i1_postings(spark, d):
    return S.postings(_docs(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max(F.size("positions")).cast("long").alias("max_tf"))


@query("WITH " + _bm25("tf[{i}]", most="least(s, 100e0)"))
def i2_bm25_native(spark, d):
    return _out(S.bm25(_docs(spark, d), TERMS, length="tf", most=100.0))


@query("WITH " + _bm25("dl", tail="ORDER BY s DESC, doc_id LIMIT 20"))
def i3_bm25_topk(spark, d):
    return _out(S.top(S.bm25(_docs(spark, d), TERMS), 20))


@query(V.sql(", " + _bm25("dl", "doc_type = 'message'", source="all"), "search_docs"))
def i4_scoped_search(spark, d):
    return _out(S.bm25(V.search_docs(spark, d), TERMS, where=F.col("doc_type") == "message"))


@query("WITH " + _bm25("dl", tail="ORDER BY s DESC, doc_id LIMIT 20"))
def i6_query_string(spark, d):
    """A query text, split by the index's own tokenizer."""
    return _out(S.search(_docs(spark, d), "From? THER, thon from!", 20))


@query("SELECT conv_id, turn, 'text: ' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || role AS content FROM conversations")
def i11_multipart_text(spark, d):
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    c = V.table(spark, d, "conversations")
    return c.select("conv_id", "turn", S.multipart_text(F.array(part("text", F.lit("text: ")), part("text", F.col("text")), part("image", F.lit("x.png")), part("text", F.col("role")))).alias("content"))


@query("WITH " + _bm25("dl").replace("FROM documents", "FROM documents WHERE source <> 'src3'", 1))
def i5_session_deleted(spark, d):
    gone = spark.createDataFrame([("src3",)], "session_id string")
    return _out(S.bm25(S.without_sessions(_docs(spark, d), gone), TERMS))


@query(f"WITH d AS (SELECT doc_id, text AS content FROM documents), t AS (SELECT doc_id, {_T} AS w FROM d), m AS (SELECT doc_id, len(list_filter(range(1, greatest(len(w), 1)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS matches FROM t) SELECT doc_id, matches FROM m WHERE matches > 0")
def i7_phrase(spark, d):
    return S.phrase(_docs(spark, d), ["of", "the"]).select("doc_id", "matches")


_VOC = f"WITH d AS (SELECT doc_id, text AS content FROM documents), t AS (SELECT doc_id, unnest({_T}) AS term FROM d), v AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term) "


@query(_VOC + "SELECT term, df, cf, levenshtein(term, 'thonon') AS distance FROM v WHERE term LIKE 'th%' AND levenshtein(term, 'thonon') <= 2 ORDER BY distance, df DESC, term LIMIT 50")
def i8_fuzzy(spark, d):
    return S.fuzzy_terms(_docs(spark, d), "thonon", 2, 2)


@query(_VOC + "SELECT term, df, cf FROM v WHERE regexp_matches(term, '^th.*tion$')")
def i9_regex_terms(spark, d):
    return S.regex_terms(_docs(spark, d), "^th.*tion$")


@query("WITH " + _bm25("dl", tail="ORDER BY doc_id LIMIT 25"))
def i10_sorted_by_id(spark, d):
    return _out(S.top(S.bm25(_docs(spark, d), TERMS), 25, *S.ORDERS["doc_id"]()))


QUERY_ID = 7
_COS = "list_cosine_similarity(v.vector::DOUBLE[], q.vector::DOUBLE[])"


def _query_vector(spark, d):
    return V.vectors(spark, d).filter(F.col("doc_id") == QUERY_ID).select("vector").first()["vector"]


@query(V.sql(f"SELECT v.doc_id, round({_COS}, 6) AS score FROM vectors v, vectors q WHERE q.doc_id = {QUERY_ID} AND {_COS} >= 0.1 ORDER BY {_COS} DESC, v.doc_id LIMIT 20", "vectors"))
def j2_vector_topk(spark, d):
    return _out(S.top(VS.similar(V.vectors(spark, d), _query_vector(spark, d), least=0.1), 20))


@query(V.sql(f"SELECT v.doc_id, round({_COS}, 6) AS score FROM vectors v, vectors q WHERE q.doc_id = {QUERY_ID} AND v.session_id = 3 AND {_COS} >= 0.0 ORDER BY {_COS} DESC, v.doc_id LIMIT 10", "vectors"))
def j3_filtered_vectors(spark, d):
    return _out(S.top(VS.similar(V.vectors(spark, d), _query_vector(spark, d), F.col("session_id") == 3, 0.0), 10))


@query(V.sql("SELECT session_id::BIGINT AS session_id, count(*) AS n FROM vectors WHERE doc_id % 7 <> 0 GROUP BY session_id", "vectors"))
def j4_vectors_deleted(spark, d):
    v = V.vectors(spark, d)
    return VS.delete(v, v.filter("doc_id % 7 = 0")).groupBy(F.col("session_id").cast("long").alias("session_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS doc_id FROM embeddings WHERE len(embedding) = 64")
def j1_checked_dimension(spark, d):
    return VS.check_dimension(V.vectors(spark, d), 64).select("doc_id")


@query(V.sql(f"SELECT v.doc_id, round({_COS}, 6) AS score FROM vectors v, vectors q WHERE q.doc_id = {QUERY_ID} AND v.session_id = 5 ORDER BY {_COS} DESC, v.doc_id LIMIT 10", "vectors"))
def j5_session_index(spark, d):
    """The index is written with a folder per session; the search opens one of them."""
    path = work_folder(spark, "vectors")
    A.save_vectors(V.vectors(spark, d), path)
    return _out(S.top(VS.similar(A.load_vectors(spark, path, 5), _query_vector(spark, d), least=-1.0), 10))


@query("SELECT doc_id, len(coalesce(text, ''))::DOUBLE AS chars, (len(coalesce(text, '')) - len(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS blanks FROM documents")
def j6_embed_texts(spark, d):
    model = lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]
    return VS.embed_batches(_docs(spark, d), model, 2).select("doc_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("blanks"))


def j7_hash_embedding(spark, d):
    return _docs(spark, d).select("doc_id", VS.hashed_embedding(F.col("content"), 16).alias("vector"))


query()(j7_hash_embedding)


def _keyword(spark, d):
    return H.with_rank(S.bm25(_docs(spark, d), TERMS), 50).select("doc_id", "rank", "score")


def _semantic(spark, d):
    hits = VS.similar(V.vectors(spark, d), _query_vector(spark, d), least=0.0)
    return H.with_rank(hits, 50).select("doc_id", "rank", "score")


_LISTS = (
    V.sql(", " + _bm25("dl").replace("SELECT doc_id, round(s, 6) AS score FROM h WHERE s > 0 ", "").rstrip(), "vectors")
    + f""", k AS (SELECT doc_id, s AS score, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM h WHERE s > 0 QUALIFY rank <= 50),
    sv AS (SELECT v.doc_id, {_COS} AS score FROM vectors v, vectors q WHERE q.doc_id = {QUERY_ID} AND {_COS} >= 0),
    e AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sv QUALIFY rank <= 50),
    f AS (SELECT doc_id, k.rank AS kr, e.rank AS er, k.score AS ks, e.score AS es, CASE WHEN k.rank IS NOT NULL AND e.rank IS NOT NULL THEN 'both' WHEN k.rank IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source FROM k FULL JOIN e USING (doc_id))
    """
)


@query(_LISTS + "SELECT doc_id, source, round(coalesce(0.5e0 / (60 + kr), 0) + coalesce(0.5e0 / (60 + er), 0), 6) AS score FROM f")
def k1_rrf(spark, d):
    return H.rrf(_keyword(spark, d), _semantic(spark, d)).select("doc_id", "source", F.round("score", 6).alias("score"))


@query(_LISTS + "SELECT doc_id, source, round(0.5e0 * coalesce(ks / greatest((SELECT max(score) FROM k), 0.001), 0) + 0.5e0 * coalesce(es / greatest((SELECT max(score) FROM e), 0.001), 0), 6) AS score FROM f")
def k2_weighted(spark, d):
    return H.weighted(_keyword(spark, d), _semantic(spark, d)).select("doc_id", "source", F.round("score", 6).alias("score"))


@query(_LISTS + ", u AS (SELECT doc_id, rank, 0 AS side FROM k UNION ALL SELECT doc_id, rank, 1 FROM e), cut AS (SELECT * FROM u ORDER BY rank, side LIMIT 30) SELECT doc_id, rank, side FROM cut QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, side) = 1")
def k3_interleave(spark, d):
    return H.interleave(_keyword(spark, d), _semantic(spark, d), 30).select("doc_id", F.col("rank").cast("long").alias("rank"), "side")


@query(_LISTS + "SELECT doc_id, round(coalesce(0.5e0 / (60 + kr), 0) + coalesce(0.5e0 / (60 + er), 0), 6) AS score FROM f ORDER BY coalesce(0.5e0 / (60 + kr), 0) + coalesce(0.5e0 / (60 + er), 0) DESC, doc_id LIMIT 10")
def k4_hybrid_engine(spark, d):
    return _out(S.top(H.rrf(_keyword(spark, d), _semantic(spark, d)), 10))


_Q = ["hello", "How to implement Rust async", "What are the key principles of effective software architecture?", 'search for "exact phrase"', "", "a b"]
_QV = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_Q))


@query(f"""SELECT id::BIGINT AS id, CASE WHEN q LIKE '%exact%' OR q LIKE '%quote%' OR q LIKE '%"%' THEN 'keyword' WHEN n < 3 THEN 'keyword' WHEN n > 5 THEN 'semantic' ELSE 'hybrid' END AS route
FROM (SELECT *, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '')) AS n FROM (VALUES {_QV}) t(id, q))""")
def k5_route(spark, d):
    q = spark.createDataFrame(list(enumerate(_Q)), "id long, q string")
    return q.select("id", H.route(F.col("q")).alias("route"))


@query(f"""SELECT id::BIGINT AS id, CASE WHEN q LIKE '%exact%' OR q LIKE '%quote%' OR q LIKE '%"%' THEN 'Keyword search recommended: query contains exact-match indicators (' || n || ' words)'
  WHEN n < 3 THEN 'Keyword search recommended: short query (' || n || ' words) benefits from exact matching'
  WHEN n > 5 THEN 'Semantic search recommended: natural language query (' || n || ' words) benefits from conceptual matching'
  ELSE 'Hybrid search recommended: balanced query (' || n || ' words) benefits from both exact and conceptual matching' END AS why
FROM (SELECT *, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '')) AS n FROM (VALUES {_QV}) t(id, q))""")
def k6_explain(spark, d):
    q = spark.createDataFrame(list(enumerate(_Q)), "id long, q string")
    return q.select("id", H.explain(F.col("q"), H.route(F.col("q"))).alias("why"))


QUESTIONS = [(1, "the that of onto", 1), (2, "with thon from", 2), (3, "de la que", 3), (4, "and tion ther", 4)]
_QUV = ", ".join(f"({i}, '{q}', {c})" for i, q, c in QUESTIONS)
_WS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''))"
_QS = f"qs AS (SELECT id::BIGINT AS qid, {_WS.format('q')} AS qw, c FROM (VALUES {_QUV}) t(id, q, c))"


def _questions(spark):
    return F.broadcast(spark.createDataFrame(QUESTIONS, "qid long, q string, c int")).select("qid", X.word_set(F.lower("q")).alias("qw"), "c")


@query(V.sql(f""", {_QS}, o AS (SELECT qid, message_id, content, c, len(list_intersect(qw, {_WS.format('content')})) / (len(qw) + 1.0e0) AS score, len(content) AS size FROM messages, qs),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, message_id) AS kr, row_number() OVER (PARTITION BY qid ORDER BY size, message_id) AS sr FROM o),
w AS (SELECT qid, message_id, (CASE c WHEN 1 THEN 0.7e0 WHEN 3 THEN 0.4e0 WHEN 4 THEN 0.3e0 ELSE 0.5e0 END) / (20 + kr) + (CASE c WHEN 1 THEN 0.3e0 WHEN 3 THEN 0.6e0 WHEN 4 THEN 0.7e0 ELSE 0.5e0 END) / (20 + sr) AS s FROM r)
SELECT qid, message_id, round(s, 6) AS score FROM w QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, message_id) <= 10""", "messages"))
def k7_category_rrf(spark, d):
    m = V.messages(spark, d).crossJoin(_questions(spark))
    o = m.select("qid", "message_id", "c", H.overlap_score(F.col("qw"), X.word_set(F.lower("content"))).alias("score"), F.length("content").alias("size"))
    by = lambda *o: F.row_number().over(Window.partitionBy("qid").orderBy(*o))
    weights = lambda i: F.create_map(*[F.lit(x) for c, w in H.CATEGORY_WEIGHTS.items() for x in (c, w[i])])[F.col("c")]
    r = o.withColumn("kr", by(F.desc("score"), "message_id")).withColumn("sr", by("size", "message_id"))
    s = r.withColumn("s", weights(0) / (20 + F.col("kr")) + weights(1) / (20 + F.col("sr")))
    return s.withColumn("n", by(F.desc("s"), "message_id")).filter("n <= 10").select("qid", "message_id", F.round("s", 6).alias("score"))


@query(V.sql(f""", {_QS}, a AS (SELECT qid, message_id, len(list_intersect(qw, {_WS.format('content')})) / (len(qw) + 1.0e0) AS s1, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') AS w, qw FROM messages, qs),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s1 DESC, message_id) <= 50),
c AS (SELECT *, len(list_filter(w, lambda x: list_contains(qw, x))) / greatest(len(w), 1)::DOUBLE AS s2 FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, message_id) <= 10),
e AS (SELECT *, s2 * CASE WHEN len(w) BETWEEN 10 AND 100 THEN 1.0e0 ELSE 0.8e0 END AS s3 FROM c)
SELECT qid, message_id, round(s3, 6) AS score FROM e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s3 DESC, message_id) <= 5""", "messages"))
def k8_cascade(spark, d):
    return _stages(spark, d)[2].select("qid", "message_id", F.round("s3", 6).alias("score"))


def _stages(spark, d):
    """The 50 best messages of each question, of these the 10 best by a second score, of these the 5 best by a third."""
    by = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "message_id"))
    m = V.messages(spark, d).crossJoin(_questions(spark)).withColumn("w", X.words(F.lower("content")))
    a = m.withColumn("s1", H.overlap_score(F.col("qw"), F.array_distinct("w")))
    b = a.withColumn("n", by("s1")).filter("n <= 50")
    hits = F.size(F.filter("w", lambda x: F.array_contains(F.col("qw"), x)))
    c = b.withColumn("s2", hits / F.greatest(F.size("w"), F.lit(1))).withColumn("n", by("s2")).filter("n <= 10")
    e = c.withColumn("s3", F.col("s2") * F.when(F.size("w").between(10, 100), 1.0).otherwise(0.8)).withColumn("n", by("s3")).filter("n <= 5")
    return b, c, e


@query(V.sql(f""", {_QS}, a AS (SELECT qid, message_id, len(list_intersect(qw, {_WS.format('content')})) / (len(qw) + 1.0e0) AS s1, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') AS w, qw FROM messages, qs),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s1 DESC, message_id) <= 50),
c AS (SELECT *, len(list_filter(w, lambda x: list_contains(qw, x))) / greatest(len(w), 1)::DOUBLE AS s2 FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, message_id) <= 10),
e AS (SELECT *, s2 * CASE WHEN len(w) BETWEEN 10 AND 100 THEN 1.0e0 ELSE 0.8e0 END AS s3 FROM c)
SELECT qid, message_id, 1 AS stage FROM b UNION ALL SELECT qid, message_id, 2 FROM c UNION ALL SELECT qid, message_id, 3 FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s3 DESC, message_id) <= 5)""", "messages"))
def f7_staged_topk(spark, d):
    """What each stage of the cascade keeps: 50, 10 and 5 of a question."""
    out = [t.select("qid", "message_id", F.lit(i).alias("stage")) for i, t in enumerate(_stages(spark, d), 1)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query()
def k9_page_rag(spark, d):
    p = H.pages(V.messages(spark, d))
    q = spark.range(1).select(VS.hashed_embedding(F.lit("the that of with"), 64).alias("q")).first().q
    s = VS.hashed_cosine(F.col("content"), q) * (1 + 0.2 * F.col("page") / F.col("pages"))
    return S.top(p.withColumn("score", s).withColumn("doc_id", F.col("session_id") * 1000 + F.col("page")), 10).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT doc_id, unnest(range(0, greatest(len(text), 1), 384)) AS start, text FROM documents)
SELECT doc_id, start, len(substring(text, start + 1, 512)) AS size FROM c WHERE len(substring(text, start + 1, 512)) > 100""")
def k10_chunks(spark, d):
    c = _docs(spark, d).select("doc_id", F.explode(H.chunks(F.col("content"))).alias("c"))
    return c.select("doc_id", "c.start", F.length("c.chunk").cast("long").alias("size"))


def _re2(pattern: str) -> str:
    """The pattern for DuckDB, over texts whose words beyond ASCII are masked."""
    return pattern.replace(R.START, "\\b").replace(R.END, "\\b")


#: Ten chats are the sessions of one conversation.
_SUM = f""", t AS (SELECT session_id // 10 AS conversation_id, session_id, content AS x, regexp_replace(content, '{_FOREIGN}', '0', 'g') AS y, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM messages),
k AS (SELECT session_id, i AS o, x FROM t WHERE i = 1 UNION ALL SELECT session_id, 1.5, x FROM t WHERE i = n UNION ALL SELECT session_id, i, x FROM t WHERE i > 1 AND i < n AND regexp_matches(y, '{_re2(R.KEY)}')),
ks AS (SELECT session_id, list_slice(list(x ORDER BY o), 1, 5) AS keys FROM k GROUP BY session_id),
f AS (SELECT session_id, list(substring(x, 1, 200) ORDER BY i) AS fs FROM t WHERE regexp_matches(y, '{_re2(R.FACT)}') GROUP BY session_id),
m AS (SELECT session_id, i, generate_subscripts(ns, 1) AS j, unnest(ns) AS name FROM (SELECT session_id, i, regexp_extract_all(y, '{_re2(R.NAME)}') AS ns FROM t)),
m1 AS (SELECT session_id, name, min(i * 1000000 + j) AS spot FROM m GROUP BY ALL), ms AS (SELECT session_id, list_slice(list(name ORDER BY spot), 1, 10) AS names FROM m1 GROUP BY session_id),
s AS (SELECT DISTINCT ON (session_id) t.conversation_id, t.session_id, 'Session ' || t.session_id || ': ' || coalesce(array_to_string(list_slice(fs, 1, 3), '; '), '') AS summary, coalesce(list_slice(fs, 1, 5), []) AS facts, coalesce(names, []) AS names, keys
  FROM t LEFT JOIN f USING (session_id) LEFT JOIN ms USING (session_id) JOIN ks USING (session_id))"""


def _summaries(spark, d):
    m = V.messages(spark, d)
    return R.summaries(m.select(F.floor(F.col("session_id") / 10).alias("conversation_id"), "session_id", "seq", "content"))


@query(V.sql(_SUM + " SELECT session_id, summary, array_to_string(facts, '|') AS facts, array_to_string(names, '|') AS names, array_to_string(keys, '|') AS keys FROM s", "messages"))
def k11_session_summaries(spark, d):
    return _summaries(spark, d).select("session_id", "summary", *[F.array_join(c, "|").alias(c) for c in ("facts", "names", "keys")])


_PARTS = _SUM + """, q AS (SELECT DISTINCT conversation_id, c::INT AS category FROM s, (VALUES (1), (2), (3), (4)) v(c)),
p0 AS (SELECT conversation_id, category, session_id, unnest(CASE category WHEN 1 THEN list_transform(list_slice(keys, 1, 2), lambda x: {'stage': 0, 'cap': 2048 * 0.4e0, 'v': x})
  WHEN 2 THEN [{'stage': 0, 'cap': 2048 * 0.3e0, 'v': summary}] WHEN 3 THEN [{'stage': 0, 'cap': 2048 * 0.3e0, 'v': summary}] || list_transform(facts, lambda x: {'stage': 1, 'cap': 2048 * 0.2e0, 'v': x})
  ELSE [{'stage': 0, 'cap': 2048e0, 'v': summary}] END) AS p, generate_subscripts(CASE category WHEN 1 THEN list_slice(keys, 1, 2) WHEN 3 THEN [summary] || facts ELSE [summary] END, 1) AS pos FROM q JOIN s USING (conversation_id)),
p AS MATERIALIZED (SELECT conversation_id, category, p.cap AS cap, p.v AS v, len(p.v) // 4 AS n, row_number() OVER (PARTITION BY conversation_id, category ORDER BY p.stage, session_id, pos) AS rn FROM p0),
r AS (SELECT conversation_id, category, 0::BIGINT AS rn, 0::BIGINT AS tokens, ''::VARCHAR AS context, 0 AS held FROM q
  UNION ALL SELECT r.conversation_id, r.category, p.rn, CASE WHEN tokens + n < cap THEN tokens + n ELSE tokens END, CASE WHEN tokens + n < cap THEN CASE WHEN held > 0 THEN context || chr(10) ELSE '' END || v ELSE context END, held + (tokens + n < cap)::INT
    FROM r JOIN p ON p.conversation_id = r.conversation_id AND p.category = r.category AND p.rn = r.rn + 1)
SELECT conversation_id, category, max_by(tokens, rn) AS tokens, sha256(max_by(context, rn)) AS context_sha256 FROM r GROUP BY conversation_id, category"""


@query(V.sql(_PARTS, "messages", recursive=True))
def k11_hierarchical(spark, d):
    """Four questions, one of each kind, on every conversation of ten sessions."""
    s = _summaries(spark, d)
    q = s.select("conversation_id").distinct().withColumn("category", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    q = q.withColumn("question_id", 10 * F.col("conversation_id") + F.col("category"))
    c = R.contexts(s, q)
    return c.join(q, "question_id").select("conversation_id", "category", "tokens", F.sha2("context", 256).alias("context_sha256"))


EVENTS = [(1, "Alice met Bob Smith on March 4, 2023 and again last week"), (2, "Nothing here"), (3, "Carol Jones moved in 2021, next month Bob Smith came on Monday"), (4, "The Band sang in 1999 on friday")]
_TIMES = " || ".join(f"list_transform(regexp_extract_all(text, '{p}', 1), lambda v: '{k}=' || v)" for k, p in X.TIME_PATTERNS.items())


@query("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in EVENTS) + f""") t(id, text)),
e AS (SELECT id, unnest(list_slice(list_filter(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1), lambda x: x NOT IN {X.NO_ENTITIES}), 1, 2)) AS entity, {_TIMES} AS times FROM t)
SELECT entity, id::BIGINT AS id, array_to_string(times, '|') AS times, row_number() OVER (PARTITION BY entity ORDER BY id)::BIGINT AS event FROM e WHERE len(times) > 0 QUALIFY event <= 5""")
def k12_timeline(spark, d):
    t = spark.createDataFrame(EVENTS, "id long, text string")
    times = F.transform(X.time_expressions(F.col("text")), lambda x: F.concat(x["kind"], F.lit("="), x["value"]))
    e = t.select("id", F.explode(F.slice(X.capitalized(F.col("text")), 1, 2)).alias("entity"), times.alias("times")).filter(F.size("times") > 0)
    n = F.row_number().over(Window.partitionBy("entity").orderBy("id")).cast("long")
    return e.select("entity", "id", F.array_join("times", "|").alias("times"), n.alias("event")).filter("event <= 5")


@query(V.sql(", h1 AS (SELECT DISTINCT object_id AS node, 1 AS depth FROM relationships WHERE subject_id = 'c7'), h2 AS (SELECT DISTINCT subject_id AS node, 2 AS depth FROM relationships JOIN h1 ON object_id = node AND predicate = 'supplies'), u AS (SELECT node, min(depth)::BIGINT AS depth FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node) SELECT node, depth FROM u WHERE node <> 'c7' ORDER BY depth, node LIMIT 20", "relationships"))
def k13_multi_hop(spark, d):
    e = V.relationships(spark, d)
    h1 = e.filter("subject_id = 'c7'").select(F.col("object_id").alias("node")).distinct().withColumn("depth", F.lit(1))
    h2 = e.filter("predicate = 'supplies'").join(h1.select(F.col("node").alias("object_id")), "object_id").select(F.col("subject_id").alias("node")).distinct().withColumn("depth", F.lit(2))
    u = h1.unionByName(h2).groupBy("node").agg(F.min("depth").cast("long").alias("depth"))
    return u.filter("node <> 'c7'").orderBy("depth", "node").limit(20)


_QA = [(1, "When did it start?", 1), (2, "Who knows Bob", 1), (3, "What is it?", 3), (4, "What is it?", 2), (5, "What is it?", 1)]


@query("SELECT id::BIGINT AS id, CASE WHEN regexp_matches(lower(q), '" + "|".join(H.TEMPORAL_WORDS) + "') THEN 'temporal' WHEN regexp_matches(lower(q), '" + "|".join(H.RELATION_WORDS) + "') THEN 'multihop' WHEN c = 3 THEN 'temporal' WHEN c = 2 THEN 'multihop' ELSE 'standard' END AS route FROM (VALUES " + ", ".join(f"({i}, '{q}', {c})" for i, q, c in _QA) + ") t(id, q, c)")
def k14_question_route(spark, d):
    q = spark.createDataFrame(_QA, "id long, q string, c int")
    return q.select("id", H.route_question(F.col("q"), F.col("c")).alias("route"))


@query(V.sql("SELECT session_id, sha256(string_agg(role || ': ' || content, chr(10) ORDER BY seq)) AS context_sha256, sum(len(content))::BIGINT AS chars FROM messages GROUP BY session_id", "messages"))
def k15_full_context(spark, d):
    m = V.messages(spark, d)
    turns = F.transform(F.sort_array(F.collect_list(F.struct("seq", "role", "content"))), lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    return m.groupBy("session_id").agg(F.sha2(F.array_join(turns, "\n"), 256).alias("context_sha256"), F.sum(F.length("content")).alias("chars"))
