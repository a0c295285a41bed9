"""The engine's tables over a directory of Parquet files: Spark views, and the same in DuckDB.

Everything is derived with integer arithmetic, so both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.functions import scoring

#: All ages are counted from here.
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def seconds(column: str):
    return F.unix_timestamp(column)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), ts.alias("ts"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "origin")
    i = F.col("doc_id")
    created = F.timestamp_seconds(F.lit(1704067200) + i * 60)
    d = d.select(
        i.alias("memory_id"), F.col("lang").alias("session_id"), F.col("text").alias("content"), F.col("n_chars").alias("n_chars"),
        F.element_at(F.array(*map(F.lit, ("episodic", "semantic", "procedural"))), (i % 3 + 1).cast("int")).alias("memory_type"),
        F.element_at(F.array(*map(F.lit, ("working", "working", "short", "long"))), (i % 4 + 1).cast("int")).alias("tier"),
        ((i * 7) % 6).alias("access_count"), (((i * 13) % 101) / 100.0).alias("confidence"),
        created.alias("created_at"), F.timestamp_seconds(F.lit(1704067200) + i * 60 + (i % 30) * 86400).alias("last_accessed"),
        F.when(i % 10 == 0, "import").otherwise("chat").alias("source"),
        F.floor(F.col("n_chars") / 4).cast("long").alias("token_estimate"), F.array("origin", F.concat(F.lit("t"), i % 5)).alias("tags"),
    )
    return d.withColumn("importance", scoring.memory_importance(F.col("confidence"), F.col("access_count"), F.lit(0.0)))


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    m = messages(spark, sf_dir)
    docs = d.select("doc_id", F.col("source").alias("session_id"), F.lit("memory").alias("doc_type"), F.col("text").alias("content"))
    chat = m.select((F.col("message_id") + 1_000_000_000).alias("doc_id"), F.concat(F.lit("c"), F.col("session_id")).alias("session_id"), F.lit("message").alias("doc_type"), "content")
    return docs.unionByName(chat)


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("op_id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op_kind"), F.col("value").alias("duration"), F.col("props").alias("input"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("session_id"), F.col("embedding").alias("vector"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def nodes(name, prefix, key, label, extra):
        t = table(spark, sf_dir, name)
        return t.select(F.concat(F.lit(prefix), F.col(key)).alias("entity_id"), F.col(key).cast("long").alias("key"), F.col(label).alias("name"), F.lit(name).alias("entity_type"), extra(t).alias("attribute"))

    none = lambda _: F.lit("")
    all_ = nodes("customer", "c", "c_custkey", "c_name", lambda t: t["c_mktsegment"])
    all_ = all_.unionByName(nodes("supplier", "s", "s_suppkey", "s_name", none)).unionByName(nodes("part", "p", "p_partkey", "p_name", lambda t: t["p_brand"]))
    all_ = all_.unionByName(nodes("nation", "n", "n_nationkey", "n_name", none)).unionByName(nodes("region", "r", "r_regionkey", "r_name", none))
    k = F.col("key")
    half = F.expr("CASE entity_type WHEN 'customer' THEN 90.0D WHEN 'supplier' THEN 90.0D WHEN 'part' THEN 30.0D ELSE 3650.0D END")
    return all_.select(
        "*", (((k * 37) % 101) / 100.0).alias("relevance"), (k % 7).alias("access_count"), (((k * 53) % 51 + 50) / 100.0).alias("confidence"),
        (k % 11 == 0).alias("is_stable"), (k % 13 == 5).alias("is_deprecated"), half.alias("half_life_days"), (k % 60).alias("days_since_decay"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    node = lambda p, c: F.concat(F.lit(p), F.col(c))
    edge = lambda df, a, p, b: df.select(a.alias("subject_id"), F.lit(p).alias("predicate"), b.alias("object_id"))
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    supplies = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    return (
        edge(t("customer"), node("c", "c_custkey"), "located_in", node("n", "c_nationkey"))
        .unionByName(edge(t("supplier"), node("s", "s_suppkey"), "located_in", node("n", "s_nationkey")))
        .unionByName(edge(t("nation"), node("n", "n_nationkey"), "located_in", node("r", "n_regionkey")))
        .unionByName(edge(bought, node("c", "o_custkey"), "bought", node("p", "l_partkey")))
        .unionByName(edge(supplies, node("s", "l_suppkey"), "supplies", node("p", "l_partkey")))
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of orders per customer (branch), by date and key."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("branch"), F.lag("o_orderkey").over(w).alias("parent"), F.row_number().over(w).alias("seq"))


#: The same views for DuckDB, in order of dependence.
SQL = {
    "messages": """messages AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id, turn AS seq, role, text AS content,
        1704067200 + conv_id * 3600 + turn * 60 AS ts FROM conversations)""",
    "memories": """memories0 AS (SELECT doc_id AS memory_id, lang AS session_id, text AS content, n_chars,
        list_extract(['episodic', 'semantic', 'procedural'], doc_id % 3 + 1) AS memory_type,
        list_extract(['working', 'working', 'short', 'long'], doc_id % 4 + 1) AS tier,
        (doc_id * 7) % 6 AS access_count, ((doc_id * 13) % 101) / 100.0e0 AS confidence,
        1704067200 + doc_id * 60 AS created_at, 1704067200 + doc_id * 60 + (doc_id % 30) * 86400 AS last_accessed,
        CASE WHEN doc_id % 10 = 0 THEN 'import' ELSE 'chat' END AS source, n_chars // 4 AS token_estimate, [source, 't' || (doc_id % 5)] AS tags FROM documents),
      memories AS (SELECT *, CASE WHEN access_count = 0 THEN 0.0e0 ELSE 0.5e0 * confidence + 0.3e0 * (least(ln(access_count + 1.0e0), 3.0e0) / 3.0e0) + 0.2e0 END AS importance FROM memories0)""",
    "search_docs": """search_docs AS (SELECT doc_id, source AS session_id, 'memory' AS doc_type, text AS content FROM documents
        UNION ALL SELECT conv_id * 1000 + turn + 1000000000, 'c' || conv_id, 'message', text FROM conversations)""",
    "operations": "operations AS (SELECT event_id AS op_id, user_id AS session_id, ts, event_type AS op_kind, value AS duration, props AS input FROM events)",
    "vectors": "vectors AS (SELECT vec_id AS doc_id, label AS session_id, embedding AS vector FROM embeddings)",
    "entities": """entities0 AS (SELECT 'c' || c_custkey AS entity_id, c_custkey::BIGINT AS key, c_name AS name, 'customer' AS entity_type, c_mktsegment AS attribute FROM customer
        UNION ALL SELECT 's' || s_suppkey, s_suppkey, s_name, 'supplier', '' FROM supplier UNION ALL SELECT 'p' || p_partkey, p_partkey, p_name, 'part', p_brand FROM part
        UNION ALL SELECT 'n' || n_nationkey, n_nationkey, n_name, 'nation', '' FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey, r_name, 'region', '' FROM region),
      entities AS (SELECT *, ((key * 37) % 101) / 100.0e0 AS relevance, key % 7 AS access_count, ((key * 53) % 51 + 50) / 100.0e0 AS confidence, key % 11 = 0 AS is_stable,
        key % 13 = 5 AS is_deprecated, CASE entity_type WHEN 'customer' THEN 90.0e0 WHEN 'supplier' THEN 90.0e0 WHEN 'part' THEN 30.0e0 ELSE 3650.0e0 END AS half_life_days, key % 60 AS days_since_decay FROM entities0)""",
    "relationships": """relationships AS (SELECT 'c' || c_custkey AS subject_id, 'located_in' AS predicate, 'n' || c_nationkey AS object_id FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'located_in', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'located_in', 'r' || n_regionkey FROM nation
        UNION ALL SELECT DISTINCT 'c' || o_custkey, 'bought', 'p' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT DISTINCT 's' || l_suppkey, 'supplies', 'p' || l_partkey FROM lineitem)""",
    "commits": """commits AS (SELECT o_orderkey AS oid, o_custkey AS branch, lag(o_orderkey) OVER w AS parent, row_number() OVER w AS seq FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A DuckDB statement whose WITH list begins with the named views; ``body`` may go on with ``, x AS (...)``."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    views = ",\n".join(SQL[n] for n in names)
    body = body.strip()
    return head + views + ("\n" if body.startswith(",") else "\n") + body
