"""D15, D16, T*: streams over the operation log, and evaluation summaries."""

from pyspark.sql import functions as F

from synapta import views as V
from synapta.operators import evaluation as E
from synapta.plans import query
from synapta.plans.search import _T
from synapta.storage import work_folder
from synapta.streaming import live as L


def _stream(spark, d):
    return L.read_operations(spark, f"{d}/events.parquet")


@query(V.sql("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, op_kind, count(*) AS n FROM operations GROUP BY ALL", "operations"))
def t1_tumbling_counts(spark, d):
    return L.run_to_table(L.tumbling(_stream(spark, d)), "complete")


_GAPS = ", g AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM operations WINDOW w AS (PARTITION BY session_id ORDER BY ts)), i AS (SELECT session_id, ts, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT session_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM i GROUP BY session_id, s"
#: A stream gives out what is over: all that ended ten minutes before the last event.
_OVER = " HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM operations) - INTERVAL 10 MINUTE"


@query(V.sql(_GAPS, "operations"))
def t2_idle_sessions(spark, d):
    return L.sessions(V.operations(spark, d))


@query(V.sql(_GAPS + _OVER, "operations"))
def t2_idle_stream(spark, d):
    """The same as a stream in append mode: sessions that are still open stay in its state."""
    return L.run_to_table(L.sessions(_stream(spark, d)), "append")


@query(V.sql("SELECT session_id, floor(epoch(max(ts)))::BIGINT AS last FROM operations GROUP BY session_id HAVING floor(epoch(max(ts))) + 86400 <= (SELECT epoch(max(ts)) FROM operations) - 600", "operations"))
def t3_ttl_timer(spark, d):
    return L.run_to_table(L.expire(_stream(spark, d), 86_400), "append")


@query(V.sql("SELECT session_id, sum(floor(duration))::BIGINT AS tokens FROM operations GROUP BY session_id", "operations"))
def t4_running_budget(spark, d):
    return L.run_to_table(L.running_budget(_stream(spark, d)), "complete")


@query(V.sql("SELECT DISTINCT session_id, op_kind AS content FROM operations", "operations"))
def t5_stream_dedup(spark, d):
    s = _stream(spark, d).select("session_id", "ts", F.col("op_kind").alias("content"))
    return L.run_to_table(L.distinct_content(s), "append").select("session_id", "content")


@query(f"WITH d AS (SELECT doc_id, text AS content FROM documents), t AS (SELECT doc_id, unnest({_T}) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def t6_incremental_index(spark, d):
    folder = work_folder(spark, "index")
    schema = V.table(spark, d, "documents").schema
    docs = spark.readStream.schema(schema).parquet(L.any_of(f"{d}/documents.parquet")).select("doc_id", F.col("text").alias("content"))
    L.incremental_index(docs, folder).awaitTermination()
    return spark.read.parquet(folder).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(V.sql(", r AS (SELECT op_kind, duration, row_number() OVER (PARTITION BY op_kind ORDER BY duration) - 1 AS i, count(*) OVER (PARTITION BY op_kind) AS n FROM operations) SELECT op_kind AS category, round(avg(duration), 6) AS mean, max(duration) FILTER (WHERE i = floor(n * 0.5e0)) AS p50, max(duration) FILTER (WHERE i = floor(n * 0.95e0)) AS p95 FROM r GROUP BY op_kind", "operations"))
def d15_latency_summary(spark, d):
    return E.latency(V.operations(spark, d), "op_kind", "duration").withColumnRenamed("op_kind", "category")


@query(V.sql("SELECT role, count(*) AS turns, count(DISTINCT session_id) AS sessions, round(count(*)::DOUBLE / count(DISTINCT session_id), 6) AS mean FROM messages GROUP BY role", "messages"))
def d16_dataset_statistics(spark, d):
    return E.dataset(V.messages(spark, d))
