"""C12, C13, D17, G5, G6, S*: versions, merges and logs."""

from pyspark.sql import functions as F

from synapta import views as V
from synapta.operators import history as H
from synapta.operators import memory as M
from synapta.plans import query
from synapta.plans.memory import _JW
from synapta.plans.scalars import values

#: Every branch begins at the third commit of the branch of half its number.
_DAG = ", dag AS (SELECT c.oid, c.branch, c.seq, CASE WHEN c.seq > 1 THEN c.parent ELSE f.oid END AS parent FROM commits c LEFT JOIN commits f ON c.seq = 1 AND f.seq = 3 AND f.branch = c.branch // 2 AND f.branch <> c.branch)"


def dag(spark, d):
    c = V.commits(spark, d)
    third = c.filter("seq = 3").select(F.col("branch").alias("fb"), F.col("oid").alias("fork"))
    joined = c.join(third, (F.col("seq") == 1) & (F.col("fb") == F.floor(F.col("branch") / 2)) & (F.col("fb") != F.col("branch")), "left")
    return joined.select("oid", "branch", "seq", F.when(F.col("seq") > 1, F.col("parent")).otherwise(F.col("fork")).alias("parent"))


@query("SELECT sha256(text) AS oid, min(length(text)) AS size FROM documents GROUP BY text")
def s1_put_objects(spark, d):
    new = V.table(spark, d, "documents").select(F.lit("blob").alias("kind"), F.col("text").alias("payload"))
    empty = spark.createDataFrame([], "kind string, payload string")
    return H.put(empty, new).select("oid", F.length("payload").cast("long").alias("size"))


@query(V.sql(_DAG + ", p AS (SELECT oid, parent FROM dag UNION ALL SELECT oid, 0 FROM dag WHERE seq % 5 = 0) SELECT oid, count(parent) AS parents FROM p GROUP BY oid HAVING count(parent) > 1", "commits"))
def s2_merge_commits(spark, d):
    g = dag(spark, d)
    links = g.select("oid", "parent").unionByName(g.filter("seq % 5 = 0").select("oid", F.lit(0).cast("long").alias("parent")))
    return H.merge_commits(links)


def _head(spark, d, branch):
    return V.commits(spark, d).filter(F.col("branch") == branch).groupBy().agg(F.max_by("oid", "seq").alias("head"))


_WALK = _DAG + ", heads AS (SELECT branch, max_by(oid, seq) AS head FROM commits WHERE branch IN (7, 3) GROUP BY branch), walk AS (SELECT branch, head AS oid, 0 AS depth FROM heads UNION ALL SELECT w.branch, g.parent, w.depth + 1 FROM walk w JOIN dag g ON g.oid = w.oid WHERE g.parent IS NOT NULL AND w.depth < 1000), a AS (SELECT branch, oid, min(depth)::BIGINT AS depth FROM walk GROUP BY ALL) "


@query(V.sql(_WALK + "SELECT oid, depth FROM a WHERE branch = 7", "commits", recursive=True))
def s3_ancestors(spark, d):
    return H.ancestors(dag(spark, d), _head(spark, d, 7)).select("oid", F.col("depth").cast("long").alias("depth"))


@query(V.sql(_WALK + "SELECT oid, depth FROM a WHERE branch = 3 AND oid IN (SELECT oid FROM a WHERE branch = 7) ORDER BY depth, oid LIMIT 1", "commits", recursive=True))
def s4_merge_base(spark, d):
    g = dag(spark, d)
    return H.merge_base(H.ancestors(g, _head(spark, d, 7)), H.ancestors(g, _head(spark, d, 3))).select("oid", F.col("depth").cast("long").alias("depth"))


@query(V.sql(_WALK + "SELECT oid FROM a WHERE branch = 7 AND oid IN (SELECT oid FROM a WHERE branch = 3)", "commits", recursive=True))
def g6_common_ancestors(spark, d):
    g = dag(spark, d)
    return H.ancestors(g, _head(spark, d, 7)).join(H.ancestors(g, _head(spark, d, 3)).select("oid"), "oid", "left_semi").select("oid")


@query(V.sql("SELECT branch, max_by(oid, seq) AS oid FROM commits GROUP BY branch", "commits"))
def s6_reflog_heads(spark, d):
    log = V.commits(spark, d).withColumn("name", F.col("branch"))
    return H.current_refs(log.select("name", "oid", "seq")).select(F.col("name").alias("branch"), "oid")


def _sides(spark, d):
    m = V.memories(spark, d)
    part = lambda i: m.filter(F.col("memory_id") % 3 == i)
    base = part(0)
    return m, base, base.unionByName(part(1)), base.unionByName(part(2))


@query(V.sql("SELECT memory_id FROM memories WHERE memory_id % 3 = 1", "memories"))
def c13_added(spark, d):
    _, base, source, _ = _sides(spark, d)
    return H.added(source, base).select("memory_id")


_PAIR = _JW + ", x AS (SELECT a, b, j, regexp_matches(lower(ac), 'not |no |never |false|wrong|instead|switched|changed') <> regexp_matches(lower(bc), 'not |no |never |false|wrong|instead|switched|changed') AS opposed FROM p WHERE j > 0.7 AND a % 3 + b % 3 = 3 AND a % 3 <> 0), k AS (SELECT a, b, CASE WHEN j > 0.85 THEN 'duplication' WHEN opposed THEN 'contradiction' END AS kind FROM x)"


def _conflicts(spark, d):
    from synapta.functions.text import MERGE_NEGATIONS, has_any

    _, base, source, target = _sides(spark, d)
    both = H.added(source, base).unionByName(H.added(target, base))
    pairs = M.similar_pairs(both.withColumn("neg", has_any(F.col("content"), MERGE_NEGATIONS)), 0.7, "neg").filter("a % 3 <> b % 3")
    return H.conflicts(pairs.withColumn("opposed", F.col("neg_a") != F.col("neg_b")))


@query(V.sql(_PAIR + " SELECT a, b, kind FROM k WHERE kind IS NOT NULL", "memories"))
def s8_c12_conflicts(spark, d):
    return _conflicts(spark, d).select("a", "b", "kind")


@query(V.sql(_PAIR + " SELECT CASE kind WHEN 'duplication' THEN 'auto_resolved' ELSE 'unresolved' END AS resolution, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1", "memories"))
def s9_auto_resolve(spark, d):
    return _conflicts(spark, d).groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


@query(V.sql("SELECT memory_id FROM memories", "memories"))
def s7_g5_three_way_merge(spark, d):
    _, base, source, target = _sides(spark, d)
    return H.merge(base, source, target).select("memory_id")


def _wal(spark, d):
    o = V.operations(spark, d).withColumn("payload", F.encode("input", "UTF-8"))
    broken = F.col("op_id") % 97 == 5
    return o.select(F.col("session_id").alias("tx"), F.col("op_id").alias("seq"), "payload", (F.crc32("payload") + F.when(broken, 1).otherwise(0)).alias("crc"))


@query(V.sql("SELECT session_id AS tx, op_id AS seq FROM operations o WHERE NOT EXISTS (SELECT 1 FROM operations b WHERE b.session_id = o.session_id AND b.op_id <= o.op_id AND b.op_id % 97 = 5)", "operations"))
def s10_wal_replay(spark, d):
    return H.replay(_wal(spark, d)).select("tx", "seq")


@query(V.sql("SELECT session_id AS tx, count(*) AS records, max(op_id) AS last FROM operations GROUP BY session_id", "operations"))
def d17_wal_transactions(spark, d):
    return H.transactions(_wal(spark, d))


@query(V.sql(", w AS (SELECT session_id, max(ts) AS last, CASE WHEN session_id % 4 = 0 THEN 'merging' ELSE 'open' END AS status FROM operations GROUP BY session_id) SELECT session_id FROM w WHERE epoch(TIMESTAMP '2024-01-31') - floor(epoch(last)) > 86400 AND status <> 'merging'", "operations"))
def s11_prune_worktrees(spark, d):
    w = V.operations(spark, d).groupBy("session_id").agg(F.max("ts").alias("last_activity")).withColumn("status", F.when(F.col("session_id") % 4 == 0, "merging").otherwise("open"))
    return H.prune(w, F.lit("2024-01-31").cast("timestamp")).select("session_id")


_SK = [("deploy", ["deploy", "ship it"]), ("review", ["review", "PR"])]
_SQ = [("Please Deploy now",), ("open a pr and ship it",), ("nothing",)]


@query(f"SELECT DISTINCT q AS query, slug FROM {values(_SQ, 'q')}, (VALUES ('deploy', 'deploy'), ('deploy', 'ship it'), ('review', 'review'), ('review', 'pr')) s(slug, p) WHERE contains(lower(q), p)")
def s12_skills(spark, d):
    return H.triggered(spark.createDataFrame(_SK, "slug string, patterns array<string>"), spark.createDataFrame(_SQ, "query string"))
