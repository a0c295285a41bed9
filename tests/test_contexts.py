"""Digests of contexts that stream past."""

from pyspark.sql import functions as F

from synapta.operators import memory


def test_digests_are_those_of_the_texts(spark, monkeypatch):
    rows = [(s, k, 7 * i % 5 / 10, i, t) for i, (s, k, t) in enumerate([
        ("a", "system", " \n\t"), ("a", "system", " x \n y "), ("a", "conversation", "\n\n z\n"), ("a", "entity", None), ("a", "semantic", "é 東"), ("b", "entity", ""), ("b", "working", "  "), (None, "episodic", "t "), ("c", "system", " "), ("d", "system", None),
    ])]
    blocks = spark.createDataFrame(rows, "session_id string, kind string, score double, memory_id long, content string")
    want = {r.session_id: r.c for r in memory.format_blocks(blocks).select("session_id", F.sha2("context", 256).alias("c")).collect()}
    monkeypatch.setattr(memory.F, "collect_list", None)  # no session as one array
    got = {r.session_id: r.context_sha256 for r in memory.context_digests(blocks).collect()}
    assert got == want | {"d": None} and len(got) == 5


def test_hashed_cosines_are_those_of_the_vectors(spark):
    from synapta.functions.similarity import cosine
    from synapta.operators import vector

    texts = ["the that", "The OF with with of the", "", "   ", None, "other words altogether", "the " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    q = F.array(*map(F.lit, [0.0, 2.0, 1.0, 0.0, 0.0, 3.0, 1.0, 0.0]))
    got = rows.select(vector.hashed_cosine(F.col("t"), [0, 2, 1, 0, 0, 3, 1, 0]).alias("x"), cosine(vector.hashed_embedding(F.col("t"), 8), q).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] and any(r.x for r in got)
