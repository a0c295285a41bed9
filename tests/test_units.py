"""Literal cases with answers worked out by hand, and what has no query."""

import json

import pytest
from pyspark.sql import functions as F

from synapta.functions import metrics, scoring, similarity, text
from synapta.operators import extract, graph, history, hybrid, memory, search, vector
from synapta.sources import stores
from synapta.streaming import live


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_similarities(spark):
    assert value(spark, similarity.jaccard(*lit("hello world test", "hello world example"))) == 0.5
    assert value(spark, similarity.jaccard(*lit("User prefers Tokio for async Rust", "User prefers Tokio for async Rust development"))) == pytest.approx(6 / 7)
    assert value(spark, similarity.jaccard(*lit("", "a"))) == 0.0
    for other, want in (([1.0, 0.0, 0.0], 0), ([0.0, 1.0, 0.0], 1), ([-1.0, 0.0, 0.0], 2), ([0.0, 0.0, 0.0], 1), ([1.0], float("inf"))):
        assert value(spark, similarity.cosine_distance(F.array(*lit(1.0, 0.0, 0.0)), F.array(*lit(*other)))) == pytest.approx(want)


def test_scores(spark):
    assert value(spark, text.configured_tokens(F.lit("Hello world this is a test"))) == 10
    assert value(spark, scoring.recency(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-11").cast("timestamp"), 0.1)) == pytest.approx(0.367879, abs=1e-6)
    assert value(spark, scoring.decay(*lit(1.0, 30.0, 30.0))) == 0.5 and value(spark, scoring.decay(*lit(1.0, 60.0, 30.0))) == 0.25
    assert value(spark, scoring.decay(*lit(0.7, 60.0, 0.0))) == 0.7
    assert value(spark, scoring.days_until_stale(*lit(0.8, 30.0, False))) == pytest.approx(90)
    assert value(spark, scoring.days_until_stale(*lit(0.8, 30.0, True))) is None
    assert value(spark, scoring.entity_importance(*lit(0.8, 1))) == pytest.approx(0.88)
    assert value(spark, scoring.memory_importance(*lit(1.0, 1, 0.0))) == pytest.approx(0.769315, abs=1e-6)
    assert value(spark, scoring.composite(*lit(0.9, 0.8, 0.7, 1.0, 0.9, 0.0))) == pytest.approx(0.845)
    assert value(spark, metrics.bleu1(*lit("a b", "b c"))) == pytest.approx(0.367879, abs=1e-6)
    assert value(spark, graph.merge_score(*lit("Rust", "Rust"), F.lit(0.0))) == pytest.approx(0.70)
    assert value(spark, graph.merge_score(*lit("Rust Programming Language", "Rust Language"), F.lit(0.0))) == pytest.approx(0.533333, abs=1e-6)


def test_fusion(spark):
    k = spark.createDataFrame([(1, 1, 3.0), (2, 2, 2.0), (3, 3, 1.0)], "doc_id long, rank int, score double")
    s = spark.createDataFrame([(2, 1, 0.9), (4, 2, 0.8)], "doc_id long, rank int, score double")
    got = {r.doc_id: (r.source, r.score) for r in hybrid.rrf(k, s).collect()}
    assert got[2] == ("both", pytest.approx(0.5 / 62 + 0.5 / 61)) and got[4][0] == "semantic"
    assert [r.doc_id for r in hybrid.interleave(k, s, 4).orderBy("rank", "side").collect()] == [1, 2, 4]
    assert search.clamp_limit(0) == 1 and search.clamp_limit(500) == 100
    for q, want in (("hello", "keyword"), ("How to implement Rust async", "hybrid"), ('search for "exact phrase"', "keyword")):
        assert value(spark, hybrid.route(F.lit(q))) == want
    assert value(spark, hybrid.route(F.lit("x"), automatic=False)) == "hybrid"


def test_budget_packing(spark):
    rows = [("s", i, 1.0 - i / 10, t) for i, t in enumerate((6, 5, 4, 1))]
    got = memory.pack_budget(spark.createDataFrame(rows, "session_id string, memory_id long, score double, tokens long"), 10, 0.0, 0).first()
    assert (got.used, got.chosen, got.skipped, list(got.ids)) == (10, 2, 2, [0, 2])


def test_lifecycle_and_contradiction(spark):
    assert value(spark, memory.promotion(*lit(3, 0.0))) == "access_count" and value(spark, memory.promotion(*lit(0, 0.7))) == "importance"
    assert value(spark, memory.demotion(*lit("long", 10**9))) is False and value(spark, memory.demotion(*lit("working", 3601))) is True
    assert value(spark, memory.contradictory(*lit("it is not so", "it is so"))) is True


def test_search_parts(spark):
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in (("text", "a"), ("image", "x"), ("text", "b"))])
    assert value(spark, search.multipart_text(parts)) == "a\n\nb"
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "b a")], "doc_id long, content string").withColumn("content", F.regexp_replace("content", "([ab])", "$1$1"))
    assert [(r.doc_id, r.matches) for r in search.phrase(docs, ["aa", "bb"]).collect()] == [(1, 2)]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "doc_id long, vector array<double>")
    assert [r.doc_id for r in vector.check_dimension(v, 2).collect()] == [1]
    with pytest.raises(Exception, match="numbers a text"):
        vector.embed_batches(docs, lambda t: [[1.0]] * len(t), 2).collect()


def test_store_versions_and_rollback(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = stores.Store.init(spark, path)
    with pytest.raises(FileExistsError):
        stores.Store.init(spark, path)
    df = spark.createDataFrame([(1, "working")], "memory_id long, tier string")
    assert store.write("memories", df, ("tier",)) == 1 and store.append("memories", spark.createDataFrame([("long", 2)], "tier string, memory_id long").select("memory_id", "tier")) == 2
    again = stores.Store.open(spark, path)
    assert again.read("memories").count() == 2 and again.read("memories", 1).count() == 1  # a checkpoint is a version
    with pytest.raises(Exception):  # noqa: B017
        again.transaction({"memories": df, "broken": df.select(F.raise_error(F.lit("no")).alias("x"))})
    assert again.versions("memories") == [1, 2] and again.versions("broken") == []
    folders = lambda: sorted(p.name for p in (tmp_path / "store/memories").iterdir())
    before = folders()
    assert len(before) == 2  # an append rewrote nothing, and the failure left no folder
    again._commit(99, again._manifest())  # another writer was first
    with pytest.raises(OSError):
        again._commit(99, again._manifest())
    assert again.restore("memories", 1) == 3 and again.read("memories").count() == 1 and folders() == before
    assert again.append("memories", df) == 4 and again.read("memories").count() == 2 and again.read("memories", 2).count() == 2
    with pytest.raises(FileNotFoundError):
        again.read("memories", 9)
    with pytest.raises(FileNotFoundError):
        stores.Store.open(spark, f"file://{tmp_path}/none")


def test_files(spark, tmp_path):
    (tmp_path / "ontology.json").write_text(json.dumps([{"top_category": "领域情报类", "first_category": f, "second_category": s, "english_name": "X"} for f, s in (("科技情报", "人工智能"), ("一级分类", "x"), ("产业情报", "y"), ("other", "z"))]))
    o = stores.domain(stores.read_ontology(spark, str(tmp_path / "ontology.json")))
    assert [r.domain for r in o.orderBy("second_category").collect()] == ["industry", "generic", "ai"]
    assert o.filter("id = '领域情报类-科技情报-人工智能'").count() == 1
    assert stores.find_category(o, "领域情报类", "产业情报").count() == 1 and stores.find_category(o, "领域情报类").count() == 3
    (tmp_path / "talk.json").write_text(json.dumps([{"sample_id": "a", "sessions": [[{"speaker": "x", "text": "hi", "dia_id": "d1"}], []], "qa": [{"question": "q", "answer": "a", "category": 2, "evidence": ["d1"]}]}]))
    turns, questions = stores.read_dialogues(spark, str(tmp_path / "talk.json"))
    assert turns.count() == 1 and questions.first().category == 2
    stores.write_results(questions, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    (tmp_path / "ops.json").write_text('{"op_id": "1", "ts": "2024-01-01T00:00:00Z", "op_kind": "tool_call", "duration_ms": 5}\n')
    assert stores.read_operations(spark, str(tmp_path / "ops.json")).first().duration_ms == 5
    md = stores.to_markdown(F.struct(F.lit("t").alias("title")), F.lit("# body\n--- not an end"))
    assert value(spark, stores.from_markdown(md, "title string"))["frontmatter"]["title"] == "t"
    assert value(spark, stores.from_markdown(md, "title string"))["content"].startswith("# body")


def test_history(spark):
    refs = spark.createDataFrame([("HEAD", None, "main"), ("main", 7, None), ("loose", None, None)], "name string, oid long, target string")
    assert history.resolve_ref(refs, "HEAD") == 7 and history.resolve_ref(refs, "none") is None
    log = spark.createDataFrame([("a", 1, 1), ("a", None, 2), ("b", 3, 1)], "name string, oid long, seq long")
    assert [r.name for r in history.current_refs(log).collect()] == ["b"]
    walk = spark.createDataFrame([(1, 0), (2, 1)], "oid long, depth int")
    assert value(spark, history.fast_forward(walk, 2)) is True and value(spark, history.fast_forward(walk, 9)) is False
    steps = spark.createDataFrame([("s", 1, False, "stop"), ("s", 2, True, "stop"), ("s", 3, False, "stop")], "slug string, step int, failed boolean, on_failure string")
    assert history.next_steps(steps).count() == 2


def test_graph_chains_resolve(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "keep string, gone string")
    assert {(r.keep, r.gone) for r in graph.roots(merges).collect()} == {("a", "b"), ("a", "c"), ("a", "d")}


def test_records_of_an_entity(spark):
    records = spark.createDataFrame([(2, ["a"]), (1, ["a", "b"]), (3, ["c"])], "seq long, entity_ids array<string>")
    assert [r.seq for r in graph.records_for(records, "a").collect()] == [1, 2]


def test_prompt_has_two_examples(spark):
    p = value(spark, extract.prompt(F.lit("TEXT"), "SYSTEM", {"Entities": "person"}, "stage 1", (("a", "1"), ("b", "2"), ("c", "3"))))
    assert p.startswith("SYSTEM") and "Example 2" in p and "Example 3" not in p and p.index("TEXT") > p.index("stage 1")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", i % 2, "k", 1.0) for i, (h, m) in enumerate([(0, 0), (0, 5), (2, 0), (2, 1), (5, 0), (9, 0), (9, 5)])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "events"))
    stream = live.read_operations(spark, str(tmp_path / "events"))
    batch = df.select(F.col("event_id").alias("op_id"), F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("op_kind"), "value")
    as_set = lambda x: {tuple(r) for r in x.collect()}
    assert as_set(live.run_to_table(live.tumbling(stream), "complete")) == as_set(live.tumbling(batch))
    closed = as_set(live.run_to_table(live.sessions(stream), "append"))
    assert closed <= as_set(live.sessions(batch)) and closed
    assert as_set(live.run_to_table(live.running_budget(stream), "complete")) == as_set(live.running_budget(batch))


def test_many_needles_meet_by_their_first_characters(spark):
    from synapta.operators.joins import holding

    texts = spark.createDataFrame([(i, f"see name{i:04d} and name{(i * 7) % 1500:04d}") for i in range(1500)] + [(9001, None), (9002, ""), (9003, "na")], "id long, content string")
    needles = [f"name{i:04d}" for i in range(1200)] + ["", None]
    for few in (needles[:5] + needles[-2:], needles):
        got = {(r.id, r.name) for r in holding(texts, "content", spark.createDataFrame([(n,) for n in few], "name string"), "name").collect()}
        known = {n for n in few if n}
        assert got == {(i, n) for i in range(1500) for n in (f"name{i:04d}", f"name{(i * 7) % 1500:04d}") if n in known}


def test_neighbours_by_words_and_by_embeddings(spark):
    schema = "memory_id long, session_id string, content string, embedding array<double>"
    old = spark.createDataFrame([(1, "a", "one two three four", None), (2, "a", "x y", [1.0, 0.0]), (3, "b", "one two three four", [1.0, 0.0]), (4, "a", "nothing like it", [0.0, 1.0])], schema)
    new = spark.createDataFrame([(10, "a", "one two three four", None), (11, "a", "z", [1.0, 0.1]), (1, "a", "one two three four", None)], schema)
    got = {(r.new, r.old): round(r.similarity, 3) for r in memory.neighbours(new, old).collect()}
    assert got == {(10, 1): 1.0, (11, 2): 0.995}


def test_context_rules(spark):
    assert value(spark, memory.replaces(*lit("entity", 0.9, "entity", 0.5))) is True and value(spark, memory.replaces(*lit("entity", 0.9, "skill", 0.5))) is False
    with pytest.raises(ValueError):
        memory.consolidate(spark.createDataFrame([], "memory_id long, session_id string, memory_type string, content string, importance double, tags array<string>"), "none")


def test_hierarchy_by_hand(spark):
    from synapta.operators import hierarchy

    turns = [(1, 1, 0, "Ann met Bob Smith in 2021"), (1, 1, 1, "what time is it"), (1, 1, 2, "no fact"), (1, 1, 3, "bye on Monday"), (1, 2, 0, "alone")]
    s = hierarchy.summaries(spark.createDataFrame(turns, "conversation_id long, session_id long, seq long, content string"))
    got = {r.session_id: r for r in s.collect()}
    assert got[1].summary == "Session 1: Ann met Bob Smith in 2021; bye on Monday" and got[1].facts == ["Ann met Bob Smith in 2021", "bye on Monday"]
    assert got[1]["keys"] == ["Ann met Bob Smith in 2021", "bye on Monday", "what time is it"] and got[1].names == ["Ann", "Bob Smith", "Monday"]
    assert (got[2].summary, got[2].facts, got[2]["keys"]) == ("Session 2: ", [], ["alone", "alone"])
    q = spark.createDataFrame([(c, 1, c) for c in (1, 2, 3, 4)], "question_id long, conversation_id long, category int")
    c = {r.question_id: (r.tokens, r.context) for r in hierarchy.contexts(s, q, 90).collect()}
    both = f"{got[1].summary}\nSession 2: "
    assert c == {1: (11, "Ann met Bob Smith in 2021\nbye on Monday\nalone\nalone"), 2: (14, both), 3: (17, both + "\nbye on Monday"), 4: (14, both)}


def test_stacked_merges(spark):
    """Two branches part and meet again, two hundred times."""
    links = [(0, None)]
    for i in range(200):
        top = 3 * i
        links += [(top + 1, top), (top + 2, top), (top + 3, top + 1), (top + 3, top + 2)]
    got = history.ancestors(spark.createDataFrame(links, "oid long, parent long"), spark.createDataFrame([(600,)], "head long")).collect()
    assert len(got) == 601 and max(r.depth for r in got) == 400
