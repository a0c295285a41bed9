"""Queries over the whole of small tables that reach past every former bound, against brute force."""

import hashlib
import random
import re

import pytest

from synapta import plans


def run(spark, name, path):
    return plans.queries()[name](spark, str(path)).collect()


@pytest.fixture(scope="module")
def long_documents(spark, tmp_path_factory):
    """Long, short and unmeasured texts with near copies of each."""
    rng, path = random.Random(5), tmp_path_factory.mktemp("long")
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for i in range(24):
        text = " ".join(rng.choice(words) for _ in range(600 if i % 3 else 40))
        rows += [(3 * i + 2, text, "en", "s", len(text)), (3 * i + 1, text + " no more", "en", "s", None if i % 5 == 0 else len(text) + 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path, {r[0]: frozenset(r[1].split()) for r in rows}


def test_pairs_and_merges_hold_long_memories(spark, long_documents):
    path, sets = long_documents
    j = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    near = lambda least: {p for p, s in j.items() if s > least}
    assert {(r.a, r.b) for r in run(spark, "o1_c11_neighbours", path)} == near(0.7)
    assert {(r.a, r.b) for r in run(spark, "o2_classify", path)} == near(0.5)
    assert {r.new for r in run(spark, "o3_effects", path)} == {b for _, b in near(0.5)}
    assert {r.memory_id: r.coherence for r in run(spark, "l3_coherence", path)} == {m: 0.0 if any(b == m for _, b in near(0.95)) else 1.0 for m in sets}
    assert {r.memory_id for r in run(spark, "c13_added", path)} == {m for m in sets if m % 3 == 1}
    assert {r.memory_id for r in run(spark, "s7_g5_three_way_merge", path)} == set(sets)
    conflicts = {(a, b) for a, b in near(0.85) if {a % 3, b % 3} == {1, 2}}
    assert {(r.a, r.b) for r in run(spark, "s8_c12_conflicts", path) if r.kind == "duplication"} == conflicts


def test_clusters_hold_long_memories(spark, long_documents):
    path, sets = long_documents
    want = {}
    for kind in range(3):
        clusters = []
        for m in sorted(x for x in sets if x % 3 == kind):
            for c in clusters:
                if any(len(sets[m] & sets[x]) / len(sets[m] | sets[x]) > 0.3 for x in c):
                    c.append(m)
                    break
            else:
                clusters.append([m])
        want |= {m: c[0] for c in clusters for m in c}
    assert {r.memory_id: r.cluster for r in run(spark, "n1_cluster", path)} == want
    assert sum(r.size for r in run(spark, "n3_consolidate", path)) == len(sets)


def test_clusters_by_lists_of_words(spark, tmp_path, monkeypatch):
    """Small sides, frequent words, copies that come late, and null keys, against the fold by hand."""
    from synapta.operators import memory, pairs

    monkeypatch.setattr(pairs, "SIDE", 40)
    monkeypatch.setattr(pairs, "FREQUENT", 16)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts, rows = [], []
    for i in range(260):
        if texts and rng.random() < 0.5:
            own = list(rng.choice(texts))
            own[: rng.randrange(len(own))] = rng.sample(words, rng.randrange(1, 9))
        else:
            own = [words[int(400 * rng.random() ** 3)] for _ in range(rng.choice((2, 6, 30, 60)))]
        texts.append(own)
        rows.append((1000 - 3 * i if i % 2 else 5000 + i, rng.choice(("a", "b")), "t", " \t".join(own), 0.5, ["x"]))
    rows += [(1, None, "t", "w1 w2", 0.5, ["x"]), (2, None, "t", "w1 w2", 0.5, ["x"]), (3, "a", None, "w1 w2", 0.5, ["x"]), (4, "a", "t", None, 0.5, ["x"]), (5, "a", "t", " \n", 0.5, ["x"])]
    sets = {r[0]: (r[1], frozenset(r[3].split() if r[3] else ())) for r in rows if r[2]}
    want = {r[0]: r[0] for r in rows}
    for m in sorted(sets):
        s, own = sets[m]
        near = [want[x] for x in sets if x < m and s and s == sets[x][0] and own and len(own & sets[x][1]) / len(own | sets[x][1]) > 0.3]
        want[m] = min([m, *near])
    table = spark.createDataFrame(rows, "memory_id long, session_id string, memory_type string, content string, importance double, tags array<string>")
    assert {r.memory_id: r.cluster for r in memory.cluster_sessions(table).collect()} == want
    assert 40 < len(set(want.values())) < 240
    sums = {r.cluster: (r["size"], r.words or 0) for r in memory.consolidate(table).collect()}
    assert sums == {c: (sum(v == c for v in want.values()), sum(len((r[3] or "").split()) for r in rows if want[r[0]] == c)) for c in set(want.values())}


def test_phrases_of_texts_with_accents(spark, tmp_path):
    texts = ["Le Café reste Paris Nord", "Élan Vital\u00a0Berlin caféHaus", "Madrid y Sevillaé", "“Plain” Text_ Lima’s 東京Tokyo Cafe\u0301"]
    rows = [(i, t, "fr", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    place = {}
    for i, t in enumerate(texts):  # Python's word boundaries know every script
        labels = re.findall(r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b", t)[:5] + re.findall(r"\b([A-Z][a-zA-Z]{2,})\b", t)
        for pos, label in enumerate(labels):
            place.setdefault(label.lower(), (i, pos))
    assert "vital\u00a0berlin" in place and "caf" not in place and "madrid" in place
    first = sorted(place, key=place.get)
    want = {(h, n) for h in first[:3] for n in place if place[h] < place[n]}
    assert {(r["from"], r["to"]) for r in run(spark, "p4_graph_from_memories", tmp_path)} == want


def test_pairs_of_parts_and_vectors_with_large_ids(spark, tmp_path):
    parts = [(i, f"{w} ring", "T", b, 1) for i, w, b in ((1, "red", "B1"), (299, "blue", "B2"), (300, "red", "B1"), (5000, "Red", "B1"), (5001, "dull", "B3"))]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    vectors = [(i, [1.0, float(i % 2)], "l") for i in (1, 119, 120, 199, 200, 9001)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label string").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    score = lambda x, y: 0.5 * len(set(x[1].lower().split()) & set(y[1].lower().split())) / len(set(x[1].lower().split()) | set(y[1].lower().split())) + 0.2 + 0.3 * (x[3] == y[3])
    pairs = [(x, y) for x in parts for y in parts if x[0] < y[0]]
    want = {(f"p{x[0]}", f"p{y[0]}"): round(score(x, y), 6) for x, y in pairs if score(x, y) >= 0.6}
    assert len(want) == 3 and {(r.a, r.b): r.similarity for r in run(spark, "q3_c10_merge_candidates", tmp_path)} == want
    assert {(r.a, r.b) for r in run(spark, "q5_keep_side", tmp_path)} == set(want)
    assert {r.entity_id for r in run(spark, "q10_evolution_cycle", tmp_path)} == {f"p{x[0]}" for x in parts}
    ids = {(x[0], y[0]) for x, y in pairs}
    assert {(r.a, r.b) for r in run(spark, "h5_h6_h7_set_similarity", tmp_path)} == {(r.a, r.b) for r in run(spark, "h8_attribute_similarity", tmp_path)} == ids
    near = {(a[0], b[0]) for a in vectors for b in vectors if a[0] < b[0]}
    assert {(r.a, r.b) for r in run(spark, "h9_cosine", tmp_path)} == {(r.a, r.b) for r in run(spark, "q4_semantic_candidates", tmp_path)} == near


def test_contexts_and_jobs_with_large_ids(spark, tmp_path):
    docs = [(i, f"text {i}", "de" if i % 2 else "fr", "s", 4000) for i in (1, 2, 3, 199, 200, 201, 777, 5000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ids = [0, 1, 4, 5, 399, 400, 401, 404, 10**6, 10**6 + 1]
    events = [(i, 10**6 - i, i % 3, "k", 1.0, "{}") for i in ids]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string, value double, props string").selectExpr("event_id", "timestamp_seconds(ts) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.memory_id for r in run(spark, "f6_block_order", tmp_path)} == {d[0] for d in docs}
    contexts = {}
    heads = ["", "[Working Memory]\n", "", "[Previous Conversation]\n", "[Relevant Information]\n", "[Skill]\n", "[Entity]\n"]
    for i, text, lang, _, _ in sorted(docs, key=lambda d: (d[0] % 7, -(d[0] * 13 % 101), d[0])):
        contexts[lang] = contexts.get(lang, "") + heads[i % 7] + text + ("\n" if i % 7 == 2 else "\n\n")
    assert {r.session_id: r.context_sha256 for r in run(spark, "l6_format_context", tmp_path)} == {k: hashlib.sha256(v.strip().encode()).hexdigest() for k, v in contexts.items()}
    # 5632 tokens hold five memories of 1000, of any type.
    assert {r.session_id: (r.used, r.chosen, r.skipped) for r in run(spark, "l4_budget_pack", tmp_path)} == {s: (min(5, n) * 1000, min(5, n), max(0, n - 5)) for s in ("de", "fr") for n in [sum(d[2] == s for d in docs)]}
    queued = sorted((i for i in ids if i % 4 == 0), reverse=True)
    assert {r.job_id: r.position for r in run(spark, "n5_queue", tmp_path)} == {i: n for n, i in enumerate(queued)}
    assert {r.job_id for r in run(spark, "b14_jobs_by_status", tmp_path)} == {i for i in ids if i % 4 == 1}
    assert {r.status: r.n for r in run(spark, "d8_scheduler_stats", tmp_path)} == {"queued": len(queued), "running": 4, "failed": 1}


def test_ancestors_of_a_long_history(spark):
    from collections import deque

    from synapta.operators import history

    n = 1600
    links = [(i, i - 1) for i in range(1, n)] + [(0, None), (1500, 1400), (1400, 1370), (9000, 30), (9001, 9000), (9000, 29)]
    up = {}
    for child, parent in links:
        up.setdefault(child, []).append(parent)

    def walk(head):
        depth, queue = {head: 0}, deque([head])
        while queue:
            x = queue.popleft()
            for p in up.get(x, []):
                if p is not None and p not in depth:
                    depth[p] = depth[x] + 1
                    queue.append(p)
        return depth

    parents = spark.createDataFrame(links, "oid long, parent long")
    heads = lambda *x: spark.createDataFrame([(h,) for h in x], "head long")
    got = history.ancestors(parents, heads(n - 1, 9001)).collect()
    assert {(r.head, r.oid): r.depth for r in got} == {(h, o): d for h in (n - 1, 9001) for o, d in walk(h).items()}
    assert max(walk(n - 1).values()) > 1000
    base = history.merge_base(history.ancestors(parents, heads(n - 1)), history.ancestors(parents, heads(9001))).first()
    assert (base.oid, base.depth) == (29, 2)
    assert {r.oid for r in history.ancestors(parents, heads(n - 1), 7).collect()} == {o for o, d in walk(n - 1).items() if d <= 7}
