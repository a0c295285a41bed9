"""The ten operators against brute force, on small tables with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from synapta.llm import ann, chat, crf_quality, line_dedup, mixing, ngram_join, packing, perfect_hash, queries, token_store, topk, toxicity
from synapta.llm.components import components
from synapta.llm.tokens import Encoder, default_path
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_lines long, score double, size int"
LINE = "this very line is long enough to be shared by several documents"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 7, 0.5, 3) for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(5)
    words = "alpha beta gamma delta idiot epsilon zeta eta theta iota kappa lambda".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "two words", "b"), (None, text(30), "c")]
    rows += [(10 + i, text(rng.randrange(3, 60)), f"s{i % 4}") for i in range(40)]
    base = text(200)
    rows += [(100 + i, base, "hot") for i in range(12)] + [(200, base + " end", "hot"), (201, "start " + base, "hot")]
    rows += [(300 + i, f"{text(5)}\n  {LINE.upper()}\t\n{text(4)}", "hot") for i in range(8)]
    rows += [(400, text(9000), "long"), (401, "é " * 3000 + "\n\n  <|endoftext|> don't!!", None)]
    rows += [(50, rows[20][1], "a"), (50, rows[20][1], "a")]  # equal rows
    return rows


def ids_of(tok, text):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.fixture(scope="module")
def tok():
    return Encoder(default_path()).tokenizer


def test_first_ids_are_those_of_the_smallest_hashes(spark):
    from synapta.llm.shared import first_ids

    ids = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) AS id").union(spark.createDataFrame([(None,)], "id long"))
    want = [r.id for r in ids.filter("id IS NOT NULL").distinct().selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    for most in (1, 50, 2000, 9000):
        assert first_ids(ids, most) == want[:most]


def test_encoder_equals_whole_texts(tok):
    texts = ["a  b", " a", "  a\n b\n  c", "x<|endoftext|> y.", "a <|endoftext|>b!!", "\n \n", "a\t b ", "don't, 's dogs' x,y .d", "　 a", "a\x1c b", "a\0b", "é!! ñ\n\nz.\n", "", None]
    assert [Encoder(default_path()).encode([t])[0] for t in texts] == [ids_of(tok, t)[:-1].tobytes() for t in texts]


def test_long_unbroken_strings_are_not_kept(tok):
    encoder = Encoder(default_path())
    texts = [f"{c}{'xyz' * 30_000}" for c in "abcdefgh"] + ["漢字" * 20_000, "a b " * 5]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(map(len, encoder.memo)) < 100
    assert len(ngram_join.shingles(" ".join(texts), 3)) and max(map(len, ngram_join._words), default=0) <= 64


def test_a_worker_gives_memory_back_when_another_operator_begins(monkeypatch):
    from synapta.llm import memos, tokens

    memos.claim("nobody")
    given = []
    monkeypatch.setattr(memos, "release", lambda: given.append(1))
    encoder = tokens.encoder(tokens.default_path())
    ids = encoder.encode(["Some words to keep, some words"])
    assert encoder.memo and tokens.encoder(tokens.default_path()) is encoder and len(given) == 1
    memos.claim("words")
    assert len(given) == 2 and not tokens._encoders and not encoder.memo
    assert tokens.encoder(tokens.default_path()).encode(["Some words to keep, some words"]) == ids


def test_op1_packs_every_id_once(spark, awkward, tok):
    got = queries.digest_pieces(packing.pack(docs(spark, awkward), size=256, open_windows=4)).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 256
    want = sum(len(ids_of(tok, t)) for _, t, _ in awkward)
    assert sum(fill.values()) == want
    texts = {i: ids_of(tok, t) for i, t, _ in awkward}
    for r in got:
        own = texts[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert packing.pack(docs(spark, [])).count() == 0


def test_op2_equals_brute_force(spark, awkward):
    rows = [r for r in awkward]
    key = lambda line: line.strip(" \t\n\v\f\r").encode().lower()
    holders = defaultdict(set)
    for n, (_, t, _) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(line.strip(" \t\n\v\f\r")) >= 40:
                holders[key(line)].add(n)
    order = lambda i: -1 if i is None else i
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= 5 and max(order(rows[n][0]) for n in h) != order(i) for x in lines]
        want.append((order(i), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    got = line_dedup.drop_shared_lines(docs(spark, rows)).collect()
    assert sorted((order(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in got) == sorted(want)
    assert line_dedup.drop_shared_lines(docs(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(3)
    h, fp, other = (rng.integers(0, 2**64, 5000, np.uint64) for _ in range(3))
    built = perfect_hash.PerfectHash.loads(perfect_hash.PerfectHash.build(h, fp, np.arange(5000)[None]).dumps())
    assert sorted(built.positions(h, fp).tolist()) == list(range(5000))
    found, values = built.probe(h, fp)
    assert found.all() and (values[0] == np.arange(5000)).all()
    assert not built.probe(h, other)[0].any() and not built.probe(other, other[::-1])[0].any()
    empty = perfect_hash.PerfectHash.build(h[:0], fp[:0], np.zeros((1, 0), np.int64))
    assert not empty.probe(h, fp)[0].any()


def test_op3_round_trip(spark, awkward, tok):
    rows = [r for r in awkward if r[0] is not None and r[0] != 50]
    manifest, folder, dictionary = token_store.write(docs(spark, rows))
    got = {r.doc_id: r for r in token_store.read(manifest, folder, dictionary).collect()}
    at = 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        own = ids_of(tok, t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    name = manifest.orderBy("shard").first()["shard"]
    with token_store.open_input(f"{folder}/{name}") as file:
        shard = token_store.Shard(file, dictionary)
        assert np.array_equal(np.array(shard.ids(len(shard) - 1)), ids_of(tok, dict((i, t) for i, t, _ in rows)[shard.doc_id(len(shard) - 1)]))
        file.seek(0)
        with pytest.raises(ValueError):
            token_store.Shard(file, dictionary + b"x")
    for i in (4, 400, 401):
        found = token_store.fetch(manifest, folder, dictionary, i)
        assert len(found) == 1 and np.array_equal(found[0], ids_of(tok, dict((j, t) for j, t, _ in rows)[i]))
    assert token_store.fetch(manifest, folder, dictionary, 99_999) == []
    assert token_store.read(*token_store.write(docs(spark, awkward))).count() == len(awkward)
    assert token_store.read(*token_store.write(docs(spark, []))).count() == 0


def vectors(spark, n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)).astype("f4")
    v[n // 3 : 2 * n // 3] = v[0]  # a third of all vectors are equal
    rows = [(i, v[i].tolist(), 1) for i in range(n)]
    rows += [(10**6, None, 1), (10**6 + 100, [0.0] * d, 1), (10**6 + 200, [float("nan")] * d, 1), (10**6 + 300, [None] * d, 1), (10**6 + 400, [1.0] * (d - 1), 1), (None, [1.0] * d, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), v


def test_op4_recall_and_scores(spark):
    table, v = vectors(spark, 3000)
    got = defaultdict(list)
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x, hits = v.astype("f8"), 0
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 3000, 50))
    for q, rows in got.items():
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(3000), -s))[:5].tolist()) & {i for i, _ in rows})
        assert len(rows) == 5 and [i for i, _ in rows] == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
        assert np.allclose([c for _, c in rows], [unit[i] @ unit[q] for i, _ in rows], atol=1e-12)
    assert hits / (5 * len(got)) >= 0.9
    assert ann.nearest(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few).orderBy("query_id", "rank").collect()] == [(0, 51), (0, 50), (50, 51), (50, 0)]


def test_multi_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**16, (4000, 8), np.uint16)
    codes[:50] = codes[0] ^ (1 << rng.integers(0, 16, (50, 8))).astype(np.uint16) * (rng.random((50, 8)) < 0.3)
    index = ann.MultiIndex(codes)
    for t in (0, 1, 3, 5):
        got = index.probe(codes[0], t).tolist()
        near = np.bitwise_count(codes ^ codes[0])
        assert got == np.flatnonzero(near.min(1) <= t).tolist()
        assert set(np.flatnonzero(near.sum(1) <= 8 * (t + 1) - 1).tolist()) <= set(got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op4_probes_part_of_the_codes_with_recall(spark, sf):
    import os

    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    table = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], "f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, narrow, hits = ann.nearest(table).collect(), 0, 0
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    for q in ids[ids % 50 == 0].tolist():
        s = np.where(ids == q, -2, x @ x[ids == q][0])
        hits += len(set(ids[np.lexsort((ids, -s))[:5]].tolist()) & {r.vec_id for r in by[q]})
        narrow += all(r.probed < r.held for r in by[q])
    assert hits >= 0.9 * 5 * len(by) and narrow > 0.9 * len(by)
    if sf == "sf0.1":
        assert np.mean([r.probed / r.held for r in got]) < 0.5


def test_op4_of_repeated_rows(spark):
    v = np.random.default_rng(4).standard_normal((80, 4)).astype("f4")
    rows = [(0, v[0].tolist())] * 12 + [(i, v[i].tolist()) for i in range(1, 80)] + [(7, v[7].tolist())] * 3
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    x = v.astype("f8") / np.linalg.norm(v.astype("f8"), axis=1, keepdims=True)
    for q in (0, 50):
        mine = [r.vec_id for r in got if r.query_id == q]
        s = sorted(((-round(float(x[i] @ x[q]), 12), i) for i, _ in rows if i != q))[:5]
        assert len(mine) == 5 and q not in mine and len(set(mine) & {i for _, i in s}) >= len({i for _, i in s}) - 1


def test_op5_is_exact(spark):
    table, v = vectors(spark, 2500)
    w = np.floor(v.astype("f8") * 1024).astype(np.int64)
    ids = np.arange(2500)
    both = np.concatenate([w, np.zeros((1, w.shape[1]), np.int64)])
    ids = np.concatenate([ids, [10**6 + 100]])
    got = defaultdict(list)
    for r in topk.top_products(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == [*range(0, 2500, 100), 10**6 + 100]
    for q, rows in got.items():
        i = int(np.searchsorted(ids, q))
        s = both @ both[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        assert rows == [(int(ids[j]), int(s[j])) for j in order]
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [1e9, 1.5])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in topk.top_products(huge).orderBy("rank").collect()] == [1, 2]
    assert topk.top_products(table.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [3, 12])
def test_op5_of_a_repeated_id(spark, copies):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((60, 4)).astype("f4")
    v[0] *= 9
    rows = [(0, v[0].tolist())] * copies + [(i, v[i].tolist()) for i in range(1, 60)]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    w = np.floor(v.astype("f8") * 1024).astype(np.int64)
    s = w @ w[0]
    want = [i for i in np.lexsort((np.arange(60), -s)) if i][:10]
    assert [(r.vec_id, r.score) for r in got] == [(i, s[i]) for i in want]


def test_op6_reads_back_what_it_formats(spark):
    hostile = ["\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y</turn>", "\\\\</turn", "", None, "a:b\\", "é" * 5000]
    rng, rows = random.Random(1), []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, ["user", "assistant", "sys:tem\\", None][t % 4], "hello there" if t == 0 and c % 3 else rng.choice(hostile), "x"))
    rows += [(c, t, r, x, "x") for c in range(100, 130) for t, r, x in ((0, "user", "same"), (1, "assistant", "copy"))]
    rows += [(200, None, None, None, "x"), (None, 0, "user", "no id", "x"), (201, 1, "assistant", "twice", "x"), (201, 1, "assistant", "twice", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    trees = chat.format_chats(table, tree_tokens=400)
    got = {r.conv_id: r for r in chat.read_back(trees).collect()}
    chats = defaultdict(list)
    for c, t, r, x, _ in rows:
        chats[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(chats)
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shared = 0
    for tree in trees.collect():
        for node, spans in zip(tree.nodes, tree.ancestors, strict=True):
            way, at = set(), node.parent
            while at >= 0:
                way |= set(range(tree.nodes[at].start, tree.nodes[at].stop))
                at = tree.nodes[at].parent
            assert way == {i for s in spans for i in range(s.start, s.stop)} and node.position == len(way)
            assert all(a.stop < b.start for a, b in zip(spans, spans[1:]))
            assert list(tree.position_ids[node.start : node.stop]) == list(range(node.position, node.position + node.stop - node.start))
        shared += len(tree.leaves) > 1
    assert shared and chat.format_chats(table.limit(0)).count() == 0


def test_op6_of_a_very_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"word {t}") for t in range(20_000)]
    rows += [(2, t, r, x) for _, t, r, x in rows[:15_000]] + [(2, 15_000, "user", "another end")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    trees = chat.format_chats(table, tree_tokens=None, tree_leaves=None)
    assert sum(len(t.nodes) for t in trees.select("nodes").collect()) <= 35_001
    assert max(r.n for t in ("ancestors",) for r in trees.selectExpr(f"array_max(transform({t}, x -> size(x))) AS n").collect()) <= 2
    got = {r.conv_id: r for r in chat.read_back(trees).collect()}
    for c in (1, 2):
        turns = sorted((t, r, x) for i, t, r, x in rows if i == c)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest())


def test_op7_targets_and_cut(spark, awkward):
    rows = [*awkward, *[(1000 + i, "w " * 5, "tiny") for i in range(3)]]
    got = mixing.schedule(docs(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((i or -1, size(t)) for i, t, _ in rows)
    total, by = sum(r["size"] for r in got), defaultdict(list)
    for r in got:
        assert r.taken <= 3 * r["size"]
        by[r.source].append(r)
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    capped: set = set()
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / (sum(w for s, w in weights.items() if s not in capped) or 1)
        more = {s for s, w in weights.items() if s not in capped and w * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s, x in by.items():
        target = 3 * sizes[s] if s in capped else weights[s] * level
        assert all(abs(r.target - target) < 1e-6 for r in x)
        assert abs(sum(r.taken for r in x) - target) <= max(r["size"] for r in x)
    assert sum(r.taken for r in got) <= total
    again = mixing.schedule(docs(spark, rows[::-1]).repartition(3)).collect()
    key = lambda r: (r.doc_id or -1, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, []).columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.schedule(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0


def test_mix_keeps_every_column_and_spreads_repeated_rows(spark):
    rows = [(i, f"w{i} " * (i % 9 + 1), f"s{i % 3}", i, -i, "h", 7) for i in range(60)]
    rows += [(5, "same again", "s0", 1, 2, "x", 3)] * 3000 + [(None, "no id", "s1", 4, 5, None, 6), (None, "no di", "s1", 4, 5, "y", 6), (None, None, None, 0, 0, "z", 0)] * 20
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, _pcopies int, held string, row int").repartition(5)
    got = [tuple(r) for r in mixing.mix(table).collect()]
    assert set(got) <= set(rows)
    taken, whole = defaultdict(int), defaultdict(int)
    for r in mixing.schedule(table).collect():
        taken[r.doc_id, r.source, r["size"]] += r.copies
    for r in got:
        whole[r[0], r[2], len((r[1] or "").split())] += 1
    assert {k: n for k, n in taken.items() if n} == dict(whole)
    held, mixed = defaultdict(int), defaultdict(int)
    for r in rows:
        held[r] += 1
    for r in got:
        mixed[r] += 1
    assert all(mixed[r] <= 3 * held[r] for r in mixed)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_op8_equals_brute_force(spark, awkward, n, num):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(300)]
    rows = list(awkward)
    for g in range(12):  # near copies around the threshold, many of one group apart from its smallest
        base = [rng.choice(words) for _ in range(rng.choice([9, 20, 60, 150, 400]))]
        for c in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + 100 * g + c, " ".join(copy), "x"))
    got = ngram_join.link_components(docs(spark, rows), n, num, 100).collect()
    want = brute.components(rows, n, num, 100)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert ngram_join.link_components(docs(spark, [])).count() == 0


def test_prefixes_lose_no_link():
    rng = np.random.default_rng(4)
    for num in (80, 90):
        for _ in range(400):
            n = int(rng.integers(1, 400))
            both = rng.integers(0, 2**64, n, np.uint64)
            extra = int(n * (100 - num) / num)
            a_only = int(rng.integers(0, extra + 1))
            more = rng.integers(0, 2**64, extra, np.uint64)
            a, b = np.unique(np.concatenate([both, more[:a_only]])), np.unique(np.concatenate([both, more[a_only:]]))
            assert ngram_join.linked(a, b, num, 100)
            common = np.sort(rng.choice(np.concatenate([both, more]), int(rng.integers(0, n + extra + 1)), replace=False))
            assert set(ngram_join.prefix(a, common, num, 100).tolist()) & set(ngram_join.prefix(b, common, num, 100).tolist())


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**64, 300, np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 300 - k, replace=False), rng.integers(0, 2**64, int(k * rng.random() * 2), np.uint64)])) for k in rng.integers(0, 60, 40)]
    sizes, rows = np.array([len(s) for s in sets]), np.arange(40)
    for per in (1, 4):
        maps = [ngram_join.bitmap(s, per) for s in sets]
        for exact in (None, sets):
            root = list(range(40))
            for a, b in ngram_join.tile_links(maps, sizes, rows, rows, rows, 90, 100, exact):
                assert exact is None or ngram_join.linked(sets[a], sets[b], 90, 100)
                root = [root[b] if r == root[a] else r for r in root]
            for a in range(40):
                for b in range(a + 1, 40):
                    assert ngram_join.most_overlap(maps[a], sizes[a], maps[b], sizes[b]) >= ngram_join.overlap(sets[a], sets[b])
                    assert root[a] == root[b] or not ngram_join.linked(sets[a], sets[b], 90, 100)
    assert ngram_join.tile_links(maps, sizes, np.zeros(40, int), rows, rows, 90, 100) == []
    body = rows % 3  # what is joined already must not hide a row's own partners
    spanned = {x for pair in ngram_join.tile_links(maps, sizes, body, rows, rows, 90, 100) for x in pair}
    for a in range(40):
        for b in range(40):
            if body[a] != body[b] and ngram_join.linked(sets[a], sets[b], 90, 100):
                assert {a, b} <= spanned


def test_keep_one_of_each_group(spark, awkward):
    kept = ngram_join.keep_one(docs(spark, awkward), 3, 90, 100)
    want = brute.components(awkward, 3, 90, 100)
    assert kept.columns == docs(spark, []).columns
    got = sorted(r.doc_id or -1 for r in kept.collect())
    assert got == sorted([i for i, (_, c) in want.items() if i is not None and c == i] + [-1])


def test_keep_one_with_clashing_columns_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base, 1, "a", 0, "h"), (2, base + " more", 2, "b", 0, "h"), (3, "another text of its own entirely", 3, "c", 0, "h"), (3, "another text of its own entirely", 4, "c", 0, "i"), (4, None, 5, "d", 0, "h"), (None, base, 6, "e", 0, "h"), (4, None, 6, "d", 0, "h")]
    rows += [(7, "seven eight nine ten eleven twelve", i, "f", 0, "h") for i in range(500)] + [(7, "quite a different text with the same id", 0, "f", 0, "h")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _kept int, source string, id int, held string")
    runs = [sorted(tuple(map(str, r)) for r in ngram_join.keep_one(t, 5, 80, 100).collect()) for t in (table, table.repartition(6))]
    assert runs[0] == runs[1] and ngram_join.keep_one(table, 5, 80, 100).columns == table.columns
    assert sorted((r[0], r[1]) for r in runs[0]) == sorted((str(i), str(t)) for i, t in [(1, base), (3, rows[2][1]), (4, None), (None, base), (7, rows[8][1]), (7, rows[-1][1])])


def test_op8_with_a_passage_in_every_third_document(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(2000)]
    passage = "this same passage of eight words is everywhere"
    rows = []
    for i in range(300):
        body = [rng.choice(words) for _ in range(rng.choice([2, 5, 9, 30, 31, 33, 80, 300]))]
        rows.append((i, " ".join([*body, passage]) if i % 3 == 0 else " ".join(body), "s"))
    rows += [(1000 + i, rows[3 * (i % 40)][1] + (" z" if i % 2 else ""), "s") for i in range(80)]
    for n, num in ((3, 90), (5, 80)):
        want = brute.components(rows, n, num, 100)
        for r in ngram_join.link_components(docs(spark, rows), n, num, 100).collect():
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 1 for i in range(1, 60))


def test_op9_search_is_exact_and_learns(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(words) for _ in range(60)) + (" vile rotten" + rng.choice(["", "ly"]) if toxic else "")
        rows.append((i, text, "s"))
        labels.append((i, None if i % 50 == 1 else int(toxic), 1))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "vile rotten words", "s"), (1002, "x " * 50_000, "s")]
    table = docs(spark, rows)
    model = toxicity.fit(table, spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 1)], "doc_id long, toxic int, quality int"))
    got = toxicity.score(table, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400]) > 0.97
    for _, text, _ in rows[:60]:
        terms, weights = model.vector(toxicity.word_counts(text))
        found, cosines = model.index.search(terms, weights, 9)
        dense = np.zeros(model.index.size)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            a, b = model.index.entry_start[model.index.term_start[t]], model.index.entry_start[model.index.term_start[t + 1]]
            np.add.at(dense, model.index.example[a:b], w * model.index.weight[a:b])
        assert np.allclose(np.sort(dense)[::-1][: len(found)], cosines)
        assert len(found) == min(9, int((dense > 1e-12).sum()))
    one = toxicity.fit(table, spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int"))
    assert {r.score for r in toxicity.score(table, one).collect()} == {0.0}


def test_op9_equals_brute_force_from_texts(spark):
    """TF-IDF, neighbours, votes and curve recomputed in plain code from the texts."""
    rng = random.Random(13)
    words, rows, labels = [f"common{i}" for i in range(60)], [], {}
    for i in range(160):
        labels[i] = int(i % 5 == 0)
        text = [rng.choice(words) for _ in range(rng.randrange(4, 30))]
        if rng.random() < (0.9 if labels[i] else 0.1):
            text += rng.choices(["vilely", "viler", "rotten", "Rottenest"], k=rng.randrange(1, 4))
        rows.append((i, " ".join(text), "s"))
    rows += [(500, "viler than rotten", "s"), (501, None, "s"), (502, "common1 common2", "s")]
    table = docs(spark, rows)
    model = toxicity.fit(table, spark.createDataFrame([(i, y, 1) for i, y in labels.items()], "doc_id long, toxic int, quality int"))
    got = {r.doc_id: (r.score, [tuple(e) for e in r.evidence]) for r in toxicity.score(table, model).collect()}

    scores, kept, near = brute.toxicity({i: t for i, t, _ in rows}, labels)
    assert kept and set(kept) == set(model.vocabulary)
    for i, _, _ in rows:
        assert got[i][0] == pytest.approx(scores[i], abs=1e-6)
        assert [round(c, 9) for _, c, _ in got[i][1]] == [round(c, 9) for c in near[i]]
    assert max(len(e) for _, e in got.values()) == 16


def test_op10_equals_brute_force_over_labellings(spark):
    """A document's score from its text, by the sum over all labellings of its lines."""
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "slowly", "to", "sea"]) for _ in range(r.randrange(3, 12))).capitalize() + "."
    rows = [(i, "\n".join(good() if i % 2 or r.random() < 0.4 else "BUY | NOW 12 | " * r.randrange(1, 4) for _ in range(r.randrange(1, 7))), "s") for i in range(120)]
    rows += [(500, "One line.", "s"), (501, None, "s"), (502, "Same line here.\n\nSame line here.\nA 99 b!", "s")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    m = crf_quality.fit(docs(spark, rows), labels)
    got = {x.doc_id: x.score for x in crf_quality.score(docs(spark, rows), m).collect()}

    def features(lines, i):
        line, words = lines[i], lines[i].split()
        k = len(words) or 1
        return [np.log1p(len(line)), np.log1p(len(words)), sum(a != b for a, b in zip(line, line.lower())) / (len(line) or 1), sum(c in crf_quality.MARKS for c in line) / k, len(set(words)) / k,
                sum(a == b for a, b in zip(words, words[1:])) / k, sum(map(len, words)) / k, sum(len(w) <= 3 for w in words) / k, sum(c.isdigit() for c in line) / (len(line) or 1),
                float(line in lines[:i]), float(line[-1:] in ".?!:;"), max(map(len, words), default=0)]

    width, f = crf_quality.BINS + 1, len(crf_quality.FEATURES)
    for i, text, _ in [*rows[:30], *rows[-3:]]:
        lines = (text or "").split("\n")
        own = [[sum(v >= c for c in cuts) for v, cuts in zip(features(lines, j), m.cuts, strict=True)] for j in range(len(lines))]
        edge = [crf_quality.BINS] * f
        e = []
        for j in range(len(lines)):
            around = (own[j], own[j - 1] if j else edge, own[j + 1] if j + 1 < len(lines) else edge)
            e.append(sum(m.weights[b + place * width + part * f * width] for part, bins in enumerate(around) for place, b in enumerate(bins)))
        total, one = 0.0, np.zeros(len(lines))
        for s in range(1 << len(lines)):
            y = [s >> j & 1 for j in range(len(lines))]
            w = np.exp(sum(a * b for a, b in zip(e, y, strict=True)) + sum(m.trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            one += w * np.array(y)
        p, sizes = one / total, np.array([max(1, len(x)) for x in lines])
        odds = np.clip(np.log(p) - np.log1p(-p), -20, 20)
        z = m.curve @ [1, p @ sizes / sizes.sum(), odds @ sizes / sizes.sum() / 4]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_op10_learns_from_documents_of_any_length(spark):
    rows = [(i, ("Good prose goes on and on here.\n" if i % 2 else "BUY | NOW |\n") * 900, "s") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    m = crf_quality.fit(docs(spark, rows), labels)
    assert m.fitted and all((x.score >= 0.7) == (x.doc_id % 2 == 1) for x in crf_quality.score(docs(spark, rows), m).collect())


def test_op9_and_op10_scores_follow_the_shares_of_all_labels(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(900):
        rare = i % 10 == 0
        marked = rng.random() < (0.8 if rare else 0.2)
        text = " ".join(rng.choice(words) for _ in range(20))
        rows.append((i, text + " vile\nBUY | NOW | " * 2 if marked else text, "s"))
        labels.append((i, int(rare), int(not rare)))
    table, labels = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 60)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 120)
    monkeypatch.setattr(crf_quality, "MOST_EACH", 60)
    toxic, good = toxicity.fit(table, labels), crf_quality.fit(table, labels)
    assert toxic.base == pytest.approx(0.1) and good.base == pytest.approx(0.9)
    assert np.mean([r.score for r in toxicity.score(table, toxic).collect()]) == pytest.approx(0.1, abs=0.05)
    assert np.mean([r.score for r in crf_quality.score(table, good).collect()]) == pytest.approx(0.9, abs=0.05)


def test_op10_marginals_and_learning(spark):
    rng = np.random.default_rng(1)
    lengths, trans = np.array([1, 4, 3, 4]), rng.standard_normal((2, 2))
    e = rng.standard_normal(lengths.sum())
    p, odds, z, counts = crf_quality.Chains(lengths).marginals(e, trans, pairs=True)
    want, want_z, want_counts, at = [], 0.0, np.zeros((2, 2)), 0
    for n in lengths:
        w = np.array([np.exp(sum(e[at + t] * (s >> t & 1) for t in range(n)) + sum(trans[s >> t & 1, s >> t + 1 & 1] for t in range(n - 1))) for s in range(1 << n)])
        want += [sum(w[s] for s in range(1 << n) if s >> t & 1) / w.sum() for t in range(n)]
        for s in range(1 << n):
            for t in range(n - 1):
                want_counts[s >> t & 1, s >> t + 1 & 1] += w[s] / w.sum()
        want_z += np.log(w.sum())
        at += n
    assert np.allclose(p, want) and np.allclose(odds, np.log(p / (1 - p))) and np.isclose(z, want_z) and np.allclose(counts, want_counts)
    r = random.Random(2)
    good = lambda: "\n".join(" ".join(r.choice(["the", "river", "runs", "slowly", "to", "sea"]) for _ in range(9)).capitalize() + "." for _ in range(6))
    bad = lambda: good().split("\n")[0] + "\n" + "\n".join("BUY | NOW | " * 4 for _ in range(5))
    rows = [(i, good() if i % 2 else bad(), "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, [*rows, (900, None, "s"), (901, "", "s"), (902, "x\n" * 20_000, "s"), (None, good(), "s")])
    model = crf_quality.fit(table, labels)
    got = {x.doc_id: x.score for x in crf_quality.score(table, model).collect()}
    assert len(got) == 204 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == (i % 2 == 1) for i in range(100, 200)]) > 0.97
    assert got[900] == got[901]
    nothing = crf_quality.fit(table, labels.limit(0))
    assert {x.score for x in crf_quality.score(table, nothing).collect()} == {1.0}
