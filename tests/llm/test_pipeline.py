"""The pipeline's stages on a small corpus: what each must drop goes, and clean documents stay."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from synapta.llm.shared import save
from synapta.llm.tokens import Encoder, default_path
from tests.llm import brute


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(9)
    words = [f"term{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "a shared line that is long enough to count for the operator"
    rows, toxic = [], set()
    for i in range(240):
        body = text(rng.randrange(20, 90))
        if i % 6 == 0:
            body += " vile rotten scoundrel"
            toxic.add(i)
        if i % 10 == 1:
            body += "\n" + shared
        rows.append((i, body, "en", f"src{i % 3}", len(body)))
    copy = rows[5][1].split(" ")
    rows += [(300, " ".join(copy), "en", "src0", 1), (301, " ".join([*copy, "more"]), "en", None, 1), (302, None, None, None, None), (303, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    left = {r.doc_id for r in seen["toxicity"]}
    clean = {r[0] for r in rows} - toxic
    assert clean <= left and len(left & toxic) <= len(toxic) * 0.1
    assert sum(shared in (r.text or "") for r in seen["line_dedup"]) == 1 and len(seen["line_dedup"]) == len(left)
    once = {r.doc_id for r in seen["ngram_join"]}
    assert 5 in once and not once & {300, 301} and left - {300, 301} <= once
    sizes = {r.doc_id: len((r.text or "").split()) for r in seen["ngram_join"]}
    assert sum(sizes[r.doc_id] for r in seen["mixing"]) <= sum(sizes.values())
    packed = seen["packing"]
    assert sum(len(r.ids) // 4 for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    key = lambda rows: sorted((r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in rows)
    assert key(corpus_pipeline.run(spark, str(tmp_path)).collect()) == key(packed)


def test_run_equals_brute_force(spark, tmp_path):
    """All five stages in plain code, from the documents to the token ids of every copy."""
    rng = random.Random(21)
    words = [f"term{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = [f"{text(8)} is a line that many documents hold" for _ in range(3)]
    rows, labels = [], {}
    for i in range(260):
        body = text(rng.randrange(3, 120))
        labels[i] = int(i % 6 == 0)
        if rng.random() < (0.9 if labels[i] else 0.05):
            body += " vile rotten" + " scoundrel" * rng.randrange(3)
        if i % 9 == 2:
            body = f"{text(4)}\n  {lines[i % 3].upper()}\t\n{body}"
        rows.append((i, body, f"src{i % 4}"))
    for i, j in ((300, 5), (301, 5), (302, 7), (303, 300)):
        rows.append((i, rows[j][1] if j < 260 else rows[5][1] + " more", "hot"))
    rows += [(400, None, None), (401, "", "src0"), (402, " \n ", "hot"), (403, text(3000), "long"), (404, "vile rotten scoundrel", None)]
    table = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    taught = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5}
    scores = brute.toxicity({i: t for i, t, _ in rows}, taught)[0]
    assert all(abs(s - 0.5) > 1e-5 for s in scores.values())
    clean = [r for r in rows if scores[r[0]] < 0.5]
    assert 0 < len(clean) < len(rows)
    left = brute.drop_shared_lines(clean)
    assert left != clean
    groups = brute.components(left, 5, 80, 100)
    once = [r for r in left if groups[r[0]][1] == r[0]]
    assert len(once) < len(left)
    copies = brute.mix(once)
    assert {0, 1, 2} <= {copies[r[0]] for r in once}

    tokenizer = Encoder(default_path()).tokenizer
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, _ in once}
    held, sequences = {i: np.zeros(len(x), int) for i, x in ids.items()}, defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        piece = np.frombuffer(bytes(r.ids), "<u4")
        assert r.doc_tokens == len(ids[r.doc_id]) and (piece == ids[r.doc_id][r.start : r.start + len(piece)]).all()
        held[r.doc_id][r.start : r.start + len(piece)] += 1
        sequences[r.sequence_id].append((r.offset, len(piece)))
    assert all((n == copies[i]).all() for i, n in held.items())
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
