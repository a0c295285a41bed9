"""Every registered query against its DuckDB statement, on the smallest data set."""

import os

import pytest

from synapta import plans

DATA = os.path.join(os.environ.get("SYNAPTA_DATA", "/root/testdata"), "sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def rows(values, columns):
    def plain(x):
        return "null" if x is None or x != x else f"{x + 0.0:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in values)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_sql(spark, duck, name):
    got, want = plans.queries()[name](spark, DATA), duck.sql(plans.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: TYPES.get(t, t) for c, t in got.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), list(want.columns))


def test_every_other_query_has_a_brute_force_test():
    assert set(plans.queries()) - set(plans.oracles()) == {"j7_hash_embedding", "k9_page_rag"}


def slots(text, d):
    """Counts of hashed words, as the engine's offline embedding has them."""
    xxhash = pytest.importorskip("xxhash")
    out = [0.0] * d
    for word in text.lower().split():
        h = xxhash.xxh64(word.encode(), seed=42).intdigest()
        out[(h - (1 << 64) if h >> 63 else h) % d] += 1
    return out


def test_hashed_embeddings(spark, duck):
    want = {i: slots(t or "", 16) for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    assert {r.doc_id: list(r.vector) for r in plans.queries()["j7_hash_embedding"](spark, DATA).collect()} == want


def test_pages_by_cosine(spark, duck):
    pages, scores, query = {}, [], slots("the that of with", 64)
    for session, text in duck.sql("SELECT conv_id, coalesce(text, '') FROM conversations ORDER BY conv_id, turn").fetchall():
        own = pages.setdefault(session, [[]])
        if own[-1] and sum(len(t) // 4 for t in own[-1]) + len(text) // 4 > 512:
            tail = []
            for t in reversed(own[-1]):
                if sum(len(x) // 4 for x in tail) + len(t) // 4 > 50:
                    break
                tail.insert(0, t)
            own.append(tail)
        own[-1].append(text)
    for session, own in pages.items():
        for i, page in enumerate(own):
            v = slots("\n".join(page), 64)
            norm = sum(x * x for x in v) ** 0.5 * sum(x * x for x in query) ** 0.5
            cosine = sum(x * y for x, y in zip(v, query, strict=True)) / norm if norm else 0.0
            scores.append((-cosine * (1 + 0.2 * i / len(own)), session * 1000 + i))
    got = [(r.doc_id, r.score) for r in plans.queries()["k9_page_rag"](spark, DATA).collect()]
    assert sorted(i for i, _ in got) == sorted(i for _, i in sorted(scores)[:10])
    assert dict(got) == pytest.approx({i: -s for s, i in sorted(scores)[:10]}, abs=1e-5)
