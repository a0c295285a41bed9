"""Operator 8: join of documents whose word n-gram sets have a Jaccard similarity of at least t.

1. Equal sets form one class with one representative (a partial aggregate on a 128-bit hash).
2. Candidates, without loss: two sets that link share one of their first n - ceil(t n) + 1
   elements in any order that is the same for all. The order is by hash, with the n-grams last
   that a bounded sample found in several documents, so shared passages seldom make candidates.
3. The documents that have an element are cut into bands wherever the next size is too far from
   the one before; bands of one document make no candidates. Bands are made of classes of sizes
   that lie close together, found by partial aggregates: no task sorts an element's documents.
4. The documents of a band are tested against the smallest of them. That links the bulk of any
   group in linear work.
5. Bands whose documents still are in different components are compared in tiles: blocks of
   bounded rows in the order of band and size; only blocks of one band whose sizes are compatible
   meet, and never two blocks of a band's main body (its largest component).
6. Every test first bounds the overlap from above: each set has a hashed bitmap, and every bit
   that only one of two sets has is an element that the other lacks. Only what passes gets the
   exact intersection of the sorted arrays, which are made for these documents alone.
7. Components of all links, by contraction.

Edge cases: null or white-space text has an empty set and links with nothing; a null ``doc_id``
links with nothing and has a null component; equal rows are copies; empty tables give empty
tables; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.llm.components import components
from synapta.llm.memos import claim
from synapta.llm.shared import bounded, first_ids, free, running_total, save
from synapta.llm.tokens import text_groups

_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))
_S = np.uint64(32)
#: Blocks of a tile: rows and bytes.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: Documents in the sample that finds common n-grams, documents that make one common, and n-grams kept.
SAMPLE_DOCS, COMMON_DOCS, COMMON_MOST = 16_384, 2, 400_000
#: Bits per element of the bitmaps (rounded up to a power of two in all).
BITS = 1
#: Words of at most so many bytes whose hashes a worker keeps, and how many.
MEMO_BYTES, MEMO = 64, 300_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M4
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-cased (A-Z) words; fewer words make one."""
    words = (text or "").encode().lower().split()  # bytes.split(): exactly [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    claim("words", _words.clear)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        x = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            x = _mix(x * _M1 + h[i : len(h) - n + 1 + i])
        return np.unique(_mix(x))


def prefix(s: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """The elements of a sorted set of which one at least is in the prefix of every set that links with it."""
    n = len(s)
    kept = n + (-num * n) // den + 1  # n - ceil(t n) + 1
    if len(common):
        last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        if last[:kept].any():
            return np.concatenate([s[~last], s[last]])[:kept]
    return s[:kept]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return den * both >= num * (len(a) + len(b) - both)


def bitmap(s: np.ndarray, per_element: int) -> np.ndarray:
    """64-bit words of a bitmap with bit h mod size set for every element."""
    bits = max(64, 1 << int(per_element * max(1, len(s)) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view("<u8")


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis) of a smaller size: the same elements modulo that size."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def most_overlap(a: np.ndarray, na, b: np.ndarray, nb) -> np.ndarray:
    """Upper bound of the overlap of sets with bitmaps a and b (rows) and sizes na and nb."""
    size = min(a.shape[-1], b.shape[-1])
    a, b = fold(a, size), fold(b, size)
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def may_link(most, na, nb, num: int, den: int):
    return den * most >= num * (na + nb - most)


def tile_links(maps: list[np.ndarray], sizes: np.ndarray, body: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links between rows ``left`` and ``right`` of different bodies (``body`` numbers what is joined already).

    With ``sets`` links are exact, and each joins two bodies at once: the result spans what belongs
    together. Without, a link is what the bitmaps allow, and the result spans the rows that have one,
    whatever their bodies: every row with an allowed partner is in it, together with that partner.
    """
    words = np.array([len(m) for m in maps], np.int64)
    tables = {w: (rows := right[words[right] == w], np.stack([maps[j] for j in rows])) for w in np.unique(words[right]).tolist()}
    body, out = body.copy(), []
    group = np.arange(len(body)) if sets is None else body
    for i in left.tolist():
        for rows, table in tables.values():
            ok = (body[rows] != body[i]) & (group[rows] != group[i]) & (den * np.minimum(sizes[rows], sizes[i]) >= num * np.maximum(sizes[rows], sizes[i]))
            if not ok.any():
                continue
            most = most_overlap(maps[i], sizes[i], table[ok], sizes[rows[ok]])
            may = may_link(most, sizes[i], sizes[rows[ok]], num, den)
            for j in rows[ok][may][np.argsort(-most[may], kind="stable")].tolist():
                if group[j] != group[i] and (sets is None or linked(sets[i], sets[j], num, den)):
                    out.append((i, j))
                    group[group == group[j]] = group[i]
    return out


def _arrays(raw: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in raw]


def _sets(docs: DataFrame, ids: DataFrame, n: int, label: str) -> DataFrame:
    """Saved sets of the documents ``ids``."""

    def run(batches):
        for batch in batches:
            for a, b in text_groups(batch.column("text"), 4_000_000):
                sets = [shingles(t, n) for t in batch.column("text")[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "elements"])

    wanted = docs.join(bounded(ids), "doc_id", "left_semi")
    return save(wanted.mapInArrow(run, "doc_id long, n long, elements binary"), label)


def _verify(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int, label: str) -> DataFrame:
    """The pairs (a, b), saved, that link: exact intersections of sorted arrays."""
    ids = save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{label}-ids")
    sets = _sets(docs, ids, n, f"{label}-arrays")

    def test(batches):
        for batch in batches:
            ok = [linked(x, y, num, den) for x, y in zip(_arrays(batch.column("x")), _arrays(batch.column("y")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k, e: sets.select(F.col("doc_id").alias(k), F.col("elements").alias(e))
    links = save(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), f"{label}-links")
    free(sets, ids)
    return links


def common_ngrams(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted n-gram hashes that several documents of a bounded sample have; most frequent first if there are too many."""

    def run(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, n).view("<i8"), pa.int64())], names=["h"])

    few = docs.sparkSession.createDataFrame([(i,) for i in first_ids(docs.select(F.col("doc_id").alias("id")), SAMPLE_DOCS)], "doc_id long")
    counts = docs.join(F.broadcast(few), "doc_id").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    kept = counts.filter(F.col("c") >= COMMON_DOCS).orderBy(F.desc("c"), "h").limit(COMMON_MOST).select("h").toArrow()
    return np.sort(kept["h"].to_numpy().view(np.uint64))


def link_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``; sets link at similarity ``num / den`` or more."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    last = docs.sparkSession.sparkContext.broadcast(common_ngrams(docs, n))  # bounded by COMMON_MOST

    def sign(batches):
        for batch in batches:
            for a, b in text_groups(batch.column("text"), 4_000_000):
                keys, sizes, heads, maps = [], [], [], []
                for text in batch.column("text")[a:b].to_pylist():
                    s = shingles(text, n)
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    heads.append(prefix(s, last.value, num, den) if len(s) else s)
                    maps.append(bitmap(s, BITS).tobytes() if len(s) else None)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads).view("<i8")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(maps, pa.binary())], names=["doc_id", "n", "key", "signatures", "bits"])

    signed = save(docs.mapInArrow(sign, "doc_id long, n long, key binary, signatures array<long>, bits binary"), "ngram-sets")
    classes = save(signed.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "ngram-classes")

    # Bands: documents with a common element whose sizes follow one another closely enough. Sizes of one
    # class are never too far apart (up to rounding, which only widens a band).
    kind = _size_class(F.col("n"), num, den)
    own = signed.join(bounded(classes.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").select("n", kind.alias("kind"), "doc_id", F.explode("signatures").alias("signature"))
    several = own.groupBy("signature").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("signature")
    own = save(own.join(several, "signature", "left_semi"), "ngram-shared")
    steps = own.groupBy("signature", "kind").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    by_size = Window.partitionBy("signature").orderBy("kind")  # a class is a power of den / num: a bounded group
    far = F.coalesce(den * F.lag("most").over(by_size) < num * F.col("least"), F.lit(True))
    steps = steps.withColumn("far", far.cast("int")).withColumn("band", F.sum("far").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    band = Window.partitionBy("signature", "band")
    steps = steps.select("signature", "kind", F.xxhash64("signature", "band").alias("band"), F.min("lo").over(band).alias("pivot"), F.max("hi").over(band).alias("other"))
    steps = steps.filter("pivot <> other").drop("other")
    bands = save(own.join(steps, ["signature", "kind"]).select("band", "doc_id", "n", "pivot"), "ngram-bands")
    free(own)
    wanted = save(bands.select("doc_id").distinct(), "ngram-wanted")
    maps = save(signed.select("doc_id", "n", "bits").join(bounded(wanted), "doc_id", "left_semi"), "ngram-maps")

    def bound(batches):
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("n", "pivot_n"))
            bits = zip(_arrays(batch.column("bits")), _arrays(batch.column("pivot_bits")), strict=True)
            most = np.array([most_overlap(a, na, b, nb) for (a, b), na, nb in zip(bits, x.tolist(), y.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pivot")], names=["a", "b"]).filter(pa.array(may_link(most, x, y, num, den), pa.bool_()))

    pivots = maps.select(F.col("doc_id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("bits").alias("pivot_bits"))
    near = den * F.least("n", "pivot_n") >= num * F.greatest("n", "pivot_n")
    pairs = bands.filter("doc_id <> pivot").select("pivot", "doc_id", "n").distinct()
    pairs = pairs.join(pivots, "pivot").filter(near).join(maps.select("doc_id", "bits"), "doc_id")
    passed = save(pairs.select("doc_id", "pivot", "n", "pivot_n", "bits", "pivot_bits").mapInArrow(bound, "a long, b long"), "ngram-passed")
    links = _verify(docs, passed, n, num, den, "ngram-stars")
    free(passed, wanted)
    found = components(links, "ngram-stars")

    # Bands whose classes are still apart.
    names = found.select(F.col("node").alias("doc_id"), "component")
    placed = bands.join(names, "doc_id", "left").select("band", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    placed = save(placed, "ngram-placed")
    apart = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    if not (apart := save(apart, "ngram-apart")).isEmpty():
        rest = placed.join(apart, "band").withColumnRenamed("band", "whole")
        allowed = _tiles(maps, "bits", rest, num, den)
        if not allowed.isEmpty():
            # What the bitmaps allow, spanned; its documents meet again with their arrays, each group once.
            groups = components(allowed, "ngram-allowed").select(F.col("node").alias("doc_id"), F.col("component").alias("whole"))
            sets = _sets(docs, groups.select("doc_id"), n, "ngram-exact")
            rest = rest.select("doc_id", "n", "component").distinct().join(groups, "doc_id")
            found = components(links.unionByName(_tiles(sets, "elements", rest, num, den)), "ngram-all")
            free(sets)
    free(maps, bands, placed, apart)
    named = classes.join(found, classes["rep"] == found["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _size_class(n: Column, num: int, den: int) -> Column:
    """Sizes that may link are in the same or in neighbouring classes (rounding may add one between)."""
    return F.floor(F.log(n) / float(np.log(den / num))).cast("int")


def _tiles(sets: DataFrame, kind: str, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b), saved, that span the components of each whole: as the ``bits`` of the sets allow, or exact by their ``elements``."""
    sizes = members.groupBy("whole", "component").agg(F.count(F.lit(1)).alias("c"))
    bodies = sizes.groupBy("whole").agg(F.max(F.struct("c", "component"))["component"].alias("body"))
    rows = members.join(bodies, "whole").withColumn("main", F.col("component") == F.col("body")).drop("body")
    rows = rows.select("*", F.col("n").alias("bytes"), F.lit(1).alias("one"))
    rows = running_total(rows, [F.col("whole"), F.col("main"), F.col("n"), F.col("doc_id")], ["bytes", "one"], "ngram-order")
    block = F.struct((F.col("before_one") / BLOCK_ROWS).cast("long").alias("r"), (F.col("before_bytes") / BLOCK_BYTES).cast("long").alias("s"))
    rows = save(rows.withColumn("block", F.xxhash64(block, "main")), "ngram-blocks")

    # Which blocks meet: blocks of one whole, of compatible sizes, not both of its main body.
    bands = save(rows.groupBy("whole", "main", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")), "ngram-bands")
    low, high = _size_class(F.col("least"), num, den), _size_class(F.col("most"), num, den)
    x = bands.filter("not main").withColumn("kind", F.explode(F.sequence(low, high))).alias("x")
    y = bands.withColumn("kind", F.explode(F.sequence(low - 2, high + 2))).alias("y")
    meet = x.join(y, (F.col("x.whole") == F.col("y.whole")) & (F.col("x.kind") == F.col("y.kind"))).filter("y.main or x.block <= y.block")
    meet = meet.filter((den * F.col("x.most") >= num * F.col("y.least")) & (den * F.col("y.most") >= num * F.col("x.least")))
    meet = save(meet.select("x.whole", F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct(), "ngram-meet")
    sides = meet.withColumn("block", F.col("i")).unionByName(meet.filter("i <> j").withColumn("block", F.col("j")))
    here = rows.join(sides, ["whole", "block"]).select("whole", "i", "j", "block", "doc_id", "component")
    here = here.join(sets.select("doc_id", "n", kind), "doc_id")

    def tile(key, table):
        table = table.combine_chunks()
        whole, block = table["whole"].to_numpy(), table["block"].to_numpy()
        ids, body, sizes, own = table["doc_id"].to_numpy(), table["component"].to_numpy(), table["n"].to_numpy(), _arrays(table[kind].combine_chunks())
        maps, exact = (own, None) if kind == "bits" else ([bitmap(s, 4) for s in own], own)
        i, j = key[0].as_py(), key[1].as_py()
        out: list[tuple[int, int]] = []
        for w in np.unique(whole):
            left, right = np.flatnonzero((whole == w) & (block == i)), np.flatnonzero((whole == w) & (block == j))
            if len(left) and len(right):
                out += [(ids[a], ids[b]) for a, b in tile_links(maps, sizes, body, left, right, num, den, exact)]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return save(here.groupBy("i", "j").applyInArrow(tile, "a long, b long").distinct(), "ngram-tiles")


def keep_one(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest ``doc_id``; columns unchanged.

    Rows of that document with equal texts are one; rows with a null ``doc_id`` stay.
    """
    held = docs.select(F.struct("*").alias("held"), F.col("doc_id").cast("long").alias("id"))
    found = save(link_components(docs, n, num, den).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows")), "ngram-kept")
    once = held.join(bounded(found.filter("rows = 1").select("id")), "id", "left_semi").select("held")
    again = save(found.filter("rows > 1").select("id"), "ngram-repeated")
    out = once.unionByName(held.filter("id IS NULL").select("held"))
    if not again.isEmpty():  # the hash of all columns decides which of several rows stays
        text, names = F.col("held.text").cast("string"), [F.col(f"held.`{c}`") for c, t in docs.dtypes if "map<" not in t]
        same = held.join(bounded(again), "id", "left_semi").groupBy("id", text.isNull().alias("none"), F.sha2(text, 256).alias("look"))
        out = out.unionByName(same.agg(F.min_by("held", F.xxhash64(*names)).alias("held")).select("held"))
    return out.select("held.*")
