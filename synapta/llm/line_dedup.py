"""Operator 2: drop lines that many documents share, with a sharded minimal perfect hash.

A first pass emits one 128-bit hash per distinct line of a document; Spark counts them with
map-side partial sums, so a line of a third of all documents costs one row per task. The
hashes found often enough are dealt by their top bits into shards of at most about
``SHARD_KEYS`` keys; each shard becomes a file in the shared folder: a minimal perfect hash
with an array of fingerprints, one of counts and one of the largest ``doc_id``. In the second
pass documents probe these arrays shard by shard, with a bounded cache; no line is joined or
dealt out, and nothing is sent to the driver but the bit for each shard that has keys.

Edge cases: null text counts as one empty line and stays null; every row is a document, also
when rows or ``doc_id`` are equal; a null ``doc_id`` is smaller than any other, so such a
document keeps a shared line only where all holders are null; input columns called like an
output are replaced; empty tables give empty tables.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synapta.llm.memos import claim
from synapta.llm.perfect_hash import PerfectHash
from synapta.llm.shared import new_folder, open_input, partitions, save, write_file
from synapta.llm.tokens import text_groups

WHITE = " \t\n\v\f\r"
#: Keys in a shard, on average at most; bytes of shards that a worker keeps.
SHARD_KEYS, CACHE_BYTES = 1 << 16, 64 << 20
_cache: OrderedDict[str, PerfectHash] = OrderedDict()


def line_hashes(lines: list[str], least_chars: int) -> tuple[list[int], np.ndarray]:
    """Places of the lines whose keys are long enough, and the two 64-bit halves of the keys' hashes."""
    places, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= least_chars and len(key := line.strip(WHITE)) >= least_chars:
            places.append(i)
            digests.append(xxhash.xxh3_128_digest(key.encode().lower()))  # bytes.lower: A-Z only
    return places, np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _shard(uri: str) -> PerfectHash:
    claim("lines", _cache.clear)
    if uri not in _cache:
        with open_input(uri) as file:
            _cache[uri] = PerfectHash.loads(file.read())
        while len(_cache) > 1 and sum(x.nbytes for x in _cache.values()) > CACHE_BYTES:
            _cache.popitem(last=False)
    _cache.move_to_end(uri)
    return _cache[uri]


def build_index(docs: DataFrame, least_chars: int, least_docs: int) -> tuple[str, int, bytes]:
    """Write the shards; returns their folder, the count of top bits that name a shard, and a bitmap of those with keys."""
    spark = docs.sparkSession

    def keys(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in text_groups(texts):
                found, owner = [], []
                for doc, text in zip(ids[a:b], texts[a:b].to_pylist(), strict=True):
                    halves = line_hashes(text.split("\n"), least_chars)[1] if text else ()
                    if len(halves):
                        own = np.unique(halves, axis=0) if len(halves) > 1 else halves
                        found.append(own)
                        owner += [doc] * len(own)
                if found:
                    halves = np.concatenate(found).view("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(owner, pa.int64())], names=["h", "fp", "doc_id"])

    frequent = save(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(keys, "h long, fp long, doc_id long")
        .groupBy("h", "fp")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        .filter(F.col("n") >= least_docs),
        "lines",
    )
    bits = max(frequent.count() // SHARD_KEYS, partitions(spark) - 1).bit_length()
    folder = new_folder(spark, "line-index")

    def build(key, table):
        shard = key[0].as_py()
        column = lambda n: table[n].to_numpy()
        null = pc.is_null(table["last"]).to_numpy(zero_copy_only=False)
        last = pc.fill_null(table["last"], 0).to_numpy()
        order = np.lexsort((column("fp"), column("h")))
        index = PerfectHash.build(column("h").view("<u8")[order], column("fp").view("<u8")[order], np.stack([column("n"), last, null.astype(np.int64)])[:, order])
        write_file(f"{folder}/{shard:08x}.mph", index.dumps())
        return pa.table({"shard": [shard], "keys": [len(table)]})

    # The hash's top bits are uniform: no shard outgrows the others.
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    built = save(frequent.groupBy(shard.alias("shard")).applyInArrow(build, "shard long, keys long"), "line-shards")
    there = np.zeros(1 << bits, bool)
    there[[r["shard"] for r in built.select("shard").toLocalIterator()]] = True
    return folder, bits, np.packbits(there).tobytes()


def drop_shared_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` without the lines that at least ``least_docs`` of them share.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least
    ``least_chars`` code points lose all their lines except those of the largest ``doc_id``.
    Adds ``n_lines`` (before) and ``n_dropped``.
    """
    docs = docs.drop("n_lines", "n_dropped")
    folder, bits, there = build_index(docs, least_chars, least_docs)
    place = docs.columns.index("text")

    def probe(h: np.ndarray, fp: np.ndarray, doc: np.ndarray, doc_null: np.ndarray) -> np.ndarray:
        drop = np.zeros(len(h), bool)
        shard = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        have = np.unpackbits(np.frombuffer(there, np.uint8))
        rows = np.flatnonzero(have[shard])
        rows = rows[np.argsort(shard[rows], kind="stable")]
        names, starts = np.unique(shard[rows], return_index=True)
        for name, own in zip(names.tolist(), np.split(rows, starts[1:]), strict=True) if len(rows) else ():
            found, (_, last, null) = _shard(f"{folder}/{name:08x}.mph").probe(h[own], fp[own])
            keeps = np.where(null == 1, doc_null[own], ~doc_null[own] & (doc[own] == last))
            drop[own] = found & ~keeps
        return drop

    def run(batches):
        for batch in batches:
            for a, b in text_groups(batch.column("text"), 8_000_000):
                part = batch.slice(a, b - a)
                ids = part.column("doc_id")
                null = pc.is_null(ids).to_numpy(zero_copy_only=False)
                doc = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy()
                lines, places, halves = [], [], []
                for text in part.column("text").to_pylist():
                    lines.append((text or "").split("\n"))
                    p, h = line_hashes(lines[-1], least_chars)
                    places.append(p)
                    halves.append(h)
                counts = [len(p) for p in places]
                both, owner = np.concatenate(halves), np.repeat(np.arange(len(lines)), counts)
                drop = probe(both[:, 0].copy(), both[:, 1].copy(), doc[owner], null[owner])
                texts, dropped = part.column("text").to_pylist(), [0] * len(lines)
                for i, own in enumerate(np.split(drop, np.cumsum(counts)[:-1])):
                    if own.any():
                        gone = {p for p, d in zip(places[i], own.tolist(), strict=True) if d}
                        texts[i] = "\n".join(x for j, x in enumerate(lines[i]) if j not in gone)
                        dropped[i] = len(gone)
                columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(map(len, lines)), pa.int64()), pa.array(dropped, pa.int64())], names=[*part.schema.names, "n_lines", "n_dropped"])

    cast = docs.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*cast.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return cast.mapInArrow(run, schema)
