"""Operator 3: token-id files with a shared zstandard dictionary and random access.

A dictionary is trained once, on the serialized ids of a bounded sample. Every document is
compressed on its own with it, so one short document can be read without its neighbours.

File format (all integers little-endian), one shard file:

    4 bytes  ``SYT1``
    8 bytes  dictionary hash (first 8 bytes of its SHA-256)
    4 bytes  n, documents in the shard
    1 byte   width of an id in the frames, 2 or 4
    n times 25 bytes: has doc_id (1), doc_id (8), offset of its frame (8), ids (8)
    frames

Shards hold documents in ascending ``doc_id`` (null first); their names sort in that order.

Edge cases: null text is empty (the end id alone); equal ``doc_id`` keep all rows, in order of
a hash of their frames; an empty table has no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synapta.llm.shared import first_ids, new_folder, open_input, partitions, running_total, save, write_file
from synapta.llm.tokens import default_path, encoder, text_groups

MAGIC = b"SYT1"
_HEAD = struct.Struct("<4s8sIB")
_ENTRY = struct.Struct("<BqQQ")
#: The dictionary's sample: at most so many documents, of at most so many bytes each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 256, 32_768, 65_536
LEVEL = 1
#: A shard is closed beyond so many bytes of frames.
SHARD_BYTES = 4 << 20


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


def serialize(ids: bytes, width: int) -> bytes:
    """Bytes of 32-bit ids as ids of ``width`` bytes."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train(docs: DataFrame, path: str, width: int) -> bytes:
    """A dictionary from a bounded sample in the order of a hash of ``doc_id``; empty if there is too little to learn from."""
    first = [F.xxhash64("doc_id"), "doc_id"]
    # The ids come first, so no task sends its candidates' texts; half of them may be too long or empty.
    few = first_ids(docs.select(F.col("doc_id").cast("long").alias("id")), 2 * SAMPLE_DOCS)
    few = docs.sparkSession.createDataFrame([(i,) for i in few], "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id", "left_semi")
    rows = texts.filter(F.octet_length("text").between(1, SAMPLE_BYTES)).orderBy(*first, "text").limit(SAMPLE_DOCS).collect()
    samples = [serialize(x, width) for x in encoder(path).encode([r["text"] for r in rows])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, [x for x in samples if x]).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_shard(rows: list[tuple[int | None, int, bytes]], digest: bytes, width: int) -> bytes:
    """One shard file from (doc_id, ids, frame)."""
    at = _HEAD.size + _ENTRY.size * len(rows)
    index = bytearray()
    for doc, n, frame in rows:
        index += _ENTRY.pack(doc is not None, doc or 0, at, n)
        at += len(frame)
    return _HEAD.pack(MAGIC, digest, len(rows), width) + bytes(index) + b"".join(f for _, _, f in rows)


class Shard:
    """A shard opened for reading: its index, and each document by its place."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        magic, digest, n, self.width = _HEAD.unpack(file.read(_HEAD.size))
        if magic != MAGIC or digest != dictionary_hash(dictionary):
            raise ValueError("not a shard of this dictionary")
        self.entries = list(_ENTRY.iter_unpack(file.read(_ENTRY.size * n)))
        self.size = file.size()
        self.decompressor = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.entries)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; reads only its own frame."""
        _, _, at, n = self.entries[i]
        end = self.entries[i + 1][2] if i + 1 < len(self.entries) else self.size
        self.file.seek(at)
        raw = self.decompressor.decompress(self.file.read(end - at), max_output_size=max(1, n * self.width))
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def doc_id(self, i: int) -> int | None:
        return self.entries[i][1] if self.entries[i][0] else None


def write(docs: DataFrame, path: str | None = None, end_id: int = 0) -> tuple[DataFrame, str, bytes]:
    """Write ``docs`` (doc_id, text) as shards; returns the manifest, their folder and the dictionary.

    Manifest: shard (name), docs (their count), n_tokens, first and last doc_id; ``before_n_tokens``
    has the ids of all earlier shards.
    """
    spark = docs.sparkSession
    path = path or default_path()
    width = 2 if max(end_id, encoder(path).tokenizer.get_vocab_size() - 1) < 1 << 16 else 4
    dictionary = train(docs, path, width)
    folder = new_folder(spark, "tokens")
    write_file(f"{folder}/dictionary.zdict", dictionary)
    digest = dictionary_hash(dictionary)

    def encode(batches):
        tok, end = encoder(path), array("I", [end_id]).tobytes()
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known:
            known.precompute_compress(level=LEVEL)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False)
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text")
            for a, b in text_groups(texts):
                ids = [x + end for x in tok.encode(texts[a:b].to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [docs[a:b], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([squeeze.compress(serialize(x, width)) for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "frame"],
                )

    frames = save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, n_tokens long, frame binary"), "frames")
    # The range bounds are sampled from the keys: a hash stands for the frame, so the driver gets numbers alone.
    hashed = frames.withColumn("look", F.xxhash64("frame"))
    ranged = hashed.repartitionByRange(partitions(spark), "doc_id", "look").sortWithinPartitions("doc_id", "look", "frame").drop("look")

    def shards(batches):
        from pyspark import TaskContext

        part, rows, size, number, out = TaskContext.get().partitionId(), [], 0, 0, []

        def close():
            nonlocal rows, size, number
            name = f"{part:08d}-{number:08d}.syt"
            write_file(f"{folder}/{name}", pack_shard(rows, digest, width))
            out.append((name, len(rows), sum(r[1] for r in rows), rows[0][0], rows[-1][0]))
            rows, size, number = [], 0, number + 1

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= SHARD_BYTES:
                    close()
        if rows:
            close()
        kinds = (("shard", pa.string()), ("docs", pa.int64()), ("n_tokens", pa.int64()), ("first", pa.int64()), ("last", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    manifest = save(ranged.mapInArrow(shards, "shard string, docs long, n_tokens long, first long, last long"), "manifest")
    return running_total(manifest, [F.col("shard")], ["n_tokens"], "shard-starts"), folder, dictionary


def fetch(manifest: DataFrame, folder: str, dictionary: bytes, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each of its rows): reads the indexes of the shards that may hold it, and its own frames."""
    found = []
    for r in manifest.filter((F.col("last") >= doc_id) & (F.coalesce("first", F.lit(doc_id)) <= doc_id)).orderBy("shard").toLocalIterator():
        with open_input(f"{folder}/{r['shard']}") as file:
            shard = Shard(file, dictionary)
            found += [shard.ids(i) for i in range(len(shard)) if shard.doc_id(i) == doc_id]
    return found


def read(manifest: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Documents read back from the shards: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids)."""

    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column("shard").to_pylist(), batch.column("before_n_tokens").to_pylist(), strict=True):
                with open_input(f"{folder}/{name}") as file:
                    shard, rows = Shard(file, dictionary), []
                    for i in range(len(shard)):
                        ids = shard.ids(i)
                        rows.append((shard.doc_id(i), before, len(ids), zlib.crc32(ids)))
                        before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = partitions(manifest.sparkSession)
    return manifest.select("shard", "before_n_tokens").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
