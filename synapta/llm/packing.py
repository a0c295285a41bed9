"""Operator 1: bounded-space online packing of documents into fixed windows.

Each partition streams its documents once. A document's ids are cut into full windows and a
rest; the rest goes into the open window that it fills best. A partition keeps at most
``open_windows`` open. If a piece fits none and all are open, the fullest is emitted first,
its gap filled with the head of the piece if the gap is at least ``least_piece`` ids, so that
little stays empty and no window holds crumbs. What is open at the end of a partition is
merged with the leftovers of a few neighbouring partitions, whole windows best-fit, largest
first. Memory is bounded by the open windows; only their (few) rows are dealt out again.

Edge cases: null text counts as empty (the end id alone); a null ``doc_id`` stays null; equal
rows are packed as separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synapta.llm.shared import save
from synapta.llm.tokens import default_path, encoder, text_groups

#: Leftover windows of so many neighbouring partitions are merged in one task.
MERGED_PARTITIONS = 8


class Windows:
    """Open windows of one partition: what each holds, best fit, and the fullest first out."""

    def __init__(self, size: int, most: int, least_piece: int):
        self.size, self.most, self.least = size, most, least_piece
        self.fill: list[int] = []
        self.held: list[list] = []

    def place(self, n: int) -> tuple[int, int] | None:
        """The window that a piece of ``n`` fills best, and the offset there."""
        best = -1
        for i, f in enumerate(self.fill):
            if f + n <= self.size and (best < 0 or f > self.fill[best]):
                best = i
        if best < 0:
            if len(self.fill) == self.most:
                return None
            self.fill.append(0)
            self.held.append([])
            best = len(self.fill) - 1
        at = self.fill[best]
        self.fill[best] += n
        return best, at

    def fullest(self) -> int:
        return max(range(len(self.fill)), key=self.fill.__getitem__)

    def pop(self, i: int) -> list:
        self.fill.pop(i)
        return self.held.pop(i)

    def add(self, doc, ids: bytes) -> Iterator[list]:
        """Place a document's ids (4 bytes each); yields the windows that are done."""
        start, stop = 0, len(ids) // 4
        piece = lambda a, b, at: (doc, a, ids[4 * a : 4 * b], stop, at)
        while stop - start >= self.size:
            yield [piece(start, start + self.size, 0)]
            start += self.size
        while start < stop:
            if got := self.place(stop - start):
                i, at = got
                self.held[i].append(piece(start, stop, at))
                if self.fill[i] == self.size:
                    yield self.pop(i)
                return
            i = self.fullest()
            if (gap := self.size - self.fill[i]) >= self.least:
                self.held[i].append(piece(start, start + gap, self.fill[i]))
                start += gap
            yield self.pop(i)


_SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, window long, offset long, leftover int"


def _pack_partition(path: str, size: int, most: int, least_piece: int, end_id: int):
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("leftover", pa.int32())])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tok, windows, number = encoder(path), Windows(size, most, least_piece), 0
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def emit(pieces, leftover):
            nonlocal number
            for doc, start, ids, total, at in pieces:
                rows.append((doc, start, ids, total, (part << 32) + number, at, leftover))
            number += 1

        def flush():
            nonlocal rows
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
            rows = []
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text")
            for a, b in text_groups(texts):
                encoded = tok.encode(texts[a:b].to_pylist())
                for doc, ids in zip(docs[a:b].to_pylist(), encoded, strict=True):
                    for done in windows.add(doc, ids + end):
                        emit(done, 0)
                if rows:
                    yield flush()
        for held in windows.held:
            emit(held, 1)
        if rows:
            yield flush()

    return run


def _merge(size: int):
    def run(key, table):
        """Whole leftover windows, largest first, each into the merged window that it fills best."""
        rows = sorted(zip(table["fill"].to_pylist(), table["window"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        fills: list[int] = []
        into: list[int] = []
        out = []
        for fill, window in rows:
            best = -1
            for i, f in enumerate(fills):
                if f + fill <= size and (best < 0 or f > fills[best]):
                    best = i
            if best < 0:
                fills.append(0)
                into.append(window)
                best = len(fills) - 1
            out.append((window, into[best], fills[best]))
            fills[best] += fill
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("window", "sequence_id", "base"))})

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = 1024, open_windows: int = 32, least_piece: int = 32, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``size`` ids.

    Returns doc_id, start, ids (binary, 4 bytes each, little-endian), doc_tokens, sequence_id,
    offset. The pieces of a sequence lie side by side from offset 0; every id of every document is in one piece.
    """
    run = _pack_partition(path or default_path(), size, open_windows, least_piece, end_id)
    pieces = save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA), "pack")
    whole = pieces.filter("leftover = 0").select("doc_id", "start", "ids", "doc_tokens", F.col("window").alias("sequence_id"), "offset")
    left = pieces.filter("leftover = 1")
    # At most ``open_windows`` rows a partition, grouped by neighbouring partitions: a bounded group.
    merged = (
        left.select("window", (F.octet_length("ids") / 4).cast("long").alias("n"))
        .groupBy("window")
        .agg(F.sum("n").alias("fill"))
        .groupBy(F.shiftright("window", 32 + MERGED_PARTITIONS.bit_length() - 1).alias("part"))
        .applyInArrow(_merge(size), "window long, sequence_id long, base long")
    )
    rest = left.join(merged, "window").select("doc_id", "start", "ids", "doc_tokens", "sequence_id", (F.col("offset") + F.col("base")).alias("offset"))
    return whole.unionByName(rest)
