"""What the two vector searches share: valid vectors, bounded samples, query blocks, and the last merge.

Queries are written to the shared folder in blocks of bounded size; every task reads them block
by block and meets them with its own shard of vectors. Vectors are never dealt out, so neither
copies nor a common vector make a task larger, and queries never pass the driver.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.llm.shared import new_folder, open_input, partitions, smallest_hashes, write_file

#: Vectors in a fitted sample, in a shard, and queries in a block: at most.
SAMPLE, SHARD, QUERIES = 4_096, 65_536, 4_096


def valid(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of usable rows; ``zero``: whether zero vectors are usable."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite)
    if not zero:
        ok = ok & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(ok)


def usual_length(vectors: DataFrame) -> tuple[int, int]:
    """The most frequent length of all vectors (ties: the smaller), and how many have it; (1, 0) for an empty table."""
    row = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (row["d"], row["count"]) if row else (1, 0)


def fitted_sample(vectors: DataFrame, d: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``SAMPLE`` of the ``n`` vectors of length d in the order of a hash of vec_id, as (ids, vectors)."""
    first = lambda x: x.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    usable, rows = vectors.filter(F.size("v") == d), []
    if n > 4 * SAMPLE:  # tasks need not send what cannot be among the first
        rows = first(usable.filter(smallest_hashes("vec_id", 2 * SAMPLE / n)))
    if len(rows) < SAMPLE:
        rows = first(usable)
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64).reshape(-1, d)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def write_queries(vectors: DataFrame, every: int, d: int, bounds=None) -> list[str]:
    """Blocks of the queries (vec_id divisible by ``every``; of rows with one id the smallest vector). Returns their files.

    ``bounds(ids, q)`` may add a number per query, known to be reached by its last result.
    """
    spark = vectors.sparkSession
    folder = new_folder(spark, "queries")
    queries = vectors.filter((F.col("vec_id") % every == 0) & (F.size("v") == d)).groupBy("vec_id").agg(F.min("v").alias("v"))

    def write(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                own = batch.slice(at, QUERIES)
                ids, q = own.column("vec_id").to_numpy(), matrix(own.column("v"), d)
                order = np.argsort(ids)
                out = io.BytesIO()
                np.savez(out, ids=ids[order], q=q[order], bounds=bounds(ids[order], q[order]) if bounds else np.zeros(0))
                name = f"{folder}/{part:06d}-{n:06d}.npz"
                write_file(name, out.getvalue())
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    # Enough rows for one block each; a task writes what it has in blocks.
    return sorted(r["name"] for r in queries.repartition(partitions(spark)).mapInArrow(write, "name string").toLocalIterator())


def read_queries(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with open_input(name) as file, np.load(io.BytesIO(file.read())) as z:
        return z["ids"], z["q"], z["bounds"]


def shards(batches, d: int):
    """(ids, vectors) of at most ``SHARD`` rows from the batches of a task."""
    ids, vectors, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD):
            own = batch.slice(at, SHARD)
            if n + own.num_rows > SHARD:
                yield np.concatenate(ids), np.concatenate(vectors)
                ids, vectors, n = [], [], 0
            ids.append(own.column("vec_id").to_numpy())
            vectors.append(matrix(own.column("v"), d))
            n += own.num_rows
    if n:
        yield np.concatenate(ids), np.concatenate(vectors)


def search(vectors: DataFrame, d: int, blocks: list[str], index, kind: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (query_id, vec_id, score, and ``more`` counts) that ``index(ids, vectors)(ids, q, bounds)`` yields from every shard and block."""
    score = pa.float64() if kind == "double" else pa.int64()

    def run(batches):
        for ids, v in shards(batches, d):
            ask = index(ids, v)
            for name in blocks:
                q, found, scores, *counts = ask(*read_queries(name))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, score), *[pa.array(c, pa.int64()) for c in counts]], names=["query_id", "vec_id", "score", *more])

    schema = f"query_id long, vec_id long, score {kind}" + "".join(f", {c} long" for c in more)
    return vectors.filter(F.size("v") == d).mapInArrow(run, schema)


def best(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of each query: Spark limits each task's groups before the exchange."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", *[c for c in found.columns if c != "query_id"])


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
