"""Vector search by exact cosine: the query travels in the plan, hits come from a bounded heap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synapta.functions.similarity import cosine


def check_dimension(vectors: DataFrame, d: int) -> DataFrame:
    """Only vectors of the index's dimension are taken in."""
    return vectors.filter(F.size("vector") == d)


def similar(vectors: DataFrame, query: list[float], where: Column | None = None, least: float = 0.5) -> DataFrame:
    """``vectors`` of at least this cosine, with score. Filters apply before the search, so none are lost."""
    if where is not None:
        vectors = vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col("vector"), q)).filter(F.col("score") >= least)


def delete(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("doc_id"), "doc_id", "left_anti")


def hashed_embedding(text: Column, d: int = 64) -> Column:
    """Offline bag-of-words embedding: counts of hashed words, by a hash that every process shares."""
    from synapta.functions.text import words

    slot = F.transform(words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(d)))
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double"))


def hashed_cosine(text: Column, query: list[float]) -> Column:
    """Cosine of a text's ``hashed_embedding`` with one of ``query``'s length: one fold over its sorted slots, not a pass per slot; 0 without words."""
    from synapta.functions.text import words

    slots = F.sort_array(F.transform(words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(len(query))).cast("int")))
    weights, length = F.lit([float(x) for x in query]), sum(x * x for x in query) ** 0.5
    start = F.struct(F.lit(-1).alias("slot"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("dot"))

    def step(acc, slot):
        run = F.when(slot == acc["slot"], acc["run"] + 1.0).otherwise(1.0)
        return F.struct(slot.alias("slot"), run.alias("run"), (acc["squares"] + 2.0 * run - 1.0).alias("squares"), (acc["dot"] + weights[slot]).alias("dot"))

    def end(acc):
        norm = F.sqrt(acc["squares"]) * length
        return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), acc["dot"] / norm))).otherwise(0.0)

    return F.coalesce(F.aggregate(slots, start, step, end), F.lit(0.0))


def embed_batches(texts: DataFrame, model, d: int) -> DataFrame:
    """``texts`` (doc_id, content) with vectors from ``model(list[str]) -> list[list[float]]``, a batch at a time."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = model([t or "" for t in batch.column("content").to_pylist()])
            if any(len(v) != d for v in made):
                raise ValueError(f"the model must return {d} numbers a text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(pa.float64()))], names=["doc_id", "vector"])

    return texts.select("doc_id", "content").mapInArrow(run, "doc_id long, vector array<double>")
