"""Live logs with Structured Streaming: every function takes and returns a streaming or batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.storage import work_folder


def any_of(path: str) -> str:
    """A pattern for the path itself: a stream takes a single file by a pattern only."""
    return f"{path[:-1]}[{path[-1]}]"


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """The operation log as a stream, with its time as an instant (event files have none of a zone)."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet(any_of(path))
    return raw.select(F.col("event_id").alias("op_id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op_kind"), "value")


def tumbling(ops: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", every)
    return ops.withWatermark("ts", late).groupBy(w, "op_kind").agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("window.start").alias("start"), "op_kind", "n")


def sessions(ops: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Idle sessions: closed once a user was silent for ``gap``."""
    w = F.session_window("ts", gap)
    return ops.withWatermark("ts", late).groupBy(w, "session_id").agg(F.count(F.lit(1)).alias("n")).select("session_id", F.unix_timestamp("session_window.start").alias("start"), "n")


def running_budget(ops: DataFrame) -> DataFrame:
    """Tokens so far per session; complete or update mode."""
    return ops.groupBy("session_id").agg(F.sum(F.floor("value").cast("long")).alias("tokens"))


def distinct_content(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "content"])


def expire(ops: DataFrame, seconds: int) -> DataFrame:
    """One row per session once it has been silent for ``seconds`` of event time: the demotion timer."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "last": [last]})
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(f["ts"].max().timestamp()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)

    return ops.withWatermark("ts", "10 minutes").groupBy("session_id").applyInPandasWithState(step, "session_id long, last long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def incremental_index(docs: DataFrame, path: str):
    """Appends the postings of each micro-batch to the index at ``path``; returns the query."""
    from synapta.operators.search import postings

    def add(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own files.
        postings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns the result as a table."""
    spark = stream.sparkSession
    folder = work_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)
