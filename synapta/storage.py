"""Tables that cut a lineage: written below the folder that the whole cluster shares, read back from there.

A table on shared storage survives the loss of any executor, and what is computed once is not computed again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it may be broadcast.
BROADCAST_ROWS = 100_000


def work_folder(spark: SparkSession, label: str = "work") -> str:
    """URI of a new folder below spark.checkpoint.dir, gone when the driver ends; a temporary one in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    uri = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path, store = _store(spark, uri)
    store.deleteOnExit(path)
    return uri


def _store(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once; returns a reader."""
    uri = work_folder(df.sparkSession, label)
    df.write.parquet(uri)
    out = df.sparkSession.read.schema(df.schema).parquet(uri)
    out._saved_at = uri
    return out


def free(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote, once nothing reads it any more."""
    for table in tables:
        if uri := getattr(table, "_saved_at", None):
            path, store = _store(table.sparkSession, uri)
            store.delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further."""
    return df.limit(most + 1).count() <= most


def bounded(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is small; else the join shuffles."""
    return F.broadcast(df) if small(df) else df
