"""Tables and files in the folder that the whole cluster shares, and global running totals.

Everything an operator materialises goes below ``spark.checkpoint.dir``: a table there
cuts the lineage and survives the loss of any executor. Names are unique per call, so
reruns never read another run's files; the folder is removed when the JVM ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode a temporary folder where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="synapta-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a folder of its own below the shared root; it goes when the driver ends."""
    uri = f"{shared_root(spark)}/synapta-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(path)
    atexit.register(_remove, store, path)
    return uri


def _remove(store, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and its own hook has removed the folder
        store.delete(path, True)


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it."""
    spark = df.sparkSession
    uri = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(uri)
    saved = spark.read.schema(df.schema).parquet(uri)
    saved._saved_at = uri
    return saved


def free(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more; what ``save`` did not return is left alone."""
    for table in tables:
        if uri := getattr(table, "_saved_at", None):
            spark = table.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` (a saved table of a few narrow columns), to be broadcast if it has at most ``most`` rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def smallest_hashes(column: str, share: float) -> Column:
    """Whether the hash of ``column`` is in the lowest ``share`` of all values."""
    return F.xxhash64(column) < F.lit(min((1 << 63) - 1, int(share * 2**64) - (1 << 63)))


def first_ids(ids: DataFrame, most: int) -> list[int]:
    """The ``most`` distinct values of ``ids`` (one long column, id) that come first by hash.

    Every task would send as many to the driver; hashes that are too large to be among them stay
    behind, so all tasks together send about twice ``most``, however many they are.
    """
    n = ids.count()
    first = lambda x: [r["id"] for r in x.filter("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    if n > 4 * most and len(found := first(ids.filter(smallest_hashes("id", 2 * most / n)))) == most:
        return found
    return first(ids)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def open_input(uri: str):
    """Open a file of the shared folder for reading, from any task."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def write_file(uri: str, payload: bytes) -> None:
    """Write a file whole or not at all: repeated and speculative tasks leave the same bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(payload)
    try:
        store.move(part, path)
    except OSError:  # some stores do not replace: another attempt was first with the same bytes
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(part)


def running_total(df: DataFrame, order: list[Column], values: list[str], label: str) -> DataFrame:
    """``df`` with ``before_<value>``: the sum of ``value`` over all rows that come earlier in ``order``.

    A range exchange sorts the table, each range sums its own rows, and only one total per
    range (a number bounded by the partition count) meets in one task. No key decides where
    a row goes, so one hot key spreads over many ranges as long as ``order`` ends in a
    column that tells rows apart.
    """
    spark = df.sparkSession
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for n, c in zip(names, order, strict=True)])
    ranged = save(
        keyed.repartitionByRange(partitions(spark), *names).withColumn("_range", F.spark_partition_id()), label
    )
    rows = Window.partitionBy("_range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: its number is bounded by the count of shuffle partitions.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("_range")
        .agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
        .select("_range", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_t_{v}") for v in values])
    )
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(rows), F.lit(0)).alias(f"_l_{v}") for v in values])
    out = local.join(F.broadcast(totals), "_range")
    return out.select(*df.columns, *[(F.col(f"_l_{v}") + F.col(f"_t_{v}")).alias(f"before_{v}") for v in values])
