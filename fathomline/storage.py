"""Written intermediate tables, dense numbering and size checks.

Intermediate results that several jobs read are written as parquet below the
cluster's shared checkpoint folder. They survive the loss of executors, keep
column pruning, and cut the lineage.
"""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_BUCKET = 20_000


_local_root: str | None = None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="fathomline-")
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_store(path: str) -> tuple[fs.FileSystem, str]:
    """A client for a path that Python code opens itself, on the driver or in a task, and the
    path within it: a plain path of a mounted folder, or a URI that ``pyarrow.fs`` knows."""
    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def bucket_count(spark: SparkSession, rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets for a table of ``rows`` chunks: one per ``rows_per_bucket``, at least one
    per core, and as many as Spark allows at most."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(most, max(cores, -(-rows // rows_per_bucket))))


def table_name(label: str) -> str:
    """A new name for a table of ``bucketed``."""
    return f"fathomline_{label}_{uuid.uuid4().hex}"


def bucketed(
    df: DataFrame, key: str, buckets: int, name: str, *sort: str, path: str | None = None
) -> DataFrame:
    """Write ``df`` as the table ``name`` (see ``table_name``) bucketed by ``key``, or append to
    it, and return the table.

    Grouping or joining such a table by ``key`` needs no shuffle. ``df`` should be
    hash-partitioned by ``key`` into ``buckets``, so that each task writes one file. Rows
    of a file are sorted by ``sort``, so scans that filter by it skip most of them. The
    files go to ``path``, or to a scratch folder; ``drop_table`` removes both kinds.
    """
    spark = df.sparkSession
    writer = df.write.format("parquet").bucketBy(buckets, key).mode("append")
    if sort:
        writer = writer.sortBy(*sort)
    if not spark.catalog.tableExists(name):
        writer = writer.option("path", path or scratch_path(spark, name.split("_")[1]))
    writer.saveAsTable(name)
    return spark.table(name)


def open_bucketed(
    spark: SparkSession, path: str, schema: str, key: str, buckets: int, label: str, *sort: str
) -> DataFrame:
    """A table that ``bucketed`` wrote at ``path``, in this or another session."""
    name = table_name(label)
    order = f"SORTED BY ({', '.join(sort)})" if sort else ""
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) {order} "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def drop_table(df: DataFrame) -> None:
    """Take a table of ``bucketed`` or ``open_bucketed`` out of the catalog. Its files stay."""
    names = [t.name for t in df.sparkSession.catalog.listTables(pattern="fathomline_*")]
    plan = df._jdf.queryExecution().analyzed().toString()
    for name in names:
        if name in plan:
            df.sparkSession.sql(f"DROP TABLE {name}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a written folder wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remove_scratch(df: DataFrame) -> None:
    """Delete the scratch folders that ``df`` reads; nothing outside the scratch root."""
    spark = df.sparkSession
    root = checkpoint_root(spark).removeprefix("file:").rstrip("/")
    for file in df.inputFiles():
        bare = re.sub(r"^file:/+", "/", file)
        if bare.startswith(root + "/"):
            remove_folder(spark, f"{root}/{bare[len(root) + 1 :].split('/')[0]}")


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` inside tasks. It is broadcast, together with its
    class, so tasks need not be able to import this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan with too few splits for this cluster; leave others alone."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Globally sorted by range partitions. The sort keys must be unique together;
    then one hot leading key is still split over many partitions."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def number_rows(ordered: DataFrame, name: str, label: str) -> DataFrame:
    """Dense 0-based row number over a frame that is already in global order.

    The frame is written once, so every row has a fixed file and position. The
    number is that position plus the rows in the files before it. Only one count
    per file reaches the driver, and no window spans more than one file.
    """
    stored = materialise(ordered, label)
    columns = stored.columns
    placed = stored.select(
        *columns,
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    counts = {r["_file"]: r["n"] for r in placed.groupBy("_file").agg(F.count("*").alias("n")).collect()}
    offsets, before = [], 0
    for file in sorted(counts, key=_file_order):
        offsets.append((file, before))
        before += counts[file]
    small = stored.sparkSession.createDataFrame(offsets, "_file string, _before long")
    # one row per written file, as collected above
    numbered = placed.join(F.broadcast(small), "_file")
    return numbered.select((F.col("_before") + F.col("_row")).alias(name), *columns)


def running_totals(ordered: DataFrame, value: str, name: str, label: str) -> DataFrame:
    """Sum of ``value`` over the rows before, for a frame that is already in global order.

    Like ``number_rows``: the frame is written once, the sums inside a file come from a window
    over that file, and one sum per file reaches the driver.
    """
    stored = materialise(ordered, label)
    columns = stored.columns
    placed = stored.select(
        *columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    sums = {r["_file"]: r["n"] for r in placed.groupBy("_file").agg(F.sum(value).alias("n")).collect()}
    offsets, before = [], 0
    for file in sorted(sums, key=_file_order):
        offsets.append((file, before))
        before += sums[file]
    small = stored.sparkSession.createDataFrame(offsets, "_file string, _before long")
    so_far = F.sum(value).over(W.partitionBy("_file").orderBy("_row"))
    # one row per written file, as collected above
    summed = placed.withColumn("_total", so_far).join(F.broadcast(small), "_file")
    return summed.select((F.col("_before") + F.col("_total") - F.col(value)).alias(name), *columns)


def _file_order(name: str) -> tuple[int, str]:
    """``part-00012-<id>-c000...``: task number, then file within the task."""
    return int(name.split("-")[1]), name.rsplit("c", 1)[-1]


def fits_in_memory(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> bool:
    """Measure a side before broadcasting it. ``row_bytes`` is a Column or an int."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"]
    return (total or 0) <= limit


def broadcast_if_small(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a measured size; otherwise a shuffle join, where
    adaptive execution splits hot keys."""
    return F.broadcast(df) if fits_in_memory(df, row_bytes, limit) else df


def ordered_blocks(
    df: DataFrame,
    order_by: Sequence[str],
    before: int = 0,
    after: int = 0,
    size: int = 65536,
    label: str = "ordered",
) -> DataFrame:
    """Cut a globally ordered frame into blocks for windows over neighbours.

    Adds ``_block``, ``_at`` (position) and ``_own``. A block also holds copies
    of the ``before`` rows ahead of it and the ``after`` rows behind it, marked
    ``_own = false``. A window partitioned by ``_block`` never sees more than
    ``size + before + after`` rows, however many rows one key has.
    """
    if before >= size or after >= size:
        raise ValueError("the neighbourhood must be smaller than a block")
    numbered = number_rows(in_order(df, *order_by), "_at", label)
    home = F.floor(F.col("_at") / size).cast("long")
    offset = F.col("_at") % size
    copies = F.array(
        home,
        F.when(offset >= size - before, home + 1) if before else F.lit(None).cast("long"),
        F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None).cast("long"),
    )
    return (
        numbered.withColumn("_block", F.explode(F.array_compact(copies)))
        .withColumn("_own", F.col("_block") == F.floor(F.col("_at") / size))
    )


def block_window(*keys: str):
    """Window over the rows of one key inside one block, in order."""
    return W.partitionBy("_block", *keys).orderBy("_at")
