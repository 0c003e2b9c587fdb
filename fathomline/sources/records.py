"""Question-answer records as JSON, and summaries written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.schemas import QA_RECORD
from fathomline.storage import materialise

CORRUPT = "_corrupt"


def read_qa_dataset(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = QA_RECORD,
    array_files: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Records and unreadable entries, as two frames.

    ``array_files`` reads files that each hold one JSON array. Such a file is one
    task, so large sets should be many files or, with ``array_files=False``, one
    record per line, which Spark splits. An empty file gives no rows. What cannot
    be parsed lands in the second frame ``(file, raw)`` instead of vanishing. The
    files are parsed once; both frames read the written result.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    everything = (
        spark.read.schema(with_corrupt)
        .option("multiLine", array_files)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    parsed = materialise(
        everything.withColumn("_file", F.col("_metadata.file_path")), "records"
    )
    readable = parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file")
    broken = parsed.where(F.col(CORRUPT).isNotNull()).select(
        F.col("_file").alias("file"), F.col(CORRUPT).alias("raw")
    )
    return readable, broken


def rename_columns(df: DataFrame, schema_map: dict[str, str] | None) -> DataFrame:
    """Rename after reading; names that are not there are ignored."""
    return df.withColumnsRenamed(schema_map or {})


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8 as is. Keep the key (``index``) as a column."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def project_qa_columns(records: DataFrame) -> DataFrame:
    return records.select("index", "context", "question", "answer")


def head_n(df: DataFrame, n: int = 20, order_by: str = "index") -> DataFrame:
    """The first ``n`` records in file order; planned as TakeOrderedAndProject."""
    return df.orderBy(order_by).limit(n)
