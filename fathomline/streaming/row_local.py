"""Running row-local operators on streams of files.

Cleaning, chunking, prompting and parsing keep no state between rows, so the
batch functions run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_file_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 1000
) -> DataFrame:
    """A stream of the parquet files that arrive under ``path``."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def run_available(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Process everything that has arrived and append it to parquet, exactly once.

    ``checkpoint`` must be on shared storage; a restarted query goes on from it.
    """
    return (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
