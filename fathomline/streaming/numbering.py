"""Dense chunk numbers over documents that keep arriving.

A micro-batch is numbered like a table, from the number after the last one of the batch
before. The state is one row per batch in a folder beside the chunks. A batch that runs
again, after a crash or a restart, replaces its own files and row, so numbers have neither
gaps nor repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.operators.chunking import CHUNK_SIZE
from fathomline.plans.corpus import counted_chunk_table

_NUMBERS = "batch long, first long, n long"


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_NUMBERS).option("recursiveFileLookup", True).parquet(f"{path}/numbers")


def number_stream(
    documents: DataFrame,
    path: str,
    checkpoint: str,
    chunker: str = "sentence_chunker",
    chunk_size: int = CHUNK_SIZE,
    **options,
) -> StreamingQuery:
    """Chunk and number everything that has arrived on the stream ``documents``.

    Chunks go below ``path``, which like ``checkpoint`` must be on shared storage; a query that
    is started again with both goes on from where the last one was. Numbers follow the
    order of the batches, and inside one that of ``chunk_table``.
    """

    def number(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            # the row before the first one
            start = spark.createDataFrame([(-1, 0, 0)], _NUMBERS)
            start.coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers/start")
        last = _numbers(spark, path).where(F.col("batch") < batch_id).orderBy(F.desc("batch")).first()
        first = last["first"] + last["n"]
        chunks, counts = counted_chunk_table(batch, chunker, chunk_size, **options)
        numbered = chunks.withColumn("chunk_index", F.col("chunk_index") + first)
        numbered.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
        n = counts.where("measure = 'chunks'").first()["n"]
        told = spark.createDataFrame([(batch_id, first, n)], _NUMBERS)
        told.coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers/{batch_id}")

    writer = documents.writeStream.foreachBatch(number).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def numbered_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks of the batches that are complete, with the number of their ``batch``."""
    whole = _numbers(spark, path).where("batch >= 0").select("batch")
    # one row per batch
    return spark.read.parquet(f"{path}/chunks").join(F.broadcast(whole), "batch")
