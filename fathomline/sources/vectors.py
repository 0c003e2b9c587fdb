"""Pre-built vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.schemas import VECTORS


def load_vectors(spark: SparkSession, path: str | list[str], dimension: int) -> DataFrame:
    """``(vec_id, embedding)`` from parquet. A vector of another length fails the job."""
    return checked_vectors(spark.read.schema(VECTORS).parquet(path), dimension)


def checked_vectors(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    wrong = F.concat(
        F.lit(f"expected {dimension} dimensions, found "), F.size(column).cast("string")
    )
    checked = F.when(F.size(column) == dimension, F.col(column)).otherwise(F.raise_error(wrong))
    return vectors.withColumn(column, checked)
