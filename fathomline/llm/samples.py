"""Bounded labelled samples and held-out folds for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30


def fold(parts: int) -> Column:
    """``crc32`` of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def agreed_labels(labels: DataFrame, column: str) -> DataFrame:
    """``(doc_id, label)``: ids whose label rows all say the same; nulls do not count."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"), F.max(column).alias("_other"))
        .where("label = _other")
        .select("doc_id", "label")
    )


def bounded(labelled: DataFrame, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label at most, drawn by a hash of the id.

    The rate of a label is ``per_label`` over its number of rows, so the expected size
    is bounded whatever the table's size. Every label keeps the order of the hash, so
    the draw does not depend on the partitioning.
    """
    counts = labelled.groupBy("label").agg(F.count("*").alias("_n"))
    rate = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("_n"))
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(_SPACE))
    drawn = labelled.join(counts, "label").where(place < rate * _SPACE)
    return drawn.select("doc_id", "label")


def binary_views(column: pa.ChunkedArray, kind: type = np.int32) -> list[np.ndarray]:
    """Numbers packed into a binary column, row by row, without copying them."""
    views = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        bounds = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        views += [raw[a:b].view(kind) for a, b in zip(bounds[:-1], bounds[1:])]
    return views
