"""Keys for rows of document tables, and dropping or joining rows by such keys.

A row's key is its ``doc_id`` and a hash of its text, so rows that share an id but not
the text stay apart, and rows without an id have a key as well. Helper columns take
names that the table does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.storage import fits_in_memory

KEY_BYTES = 64
BROADCAST_KEYS = 32 * 1024 * 1024


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def same_row(left: DataFrame, right: DataFrame, key: str) -> Column:
    """Null-safe equality of id and key with ``right``'s ``_id`` and ``_key``."""
    return left["doc_id"].eqNullSafe(right["_id"]) & (left[key] == right["_key"])


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``(_id, _key)`` stand in ``gone``.

    Keys that measure small are broadcast, so texts stay in place; else both sides
    shuffle. ``gone`` should be a written table, it is read twice.
    """
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    if fits_in_memory(gone, KEY_BYTES, BROADCAST_KEYS):
        gone = F.broadcast(gone)
    return keyed.join(gone, same_row(keyed, gone, key), "left_anti").drop(key)
