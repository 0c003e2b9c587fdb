"""The keyword index: postings in blocks of chunks, chunk lengths and corpus statistics.

Layout: a row holds the postings of one term in one block of neighbouring chunks, and one
more row of each block the lengths of its chunks. Blocks are hash-partitioned once and
written in buckets, so whatever groups by block later reads them without a shuffle, for
any number of question batches. A term that only one block has needs no statistics
from elsewhere; so most of a large vocabulary never moves again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions import text as txt
from fathomline.storage import (
    bucket_count,
    bucketed,
    drop_table,
    materialise,
    open_bucketed,
    remove_scratch,
    table_name,
)

#: chunks in a block
BLOCK = 1024
#: the term of the row with a block's lengths; others are never empty
LENGTHS = ""
#: of the vocabulary, the most frequent terms are broadcast, up to so many bytes: the hot keys
VOCABULARY_BYTES = 4 * 1024 * 1024
_POSTINGS = "block long, term string, chunks array<int>, tfs array<int>"
_BLOCKS = f"{_POSTINGS}, lengths array<double>"


@dataclass(frozen=True)
class TfIdfIndex:
    """``blocks(block, term, chunks, tfs, lengths)`` in buckets of ``block``, and
    ``idf(term, df, idf)``. ``chunks`` are places within the block."""

    blocks: DataFrame
    idf: DataFrame

    def _unfolded(self, rows: DataFrame, values: str, name: str) -> DataFrame:
        chunk = (F.col("block") * BLOCK + F.col("_p.chunks")).alias("chunk_index")
        pairs = rows.select("block", "term", F.explode(F.arrays_zip("chunks", values)).alias("_p"))
        return pairs.select(chunk, "term", F.col(f"_p.{values}").alias(name))

    @property
    def postings(self) -> DataFrame:
        """``(chunk_index, term, tf)``."""
        found = self._unfolded(self.blocks.where(F.col("term") != LENGTHS), "tfs", "tf")
        return found.withColumn("tf", F.col("tf").cast("long"))

    @property
    def lengths(self) -> DataFrame:
        """``(chunk_index, length)``: the L2 norm of ``tf * idf`` of every chunk with terms."""
        return self._unfolded(self.blocks.where(F.col("term") == LENGTHS), "lengths", "length").drop("term")

    @property
    def weights(self) -> DataFrame:
        """``(chunk_index, term, weight)`` with weights of unit length per chunk."""
        weight = F.col("tf") * F.col("idf") / F.col("length")
        found = self.postings.join(self.idf.select("term", "idf"), "term").join(self.lengths, "chunk_index")
        return found.select("chunk_index", "term", weight.alias("weight"))

    def close(self, remove: bool = False) -> None:
        """Take the table out of the session; ``remove`` also deletes scratch folders."""
        if remove:
            remove_scratch(self.blocks)
            remove_scratch(self.idf)
        drop_table(self.blocks)


def tokenize(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per term occurrence."""
    return texts.select(key, F.explode(txt.terms(F.col(text))).alias("term"))


def term_frequencies(chunks: DataFrame, buckets: int | None = None) -> DataFrame:
    """Count per (chunk, term). Moving the texts by chunk first is the only shuffle."""
    texts = chunks.select("chunk_index", "text")
    by_chunk = ("chunk_index",) if buckets is None else (buckets, "chunk_index")
    placed = texts.repartition(*by_chunk)
    return (
        tokenize(placed, "chunk_index")
        .groupBy("chunk_index", "term")
        .agg(F.count("*").alias("tf"))
    )


def inverse_document_frequency(postings: DataFrame, n_chunks: Column) -> DataFrame:
    """``ln((1 + N) / (1 + df)) + 1`` per term. Counts combine before the shuffle,
    so a term in every chunk costs one row per task."""
    return _with_idf(postings.groupBy("term").agg(F.count("*").alias("df")), n_chunks)


def _with_idf(held: DataFrame, n_chunks: Column) -> DataFrame:
    return held.withColumn("idf", F.log((n_chunks + 1) / (F.col("df") + 1)) + 1)


def corpus_size(chunks: DataFrame) -> Column:
    """Number of chunks as a scalar subquery."""
    return chunks.select(F.count("*")).scalar()


def _term_bytes() -> Column:
    return F.octet_length("term") + 48


def _broadcastable_df(idf: DataFrame, limit: int) -> int:
    """The lowest power of two such that all terms at least that frequent fit in
    ``limit`` bytes. At most 64 rows come back."""
    level = F.floor(F.log2("df")).cast("int")
    sizes = idf.groupBy(level.alias("level")).agg(F.sum(_term_bytes()).alias("bytes")).collect()
    lowest, total = 62, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["bytes"]
        if total > limit:
            break
        lowest = row["level"]
    return 1 << lowest


def _packed(block: pa.Table) -> pa.Table:
    """The rows of a block from its chunks' terms: one per term, in order."""
    words = block.column("terms").combine_chunks()
    chunk = np.repeat(block.column("chunk_index").to_numpy() % BLOCK, pc.list_value_length(words).fill_null(0).to_numpy())
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, tfs = np.unique(rank[coded.indices.to_numpy()] * BLOCK + chunk, return_counts=True)
    term, place = np.divmod(keys, BLOCK)
    bounds = pa.array(np.searchsorted(term, np.arange(len(order) + 1)), pa.int32())
    return pa.table(
        {
            "block": pa.array(np.full(len(order), block.column("chunk_index")[0].as_py() // BLOCK)),
            "term": coded.dictionary.take(pa.array(order)),
            "chunks": pa.ListArray.from_arrays(bounds, pa.array(place, pa.int32())),
            "tfs": pa.ListArray.from_arrays(bounds, pa.array(tfs, pa.int32())),
        }
    )


def _measured(rows: pa.Table, rare: pa.Table, size: int) -> pa.Table:
    """The row with the lengths of a block's chunks, from its rows with ``idf`` where that was
    looked up, the other shared terms in ``rare``, and terms that only this block has."""
    rows = rows.sort_by("term")
    lists, tfs = (rows.column(c).combine_chunks() for c in ("chunks", "tfs"))
    sizes = pc.list_value_length(lists).to_numpy()
    own = pa.array(np.log((size + 1) / (sizes + 1)) + 1)
    idf = rows.column("idf").combine_chunks()
    if rare.num_rows:
        at = pc.index_in(rows.column("term").combine_chunks(), rare.column("term").combine_chunks())
        idf = pc.coalesce(idf, rare.column("idf").combine_chunks().take(at))
    idf = pc.coalesce(idf, own).to_numpy()
    place = lists.flatten().to_numpy()
    values = tfs.flatten().to_numpy() * np.repeat(idf, sizes)
    lengths = np.sqrt(np.bincount(place, weights=values**2, minlength=BLOCK))
    held = np.flatnonzero(lengths)
    return pa.table(
        {
            "block": rows.column("block").slice(0, 1),
            "term": [LENGTHS],
            "chunks": pa.array([held], pa.list_(pa.int32())),
            "tfs": pa.array([None], pa.list_(pa.int32())),
            "lengths": pa.array([lengths[held]], pa.list_(pa.float64())),
        }
    )


def chunk_lengths(postings: DataFrame, statistics: DataFrame, size: int, limit: int = VOCABULARY_BYTES) -> DataFrame:
    """The rows of lengths for rows of ``postings`` in buckets of ``block``; ``size`` is the number
    of chunks, ``statistics`` has ``(term, df, idf, blocks)``.

    Only terms of several blocks are looked up. Of these the most frequent are broadcast, as
    many as fit in ``limit``: the hot keys. The names of the others shuffle by term and
    come back to their block; the postings stay where they are.
    """
    shared = statistics.where("blocks > 1").select("term", "df", "idf")
    split = _broadcastable_df(shared, limit)
    frequent = F.broadcast(shared.where(F.col("df") >= split).drop("df"))
    looked_up = postings.join(frequent, "term", "left").select("block", "term", "chunks", "tfs", "idf")
    # new names for columns of the same table, which meets itself below
    names = postings.select(F.col("block").alias("at"), "term").join(frequent.select("term"), "term", "left_anti")
    rare = names.join(shared.where(F.col("df") < split).drop("df"), "term")
    rare = rare.select(F.col("at").alias("block"), F.col("term").alias("term"), F.col("idf").alias("idf"))

    def measured(rows: pa.Table, others: pa.Table) -> pa.Table:
        return _measured(rows, others, size)

    return looked_up.groupBy("block").cogroup(rare.groupBy("block")).applyInArrow(measured, _BLOCKS)


def tfidf_index(
    chunks: DataFrame, path: str | None = None, buckets: int | None = None, limit: int = VOCABULARY_BYTES
) -> TfIdfIndex:
    """Build and write the index of a numbered chunk table.

    With ``path`` it is kept there for ``open_index``; otherwise it lives in scratch
    folders. ``buckets`` defaults to a number that follows the chunks. ``limit`` bounds the
    broadcast part of the vocabulary (see ``chunk_lengths``).
    """
    spark, size = chunks.sparkSession, chunks.count()
    if buckets is None:
        buckets = bucket_count(spark, size)
    part = lambda name: None if path is None else f"{path}/{name}"
    block = F.expr(f"chunk_index div {BLOCK}").alias("block")
    # the texts move once, to their bucket
    texts = chunks.select(block, F.col("chunk_index").cast("long").alias("chunk_index"), "text").repartition(buckets, "block")
    words = texts.select("block", "chunk_index", txt.terms(F.col("text")).alias("terms"))
    packed = words.groupBy("block").applyInArrow(_packed, _POSTINGS)
    name = table_name("postings")
    empty = F.lit(None).cast("array<double>").alias("lengths")
    postings = bucketed(packed.select("*", empty), "block", buckets, name, "term", path=part("postings"))
    held = postings.groupBy("term").agg(F.sum(F.size("chunks")).cast("long").alias("df"), F.count("*").alias("blocks"))
    counted = _with_idf(held, F.lit(size)).select("term", "df", "idf", "blocks")
    if path is None:
        statistics = materialise(counted, "idf")
    else:
        counted.write.parquet(part("idf"))
        statistics = spark.read.parquet(part("idf"))
    lengths = materialise(chunk_lengths(postings, statistics, size, limit), "lengths")
    blocks = bucketed(lengths.repartition(buckets, "block"), "block", buckets, name, "term")
    remove_scratch(lengths)
    if path is not None:
        layout = spark.createDataFrame([(buckets, BLOCK)], "buckets int, block int")
        layout.coalesce(1).write.json(part("layout"))
    return TfIdfIndex(blocks, statistics.drop("blocks"))


def open_index(spark: SparkSession, path: str) -> TfIdfIndex:
    """An index that ``tfidf_index`` kept at ``path``, with its buckets."""
    layout = spark.read.schema("buckets int, block int").json(f"{path}/layout").first()
    if layout["block"] != BLOCK:
        raise ValueError(f"the index has blocks of {layout['block']} chunks, not {BLOCK}; build it again")
    blocks = open_bucketed(spark, f"{path}/postings", _BLOCKS, "block", layout["buckets"], "postings", "term")
    return TfIdfIndex(blocks, spark.read.parquet(f"{path}/idf").drop("blocks"))


def question_terms(questions: DataFrame, idf: DataFrame, small: bool) -> DataFrame:
    """``(index, term, idf, weight)``: unit weights of the question terms that the
    corpus has."""
    counts = (
        tokenize(questions, "index", "question")
        .groupBy("index", "term")
        .agg(F.count("*").alias("tf"))
    )
    known = idf.select("term", "idf").join(F.broadcast(counts) if small else counts, "term")
    raw = known.withColumn("_x", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(W.partitionBy("index")))
    return raw.select("index", "term", "idf", (F.col("_x") / length).alias("weight"))
