"""Cutting cleaned pages into chunks. Chunks never cross a page.

Every chunker is a chain of projections over one page row, so it needs no
shuffle; pages are the unit of parallelism.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import hashing, packing
from fathomline.functions import text as txt
from fathomline.operators.embedding import Embedder, embed_lists, map_lists
from fathomline.storage import broadcast_if_small, in_order, materialise, running_totals

# Chunker defaults.
CHUNK_SIZE = 500
SENTENCE_OVERLAP = 50
MIN_SENTENCES = 5
SIMILARITY_THRESHOLD = 0.2
CHUNKERS = ("sentence_chunker", "recursive_chunker", "semantic_chunker")
#: the column that tells pages apart
PAGE = "_page"


#: counts the tokens of a list of texts, for example with a tokenizer
TokenCounter = Callable[[list[str]], list[int]]


def split_sentences(pages: DataFrame, tokens: str = "words") -> DataFrame:
    """One row per sentence with its size."""
    return pages.select(
        "doc_id", "page_no", F.posexplode(txt.sentences(F.col("text"))).alias("pos", "sentence")
    ).withColumn("tokens", txt.count_tokens(F.col("sentence"), tokens))


def _sizes(items: str, tokens: str | TokenCounter) -> Column:
    """Sizes of a list column by a built-in counter, or by the caller's in Python."""
    if callable(tokens):
        return map_lists(F.col(items), tokens, "int")
    return F.transform(items, lambda item: txt.count_tokens(item, tokens))


def sentence_chunks(
    pages: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = SENTENCE_OVERLAP,
    min_sentences: int = 1,
    tokens: str | TokenCounter = "words",
) -> DataFrame:
    """Whole sentences up to ``chunk_size``, repeating up to ``overlap`` tokens.

    The size of a chunk is the sum of its sentences' sizes."""
    sized = pages.withColumn("_items", txt.sentences(F.col("text"))).withColumn(
        "_sizes", _sizes("_items", tokens)
    )
    bounds = packing.pack(F.col("_sizes"), chunk_size, overlap, min_sentences)
    return _flatten(sized.withColumn("_bounds", bounds))


def recursive_chunks(
    pages: DataFrame, chunk_size: int = CHUNK_SIZE, tokens: str | TokenCounter = "words"
) -> DataFrame:
    """Sentences; a longer sentence falls apart into clauses, a longer clause into
    words. The pieces are packed without overlap."""
    if callable(tokens):
        return _counted_recursive_chunks(pages, chunk_size, tokens)

    def words(clause: Column) -> Column:
        return F.when(txt.count_tokens(clause, tokens) <= chunk_size, F.array(clause)).otherwise(
            F.split(clause, " ")
        )

    def pieces(sentence: Column) -> Column:
        return F.when(
            txt.count_tokens(sentence, tokens) <= chunk_size, F.array(sentence)
        ).otherwise(F.flatten(F.transform(txt.clauses(sentence), words)))

    atoms = F.flatten(F.transform(txt.sentences(F.col("text")), pieces))
    sized = pages.withColumn("_items", atoms).withColumn("_sizes", _sizes("_items", tokens))
    return _flatten(sized.withColumn("_bounds", packing.pack(F.col("_sizes"), chunk_size)))


def _counted_recursive_chunks(pages: DataFrame, chunk_size: int, counter: TokenCounter) -> DataFrame:
    """The same with a counter in Python: all pieces of a page are counted between steps."""

    def apart(cut) -> Column:
        both = F.arrays_zip("_items", "_sizes")
        return F.flatten(
            F.transform(both, lambda x: F.when(x["_sizes"] <= chunk_size, F.array(x["_items"])).otherwise(cut(x["_items"])))
        )

    sized = pages.withColumn("_items", txt.sentences(F.col("text"))).withColumn("_sizes", _sizes("_items", counter))
    for cut in (txt.clauses, lambda clause: F.split(clause, " ")):
        sized = sized.withColumn("_items", apart(cut)).withColumn("_sizes", _sizes("_items", counter))
    return _flatten(sized.withColumn("_bounds", packing.pack(F.col("_sizes"), chunk_size)))


def semantic_chunks(
    pages: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    min_sentences: int = MIN_SENTENCES,
    threshold: float = SIMILARITY_THRESHOLD,
    dim: int = hashing.DIMENSION,
    tokens: str | TokenCounter = "words",
    embedder: Embedder | None = None,
) -> DataFrame:
    """Break where neighbouring sentences differ, or where a chunk is full.

    Sentence vectors are hashed terms, or come from ``embedder``."""
    if embedder is None:
        vectors = F.transform("_items", lambda s: hashing.bucket_counts(txt.terms(s), dim))
    else:
        vectors = embed_lists(F.col("_items"), embedder)
    sized = (
        pages.withColumn("_items", txt.sentences(F.col("text")))
        .withColumn("_sizes", _sizes("_items", tokens))
        .withColumn("_vectors", vectors)
        .withColumn("_similarities", hashing.neighbour_similarities(F.col("_vectors")))
    )
    bounds = packing.pack_at_breaks(
        F.col("_sizes"), F.col("_similarities"), chunk_size, min_sentences, threshold
    )
    return _flatten(sized.withColumn("_bounds", bounds))


def _flatten(packed: DataFrame) -> DataFrame:
    """One row per chunk; a page without sentences gives none. A ``PAGE`` column stays."""
    chunk = packing.assemble(F.col("_items"), F.col("_bounds"))
    kept = [c for c in packed.columns if c == PAGE]
    return packed.select(
        *kept, "doc_id", "page_no", F.posexplode(chunk).alias("chunk_pos", "_chunk")
    ).select(
        *kept,
        "doc_id",
        "page_no",
        "chunk_pos",
        F.col("_chunk.text").alias("text"),
        F.col("_chunk.tokens").alias("chunk_token_count"),
        F.lit("").alias("source"),
    )


def chunk_documents(
    pages: DataFrame, chunker: str = "sentence_chunker", chunk_size: int = CHUNK_SIZE, **options
) -> DataFrame:
    """Chunk cleaned pages with the configured chunker."""
    if chunker == "sentence_chunker":
        return sentence_chunks(pages, chunk_size, **options)
    if chunker == "recursive_chunker":
        return recursive_chunks(pages, chunk_size, **options)
    if chunker == "semantic_chunker":
        return semantic_chunks(pages, chunk_size, **options)
    raise ValueError(f"chunker {chunker!r} is not supported; use one of {', '.join(CHUNKERS)}")


def marked_pages(pages: DataFrame) -> DataFrame:
    """Add a number of its own to every page, also to pages that repeat an id."""
    return pages.withColumn(PAGE, F.monotonically_increasing_id())


def global_chunk_index(chunks: DataFrame) -> DataFrame:
    """Dense ``chunk_index`` by ``doc_id``, ``page_no`` and ``chunk_pos`` over the chunks of
    ``marked_pages``.

    Texts are written where they are. Only the ids of the pages and their number of chunks
    are sorted, and each page's first number comes back to its chunks: the texts stay in
    place if the pages measure small, else this join is the one time that they move.
    """
    stored = materialise(chunks, "chunks")
    pages = stored.groupBy(PAGE).agg(
        F.first("doc_id").alias("doc_id"), F.first("page_no").alias("page_no"), F.count("*").alias("_n")
    )
    first = running_totals(in_order(pages, "doc_id", "page_no", PAGE), "_n", "_first", "page-counts")
    side = broadcast_if_small(first.select(PAGE, "_first"), 32)
    numbered = stored.join(side, PAGE)
    columns = [c for c in stored.columns if c != PAGE]
    return numbered.select((F.col("_first") + F.col("chunk_pos")).alias("chunk_index"), *columns)


def chunk_stats(spark: SparkSession, pages: int, chunks: int) -> DataFrame:
    """Pages in and chunks out, as one row per measure."""
    return spark.createDataFrame([("pages", pages), ("chunks", chunks)], "measure string, n long")
