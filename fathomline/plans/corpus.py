"""From documents to a numbered chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fathomline.operators.chunking import (
    CHUNK_SIZE,
    chunk_documents,
    chunk_stats,
    global_chunk_index,
    marked_pages,
)
from fathomline.operators.cleaning import clean_pages
from fathomline.sources.documents import load_pages
from fathomline.storage import spread


def counted_chunk_table(
    documents: DataFrame,
    chunker: str = "sentence_chunker",
    chunk_size: int = CHUNK_SIZE,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """``chunk_table``, and pages in and chunks out as ``(measure, n)``.

    The counts are observed in the pass that writes the chunks; nothing is read for them.
    """
    pages, chunks = Observation(), Observation()
    rows = spread(load_pages(documents), "doc_id", "page_no").observe(pages, F.count(F.lit(1)).alias("n"))
    cut = chunk_documents(marked_pages(clean_pages(rows)), chunker, chunk_size, **options)
    table = global_chunk_index(cut.observe(chunks, F.count(F.lit(1)).alias("n")))
    return table, chunk_stats(documents.sparkSession, pages.get["n"], chunks.get["n"])


def chunk_table(
    documents: DataFrame,
    chunker: str = "sentence_chunker",
    chunk_size: int = CHUNK_SIZE,
    **options,
) -> DataFrame:
    """Load, clean, chunk and number: ``chunk_index, doc_id, page_no, chunk_pos,
    text, chunk_token_count, source``.

    Documents are read once and everything up to the written table is narrow; numbers come
    from the pages' ids and counts alone. Where a scan has fewer splits than cores, pages
    spread first, so that one document with very many pages is not one task's work.
    """
    pages = spread(load_pages(documents), "doc_id", "page_no")
    return global_chunk_index(chunk_documents(marked_pages(clean_pages(pages)), chunker, chunk_size, **options))
