"""Document listing and page loading."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathomline.operators.cleaning import validate_records
from fathomline.schemas import PAGES
from fathomline.storage import file_store, in_order, materialise, running_totals

PAGE_BREAK = "\f"
#: folders that the driver opens before tasks list the rest
OPENED_FOLDERS = 256
#: bytes of files that one task loads
TASK_BYTES = 128 * 1024 * 1024


@dataclass
class _Listed(InputPartition):
    """Files found so far, or a folder to list with all below."""

    files: list[tuple[str, int]]
    folder: str | None = None


class DocumentListing(DataSource):
    """Paths and sizes of the files below ``path`` whose names end in ``suffix``.

    It lists by itself, so it also finds names that begin with ``_`` or ``.``. The driver opens
    the upper folders and tasks the others; no file is opened.
    """

    @classmethod
    def name(cls) -> str:
        return "fathomline_documents"

    def schema(self) -> str:
        return "path string, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"], self.options.get("suffix", ""))


class _ListingReader(DataSourceReader):
    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path, suffix

    def _kept(self, infos: list[fs.FileInfo]) -> list[tuple[str, int]]:
        return [(i.path, i.size) for i in infos if i.type == fs.FileType.File and i.base_name.endswith(self.suffix)]

    def partitions(self) -> list[_Listed]:
        store, root = file_store(self.path)
        top = store.get_file_info(root)
        if top.type != fs.FileType.Directory:
            return [_Listed(self._kept([top]))]
        folders, files, opened = [root], [], 0
        while folders and opened < OPENED_FOLDERS:
            found = store.get_file_info(fs.FileSelector(folders.pop(0)))
            folders += [i.path for i in found if i.type == fs.FileType.Directory]
            files += self._kept(found)
            opened += 1
        return [_Listed(files)] + [_Listed([], folder) for folder in folders]

    def read(self, partition: _Listed) -> Iterator[tuple[str, int]]:
        yield from partition.files
        if partition.folder is not None:
            store, _ = file_store(self.path)
            yield from self._kept(store.get_file_info(fs.FileSelector(partition.folder, recursive=True)))


def list_documents(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """``(path, length)`` of the files below ``root``, or of ``root`` itself, whose names end in
    ``suffix`` (case matters). A root that is not there has none.

    Names may begin with ``_`` or ``.``. ``root`` must be a path that ``file_store`` opens. The
    content is never read.
    """
    spark.dataSource.register(DocumentListing)
    return spark.read.format(DocumentListing.name()).option("path", root).option("suffix", suffix).load()


def load_pages(documents: DataFrame, page_break: str = PAGE_BREAK) -> DataFrame:
    """One row per page, in page order. ``documents`` has ``doc_id, text, source``.

    A document without a text has no page; ``checked_documents`` tells which ones.
    """
    pages = F.split(F.col("text"), page_break)
    return documents.select(
        "doc_id", F.posexplode(pages).alias("page_no", "text"), F.col("source")
    ).select("doc_id", "page_no", "text", "source")


def checked_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a text, and the others with a ``reason``: they have no pages."""
    return validate_records(documents, ["text"])


def load_binary_pages(
    spark: SparkSession,
    root: str | None,
    extract: Callable[[bytes], list[str]],
    suffix: str = ".pdf",
    task_bytes: int = TASK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """One row per page of each binary file, with a caller-supplied extractor.

    ``extract(content)`` returns the page texts and must be picklable. The id is
    a hash of the path. Without ``root`` there is nothing to read. Files are dealt to tasks
    by their sizes, about ``task_bytes`` each, and a task opens one file after another. The
    second result names the files that could not be read or that the extractor failed on,
    with a ``reason``.
    """
    if not root:
        raise ValueError("give the folder or file to load")

    def extract_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = file_store(root)
        for batch in batches:
            for doc_id, path in zip(batch["doc_id"], batch["path"]):
                try:
                    with store.open_input_file(path) as file:
                        texts, reason = list(extract(file.read())), None
                except Exception as error:
                    texts, reason = [None], f"{type(error).__name__}: {error}"
                yield pd.DataFrame(
                    {
                        "doc_id": doc_id,
                        "page_no": range(len(texts)),
                        "text": texts,
                        "source": path,
                        "reason": reason,
                    }
                )

    placed = running_totals(in_order(list_documents(spark, root, suffix), "path"), "length", "_before", "listed")
    total = placed.agg(F.sum("length").alias("bytes")).first()["bytes"] or 0
    task = F.expr(f"int(_before div {task_bytes})")
    files = placed.repartitionById(total // task_bytes + 1, task).select(F.xxhash64("path").alias("doc_id"), "path")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAGES.fields)
    # written once: extracting is dear, and both results read it
    read = materialise(files.mapInPandas(extract_pages, f"{kinds}, reason string"), "extracted")
    pages = read.where("reason is null").drop("reason")
    return pages, read.where("reason is not null").select("doc_id", "source", "reason")
