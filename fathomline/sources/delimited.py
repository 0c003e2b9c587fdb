"""Delimited text tables with a header; also the stand-in for spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fathomline.sources.records import rename_columns

#: how a null is written; a text that equals it reads back as null
NULL_TEXT = "\\N"
# without these, edge spaces would go and empty texts become null
_EXACT = {
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": "",
    "nullValue": NULL_TEXT,
}


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    delimiter: str = "\t",
    encoding: str = "UTF-8",
    schema_map: dict[str, str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read with a declared schema. Quoted fields may hold delimiters and quotes.

    Line breaks inside fields need ``multi_line``, which makes each file one task;
    cleaned text has none, so its files stay splittable. Edge spaces and empty texts
    are kept; ``NULL_TEXT`` stands for null.
    """
    df = (
        spark.read.schema(schema)
        .option("sep", delimiter)
        .option("header", True)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .options(**_EXACT)
        .csv(path)
    )
    return rename_columns(df, schema_map)


def write_delimited(
    df: DataFrame,
    path: str,
    delimiter: str = "\t",
    encoding: str = "UTF-8",
    mode: str = "overwrite",
) -> None:
    (
        df.write.mode(mode)
        .option("sep", delimiter)
        .option("header", True)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .options(**_EXACT)
        .csv(path)
    )
