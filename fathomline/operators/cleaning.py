"""Page text projection, cleaning and record validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as txt


def project_page_text(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_no", "text")


def clean_pages(pages: DataFrame) -> DataFrame:
    """Replace ``text`` by its cleaned form."""
    return pages.withColumn("text", txt.clean(F.col("text")))


def validate_records(
    records: DataFrame, text_columns: Sequence[str], list_columns: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Split records into valid ones and rejected ones with a ``reason``.

    Types are checked when the plan is built; nulls are checked per row.
    """
    found = dict(records.dtypes)
    for name in text_columns:
        if found.get(name) != "string":
            raise TypeError(f"column {name!r} must be a string, not {found.get(name)}")
    for name in list_columns:
        if not str(found.get(name)).startswith("array<"):
            raise TypeError(f"column {name!r} must be a list, not {found.get(name)}")
    checks = [F.when(F.col(n).isNull(), F.lit(f"{n} is missing")) for n in text_columns]
    checks += [
        F.when(F.col(n).isNull() | F.exists(n, lambda item: item.isNull()), F.lit(f"{n} is incomplete"))
        for n in list_columns
    ]
    return split_on(records, F.coalesce(*checks))


def split_on(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``reason`` is null, and the others with the reason attached."""
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(
        F.col("reason").isNotNull()
    )
