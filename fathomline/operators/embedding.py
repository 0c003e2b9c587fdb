"""Turning texts into vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.hashing import DIMENSION, hash_embedding

#: texts per call of an embedder or counter
AT_ONCE = 1024

Embedder = Callable[[list[str]], np.ndarray]


def embed_texts(
    df: DataFrame,
    text: str = "text",
    embedder: Embedder | None = None,
    dim: int = DIMENSION,
    name: str = "embedding",
    error: str | None = None,
    make_embedder: Callable[[], Embedder] | None = None,
) -> DataFrame:
    """Add a vector column.

    The default hashes terms (``hash_embedding``). A caller's ``embedder`` (picklable, a
    list of texts to a matrix), or the one that ``make_embedder`` builds once per task,
    runs on ``AT_ONCE`` texts per call; only the text column crosses to Python. A failing
    call ends the job, unless ``error`` names a column: then it is repeated on halves
    until single texts fail, which get a null vector and their error there.
    """
    if embedder is None and make_embedder is None:
        hashed = df.withColumn(name, hash_embedding(F.col(text), dim).cast("array<float>"))
        return hashed if error is None else hashed.withColumn(error, F.lit(None).cast("string"))

    @F.arrow_udf("vector array<float>, error string")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = embedder if make_embedder is None else make_embedder()

        def vectors(texts: list[str]) -> list:
            matrix = np.asarray(client(texts), dtype=np.float32)
            if matrix.shape != (len(texts), dim):
                raise ValueError(f"the embedder returned shape {matrix.shape}")
            return list(matrix)

        def answers(texts: pa.Array) -> pa.StructArray:
            given = texts.fill_null("").to_pylist()
            found = [(v, None) for v in vectors(given)] if error is None else _halved(vectors, given)
            told = [pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())]
            return pa.StructArray.from_arrays(told, ["vector", "error"])

        for texts in batches:
            # only the texts of one call are Python strings at a time
            parts = [answers(texts.slice(at, AT_ONCE)) for at in range(0, len(texts), AT_ONCE)]
            yield pa.concat_arrays(parts or [answers(texts)])

    told = df.withColumn("_told", embed.asNondeterministic()(F.col(text)))
    columns = {name: F.col("_told.vector")} | ({} if error is None else {error: F.col("_told.error")})
    return told.withColumns(columns).drop("_told")


def _halved(call: Callable[[list[str]], list], texts: list[str]) -> list[tuple]:
    """Results of ``call``, or an error for each text that fails alone."""
    try:
        return [(v, None) for v in call(texts)]
    except Exception as problem:
        if len(texts) == 1:
            return [(None, f"{type(problem).__name__}: {problem}")]
    middle = len(texts) // 2
    return _halved(call, texts[:middle]) + _halved(call, texts[middle:])


def map_lists(texts: Column, call: Callable[[list[str]], Iterable], kind: str) -> Column:
    """``call`` on every text of a list column, list by list and ``AT_ONCE`` texts at most
    per call; ``kind`` is the type of one result."""

    @F.pandas_udf(f"array<{kind}>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            rows = []
            for row in lists:
                if row is None:
                    rows.append(None)
                    continue
                given, found = list(row), []
                for at in range(0, len(given), AT_ONCE):
                    part = given[at : at + AT_ONCE]
                    told = list(call(part))
                    if len(told) != len(part):
                        raise ValueError(f"{len(told)} results for {len(part)} texts")
                    found += told
                rows.append(found)
            yield pd.Series(rows, index=lists.index)

    return apply.asNondeterministic()(texts)


def embed_lists(texts: Column, embedder: Embedder) -> Column:
    """Vectors of every text in a list column."""
    return map_lists(texts, lambda part: np.asarray(embedder(part), dtype=np.float32), "array<float>")
