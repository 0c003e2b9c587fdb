"""Declared schemas. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

QA_RECORD = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("location_dependency_evaluator_target_answer", T.StringType()),
        T.StructField("groundedness_score", T.IntegerType()),
        T.StructField("groundedness_eval", T.StringType()),
        T.StructField("question_relevancy_score", T.IntegerType()),
        T.StructField("question_relevancy_eval", T.StringType()),
        T.StructField("faithfulness_score", T.IntegerType()),
        T.StructField("faithfulness_eval", T.StringType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

RATING = "struct<Evaluation:string,Score:string>"
LOCATION_RATING = (
    "struct<Evaluation:string,Score:string,`Refined Question`:string,"
    "`Refined Answer`:string,`Target Answer`:string>"
)


def require(df: DataFrame, **types: str) -> DataFrame:
    """Check names and types when the plan is built, before any job runs."""
    found = dict(df.dtypes)
    for name, wanted in types.items():
        if name not in found:
            raise ValueError(f"column {name!r} is missing; found {sorted(found)}")
        if found[name] != wanted:
            raise TypeError(f"column {name!r} must be {wanted}, not {found[name]}")
    return df
