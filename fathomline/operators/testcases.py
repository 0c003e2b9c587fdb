"""Goldens, predictions and test cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.storage import block_window, ordered_blocks


def zip_align(*tables: DataFrame) -> DataFrame:
    """Join tables on a dense ``index``; rows beyond the shortest table drop out,
    as when lists are zipped."""
    first, *others = tables
    for other in others:
        first = first.join(other, "index")
    return first


def build_goldens(qa: DataFrame) -> DataFrame:
    """``index, input, expected_output, context`` from ``index, question, answer, context``."""
    return qa.select(
        "index",
        F.col("question").alias("input"),
        F.col("answer").alias("expected_output"),
        F.array("context").alias("context"),
    )


def attach_predictions(goldens: DataFrame, predictions: DataFrame) -> DataFrame:
    """Add ``actual_output`` and ``retrieval_context``. A golden without a
    prediction gets empty ones."""
    joined = goldens.join(predictions, "index", "left")
    return joined.withColumns(
        {
            "actual_output": F.coalesce("actual_output", F.lit("")),
            "retrieval_context": F.coalesce("retrieval_context", F.array().cast("array<string>")),
        }
    )


def qa_from_turns(
    turns: DataFrame, group: str = "conv_id", order: str = "turn", block_size: int = 65536
) -> DataFrame:
    """Question-answer pairs: a user turn directly followed by an assistant turn.

    Neighbours are looked up inside ordered blocks, so one very long conversation
    spreads over many tasks.
    """
    blocks = ordered_blocks(turns, [group, order], after=1, size=block_size, label="turns")
    w = block_window(group)
    return (
        blocks.withColumns(
            {"_role": F.lead("role").over(w), "answer": F.lead("text").over(w)}
        )
        .where(F.col("_own") & (F.col("role") == "user") & (F.col("_role") == "assistant"))
        .select(group, order, F.col("text").alias("question"), "answer")
    )


def qa_history(
    pairs: DataFrame,
    n: int = 3,
    group: str = "conv_id",
    order: str = "turn",
    block_size: int = 65536,
) -> DataFrame:
    """Add ``history``: the up to ``n`` pairs before each pair of a conversation."""
    if n < 1:
        raise ValueError("n must be positive")
    blocks = ordered_blocks(pairs, [group, order], before=n, size=block_size, label="pairs")
    said = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"))
    earlier = block_window(group).rowsBetween(-n, -1)
    return (
        blocks.withColumn("history", F.array_join(F.collect_list(said).over(earlier), "\n"))
        .where("_own")
        .select(group, order, "question", "answer", "history")
    )
