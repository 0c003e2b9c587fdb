"""Making a rated question-answer set from chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.lexical import drafted_pair, rating_json, rating_of
from fathomline.functions.prompts import TEMPLATES, placeholders, render
from fathomline.functions.parsing import qa_problem
from fathomline.functions.text import distinct_terms
from fathomline.operators.cleaning import split_on
from fathomline.operators.generation import Model
from fathomline.operators.ledger import replied
from fathomline.operators.synthesis import (
    assemble_qa_dataset,
    critique,
    location_dependency,
    parse_pairs,
    qa_prompts,
    rating_problem,
)
from fathomline.storage import materialise


def drafted_pairs(
    chunks: DataFrame,
    writer: Model | None = None,
    make_writer: Callable[[], Model] | None = None,
    calls: dict | None = None,
) -> DataFrame:
    """``index, context, output, error``: one generated pair text per chunk.

    If the chunks have a column ``history``, the prompt tells the earlier questions and
    answers in it.
    """
    if "history" in chunks.columns:
        prompted = qa_prompts(chunks, "qa_generation_with_history", history="history")
    else:
        prompted = qa_prompts(chunks)
    if writer is None and make_writer is None:
        reply = F.struct(drafted_pair(F.col("text")).alias("output"), F.lit(None).cast("string").alias("error"))
        drafted = prompted.withColumn("_reply", reply)
    else:
        drafted = replied(prompted, "_reply", F.col("prompt"), writer, make_writer, calls)
    return drafted.select(
        F.col("chunk_index").alias("index"), F.col("text").alias("context"), "_reply.output", "_reply.error"
    )


def location_reply(
    df: DataFrame,
    judge: Model | None = None,
    make_judge: Callable[[], Model] | None = None,
    calls: dict | None = None,
) -> DataFrame:
    """Add ``location_output`` and ``_location_call`` with the error of a failed call.

    Without a judge, a question rated 1 or 2 for its shared terms with the context
    counts as depending on more context.
    """
    if judge is not None or make_judge is not None:
        names = placeholders(TEMPLATES["location_dependency"])
        prompt = render(TEMPLATES["location_dependency"], {n: F.col(n) for n in names})
        asked = replied(df, "_location_reply", prompt, judge, make_judge, calls)
        return asked.select(
            *df.columns,
            F.col("_location_reply.output").alias("location_output"),
            F.col("_location_reply.error").alias("_location_call"),
        )
    shared = rating_of(
        distinct_terms(F.col("question")), distinct_terms(F.col("context"))
    )
    vague = (shared <= 2).cast("int")
    return df.withColumns(
        {
            "location_output": rating_json(vague, F.lit("shared terms")),
            "_location_call": F.lit(None).cast("string"),
        }
    )


def qa_dataset(
    chunks: DataFrame,
    writer: Model | None = None,
    judge: Model | None = None,
    make_writer: Callable[[], Model] | None = None,
    make_judge: Callable[[], Model] | None = None,
    calls: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The eleven-column dataset, and the rejected rows with a reason.

    ``chunks`` is whatever should become pairs: all chunks or ``sample_chunks``, with a
    column ``history`` if earlier pairs should be told. Rejected are drafts whose call
    failed, that are no pair or too long, and pairs with a failed or invalid rating. All
    model replies are written once, so that no result asks again. ``calls`` are options of
    the calls; with a ``ledger`` among them, a restarted run pays for no finished call.
    """
    drafts = materialise(drafted_pairs(chunks, writer, make_writer, calls), "drafts")
    pairs = parse_pairs(drafts)
    failed = F.concat(F.lit("draft: "), F.col("error"))
    problem = F.coalesce(failed, qa_problem(F.col("question"), F.col("answer")))
    valid, unfit = split_on(pairs, problem)
    rated_pairs = critique(valid.drop("error"), judge=judge, make_judge=make_judge, calls=calls)
    asked = location_reply(rated_pairs, judge, make_judge, calls)
    judged = location_dependency(asked, "location_output")
    judged = judged.withColumn("location_error", F.coalesce("_location_call", "location_error"))
    rated = materialise(judged.withColumn("reason", rating_problem()), "rated")
    columns = ["index", "context", "output", "question", "answer", "reason"]
    rejected = unfit.select(columns).union(rated.where("reason is not null").select(columns))
    return assemble_qa_dataset(rated.where("reason is null")), rejected
