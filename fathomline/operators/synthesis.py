"""Making and judging question-answer sets. All model output is text to parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import lexical, parsing
from fathomline.functions import text as txt
from fathomline.functions.prompts import CLARIFICATION, TEMPLATES, placeholders, render
from fathomline.operators.cleaning import split_on
from fathomline.operators.generation import Model
from fathomline.operators.ledger import replied
from fathomline.schemas import QA_RECORD

# Fixed value: default number of records to generate.
N_GENERATIONS = 5
CRITIQUES = ("groundedness", "question_relevance", "faithfulness")


def sample_chunks(chunks: DataFrame, n: int = N_GENERATIONS, seed: str = "0") -> DataFrame:
    """``n`` chunks in a fixed pseudo-random order, the same on every run.

    Each task keeps only its own ``n`` best rows before they are merged.
    """
    key = F.md5(F.concat(F.col("chunk_index").cast("string"), F.lit(seed)))
    return chunks.orderBy(key, "chunk_index").limit(n)


def qa_prompts(chunks: DataFrame, template: str = "qa_generation", **columns: str) -> DataFrame:
    """One prompt per chunk. ``columns`` maps placeholders to columns; ``context`` and
    ``text`` are the chunk's text by default, any other placeholder needs a column."""
    known = {"context": "text", "text": "text"} | columns
    missing = [p for p in placeholders(TEMPLATES[template]) if p not in known]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    names = {p: known[p] for p in placeholders(TEMPLATES[template])}
    return chunks.withColumn(
        "prompt", render(TEMPLATES[template], {p: F.col(c) for p, c in names.items()})
    )


def parse_pairs(df: DataFrame, output: str = "output") -> DataFrame:
    """Add ``question`` and ``answer`` read from the model output."""
    parsed = parsing.parse_qa(F.col(output))
    return df.withColumn("_pair", parsed).select("*", "_pair.*").drop("_pair")


def qa_constraints(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs within the length limits, and the others with a ``reason``."""
    return split_on(pairs, parsing.qa_problem(F.col("question"), F.col("answer")))


_TERM_SETS = {"_question": "question", "_answer": "answer", "_context": "context"}


def with_term_sets(df: DataFrame) -> DataFrame:
    """Term sets of question, answer and context, computed once for all ratings."""
    return df.withColumns({n: txt.distinct_terms(F.col(c)) for n, c in _TERM_SETS.items()})


def lexical_critique(kind: str) -> Column:
    """Offline rating text for one critique, from the term sets."""
    question, answer, context = F.col("_question"), F.col("_answer"), F.col("_context")
    if kind == "groundedness":
        score = lexical.rating_of(question, context)
    elif kind == "question_relevance":
        score = lexical.rating_of(question, F.array_union(context, answer))
    elif kind == "faithfulness":
        score = lexical.rating_of(answer, context)
    elif kind == "answer_relevancy":
        score = lexical.rating_of(question, answer)
        return F.concat(
            F.lit("Evaluation: shared terms\nTotal rating: "), score.cast("string")
        )
    else:
        raise ValueError(f"unknown critique {kind!r}")
    return lexical.rating_json(score, F.lit("shared terms"))


def critique(
    df: DataFrame,
    kinds: tuple[str, ...] = CRITIQUES,
    judge: Model | None = None,
    make_judge: Callable[[], Model] | None = None,
    calls: dict | None = None,
) -> DataFrame:
    """Add ``<kind>_score``, ``<kind>_eval`` and ``<kind>_error`` for each kind.

    ``df`` has ``question, answer, context``. All ratings stay on the row of their
    pair, one model call each, so nothing moves or joins. Without a judge the
    ratings come from shared terms. ``calls`` are options of the calls (see ``replied``).
    """
    replies, modelled = {}, judge is not None or make_judge is not None
    asked = df if modelled else with_term_sets(df)
    for kind in kinds:
        if kind not in TEMPLATES:
            raise ValueError(f"unknown critique {kind!r}")
        if not modelled:
            output, error = lexical_critique(kind), F.lit(None).cast("string")
            replies[kind] = f"_{kind}_reply"
            asked = asked.withColumn(replies[kind], F.struct(output.alias("output"), error.alias("error")))
        else:
            names = placeholders(TEMPLATES[kind])
            prompt = render(TEMPLATES[kind], {p: F.col(p) for p in names})
            replies[kind] = f"_{kind}_reply"
            asked = replied(asked, replies[kind], prompt, judge, make_judge, calls)
    return rate(asked, replies).drop(*replies.values(), *_TERM_SETS)


def rate(df: DataFrame, replies: dict[str, str]) -> DataFrame:
    """Parse and validate reply columns (``struct<output, error>``)."""
    # first the parsed structs as columns, so that each reply is parsed once
    parsed = {
        f"{column}_judged": parsing.parse_judge_json(F.col(f"{column}.output"))
        for kind, column in replies.items()
        if kind != "answer_relevancy"
    }
    rated = {}
    for kind, column in replies.items():
        if kind == "answer_relevancy":
            output = F.col(f"{column}.output")
            score, reasons = parsing.plain_rating(output), parsing.plain_reasons(output)
            problem = F.when(score.isNull(), F.lit("no rating in the output"))
        else:
            reasons = F.col(f"{column}_judged.parsed.Evaluation")
            score = parsing.valid_score(reasons, F.col(f"{column}_judged.parsed.Score"))
            problem = F.coalesce(
                F.col(f"{column}_judged.error"),
                F.when(score.isNull(), F.lit("score or reasons are invalid")),
            )
        rated[f"{kind}_score"] = score
        rated[f"{kind}_eval"] = reasons
        rated[f"{kind}_error"] = F.coalesce(F.col(f"{column}.error"), problem)
    return df.withColumns(parsed).withColumns(rated).drop(*parsed)


def location_dependency(df: DataFrame, output: str = "output") -> DataFrame:
    """Read the 0/1 rating: ``location_score``, refined pair and target answer.

    For 1 the target is the fixed request for more context; for 0 it is the given
    answer and the refined fields are empty. Invalid output leaves nulls and an error.
    """
    judged = df.withColumn("_location", parsing.parse_location_json(F.col(output)))
    parsed = F.col("_location.parsed")
    score = parsing.valid_score(parsed["Evaluation"], parsed["Score"], "^[01]$")

    def for_one(value: Column, otherwise: Column) -> Column:
        return F.when(score == 1, value).when(score == 0, otherwise)

    nothing = F.lit("")
    return judged.withColumns(
        {
            "location_score": score,
            "refined_question": for_one(
                F.coalesce(parsed["Refined Question"], nothing), nothing
            ),
            "refined_answer": for_one(F.coalesce(parsed["Refined Answer"], nothing), nothing),
            "location_dependency_evaluator_target_answer": for_one(
                F.lit(CLARIFICATION), F.col("answer")
            ),
            "location_error": F.coalesce(
                F.col("_location.error"),
                F.when(score.isNull(), F.lit("score or reasons are invalid")),
            ),
        }
    ).drop("_location")


def rating_problem(kinds: tuple[str, ...] = CRITIQUES) -> Column:
    """The first rating of a row that failed or is invalid, as ``kind: error``; else null."""
    errors = [F.concat(F.lit(f"{kind}: "), F.col(f"{kind}_error")) for kind in kinds]
    return F.coalesce(*errors, F.concat(F.lit("location: "), F.col("location_error")))


def assemble_qa_dataset(rated: DataFrame) -> DataFrame:
    """The documented eleven columns. All ratings travel on the row of their pair,
    so nothing is joined."""
    names = {
        "question_relevancy_score": "question_relevance_score",
        "question_relevancy_eval": "question_relevance_eval",
    }
    return rated.select(
        *[F.col(names.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in QA_RECORD.fields]
    )
