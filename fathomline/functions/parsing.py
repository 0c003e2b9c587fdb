"""Parsing of model output: question-answer pairs, JSON ratings, plain ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.text import bind
from fathomline.schemas import LOCATION_RATING, RATING

# The output formats the prompts ask for, and the limits on pairs.
PAIR = r"(?s)Factoid question:\s*(.*?)\s*Answer:\s*(.*?)\s*\z"
PLAIN_RATING = r"Total rating:\s*([1-5])"
PLAIN_REASONS = r"(?s)Evaluation:\s*(.*?)\s*Total rating:"
JSON_OBJECT = r"(?s)\{.*\}"
MAX_QUESTION = 300
MAX_ANSWER = 300
INVALID_JSON = "Invalid JSON from model"


def parse_qa(output: Column) -> Column:
    """``struct<question, answer>``; both null when the format is not there."""
    found = output.rlike(PAIR)
    part = lambda group: F.when(found, F.trim(F.regexp_extract(output, PAIR, group)))
    return F.struct(part(1).alias("question"), part(2).alias("answer"))


def qa_problem(question: Column, answer: Column) -> Column:
    """Why a pair is rejected, or null."""
    return (
        F.when(question.isNull() | answer.isNull(), F.lit("no pair in the output"))
        .when((question == "") | (answer == ""), F.lit("empty question or answer"))
        .when(F.length(question) > MAX_QUESTION, F.lit("question too long"))
        .when(F.length(answer) > MAX_ANSWER, F.lit("answer too long"))
    )


def parse_judge_json(output: Column, schema: str = RATING) -> Column:
    """``struct<parsed, error, raw_output>`` from free text around a JSON object.

    The widest ``{...}`` is parsed. Text without valid JSON keeps the raw output
    next to an error message and a null ``parsed``.
    """
    text = F.coalesce(output, F.lit(""))

    def judged(candidate: Column) -> Column:
        valid = (candidate != "") & F.try_parse_json(candidate).isNotNull()
        return F.struct(
            F.when(valid, F.from_json(candidate, schema)).alias("parsed"),
            F.when(~valid, F.lit(INVALID_JSON)).alias("error"),
            F.when(~valid, text).alias("raw_output"),
        )

    return bind(F.regexp_extract(text, JSON_OBJECT, 0), judged)


def parse_location_json(output: Column) -> Column:
    return parse_judge_json(output, LOCATION_RATING)


def valid_score(reasons: Column, score: Column, pattern: str = "^[1-5]$") -> Column:
    """The score as a number if it is in range and reasons are given, else null."""
    return F.when(reasons.isNotNull() & score.rlike(pattern), score.cast("int"))


def plain_rating(output: Column) -> Column:
    """Score of an ``Evaluation: ... Total rating: n`` text, or null."""
    return F.when(
        output.rlike(PLAIN_RATING), F.regexp_extract(output, PLAIN_RATING, 1).cast("int")
    )


def plain_reasons(output: Column) -> Column:
    return F.when(output.rlike(PLAIN_REASONS), F.regexp_extract(output, PLAIN_REASONS, 1))
