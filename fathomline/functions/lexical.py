"""Offline stand-ins for a model: answers, ratings and verdicts from shared terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions import text as txt
from fathomline.functions.parsing import MAX_ANSWER

# Fixed value: share of terms from which a statement counts as supported.
SUPPORT = 0.5


def containment_of(terms: Column, other_terms: Column) -> Column:
    """Share of the first term set found in the second; 0 if the first is empty."""
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(terms, other_terms)) / F.size(terms)
    )


def extractive_answer(question: Column, context: Column) -> Column:
    """The context sentence sharing most distinct terms with the question.

    The first of equals wins, and an empty context gives an empty answer.
    """

    def scored(asked: Column) -> Column:
        return F.transform(
            txt.sentences(txt.clean(context)),
            lambda sentence, at: F.struct(
                F.size(F.array_intersect(asked, txt.distinct_terms(sentence))).alias("shared"),
                (-at).alias("before"),
                sentence.alias("sentence"),
            ),
        )

    best = txt.bind(txt.distinct_terms(question), lambda asked: F.array_max(scored(asked)))
    return F.coalesce(best["sentence"], F.lit(""))


def longest_sentence(text: Column, fits: int) -> Column:
    """The sentence with most tokens of those with at most ``fits`` characters; the
    first of equals. If none fits, the one with most tokens, whole."""
    sized = F.transform(
        txt.sentences(text),
        lambda s, at: F.struct(
            (F.length(s) <= fits).alias("fits"),
            txt.count_tokens(s).alias("tokens"),
            (-at).alias("before"),
            s.alias("sentence"),
        ),
    )
    return F.coalesce(F.array_max(sized)["sentence"], F.lit(""))


def longest_term(text: Column) -> Column:
    """The longest term; the alphabetically first of equals."""
    ranked = F.transform(
        txt.distinct_terms(text), lambda t: F.struct((-F.length(t)).alias("shorter"), t.alias("t"))
    )
    return F.coalesce(F.array_min(ranked)["t"], F.lit(""))


def drafted_pair(text: Column) -> Column:
    """A question-answer pair in the agreed output format, taken from the text."""

    def written(sentence: Column) -> Column:
        return F.concat(
            F.lit("Factoid question: What does the text say about "),
            longest_term(sentence),
            F.lit("?\nAnswer: "),
            sentence,
        )

    return txt.bind(longest_sentence(text, MAX_ANSWER), written)


def rating_of(terms: Column, other_terms: Column) -> Column:
    """1 to 5 from the share of the first term set that the second also has."""
    return (F.floor(containment_of(terms, other_terms) * 4 + 0.5) + 1).cast("int")


def rating_json(score: Column, reasons: Column) -> Column:
    return F.to_json(
        F.struct(reasons.alias("Evaluation"), score.cast("string").alias("Score"))
    )
