"""Per-case metrics from shared terms, or from a judge's verdicts.

The formulas are statement ratios and average precision. Every metric of a case
is a column of its row; the long form is an unpivot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import lexical, parsing
from fathomline.functions import text as txt
from fathomline.functions.prompts import TEMPLATES, render
from fathomline.operators.generation import Model
from fathomline.operators.ledger import replied
from fathomline.operators.retrieval import build_context


def statements(text: Column) -> Column:
    return txt.sentences(txt.clean(text))


def _ratio(items: Column, holds) -> Column:
    """Share of items for which ``holds``; 0 without items."""
    return txt.bind(
        items,
        lambda found: F.when(F.size(found) == 0, F.lit(0.0)).otherwise(
            F.size(F.filter(found, holds)) / F.size(found)
        ),
    )


def answer_relevancy(question: Column, output: Column) -> Column:
    """Share of answer statements that have a term in common with the question."""
    return txt.bind(
        txt.distinct_terms(question),
        lambda asked: _ratio(
            statements(output), lambda s: F.arrays_overlap(txt.terms(s), asked)
        ),
    )


def faithfulness(output: Column, retrieved: Column, support: float = lexical.SUPPORT) -> Column:
    """Share of answer statements whose terms are mostly in the retrieved context."""
    return txt.bind(
        txt.distinct_terms(build_context(retrieved)),
        lambda known: _ratio(
            statements(output),
            lambda s: lexical.containment_of(txt.distinct_terms(s), known) >= support,
        ),
    )


def contextual_recall(
    expected: Column, retrieved: Column, support: float = lexical.SUPPORT
) -> Column:
    """Share of expected statements that some retrieved text supports."""
    return txt.bind(
        F.transform(retrieved, txt.distinct_terms),
        lambda known: _ratio(
            F.transform(statements(expected), txt.distinct_terms),
            lambda s: F.exists(known, lambda c: lexical.containment_of(s, c) >= support),
        ),
    )


def relevant_ranks(expected: Column, retrieved: Column, support: float = lexical.SUPPORT) -> Column:
    """For each retrieved text, whether it holds most terms of the expected output."""
    return txt.bind(
        txt.distinct_terms(expected),
        lambda wanted: F.transform(
            retrieved, lambda c: lexical.containment_of(wanted, txt.distinct_terms(c)) >= support
        ),
    )


def average_precision(verdicts: Column) -> Column:
    """Mean precision at the ranks with a true verdict; 0 without one."""
    start = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("hits"), F.lit(0.0).alias("total"))

    def step(state: Column, verdict: Column) -> Column:
        rank, hits = state["rank"] + 1, state["hits"] + verdict.cast("int")
        gained = F.when(verdict, hits / rank).otherwise(F.lit(0.0))
        return F.struct(
            rank.alias("rank"), hits.alias("hits"), (state["total"] + gained).alias("total")
        )

    def finish(state: Column) -> Column:
        return F.when(state["hits"] == 0, F.lit(0.0)).otherwise(state["total"] / state["hits"])

    return F.aggregate(verdicts, start, step, finish)


def contextual_precision(
    expected: Column, retrieved: Column, support: float = lexical.SUPPORT
) -> Column:
    """Average precision of the retrieved ranks."""
    return average_precision(relevant_ranks(expected, retrieved, support))


METRICS = {
    "Answer Relevancy": lambda: answer_relevancy(F.col("input"), F.col("actual_output")),
    "Faithfulness": lambda: faithfulness(F.col("actual_output"), F.col("retrieval_context")),
    "Contextual Recall": lambda: contextual_recall(
        F.col("expected_output"), F.col("retrieval_context")
    ),
    "Contextual Precision": lambda: contextual_precision(
        F.col("expected_output"), F.col("retrieval_context")
    ),
}


def score_cases(test_cases: DataFrame, metrics: list[str]) -> DataFrame:
    """Add one score column per metric."""
    if not metrics:
        raise ValueError("no metric is selected")
    return test_cases.withColumns({name: F.round(METRICS[name](), 6) for name in metrics})


def evaluate(test_cases: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``(index, metric, score, threshold, success)``: every case, every metric."""
    names = list(thresholds)
    scored = score_cases(test_cases, names)
    return metric_success(to_long(scored, names), thresholds)


def to_long(scored: DataFrame, metrics: list[str]) -> DataFrame:
    return scored.select("index", *[f"`{m}`" for m in metrics]).unpivot(
        "index", metrics, "metric", "score"
    )


def metric_success(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Add the threshold of each metric and whether the score reaches it."""
    lookup = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    return scores.withColumn("threshold", lookup[F.col("metric")]).withColumn(
        "success", F.col("score") >= F.col("threshold")
    )


def judge_verdicts(
    test_cases: DataFrame,
    judge: Model | None = None,
    statement_of: str = "actual_output",
    evidence: Column | None = None,
    positive: str = "yes",
    make_judge: Callable[[], Model] | None = None,
    calls: dict | None = None,
) -> DataFrame:
    """``(index, score, n_statements, n_failed, error)``: share of statements a judge
    model supports.

    One row per case and statement goes to the judge. A call that fails and a reply
    that cannot be read are failures: the score is then null and ``error`` tells the
    first one. Cases without statements score 0.
    """
    known = build_context(F.col("retrieval_context")) if evidence is None else evidence
    asked = test_cases.select(
        "index",
        known.alias("_evidence"),
        F.explode_outer(statements(F.col(statement_of))).alias("_statement"),
    )
    prompt = render(
        TEMPLATES["judge_support"],
        {"statement": F.col("_statement"), "evidence": F.col("_evidence")},
    )
    # no statement, no call
    sent = F.when(F.col("_statement").isNotNull(), prompt)
    written = asked.select("index", "_statement", sent.alias("prompt"))
    told = replied(written, "_reply", F.col("prompt"), judge, make_judge, calls)
    told = told.select("index", "_statement", "_reply.output", "_reply.error")
    heard = told.select("index", "_statement", verdict_of(positive).alias("v"))
    stated = F.col("_statement").isNotNull()
    failed = F.count_if(stated & F.col("v.error").isNotNull())
    share = F.avg((stated & F.coalesce(F.col("v.holds"), F.lit(False))).cast("double"))
    return heard.groupBy("index").agg(
        F.when(failed == 0, F.round(share, 6)).alias("score"),
        F.count("_statement").alias("n_statements"),
        failed.alias("n_failed"),
        F.min(F.when(stated, F.col("v.error"))).alias("error"),
    )


def verdict_of(positive: str = "yes") -> Column:
    """``struct<holds, error>`` from the columns ``output`` and ``error`` of a judge call."""
    told = parsing.parse_judge_json(F.col("output"), "struct<verdict:string,reason:string>")

    def read(judged: Column) -> Column:
        verdict = judged["parsed"]["verdict"]
        problem = F.coalesce(
            F.col("error"), judged["error"], F.when(verdict.isNull(), F.lit("no verdict in the output"))
        )
        return F.struct(
            F.when(problem.isNull(), F.lower(verdict) == positive).alias("holds"), problem.alias("error")
        )

    return txt.bind(told, read)


_ASKED = "array<struct<metric:string,position:int,statement:string,evidence:string>>"
#: what the judge is asked for a metric
_TASKS = {
    "Answer Relevancy": "judge_relevance",
    "Faithfulness": "judge_support",
    "Contextual Recall": "judge_support",
    "Contextual Precision": "judge_usefulness",
}


def _judge_prompt(metric: Column, question: Column, statement: Column, evidence: Column) -> Column:
    """The prompt of the metric's own task."""
    values = {"question": question, "statement": statement, "evidence": evidence}
    prompt = F.lit(None).cast("string")
    for task in dict.fromkeys(_TASKS.values()):
        metrics = [m for m, t in _TASKS.items() if t == task]
        prompt = F.when(metric.isin(metrics), render(TEMPLATES[task], values)).otherwise(prompt)
    return prompt


def _asked(metrics: list[str]) -> Column:
    """What a judge is asked about a case: statements with their evidence, and for
    contextual precision every retrieved text in rank order."""
    known = build_context(F.col("retrieval_context"))

    def each(metric: str, items: Column, ask) -> Column:
        return F.transform(
            items,
            lambda x, i: F.struct(F.lit(metric).alias("metric"), i.alias("position"), *ask(x)),
        ).cast(_ASKED)

    def of_statements(metric: str, text: str, evidence: Column) -> Column:
        return each(
            metric,
            statements(F.col(text)),
            lambda s: (s.alias("statement"), evidence.alias("evidence")),
        )

    kinds = {
        "Answer Relevancy": lambda m: of_statements(m, "actual_output", F.lit("")),
        "Faithfulness": lambda m: of_statements(m, "actual_output", known),
        "Contextual Recall": lambda m: of_statements(m, "expected_output", known),
        "Contextual Precision": lambda m: each(
            m,
            F.col("retrieval_context"),
            lambda r: (F.col("expected_output").alias("statement"), r.alias("evidence")),
        ),
    }
    return F.concat(*[F.coalesce(kinds[m](m), F.array().cast(_ASKED)) for m in metrics])


def judge_cases(
    test_cases: DataFrame,
    metrics: list[str],
    judge: Model | None = None,
    make_judge: Callable[[], Model] | None = None,
    positive: str = "yes",
    calls: dict | None = None,
) -> DataFrame:
    """``(index, metric, score, n_calls, n_failed, error)`` from a judge's verdicts.

    One call per case, metric and statement or rank, with a prompt of the metric's own: does
    a statement of the answer help to answer the question, does the retrieved text support
    a statement, is a retrieved text of use for the expected answer. Contextual precision
    is the average precision of the verdicts on the ranks, the others are shares of
    statements with a positive verdict; nothing to judge scores 0. A failed call or an unreadable reply makes
    the score of its case and metric null and leaves the error there.
    """
    if not metrics:
        raise ValueError("no metric is selected")
    asked = test_cases.select("index", F.col("input").alias("question"), F.explode(_asked(metrics)).alias("a"))
    asked = asked.select("index", "question", "a.*")
    prompt = _judge_prompt(F.col("metric"), F.col("question"), F.col("statement"), F.col("evidence"))
    sent = asked.select("index", "metric", "position", prompt.alias("prompt"))
    told = replied(sent, "_reply", F.col("prompt"), judge, make_judge, calls)
    told = told.select("index", "metric", "position", "_reply.output", "_reply.error")
    heard = told.select("index", "metric", "position", verdict_of(positive).alias("v"))
    ranks = F.array_sort(F.collect_list(F.struct("position", "v.holds")))
    failed = F.count_if(F.col("v.error").isNotNull())
    # a case has as many rows as its texts have statements
    found = heard.groupBy("index", "metric").agg(
        ranks.alias("_ranks"),
        F.avg(F.col("v.holds").cast("double")).alias("_share"),
        F.count("*").alias("n_calls"),
        failed.alias("n_failed"),
        F.min("v.error").alias("error"),
    )
    precision = average_precision(F.transform("_ranks", lambda r: F.coalesce(r["holds"], F.lit(False))))
    score = F.when(F.col("metric") == "Contextual Precision", precision).otherwise(F.col("_share"))
    every = test_cases.select("index", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    nothing = F.lit(0).cast("long")
    return every.join(found, ["index", "metric"], "left").select(
        "index",
        "metric",
        F.when(F.col("n_calls").isNull(), 0.0).when(F.col("n_failed") == 0, F.round(score, 6)).alias("score"),
        F.coalesce("n_calls", nothing).alias("n_calls"),
        F.coalesce("n_failed", nothing).alias("n_failed"),
        "error",
    )
