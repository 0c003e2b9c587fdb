from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomline.operators import metrics
from fathomline.operators.ledger import Ledger
from fathomline.operators.reporting import metric_means, normalise_weights, overall_metrics
from fathomline.operators.testcases import attach_predictions, build_goldens, qa_from_turns, qa_history, zip_align
from fathomline.plans.evaluation import EvaluationSet, Scorer
from fathomline.plans.rag import DenseRag, Rag, TfIdfRag


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list)
                                 else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_answer_relevancy(spark):
    score = metrics.answer_relevancy(F.col("q"), F.col("o"))
    assert one(spark, score, q="the cat", o="A cat. A dog.") == 0.5
    assert one(spark, score, q="the cat", o="") == 0.0


def test_faithfulness(spark):
    score = metrics.faithfulness(F.col("o"), F.col("r"))
    assert one(spark, score, o="Cats sit. Dogs fly high.", r=["cats", "sit dogs"]) == 0.5
    assert one(spark, score, o="Cats sit.", r=[]) == 0.0


def test_contextual_recall(spark):
    score = metrics.contextual_recall(F.col("e"), F.col("r"))
    assert one(spark, score, e="Cats sit. Dogs fly high.", r=["cats sit", "zz"]) == 0.5
    # two contexts with a third of the terms each do not add up
    assert one(spark, score, e="one two three", r=["one", "two"]) == 0.0


@pytest.mark.parametrize("verdicts,expected", [
    ([True, True, True], 1.0), ([False, False, True], 1 / 3), ([True, False, True], (1 + 2 / 3) / 2), ([False], 0.0), ([], 0.0),
])
def test_average_precision(spark, verdicts, expected):
    df = spark.createDataFrame([(verdicts,)], "v array<boolean>")
    assert df.select(metrics.average_precision(F.col("v"))).first()[0] == pytest.approx(expected)


def test_contextual_precision(spark):
    score = metrics.contextual_precision(F.col("e"), F.col("r"))
    assert one(spark, score, e="cats sit", r=["zz", "yy", "cats"]) == pytest.approx(1 / 3)


SCORES = [(i, m, s, 0.5, s >= 0.5) for i, pair in enumerate([(1.0, 0.4), (0.5, 0.0)])
          for m, s in zip(("Answer Relevancy", "Faithfulness"), pair)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(SCORES, "index long, metric string, score double, threshold double, success boolean")


def as_dict(df):
    return {r.metric: r.value for r in df.collect()}


def test_overall(scores):
    assert as_dict(metric_means(scores)) == {"Answer Relevancy": 0.75, "Faithfulness": 0.2}
    found = as_dict(overall_metrics(scores))
    assert found["Average Performance"] == 0.475
    assert found["Weighted Average Performance"] == pytest.approx((0.75 * 0.2 + 0.2 * 0.3) / 0.5)
    scaled = as_dict(overall_metrics(scores, {"Answer Relevancy": 2, "Faithfulness": 3, "Absent": 9}))
    assert scaled == found
    assert as_dict(overall_metrics(scores, {"Answer Relevancy": 0}))["Weighted Average Performance"] == 0.475
    assert as_dict(overall_metrics(scores, {}))["Weighted Average Performance"] == 0.475


def test_weights():
    assert normalise_weights({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75}
    assert normalise_weights({"a": 0}) == {"a": 0}
    with pytest.raises(ValueError):
        normalise_weights({"Average Performance": 1})


def test_no_results_is_an_error(scores):
    with pytest.raises(Exception, match="no results"):
        overall_metrics(scores.where("false")).collect()


def test_zip_truncates(spark):
    a = spark.range(3).select(F.col("id").alias("index"), F.lit("q").alias("q"))
    b = spark.range(2).select(F.col("id").alias("index"), F.lit("a").alias("a"))
    assert zip_align(a, b).count() == 2


def test_missing_predictions_are_empty(spark):
    qa = spark.createDataFrame([(0, "q", "a", "c"), (1, "q", "a", "c")], "index long, question string, answer string, context string")
    predictions = spark.createDataFrame([(0, "out", ["r"])], "index long, actual_output string, retrieval_context array<string>")
    rows = attach_predictions(build_goldens(qa), predictions).orderBy("index").collect()
    assert [(r.actual_output, r.retrieval_context, r.context) for r in rows] == [("out", ["r"], ["c"]), ("", [], ["c"])]


def turns(spark):
    """One conversation holds most turns; others are short, with gaps in numbering."""
    rows = [(1, 3 * t, ("user", "assistant", "user", "system")[t % 4], f"t{t}") for t in range(400)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"c{c}t{t}") for c in range(2, 40) for t in range(c % 4 + 1)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), rows


@pytest.mark.parametrize("block_size", [4, 50, 65536])
def test_pairs_and_history_do_not_depend_on_blocks(spark, block_size):
    df, rows = turns(spark)
    ordered = sorted(rows)
    expected = [
        (a[0], a[1], a[3], b[3]) for a, b in zip(ordered, ordered[1:])
        if a[0] == b[0] and a[2] == "user" and b[2] == "assistant"
    ]
    pairs = qa_from_turns(df, block_size=block_size)
    assert sorted(map(tuple, pairs.collect())) == expected
    history = qa_history(pairs, n=3, block_size=block_size)
    found = {(r.conv_id, r.turn): r.history for r in history.collect()}
    for i, (conv, turn, _, _) in enumerate(expected):
        before = [e for e in expected[:i] if e[0] == conv][-3:]
        assert found[conv, turn] == "\n".join(f"Q: {e[2]}\nA: {e[3]}" for e in before)
    assert len(found) == len(expected)


class Fixed(Rag):
    """A custom strategy: the same text for everyone, and a model that fails once."""

    def retrieve(self, questions):
        return questions.select("index", F.lit(1).alias("rank"), F.lit("Fixed text.").alias("text"))


@pytest.fixture(scope="module")
def qa(spark):
    return spark.createDataFrame(
        [(0, "what cats do", "Cats sit.", "Cats sit."), (1, "what dogs do", "Dogs fly.", "Dogs fly.")],
        "index long, question string, answer string, context string",
    )


def test_custom_rag_and_failures(spark, qa):
    def model(prompts):
        if any("dogs" in p for p in prompts):
            raise RuntimeError("down")
        return ["Fixed text."] * len(prompts)

    cases = EvaluationSet(Fixed(model), qa).test_cases.orderBy("index").collect()
    assert [(c.actual_output, c.retrieval_context) for c in cases] == [("Fixed text.", ["Fixed text."]), ("", [])]
    assert cases[1].error == "RuntimeError: down"
    with pytest.raises(TypeError):
        Fixed().answer(qa.select(F.col("index").cast("string").alias("index"), "question"))


def test_scorer_end_to_end(spark, qa, tmp_path):
    chunks = spark.createDataFrame([(0, "Cats sit."), (1, "Dogs fly."), (2, "Birds sing.")], "chunk_index long, text string")
    for rag in (TfIdfRag(chunks, k=1), DenseRag(chunks, k=1), DenseRag(chunks, k=1, approximate={"cells": 2})):
        scorer = Scorer(EvaluationSet(rag, qa).test_cases)
        with pytest.raises(RuntimeError):
            scorer.overall_metrics()
        results = scorer.calculate_scores()
        assert results.count() == 8 and results.where("success").count() == 8
        assert as_dict(scorer.overall_metrics())["Weighted Average Performance"] == 1.0
    path = str(tmp_path / "summary")
    first = scorer.summary(save_to=path).where("index = 0").first()
    assert first.metrics == {m: 1.0 for m in scorer.thresholds}
    saved = spark.read.json(path)
    assert saved.count() == 2 and saved.where("index = 1").first()["metrics"]["Faithfulness"] == 1.0


def test_judge_verdicts(spark):
    cases = spark.createDataFrame(
        [(0, "Good one. Bad one.", ["ctx"]), (1, "", ["ctx"]), (2, "Odd.", ["ctx"])],
        "index long, actual_output string, retrieval_context array<string>",
    )

    def judge(prompts):
        assert all("Evidence: ctx" in p for p in prompts)
        return ["what?" if "Odd" in p else '{"verdict": "%s"}' % ("Yes" if "Good" in p else "no") for p in prompts]

    rows = {r["index"]: tuple(r)[1:] for r in metrics.judge_verdicts(cases, judge).collect()}
    unread = "Invalid JSON from model"
    assert rows == {0: (0.5, 2, 0, None), 1: (0.0, 0, 0, None), 2: (None, 1, 1, unread)}

    def down(prompts):
        raise OSError("down")

    failed = metrics.judge_verdicts(cases, make_judge=lambda: down).where("n_statements > 0").collect()
    assert [(r.score, r.error) for r in failed] == [(None, "OSError: down")] * 2


def test_each_metric_has_its_own_task(spark):
    cases = spark.createDataFrame(
        [(0, "Who sits?", "Cats sit. It rains.", "Cats sit.", ["Cats sit.", "Fog."])],
        "index long, input string, actual_output string, expected_output string, retrieval_context array<string>",
    )

    def judge(prompts):
        replies = []
        for p in prompts:
            task = p.split("\n")[0]
            if "help to answer" in task:
                assert "Question: Who sits?\nStatement: " in p and "Fog" not in p
                holds = "Statement: Cats" in p
            elif "support" in task:
                assert "Evidence: Cats sit. Fog." in p and "Who sits?" not in p
                holds = "Statement: Cats" in p
            else:
                assert "expected answer" in task and "Question: Who sits?\nExpected answer: Cats sit.\n" in p
                holds = "Passage: Cats" in p
            replies.append('{"verdict": "%s"}' % ("yes" if holds else "no"))
        return replies

    names = ["Answer Relevancy", "Faithfulness", "Contextual Recall", "Contextual Precision"]
    rows = {r.metric: (r.score, r.n_calls, r.error) for r in metrics.judge_cases(cases, names, judge).collect()}
    assert rows == {
        "Answer Relevancy": (0.5, 2, None),
        "Faithfulness": (0.5, 2, None),
        "Contextual Recall": (1.0, 1, None),
        "Contextual Precision": (1.0, 2, None),
    }


def test_restarted_scorer_asks_nothing_again(spark, qa, tmp_path):
    chunks = spark.createDataFrame([(0, "Cats sit."), (1, "Dogs fly.")], "chunk_index long, text string")
    cases = EvaluationSet(TfIdfRag(chunks, k=1), qa).test_cases
    kept = {"ledger": Ledger(spark, str(tmp_path / "calls")), "in_flight": 2}
    first = Scorer(cases, judge=lambda ps: ['{"verdict": "yes"}'] * len(ps), calls=kept)
    first.calculate_scores()

    def gone(prompts):
        raise AssertionError("asked again")

    again = Scorer(cases, judge=gone, calls=kept)
    assert as_dict(again.calculate_scores().groupBy("metric").agg(F.avg("score").alias("value"))) == as_dict(first.metric_means())
    assert again.failures().count() == 0
