"""Building test cases and scoring them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.generation import Model
from fathomline.operators.metrics import judge_cases, metric_success, score_cases, to_long
from fathomline.operators.reporting import metric_means, overall_metrics, save_summary, summary
from fathomline.operators.testcases import attach_predictions, build_goldens
from fathomline.plans.rag import Rag
from fathomline.schemas import require
from fathomline.sources.config import DEFAULT_CONFIG, select_metrics
from fathomline.storage import materialise


class EvaluationSet:
    """Goldens, predictions and test cases of a question-answer table.

    ``qa`` is ``(index, question, answer, context)``. The corpus is the one the
    ``rag`` was built with. Predictions are written once: a model call must not
    run again because a second job reads its result.
    """

    def __init__(self, rag: Rag, qa: DataFrame, store: bool = True) -> None:
        require(qa, index="bigint", question="string", answer="string", context="string")
        self.goldens = build_goldens(qa)
        predicted = rag.answer(qa.select("index", "question")).select(
            "index", "actual_output", "retrieval_context", "error"
        )
        self.predictions = materialise(predicted, "predictions") if store else predicted
        self.test_cases = attach_predictions(self.goldens, self.predictions)


class Scorer:
    """Scores of test cases for the first configured service.

    With ``judge``, or ``make_judge`` that builds one once per task, a model gives the
    verdicts of all metrics; without, shared terms do. A case and metric for which a
    judge's call failed has no score; ``failures`` tells how many there are. ``calls`` are
    options of the judge's calls (see ``replied``).
    """

    def __init__(
        self,
        test_cases: DataFrame,
        services: dict = DEFAULT_CONFIG,
        judge: Model | None = None,
        make_judge: Callable[[], Model] | None = None,
        calls: dict | None = None,
    ) -> None:
        self.thresholds, self.skipped = select_metrics(services)
        self.test_cases = test_cases
        self.judge, self.make_judge, self.calls = judge, make_judge, calls
        self._scored: DataFrame | None = None
        self._judged: DataFrame | None = None

    def calculate_scores(self) -> DataFrame:
        """``(index, metric, score, threshold, success)``. Raises if it fails."""
        names = list(self.thresholds)
        if self.judge is None and self.make_judge is None:
            scored = score_cases(self.test_cases, names)
        else:
            # written once: no call may run again because a second job reads its result
            self._judged = materialise(
                judge_cases(self.test_cases, names, self.judge, self.make_judge, calls=self.calls), "judged"
            )
            wide = self._judged.groupBy("index").agg(
                *[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in names]
            )
            scored = self.test_cases.join(wide, "index")
        self._scored = materialise(scored, "scored")
        return self.results()

    def failures(self) -> DataFrame:
        """``(metric, n_failed, error)``: cases without a score because a call failed."""
        self._require_scores()
        if self._judged is None:
            return self.results().where("false").select(
                "metric", F.lit(0).cast("long").alias("n_failed"), F.lit("").alias("error")
            )
        failed = self._judged.where("n_failed > 0")
        return failed.groupBy("metric").agg(
            F.count("*").alias("n_failed"), F.min("error").alias("error")
        )

    def _require_scores(self) -> DataFrame:
        if self._scored is None:
            raise RuntimeError("calculate the scores first")
        return self._scored

    def results(self) -> DataFrame:
        long = to_long(self._require_scores(), list(self.thresholds))
        return metric_success(long, self.thresholds)

    def metric_means(self) -> DataFrame:
        return metric_means(self.results())

    def overall_metrics(self, weights: dict[str, float] | None = None) -> DataFrame:
        return overall_metrics(self.results(), weights)

    def summary(self, save_to: str | None = None) -> DataFrame:
        result = summary(self._require_scores(), list(self.thresholds))
        if save_to is not None:
            save_summary(result, save_to)
        return result
