"""Metric configuration, passed in as a plain dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The default metric thresholds, weights and report names.
DEFAULT_CONFIG = {
    "default": {
        "metrics": {
            "AnswerRelevancyMetric": {"threshold": 0.5},
            "FaithfulnessMetric": {"threshold": 0.7},
            "ContextualRecallMetric": {"threshold": 0.7},
            "ContextualRelevanceMetric": {"threshold": 0.7},
            "ContextualPrecisionMetric": {"threshold": 0.7},
        }
    }
}
DEFAULT_WEIGHTS = {
    "Answer Relevancy": 0.20,
    "Faithfulness": 0.30,
    "Contextual Recall": 0.25,
    "Contextual Precision": 0.25,
}
METRIC_NAMES = {
    "AnswerRelevancyMetric": "Answer Relevancy",
    "FaithfulnessMetric": "Faithfulness",
    "ContextualRecallMetric": "Contextual Recall",
    "ContextualPrecisionMetric": "Contextual Precision",
}
FALLBACK_THRESHOLD = 0.5


def select_metrics(services: dict) -> tuple[dict[str, float], list[str]]:
    """Thresholds of the known metrics of the first service, and what is skipped:
    names of unknown metrics, and ``metric.parameter`` for all but the threshold."""
    if not services:
        raise ValueError("no output service is configured")
    configured = next(iter(services.values()))["metrics"]
    chosen = {
        METRIC_NAMES[name]: float((params or {}).get("threshold", FALLBACK_THRESHOLD))
        for name, params in configured.items()
        if name in METRIC_NAMES
    }
    skipped = [name for name in configured if name not in METRIC_NAMES]
    for name in chosen_names(configured):
        skipped += [f"{name}.{p}" for p in (configured[name] or {}) if p != "threshold"]
    return chosen, skipped


def chosen_names(configured: dict) -> list[str]:
    return [name for name in configured if name in METRIC_NAMES]


def metric_config(spark: SparkSession, services: dict = DEFAULT_CONFIG) -> DataFrame:
    """``(metric, threshold)``: a handful of rows."""
    chosen, _ = select_metrics(services)
    return spark.createDataFrame(list(chosen.items()), "metric string, threshold double")
