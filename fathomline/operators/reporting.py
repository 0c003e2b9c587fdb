"""Means over cases, weighted overall scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.sources.config import DEFAULT_WEIGHTS
from fathomline.sources.records import write_json

# Report names.
AVERAGE = "Average Performance"
WEIGHTED = "Weighted Average Performance"


def metric_means(scores: DataFrame) -> DataFrame:
    """Mean score per metric, from ``(index, metric, score, ...)``."""
    return scores.groupBy("metric").agg(F.round(F.avg("score"), 6).alias("value"))


def normalise_weights(weights: dict[str, float]) -> dict[str, float]:
    """Divide by the sum when it is positive."""
    if AVERAGE in weights or WEIGHTED in weights:
        raise ValueError("averages cannot be weighted")
    total = sum(weights.values())
    return {name: w / total for name, w in weights.items()} if total > 0 else dict(weights)


def _weight(weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(None).cast("double")
    pairs = [F.lit(x) for name, w in weights.items() for x in (name, float(w))]
    return F.create_map(*pairs)[F.col("metric")]


def overall_metrics(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(metric, value)``: the means, their plain mean and their weighted mean.

    Metrics without a weight stay out of the weighted mean, and weights that do
    not add up to something positive give the plain mean. The second aggregation
    sees one row per metric.
    """
    shares = normalise_weights(DEFAULT_WEIGHTS if weights is None else weights)
    means = scores.groupBy("metric").agg(F.avg("score").alias("value"))
    weight = F.when(F.col("value").isNotNull(), _weight(shares))
    plain = F.avg("value")
    weighted = F.when(
        F.sum(weight) > 0, F.sum(F.col("value") * weight) / F.sum(weight)
    ).otherwise(plain)
    row = lambda name, value: F.struct(name.alias("metric"), value.alias("value"))
    totals = means.agg(
        F.count("*").alias("_n"),
        F.collect_list(row(F.col("metric"), F.col("value"))).alias("_means"),
        plain.alias("_plain"),
        weighted.alias("_weighted"),
    )
    guarded = F.when(F.col("_n") > 0, F.col("_means")).otherwise(
        F.raise_error(F.lit("there are no results to aggregate"))
    )
    every = F.concat(
        guarded,
        F.array(row(F.lit(AVERAGE), F.col("_plain")), row(F.lit(WEIGHTED), F.col("_weighted"))),
    )
    return totals.select(F.inline(every)).withColumn("value", F.round("value", 6))


def summary(scored_cases: DataFrame, metrics: list[str]) -> DataFrame:
    """One record per case with its scores as a map.

    The scores are already columns of the case, so no grouping is needed.
    """
    entries = [x for m in metrics for x in (F.lit(m), F.col(f"`{m}`"))]
    return scored_cases.select(
        "index",
        F.col("input").alias("query"),
        "actual_output",
        "expected_output",
        F.col("context").alias("actual_context"),
        "retrieval_context",
        F.create_map(*entries).alias("metrics"),
    )


def save_summary(summaries: DataFrame, path: str) -> None:
    write_json(summaries, path)
