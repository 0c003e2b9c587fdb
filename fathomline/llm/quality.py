"""Text quality by naive Bayes support vectors.

Features are indicators of hashed n-grams: words (runs of non-space), word pairs and
byte trigrams. Each is scaled by the log ratio of its smoothed counts in the two
classes; a linear hinge-loss model is then fitted by dual coordinate descent, and its
margins are turned into probabilities by a logistic fit on folds it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import features as ft
from fathomline.llm.samples import agreed_labels, binary_views, bounded, fold
from fathomline.llm.words import text_chunks

BITS = 19
PER_LABEL = 2500
SMOOTHING = 1.0
COST = 1.0
ROUNDS = 12
FOLDS = 3


@dataclass
class Model:
    """Scaled weights, squared log ratios, the bias, and the logistic slope and shift."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float


def indicators(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each row, and the row bounds."""
    starts, ends, rows = ft.word_spans(chunk)
    words = ft.span_hashes(chunk.data, starts, ends)
    pairs, pair_rows = ft.gram_hashes(words, rows, 2)
    bytes3, byte_rows = ft.byte_grams(chunk, 3)
    values = np.concatenate([ft.bucket(h, BITS) for h in (words, pairs, bytes3)])
    return ft.distinct_per_row(values, np.concatenate([rows, pair_rows, byte_rows]), chunk.rows)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            values, bounds = indicators(chunk)
            values = values.astype(np.int32)
            packed = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(chunk.first, chunk.rows),
                    batch.column("label").slice(chunk.first, chunk.rows),
                    pa.array(packed, pa.binary()),
                ],
                ["doc_id", "label", "buckets"],
            )


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, seed: int = 11) -> Model:
    """Fit on the documents with an agreed ``quality`` label whose fold is not 0.

    The sample has about ``per_label`` documents of each label at most, which bounds the
    bucket numbers sent to the driver. If one label is missing, every score is the share
    of label 1 among the sample, or 0.5 without any.
    """
    known = agreed_labels(labels, "quality").where(fold(5) != 0)
    # about 2 * per_label rows of two numbers
    sample = F.broadcast(bounded(known, per_label))
    rows = (
        docs.select("doc_id", "text")
        .join(sample, "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(_examples, "doc_id long, label int, buckets binary")
        .toArrow()
    )
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    truth = np.where(rows.column("label").to_numpy()[order] > 0, 1.0, -1.0)
    packed = binary_views(rows.column("buckets"))
    examples = [packed[i] for i in order]
    if len(set(truth)) < 2:
        share = float((truth > 0).mean()) if len(truth) else 0.5
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        nothing = np.zeros(1 << BITS, np.float32)
        return Model(nothing, nothing, 0.0, 0.0, float(odds))
    random = np.random.default_rng(seed)
    part = random.integers(0, FOLDS, len(examples))
    margins = np.zeros(len(examples))
    for k in range(FOLDS):
        seen, unseen = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(truth[seen])) < 2:
            continue
        fitted = _fit([examples[i] for i in seen], truth[seen], random)
        margins[unseen] = [_margin(fitted, examples[i]) for i in unseen]
    slope, shift = _logistic_fit(margins, truth)
    weights, squares, bias = _fit(examples, truth, random)
    return Model(weights.astype(np.float32), squares.astype(np.float32), bias, slope, shift)


def _fit(examples, truth: np.ndarray, random) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights with the ratios multiplied in, squared ratios, and the bias."""
    ratios = _log_ratios(examples, truth)
    weights, bias = _dual_descent(examples, ratios, truth, random)
    return weights * ratios, ratios * ratios, bias


def _margin(fitted, example: np.ndarray) -> float:
    weights, squares, bias = fitted
    return weights[example].sum() / max(np.sqrt(squares[example].sum()), 1e-9) + bias


def _log_ratios(examples, truth: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's share among the classes' smoothed indicator counts."""
    sides = []
    for sign in (1.0, -1.0):
        own = [e for e, y in zip(examples, truth) if y == sign]
        counts = np.bincount(np.concatenate(own), minlength=1 << BITS) + SMOOTHING
        sides.append(np.log(counts / counts.sum()))
    return sides[0] - sides[1]


def _dual_descent(examples, scale: np.ndarray, truth: np.ndarray, random) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over scaled indicators, one dual variable after another.

    Rows are brought to unit length; the bias is one more feature of value 1.
    """
    values = [scale[e] for e in examples]
    values = [v / max(np.sqrt((v * v).sum()), 1e-9) for v in values]
    norms = np.array([(v * v).sum() + 1.0 for v in values])
    weights, bias = np.zeros(len(scale)), 0.0
    dual = np.zeros(len(examples))
    for _ in range(ROUNDS):
        for i in random.permutation(len(examples)):
            e, v, y = examples[i], values[i], truth[i]
            gradient = y * (weights[e] @ v + bias) - 1.0
            new = min(max(dual[i] - gradient / norms[i], 0.0), COST)
            if new != dual[i]:
                step = (new - dual[i]) * y
                weights[e] += step * v
                bias += step
                dual[i] = new
    return weights, bias


def _logistic_fit(margins: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities, by Newton steps.

    Targets are drawn in a little from 0 and 1, so separable margins keep a finite slope.
    """
    up, down = (truth > 0).sum(), (truth < 0).sum()
    target = np.where(truth > 0, (up + 1) / (up + 2), 1 / (down + 2))
    design = np.stack([margins, np.ones_like(margins)], axis=1)
    found = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ found, -40, 40)))
        gradient = design.T @ (p - target) + 1e-6 * found
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        found -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(found[0]), float(found[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row; 1 means that label 1 is likely.

    Null and empty texts have no feature and get the score of the bias. Rows are
    independent: repeated rows get equal scores, an empty table gives none. Columns but
    ``doc_id`` and ``text`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                values, bounds = indicators(chunk)
                top = ft.segment_sums(m.weights[values], bounds)
                size = np.sqrt(np.maximum(ft.segment_sums(m.squares[values], bounds), 0.0))
                margin = top / np.maximum(size, 1e-9) + m.bias
                p = 1 / (1 + np.exp(-np.clip(margin * m.slope + m.shift, -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, chunk.rows), pa.array(p, pa.float64())],
                    ["doc_id", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        apply, "doc_id long, score double"
    )
