"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic value of a linear
function of its hashed words and word beginnings; the document's is the noisy-or of its
sentences, so one offending sentence is enough. Only document labels train it. The
sentence scores then locate what offends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import features as ft
from fathomline.llm.rows import drop_rows, text_key
from fathomline.llm.samples import agreed_labels, binary_views, bounded, fold
from fathomline.llm.words import text_chunks
from fathomline.storage import materialise

BITS = 18
#: word beginnings of so many bytes are features besides the whole word
PREFIXES = (4, 5, 6, 7, 8)
KINDS = 1 + len(PREFIXES)
PER_LABEL = 3000
EPOCHS = 16
BATCH = 64
RATE = 1.0
DECAY = 1e-4
START_BIAS = -5.0
#: documents of each class's share that smooth a feature's odds
PRIOR_DOCS = 1.0
#: share of the log odds that a weight starts with
START = 0.5
#: weight of each class in the loss
BALANCE = 0.5
#: standard deviations that a feature's log odds must be away from chance
LEAST_DEVIATIONS = 3.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _sentences(chunk):
    """Features of a chunk's sentences.

    ``KINDS`` buckets for each distinct word of a sentence, the sentences of these words,
    the sentences' rows, and the bytes where each sentence's words begin and end. A word
    counts once in a sentence, so mere repetition adds nothing.
    """
    starts, ends, rows = ft.word_spans(chunk, ft.LETTER)
    whole = ft.bucket(ft.span_hashes(chunk.data, starts, ends), BITS)
    begins = [ft.bucket(ft.prefix_hashes(chunk, starts, ends, n), BITS) for n in PREFIXES]
    sentence, owner = ft.sentence_ids(chunk, starts, rows)
    bounds = np.searchsorted(sentence, np.arange(len(owner) + 1))
    low, high = starts[bounds[:-1]], ends[bounds[1:] - 1]
    _, once = np.unique((sentence << BITS) | whole, return_index=True)
    once.sort()
    return np.stack([f[once] for f in (whole, *begins)], axis=1), sentence[once], owner, low, high


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(doc_id, label, text)`` to buckets and sentence lengths."""
    for batch in batches:
        labels = batch.column("label")
        for chunk in text_chunks(batch.column("text")):
            buckets, sentence, owner, *_ = _sentences(chunk)
            per_sentence = np.bincount(sentence, minlength=len(owner)).astype(np.int32)
            words = np.searchsorted(owner[sentence], np.arange(chunk.rows + 1))
            parts = np.searchsorted(owner, np.arange(chunk.rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(chunk.first, chunk.rows),
                    labels.slice(chunk.first, chunk.rows),
                    _binary(buckets.astype(np.int32), words),
                    _binary(per_sentence, parts),
                ],
                ["doc_id", "label", "buckets", "lengths"],
            )


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, seed: int = 7) -> Model:
    """Fit on the documents with an agreed ``toxic`` label whose fold is not 0.

    The sample has about ``per_label`` documents of each label at most; that bound also
    bounds what reaches the driver, as bucket numbers. Without documents of both labels
    every score is that of the starting bias.
    """
    known = agreed_labels(labels, "toxic").where(fold(5) != 0)
    # about 2 * per_label rows of two numbers
    sample = F.broadcast(bounded(known, per_label))
    rows = (
        docs.select("doc_id", "text")
        .join(sample, "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(_bags, "doc_id long, label int, buckets binary, lengths binary")
        .toArrow()
    )
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    truth = rows.column("label").to_numpy()[order].astype(np.float64)
    buckets, lengths = binary_views(rows.column("buckets")), binary_views(rows.column("lengths"))
    bags = [(buckets[i], lengths[i]) for i in order]
    model = Model(np.zeros(1 << BITS, np.float64), START_BIAS)
    if len(set(truth)) > 1:
        _descend(model, bags, truth, seed)
    return Model(model.weights.astype(np.float32), float(model.bias))


def _descend(model: Model, bags, truth: np.ndarray, seed: int) -> None:
    """Adaptive stochastic gradient on the document log-likelihood."""
    random = np.random.default_rng(seed)
    seen = np.zeros(1 << BITS, np.int32)
    for words, _ in bags:
        seen[np.unique(words)] += 1
    toxic = truth > 0
    hits = np.zeros(1 << BITS)
    for (words, _), y in zip(bags, toxic):
        if y:
            hits[np.unique(words)] += 1
    base = toxic.mean()
    missed = seen - hits
    odds = np.log((hits + PRIOR_DOCS * base) / (missed + PRIOR_DOCS * (1 - base)) * (1 - base) / base)
    # features that differ between the classes beyond chance; others keep weight 0
    common = np.abs(odds) >= LEAST_DEVIATIONS * np.sqrt(1 / (hits + 1) + 1 / (missed + 1))
    model.weights[common] = START * odds[common]
    weight = np.where(toxic, BALANCE / base, BALANCE / (1 - base))
    power = np.full(1 << BITS, 1e-6)
    bias_power = 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            words = np.concatenate([bags[i][0] for i in chosen]).reshape(-1, KINDS)
            lengths = np.concatenate([bags[i][1] for i in chosen])
            if not len(lengths):
                continue
            counts = np.array([len(bags[i][1]) for i in chosen])
            word_bounds = np.concatenate(([0], np.cumsum(lengths)))
            part_bounds = np.concatenate(([0], np.cumsum(counts)))
            value = ft.segment_sums(model.weights[words].sum(axis=1), word_bounds) + model.bias
            p = _logistic(value)
            clean = ft.segment_sums(_log_not(value), part_bounds)
            whole = -np.expm1(clean)
            y = truth[chosen]
            # the loss by log(1 - whole): -1 for clean documents, (1 - whole) / whole for toxic ones
            push = np.where(y > 0, np.exp(clean) / np.maximum(whole, 1e-9), -1.0) * weight[chosen]
            step = -np.repeat(push, counts) * p
            gradient = np.zeros(1 << BITS)
            for k in range(KINDS):
                np.add.at(gradient, words[:, k], np.repeat(step, lengths))
            touched = np.unique(words)
            touched = touched[common[touched]]
            g = gradient[touched] / len(chosen) + DECAY * model.weights[touched]
            power[touched] += g * g
            model.weights[touched] -= RATE * g / np.sqrt(power[touched])
            g = step.sum() / len(chosen)
            bias_power += g * g
            model.bias -= RATE * g / np.sqrt(bias_power)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def _log_not(x: np.ndarray) -> np.ndarray:
    """Logarithm of one minus the logistic value."""
    x = np.clip(x, -60, 60)
    return -(np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x))))


_SCORED = (
    "doc_id long, key long, score double, n_sentences long, n_offending long, "
    "offending array<struct<start:long,end:long,score:double>>"
)


def score(docs: DataFrame, model: Model, offends: float = 0.5) -> DataFrame:
    """``(doc_id, key, score, n_sentences, n_offending, offending)`` for every row.

    ``offending`` lists the sentences scored ``offends`` or more, from the first to the
    last word, as byte offsets of the UTF-8 text. Null and empty texts and texts without
    letters have no sentence and score 0. Rows are independent: repeated rows get equal
    results, an empty table gives none. Columns but ``doc_id`` and ``text`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                buckets, sentence, owner, low, high = _sentences(chunk)
                bounds = np.searchsorted(sentence, np.arange(len(owner) + 1))
                value = ft.segment_sums(fitted.weights[buckets].sum(axis=1), bounds) + fitted.bias
                parts = np.searchsorted(owner, np.arange(chunk.rows + 1))
                whole = -np.expm1(ft.segment_sums(_log_not(value), parts))
                p = _logistic(value)
                bad = np.flatnonzero(p >= offends)
                per_row = np.searchsorted(owner[bad], np.arange(chunk.rows + 1))
                base = chunk.bounds[owner[bad]]
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array(low[bad] - base, pa.int64()),
                        pa.array(high[bad] - base, pa.int64()),
                        pa.array(p[bad], pa.float64()),
                    ],
                    fields=list(kind),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(chunk.first, chunk.rows),
                        batch.column("key").slice(chunk.first, chunk.rows),
                        pa.array(np.clip(whole, 0.0, 1.0), pa.float64()),
                        pa.array(np.diff(parts), pa.int64()),
                        pa.array(np.diff(per_row), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), spans),
                    ],
                    ["doc_id", "key", "score", "n_sentences", "n_offending", "offending"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text"
    )
    return rows.mapInArrow(apply, _SCORED)


def drop_toxic(docs: DataFrame, model: Model, rejects: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``rejects`` or more."""
    found = score(docs, model).where(F.col("score") >= rejects)
    gone = materialise(found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "gone")
    return drop_rows(docs, gone)
