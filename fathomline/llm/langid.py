"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its words' byte n-grams and whole words; a
linear softmax names the language. Embeddings and softmax are trained together by
stochastic gradient descent in NumPy. A temperature fitted on withheld texts calibrates
the probabilities, and a threshold chosen there tells which predictions to reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import features as ft
from fathomline.llm.samples import binary_views, bounded, fold
from fathomline.llm.words import mix, text_chunks

BITS = 16
DIMENSION = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 1500
EPOCHS = 8
RATE = 0.5
BATCH = 32
WITHHELD = 5
#: share of accepted withheld texts that must be right
PRECISION = 0.99
UNKNOWN = "und"


@dataclass
class Model:
    """Per bucket the product of embedding and softmax weights; the bias, names,
    temperature and the least probability that is accepted."""

    logits: np.ndarray
    bias: np.ndarray
    names: list[str]
    temperature: float
    threshold: float


def subwords(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all word n-grams and words of a chunk, and each row's bounds."""
    starts, ends, rows = ft.word_spans(chunk, ft.LETTER)
    size = len(chunk.data)
    # word number of each byte, 0 outside; one separator byte belongs to the word after it
    mark = np.zeros(size + 1, np.int32)
    mark[starts] += 1
    mark[ends] -= 1
    inside = np.cumsum(mark[:size]) > 0
    data = np.where(inside, chunk.data, 0).astype(np.uint64)
    owner = np.repeat(np.arange(chunk.rows), np.diff(chunk.bounds))
    values, owners = [ft.bucket(ft.span_hashes(chunk.data, starts, ends), BITS)], [rows]
    for n in GRAMS:
        count = size - n + 1
        if count <= 0:
            continue
        packed = np.zeros(count, np.uint64)
        solid = np.ones(count, bool)
        for k in range(n):
            packed = (packed << np.uint64(8)) | data[k : k + count]
            if k:
                solid &= inside[k : k + count]
        # the first byte may be the gap before a word, so word beginnings are marked
        solid &= owner[:count] == owner[n - 1 :]
        values.append(ft.bucket(mix(packed[solid] + (np.uint64(n) << np.uint64(60))), BITS))
        owners.append(owner[:count][solid])
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return values[order], np.searchsorted(owners[order], np.arange(chunk.rows + 1))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            values, bounds = subwords(chunk)
            packed = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                found, counts = np.unique(values[a:b], return_counts=True)
                packed.append(np.stack([found, counts]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(chunk.first, chunk.rows),
                    batch.column("label").slice(chunk.first, chunk.rows),
                    pa.array(packed, pa.binary()),
                ],
                ["doc_id", "label", "buckets"],
            )


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 5) -> Model:
    """Fit on texts and non-null ``lang`` of documents whose fold (of 4) is not 2.

    About ``per_language`` documents of each language at most are used. Ids that carry
    two languages do not count. Without any labelled text nothing can be predicted, and
    every text is unknown.
    """
    known = (
        docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold(4) != 2))
        .groupBy("doc_id")
        .agg(F.min("lang").alias("label"), F.max("lang").alias("_other"))
        .where("label = _other")
        .select("doc_id", "label")
    )
    # about per_language rows of two short values for each language
    sample = F.broadcast(bounded(known, per_language))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(sample, "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(_examples, "doc_id long, label string, buckets binary")
        .toArrow()
    )
    labels = np.array(rows.column("label").to_pylist(), dtype=object)
    names = sorted(set(labels))
    packed = binary_views(rows.column("buckets"))
    order = [i for i in np.argsort(rows.column("doc_id").to_numpy(), kind="stable") if len(packed[i])]
    if not names or not order:
        return Model(np.zeros((1 << BITS, 1), np.float32), np.zeros(1), [UNKNOWN], 1.0, 1.0)
    truth = np.searchsorted(names, labels[order])
    examples = [packed[i].reshape(2, -1) for i in order]
    return _descend(examples, truth, names, seed)


def _descend(examples, truth: np.ndarray, names: list[str], seed: int) -> Model:
    random = np.random.default_rng(seed)
    shuffled = random.permutation(len(examples))
    withheld = shuffled[: len(shuffled) // WITHHELD]
    seen = shuffled[len(shuffled) // WITHHELD :]
    embed = random.uniform(-1, 1, (1 << BITS, DIMENSION)) / DIMENSION
    soft, bias = np.zeros((DIMENSION, len(names))), np.zeros(len(names))
    steps, done = EPOCHS * -(-len(seen) // BATCH), 0
    for _ in range(EPOCHS):
        order = random.permutation(seen)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            ids = np.concatenate([examples[i][0] for i in chosen])
            share = np.concatenate([examples[i][1] / examples[i][1].sum() for i in chosen])
            sizes = np.array([examples[i].shape[1] for i in chosen])
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            mean = np.add.reduceat(embed[ids] * share[:, None], bounds[:-1], axis=0)
            error = _softmax(mean @ soft + bias)
            error[np.arange(len(chosen)), truth[chosen]] -= 1.0
            back = np.repeat(error @ soft.T, sizes, axis=0) * share[:, None]
            soft -= rate * (mean.T @ error)
            bias -= rate * error.sum(axis=0) / len(chosen)
            np.subtract.at(embed, ids, rate * 20 * back)
    logits = embed @ soft
    raw = np.array([(logits[examples[i][0]] * (examples[i][1] / examples[i][1].sum())[:, None]).sum(axis=0) for i in withheld])
    temperature, threshold = 1.0, 0.0
    if len(withheld):
        temperature, threshold = _calibrated(raw + bias, truth[withheld])
    return Model(logits.astype(np.float32), bias, list(names), temperature, threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _calibrated(raw: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """The temperature with the least log loss, and the least threshold that is precise."""
    at = np.arange(len(truth))
    grid = np.geomspace(0.05, 5.0, 60)
    losses = [-np.log(np.maximum(_softmax(raw / t)[at, truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = _softmax(raw / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-best)
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    last = np.flatnonzero(precise)
    return temperature, float(best[order[last[-1]]]) if len(last) else 1.0


def _has_letter(column: pa.Array, chunk) -> np.ndarray:
    """Whether each row of the chunk has a letter of any script."""
    ascii_letter = (chunk.data >= ord("a")) & (chunk.data <= ord("z"))
    wide = chunk.data >= 0x80
    found = ft.segment_sums(ascii_letter, chunk.bounds) > 0
    for row in np.flatnonzero(~found & (ft.segment_sums(wide, chunk.bounds) > 0)):
        found[row] = any(c.isalpha() for c in column[chunk.first + int(row)].as_py())
    return found


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row.

    ``score`` is the calibrated probability of ``lang_pred``, and ``rejected`` tells that
    it is below the model's threshold. A null text and one without a letter are ``und``
    with score 0, rejected; a text whose letters form no known subword gets the softmax
    of the bias. Rows are independent: repeated rows get equal results, an empty table
    gives none. Columns but ``doc_id`` and ``text`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.names, dtype=object)
        for batch in batches:
            column = batch.column("text")
            for chunk in text_chunks(column):
                values, bounds = subwords(chunk)
                counts = np.maximum(np.diff(bounds), 1)
                raw = np.stack(
                    [ft.segment_sums(m.logits[values, k], bounds) for k in range(len(names))], axis=1
                )
                p = _softmax((raw / counts[:, None] + m.bias) / m.temperature)
                best = p.argmax(axis=1)
                letters = _has_letter(column, chunk) & (m.names != [UNKNOWN])
                score = np.where(letters, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(chunk.first, chunk.rows),
                        pa.array(np.where(letters, names[best], UNKNOWN), pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(~letters | (score < m.threshold), pa.bool_()),
                    ],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        apply, "doc_id long, lang_pred string, score double, rejected boolean"
    )
