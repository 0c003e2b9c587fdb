"""Ranked lexical search: the best documents for each of a stated set of items.

A document is a vector of impacts: for every term of the items the share of the score that
it would add, an integer. The score is the inner product with an item's indicator vector.
Vectors are ordered by their length and compared in buckets. A bucket whose longest
vector stays below an item's threshold by Cauchy-Schwarz is skipped; inside, an item's
coordinates are taken heaviest first, and a document goes as soon as what is left can no
longer lift it over the threshold. Sums are 64-bit integers, so scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.llm.words import LOWER, text_chunks, word_spans
from fathomline.storage import materialise

#: bytes of item texts in one pass over the documents; more items take more passes
ITEM_BYTES = 4 << 20
#: vectors in a bucket, and of the longest vectors that give the first thresholds
BUCKET = 4096
LONGEST = 16_384
#: coordinates between two looks at the bounds
STEP = 6
#: relative slack of the bounds in doubles
SLACK = 1e-9

_UPPER_LETTERS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MEMBER = np.zeros(256, bool)
_MEMBER[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_HITS = "item int, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, terms)``: the distinct terms of all rows of an item."""
    lowered = F.translate("text", _UPPER_LETTERS, _UPPER_LETTERS.translate({c: int(LOWER[c]) for c in range(128)}))
    found = items.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0))).alias("term"))
    return found.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def _words(chunk) -> tuple[pa.Array, np.ndarray]:
    """The terms of a chunk as an Arrow column over its bytes, and their rows."""
    starts, ends, rows = word_spans(chunk, _MEMBER)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    kept = np.ascontiguousarray(chunk.data[_MEMBER[chunk.data]])
    return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(kept)), rows


def _counted(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of the documents with terms: their number with repeats, and
    the places in the vocabulary and occurrences of those that are in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                texts, rows = _words(chunk)
                place = pc.fill_null(pc.index_in(texts, known), -1).to_numpy().astype(np.int64)
                n = np.bincount(rows, minlength=chunk.rows)
                here = place >= 0
                keys, tfs = np.unique(rows[here] * len(known) + place[here], return_counts=True)
                owner, term = np.divmod(keys, max(len(known), 1))
                bounds = np.searchsorted(owner, np.arange(chunk.rows + 1)).astype(np.int32)
                found = pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(chunk.first, chunk.rows),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(bounds, pa.array(term, pa.int32())),
                        pa.ListArray.from_arrays(bounds, pa.array(tfs, pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )
                yield found.filter(pa.array(n > 0))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


@dataclass
class _Corpus:
    """Documents with terms, all their terms, and the weight of each vocabulary place."""

    size: int
    length: int
    weights: np.ndarray

    def impacts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary places and impacts of a batch's rows one after the other, and row bounds."""
        terms, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
        bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.list_value_length(terms).to_numpy())))
        # n times N may pass 64 bits in between
        dampings = [10 + 90 * n * self.size // self.length for n in batch.column("n").to_pylist()]
        damping = np.repeat(np.array(dampings, np.int64), np.diff(bounds))
        places = terms.flatten().to_numpy()
        return places, self.weights[places] * (1_000_000_000 * tfs // (1000 * tfs + 8 * damping)), bounds


def _corpus(counts: DataFrame, words: int) -> _Corpus:
    told = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    # one row per term of the items
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(words, np.int64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weights = [math.floor(1000 * math.log((2 * told["n"] + 2) / (2 * x + 1))) for x in df.tolist()]
    return _Corpus(told["n"], told["l"], np.array(weights, np.int64))


def _with_lengths(counts: DataFrame, corpus: _Corpus) -> DataFrame:
    """Add ``norm``, the Euclidean length of a document's impact vector; drop empty vectors."""
    shared = counts.sparkSession.sparkContext.broadcast(corpus)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, impacts, bounds = shared.value.impacts(batch)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            squares = np.bincount(owner, weights=impacts.astype(np.float64) ** 2, minlength=batch.num_rows)
            yield batch.append_column("norm", pa.array(np.sqrt(squares)))

    schema = "doc_id long, n long, terms array<int>, tfs array<long>, norm double"
    return counts.where(F.size("terms") > 0).mapInArrow(measure, schema).where("norm > 0")


class _Bucket:
    """Vectors with their coordinates by vocabulary place."""

    def __init__(self, places: np.ndarray, impacts: np.ndarray, bounds: np.ndarray, norms: np.ndarray, words: int) -> None:
        owner = np.repeat(np.arange(len(norms)), np.diff(bounds))
        order = np.argsort(places, kind="stable")
        self.rows, self.values = owner[order], impacts[order]
        self.at = np.searchsorted(places[order], np.arange(words + 1))
        self.squares = norms**2
        self.longest = float(norms.max())
        self.most = np.zeros(words, np.int64)
        held = np.flatnonzero(np.diff(self.at))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.values, self.at[held])

    def over(self, terms: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose score for an item with ``terms`` is at least ``threshold``, and the scores."""
        terms = terms[np.diff(self.at)[terms] > 0]
        rest = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0)
        score = np.zeros(len(self.squares), np.int64)
        square = np.zeros(len(self.squares))
        alive = np.arange(len(self.squares))
        for low in range(0, len(terms), STEP):
            for t in terms[low : low + STEP]:
                here = slice(self.at[t], self.at[t + 1])
                score[self.rows[here]] += self.values[here]
                square[self.rows[here]] += self.values[here].astype(np.float64) ** 2
            high = min(low + STEP, len(terms))
            left = np.maximum(self.squares[alive] * (1 + SLACK) - square[alive] * (1 - SLACK), 0.0)
            more = np.minimum(np.sqrt((len(terms) - high) * left), float(rest[high]))
            alive = alive[(score[alive] + more) * (1 + SLACK) >= threshold]
            if not len(alive):
                break
        alive = alive[score[alive] >= threshold]
        return alive, score[alive]


@dataclass
class _Items:
    """Term places of every item, heaviest first, and the scores that hits must reach."""

    terms: list[np.ndarray]
    thresholds: np.ndarray
    corpus: _Corpus


def _best(vectors: DataFrame, items: _Items, k: int) -> DataFrame:
    """``(item, doc_id, score)``: of every partition up to ``k`` best vectors of each item.

    Ranks by falling score, then rising ``doc_id``, null first. Partitions need no order;
    where the longest vectors come first, thresholds rise early.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, words = shared.value, len(shared.value.corpus.weights)
        limits = asked.thresholds.copy()
        reach = np.sqrt([len(t) for t in asked.terms])
        none = np.zeros(0, np.int64)
        kept = {i: (none, none) for i in range(len(asked.terms))}
        for batch in batches:
            for part in (batch.slice(at, BUCKET) for at in range(0, batch.num_rows, BUCKET)):
                ids = part.column("doc_id").fill_null(_NO_ID).to_numpy()
                bucket = _Bucket(*asked.corpus.impacts(part), part.column("norm").to_numpy(), words)
                for i in np.flatnonzero(reach * bucket.longest * (1 + SLACK) >= limits):
                    rows, scores = bucket.over(asked.terms[i], int(limits[i]))
                    if not len(rows):
                        continue
                    names, scores = np.concatenate((kept[i][0], ids[rows])), np.concatenate((kept[i][1], scores))
                    order = np.lexsort((names, -scores))[:k]
                    kept[i] = names[order], scores[order]
                    if len(order) == k:
                        limits[i] = max(limits[i], scores[order[-1]])
        for i, (names, scores) in kept.items():
            if len(names):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), i), pa.int32()), pa.array(names, mask=names == _NO_ID), pa.array(scores)],
                    ["item", "doc_id", "score"],
                )

    return vectors.mapInArrow(search, _HITS)


#: stands for a missing id inside a task and is lower than every real one
_NO_ID = np.iinfo(np.int64).min


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    # bounded by ITEM_BYTES of texts
    asked = items.toArrow()
    names, lists = asked.column("item_id").combine_chunks(), asked.column("terms").combine_chunks()
    vocabulary = pa.array(sorted(set(lists.flatten().to_pylist())), pa.large_string())
    counts = materialise(_counted(docs, vocabulary), "counts")
    corpus = _corpus(counts, len(vocabulary))
    places = pc.index_in(lists.flatten().cast(pa.large_string()), vocabulary).to_numpy()
    cuts = np.cumsum(pc.list_value_length(lists).to_numpy())
    terms = [p[np.lexsort((p, -corpus.weights[p]))] for p in np.split(places, cuts)[: len(names)]]
    found = _Items(terms, np.ones(len(terms), np.int64), corpus)

    vectors = materialise(_with_lengths(counts, corpus), "vectors")
    # the longest vectors give every item a first threshold
    size = vectors.count()
    share = 1.0 - min(1.0, LONGEST / max(size, 1))
    least = vectors.agg(F.percentile_approx("norm", F.lit(share), F.lit(100_000)).alias("norm")).first()["norm"]
    longest = vectors.where(F.col("norm") >= F.lit(least or 0.0))
    for row in _ranked(_best(longest, found, k), k).where(F.col("rank") == k).select("item", "score").collect():
        found.thresholds[row["item"]] = row["score"]

    by_length = [F.col("norm").desc(), F.col("doc_id").asc()]
    ordered = vectors.repartitionByRange(*by_length).sortWithinPartitions(*by_length)
    best = _ranked(_best(ordered, found, k), k)
    # one row per item of the block
    told = spark.createDataFrame(pa.table({"item": pa.array(range(len(names)), pa.int32()), "item_id": names}))
    return best.join(F.broadcast(told), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents with the highest scores above 0.

    Terms are runs of digits, letters and non-ASCII characters with A-Z lower-cased. With
    N documents that hold a term, L terms in them with repeats, and n of those in one
    document, a term held by df documents weighs floor(1000 ln((2N + 2) / (2 df + 1))) and a
    document's damping m is 10 + (90 n N) div L. A document's score is the sum, over the
    item's distinct terms, of weight times ((10^9 tf) div (1000 tf + 8 m)), in integers. Equal
    scores go by rising ``doc_id``, null first.

    All documents are searched for all items. Items are taken in passes of about ``item_bytes``
    of text, which bounds what is sent to the tasks; each pass reads the documents once.

    A null or empty text has no terms: such a document is never found and an item without
    terms has no rows. Rows that share an ``item_id`` are one item with the terms of all of
    them, also where it is null. Rows that repeat a ``doc_id`` are documents of their own. Empty
    tables give an empty result. Columns but ``doc_id``, ``text`` and ``item_id`` are ignored.
    """
    if k < 1:
        raise ValueError("k must be positive")
    terms = item_terms(items.select("item_id", "text"))
    size = items.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
    passes = max(1, -(-size // item_bytes))
    if passes == 1:
        return _search_block(docs, terms, k)
    terms = materialise(terms, "items")
    at = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    return reduce(DataFrame.unionByName, [_search_block(docs, terms.where(at == p), k) for p in range(passes)])
