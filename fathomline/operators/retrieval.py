"""Top-k keyword retrieval for a table of questions ``(index, question)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.operators.indexing import BLOCK, LENGTHS, TfIdfIndex, corpus_size, question_terms
from fathomline.operators.neighbours import _true
from fathomline.storage import BROADCAST_BYTES, fits_in_memory, materialise, share

# Fixed value: default number of chunks per question.
TOP_K = 3
#: pairs of a question and a posting at a time
CELLS = 1 << 19
#: cells of a matrix product that take the time of one pair of a question and a posting
PAIR_COST = 2048
#: cells of all columns of a task, their groups, and about how many chunks tell which go together
WIDE_CELLS = 1 << 23
GROUPS = 96
SAMPLED = 1024
#: rows of the index that are looked up together, besides twice the terms
ROWS_AT_ONCE = 100_000
#: questions that go through the blocks together
QUESTIONS_AT_ONCE = 1024
#: up to so many question terms are pushed into the scan of the postings
PUSHED_TERMS = 20_000
#: bytes of question terms that meet the index in one pass
PASS_BYTES = 64 * 1024 * 1024
#: an index of that many buckets a core is searched in two rounds
ROUNDS_FROM = 3
#: scores have six digits, so a bound must be that much lower to rule a chunk out
ROUNDED = 1e-6


def questions_fit(questions: DataFrame, k: int = 0, limit: int = BROADCAST_BYTES) -> bool:
    """Whether everything derived per question may be broadcast.

    A term takes at least three characters with its separator and about 64 bytes
    as a row, so 24 bytes per text byte bounds the term rows; each hit takes 32.
    """
    return fits_in_memory(questions, F.octet_length("question") * 24 + 64 + 32 * k, limit)


def tfidf_scores(asked: DataFrame, index: TfIdfIndex, small: bool) -> DataFrame:
    """Cosine of every question with every chunk that shares a term: a row per pair.

    Use ``best_chunks`` where only the best are wanted: it makes no rows of pairs.
    """
    side = asked.select("index", "term", (F.col("weight") * F.col("idf")).alias("_asked"))
    products = index.postings.join(F.broadcast(side) if small else side, "term")
    sums = products.groupBy("index", "chunk_index").agg(F.sum(F.col("tf") * F.col("_asked")).alias("_dot"))
    return sums.join(index.lengths, "chunk_index").select(
        "index", "chunk_index", F.round(F.col("_dot") / F.col("length"), 6).alias("score")
    )


class _Asked:
    """Question terms in order of their question: ``question`` (a place in ``names``), ``term`` (a
    place in ``terms``) and ``weight`` of each, and the ``idf`` of every term."""

    def __init__(self, table: pa.Table) -> None:
        self.names, question = np.unique(table.column("index").to_numpy(), return_inverse=True)
        encoded = table.column("term").combine_chunks().dictionary_encode()
        self.terms = encoded.dictionary
        term = encoded.indices.to_numpy(zero_copy_only=False)
        self.idf = np.zeros(len(self.terms))
        self.idf[term] = table.column("idf").to_numpy()
        order = np.argsort(question, kind="stable")
        self.question, self.term = question[order].astype(np.int32), term[order].astype(np.int32)
        self.weight = table.column("weight").to_numpy()[order]
        #: scores that chunks must reach to be among the best
        self.least = np.zeros(len(self.names))

    def reach(self, names: np.ndarray, scores: np.ndarray) -> None:
        """Take the scores that the questions ``names``, in order, have reached elsewhere."""
        if len(names):
            at = np.minimum(np.searchsorted(names, self.names), len(names) - 1)
            self.least = np.where(names[at] == self.names, scores[at], 0.0)

    def part(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question (from 0), term and weight of the terms of the questions from ``low`` to ``high``."""
        here = slice(*np.searchsorted(self.question, [low, high]))
        return self.question[here].astype(np.int64) - low, self.term[here], self.weight[here]


class _Best:
    """Up to ``k`` best chunks of some questions, by falling score, then chunk."""

    def __init__(self, questions: int, k: int) -> None:
        self.chunk = np.full((questions, k), np.iinfo(np.int64).max)
        self.score = np.zeros((questions, k))

    def add(self, owner: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> None:
        """Rounded scores of some questions with chunks that they have not met; zeros do not count."""
        k = self.chunk.shape[1]
        order = np.lexsort((chunk, -score, owner))
        owner, chunk, score = owner[order], chunk[order], score[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
        kept = (place < k) & (score > 0)
        owner, place, chunk, score = owner[kept], place[kept], chunk[kept], score[kept]
        who, row = np.unique(owner, return_inverse=True)
        new_chunk, new_score = np.full((len(who), k), np.iinfo(np.int64).max), np.zeros((len(who), k))
        new_chunk[row, place], new_score[row, place] = chunk, score
        chunk = np.concatenate((self.chunk[who], new_chunk), axis=1)
        score = np.concatenate((self.score[who], new_score), axis=1)
        order = np.lexsort((chunk, -score), axis=-1)[:, :k]
        self.chunk[who] = np.take_along_axis(chunk, order, axis=1)
        self.score[who] = np.take_along_axis(score, order, axis=1)

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        owner, place = np.nonzero(self.score > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(names[owner]), pa.array(self.chunk[owner, place]), pa.array(self.score[owner, place])],
            ["index", "chunk_index", "score"],
        )


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of so many places from each of ``first`` on, one after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class _Rows:
    """Rows of the index in order of their blocks and terms, with the unit weights of their postings
    and the largest of these. ``rows`` has their places by term, and ``first`` where a term's begin."""

    def __init__(self, asked: _Asked, batches: Iterator[pa.RecordBatch]) -> None:
        told, kept = [], []
        for some in _tables(batches, ROWS_AT_ONCE + len(asked.terms)):
            words = some.column("term").combine_chunks()
            told.append(some.filter(pc.equal(words, LENGTHS)).select(["block", "chunks", "lengths"]))
            place = pc.index_in(words, asked.terms)
            # most terms of a large index may be in no question
            some = some.filter(place.is_valid())
            chunks, tfs = (some.column(c).combine_chunks() for c in ("chunks", "tfs"))
            columns = some.column("block"), place.drop_null(), pc.list_value_length(chunks), chunks.flatten(), tfs.flatten()
            types = np.int64, np.int32, np.int32, np.min_scalar_type(BLOCK), np.int32
            kept.append([column.to_numpy().astype(kind) for column, kind in zip(columns, types)])
        del some, words, place, chunks, tfs, columns
        pa.default_memory_pool().release_unused()
        block, place, sizes, self.chunk, self.tf = (np.concatenate(column) for column in zip(*kept))
        del kept
        order = np.lexsort((place, block))
        flat = _spread((np.cumsum(sizes, dtype=np.int64) - sizes)[order], sizes[order])
        self.chunk, self.tf = self.chunk[flat], self.tf[flat]
        del flat
        self.term, self.sizes = place[order], sizes[order].astype(np.int64)
        self.rows = np.argsort(self.term, kind="stable")
        self.first = np.searchsorted(self.term[self.rows], np.arange(len(asked.terms) + 1))
        self.blocks, self.block = np.unique(block[order], return_inverse=True)
        self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.sizes)))
        self.lengths = self._lengths(pa.concat_tables(told))
        self.weight = np.empty(len(self.tf))
        for low, high in _runs(self.sizes, CELLS):
            part, some = slice(self.at[low], self.at[high]), self.sizes[low:high]
            values = self.tf[part] * np.repeat(asked.idf[self.term[low:high]], some)
            self.weight[part] = values / self.lengths[np.repeat(self.block[low:high], some), self.chunk[part]]
        self.most = np.maximum.reduceat(self.weight, self.at[:-1]) if len(order) else np.zeros(0)
        self._columns(asked)

    def _lengths(self, told: pa.Table) -> np.ndarray:
        """Lengths of the chunks of every block (rows) here."""
        told = told.filter(pa.array(np.isin(told.column("block").to_numpy(), self.blocks)))
        lengths = np.ones((len(self.blocks), BLOCK))
        chunks = told.column("chunks").combine_chunks()
        row = np.searchsorted(self.blocks, told.column("block").to_numpy())
        owner = np.repeat(row, pc.list_value_length(chunks).to_numpy())
        lengths[owner, chunks.flatten().to_numpy()] = told.column("lengths").combine_chunks().flatten().to_numpy()
        return lengths

    def _columns(self, asked: _Asked) -> None:
        """Terms of many pairs of a question and a chunk here get a column of a matrix: ``column``
        has its place or -1, ``wide`` has the matrices of counts by block, ``idf`` their factors.

        Columns that hardly ever meet in a chunk form a group. What a group adds to a score is no more
        than the product of the lengths of the question's and the chunk's weights there, whatever
        the groups are; ``grouped`` has those of the chunks, by block.
        """
        size = len(self.blocks) * BLOCK
        pairs = np.bincount(self.term, self.sizes, len(asked.terms))
        pairs *= np.bincount(asked.term, minlength=len(asked.terms))
        wide = np.flatnonzero((pairs * PAIR_COST > size * len(asked.names)) & (pairs > size))
        wide = wide[np.argsort(-pairs[wide], kind="stable")][: WIDE_CELLS // max(size, 1)]
        self.column = np.full(len(asked.terms), -1, np.int32)
        self.column[wide] = np.arange(len(wide))
        self.idf = asked.idf[wide]
        self.wide = np.zeros((len(self.blocks), BLOCK, len(wide)), np.int32)
        rows = np.flatnonzero(self.column[self.term] >= 0)
        for low, high in _runs(self.sizes[rows], CELLS):
            part = rows[low:high]
            flat, column = _spread(self.at[part], self.sizes[part]), self.column[self.term[part]]
            to = np.repeat(self.block[part], self.sizes[part]), self.chunk[flat], np.repeat(column, self.sizes[part])
            self.wide[to] = self.tf[flat]
        del self.tf
        step = max(1, size // SAMPLED)
        some = (self.wide.reshape(size, len(wide))[::step] * self.idf / self.lengths.reshape(size, 1)[::step]).T.copy()
        groups = min(GROUPS, len(wide))
        self.group, together = np.arange(len(wide)), some[:groups].copy()
        for c in range(groups, len(wide)):
            self.group[c] = np.argmin(together @ some[c])
            together[self.group[c]] += some[c]
        order = np.argsort(self.group, kind="stable")
        starts = np.searchsorted(self.group[order], np.arange(groups))
        self.grouped = np.zeros((len(self.blocks), groups, BLOCK), np.float32)
        for b in range(len(self.blocks) if groups else 0):
            weights = (self.wide[b] * self.idf / self.lengths[b][:, None]).T
            self.grouped[b] = np.sqrt(np.add.reduceat(weights[order] ** 2, starts, axis=0))


class _Part:
    """Some questions before the rows of the index: ``bounds`` of their scores by block, the lengths of
    their weights by group, and their terms without a column by block."""

    def __init__(self, index: _Rows, question: np.ndarray, term: np.ndarray, weight: np.ndarray, questions: int) -> None:
        self.index = index
        sizes = index.first[term + 1] - index.first[term]
        row, entry = index.rows[_spread(index.first[term], sizes)], np.repeat(np.arange(len(term)), sizes)
        block, blocks = index.block[row], len(index.blocks)
        self.bounds = np.bincount(
            block * questions + question[entry], weight[entry] * index.most[row], blocks * questions
        ).reshape(blocks, questions)
        column = index.column[term]
        wide = np.flatnonzero(column >= 0)
        self.column, self.weight = column[wide], weight[wide]
        self.first = np.searchsorted(question[wide], np.arange(questions + 1))
        groups = index.grouped.shape[1]
        squares = np.bincount(question[wide] * groups + index.group[self.column], self.weight**2, questions * groups)
        self.grouped = np.sqrt(squares).reshape(questions, groups).astype(np.float32)
        narrow = np.flatnonzero(column[entry] < 0)
        narrow = narrow[np.argsort(block[narrow].astype(np.min_scalar_type(blocks)), kind="stable")]
        self.starts = np.searchsorted(block[narrow], np.arange(blocks + 1))
        self.row, entry = row[narrow], entry[narrow]
        self.question, self.factor = question[entry], weight[entry]
        # more than sums in single precision lose
        most = np.bincount(question, minlength=1).max() + groups + 16
        self.error = most * float(np.finfo(np.float32).eps)

    def meet(self, b: int, active: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Upper bounds, in single precision, of the scores of some questions (rows) with the chunks of a
        block, and the cells and values of the pairs there that terms without a column add.

        Groups of columns take part in a matrix product; for the other terms the pairs of their
        questions and their chunks are added up, which are far fewer than cells.
        """
        here = slice(self.starts[b], self.starts[b + 1])
        row, question, factor = self.row[here], self.question[here], self.factor[here]
        every = self.grouped
        if len(active) < len(every):
            place = np.full(len(every), -1)
            place[active] = np.arange(len(active))
            kept = np.flatnonzero(place[question] >= 0)
            row, question, factor = row[kept], place[question[kept]], factor[kept]
            every = every[active]
        index, pairs = self.index, []
        scores = every @ index.grouped[b]
        sizes = index.sizes[row]
        for low, high in _runs(sizes, CELLS):
            some = sizes[low:high]
            flat = _spread(index.at[row[low:high]], some)
            cell = np.repeat(question[low:high] * BLOCK, some) + index.chunk[flat]
            value = np.repeat(factor[low:high], some) * index.weight[flat]
            np.add.at(scores.reshape(-1), cell, value.astype(np.float32))
            pairs.append((cell, value))
        return scores, pairs

    def exact(self, b: int, active: np.ndarray, mask: np.ndarray, pairs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and scores in double precision of the true cells of a matrix like that of ``meet``."""
        owner, chunk = _true(mask)
        found, cells = np.zeros(len(owner)), owner * BLOCK + chunk
        for cell, value in pairs:
            held = np.flatnonzero(mask.reshape(-1)[cell])
            found += np.bincount(np.searchsorted(cells, cell[held]), value[held], len(cells))
        question = active[owner]
        sizes = self.first[question + 1] - self.first[question]
        for low, high in _runs(sizes, CELLS):
            some = sizes[low:high]
            at, pair = _spread(self.first[question[low:high]], some), np.repeat(np.arange(high - low), some)
            column, place = self.column[at], chunk[low:high][pair]
            weight = self.index.wide[b][place, column] * self.index.idf[column] / self.index.lengths[b][place]
            found[low:high] += np.bincount(pair, weight * self.weight[at], high - low)
        return owner, chunk, found


def _runs(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cut a list in runs of about ``limit`` together."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // limit)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return [(low, high) for low, high in zip(edges, edges[1:]) if high > low]


def _search(asked: _Asked, rows: _Rows, k: int) -> tuple[_Best, int, int]:
    """The best chunks, and how many pairs of question and block were scored and had a
    term in common.

    Blocks come in the order of their largest bound. A question leaves a block out if the
    largest weights there cannot lift any chunk over the question's ``k``-th best score. In the
    others bounds choose the chunks that may be among the best, and only these are scored.
    """
    best, scored, shared = _Best(len(asked.names), k), 0, 0
    for low in range(0, len(asked.names), QUESTIONS_AT_ONCE):
        high = min(low + QUESTIONS_AT_ONCE, len(asked.names))
        part = _Part(rows, *asked.part(low, high), high - low)
        shared += int((part.bounds > 0).sum())
        for b in np.argsort(-part.bounds.max(axis=1), kind="stable"):
            least = np.maximum(best.score[low:high, -1], asked.least[low:high])
            active = np.flatnonzero((part.bounds[b] > 0) & (part.bounds[b] + ROUNDED >= least))
            if not len(active):
                continue
            scored += len(active)
            most, pairs = part.meet(b, active)
            least = least[active]
            few = np.flatnonzero(least == 0)
            if len(few) and BLOCK > k:
                # the k best scores are no less than those of any k chunks
                mask = np.zeros(most.shape, bool)
                mask[few[:, None], np.argpartition(most[few], -k, axis=1)[:, -k:]] = True
                least[few] = part.exact(b, active, mask, pairs)[2].reshape(len(few), k).min(axis=1)
            # a score that is rounded to zero does not count
            least = np.maximum(least - ROUNDED, ROUNDED / 4)
            mask = most >= (least * (1 - part.error)).astype(np.float32)[:, None]
            owner, column, score = part.exact(b, active, mask, pairs)
            kept = np.flatnonzero(score >= least[owner])
            owner, column, score = owner[kept], column[kept], np.round(score[kept], 6)
            best.add(low + active[owner], rows.blocks[b] * BLOCK + column, score)
    return best, scored, shared


_HITS = "index long, chunk_index long, score double"


class Work:
    """Pairs of question and block that shared a term, and those of them that were scored."""

    def __init__(self, spark) -> None:
        self.shared: Accumulator = spark.sparkContext.accumulator(0)
        self.scored: Accumulator = spark.sparkContext.accumulator(0)

    def skipped(self) -> float:
        return 1.0 - self.scored.value / max(self.shared.value, 1)


def best_chunks(asked: DataFrame, index: TfIdfIndex, k: int, work: Work | None = None) -> DataFrame:
    """``(index, chunk_index, score)``: for every question at least its ``k`` best chunks.

    ``asked`` are question terms that measure small. They are sent to the buckets of the
    index, of which only the rows with their terms are read. Each task takes the largest
    weight of every term in every block, scores the blocks that these do not rule out
    in NumPy, and hands on ``k`` rows per question, so no pair of question and chunk is ever
    a row. ``work`` counts what the bounds saved.
    """
    return _hits(_sent(asked), index, k, work)


def _sent(asked: DataFrame) -> tuple[Callable[[], _Asked], list[str]]:
    """Question terms for the tasks, and the names of the terms."""
    # measured by the caller
    questions = _Asked(asked.select("index", "term", "idf", "weight").toArrow())
    return share(asked.sparkSession, questions), questions.terms.to_pylist()


def _hits(
    asked: tuple[Callable[[], _Asked], list[str]],
    index: TfIdfIndex,
    k: int,
    work: Work | None,
    reached: DataFrame | None = None,
) -> DataFrame:
    """``best_chunks`` for questions that were sent. Those in ``reached``, ``(index, score)``, which
    is one row a question, need no chunks with lower scores."""
    (shared, terms), blocks, told = asked, index.blocks, None
    if reached is not None:
        table = reached.select("index", "score").toArrow().sort_by("index")
        told = share(reached.sparkSession, [table.column(c).to_numpy() for c in ("index", "score")])
    if len(terms) <= PUSHED_TERMS:
        # one expression text; terms consist of word characters
        names = ", ".join(f"'{t}'" for t in [LENGTHS, *terms])
        blocks = blocks.where(f"term IN ({names})")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        for first in batches:
            known = shared()
            if told is not None:
                known.reach(*told())
            best, scored, common = _search(known, _Rows(known, chain((first,), batches)), k)
            if work is not None:
                work.scored.add(scored)
                work.shared.add(common)
            yield best.rows(known.names)

    return blocks.select("block", "term", "chunks", "tfs", "lengths").mapInArrow(score, _HITS)


def _rounds(index: TfIdfIndex) -> list[TfIdfIndex]:
    """The index, or of a large one a bucket for every core, and the others."""
    cores = index.blocks.sparkSession.sparkContext.defaultParallelism
    # one row a block
    held = index.blocks.where(F.col("term") == LENGTHS).select("block", F.col("_metadata.file_name").alias("file")).collect()
    files = sorted({row["file"] for row in held})
    if len(files) < max(ROUNDS_FROM * cores, cores + 1):
        return [index]
    first = set(files[:cores])
    # named one by one, they tell which buckets are read
    named = [", ".join(str(row["block"]) for row in held if (row["file"] in first) == here) for here in (True, False)]
    return [replace(index, blocks=index.blocks.where(f"block IN ({names})")) for names in named]


def best_chunks_in_passes(
    asked: DataFrame, index: TfIdfIndex, k: int, limit: int | None = None, work: Work | None = None
) -> DataFrame:
    """``best_chunks`` for question terms of any size: block after block of questions meets
    the index in its buckets, so the postings never move.

    In a large index some buckets are searched first: the others need only look for chunks that
    are no worse than the ``k`` best there.
    """
    written = materialise(asked.select("index", "term", "idf", "weight"), "asked")
    size = written.agg(F.sum(F.octet_length("term") + 48).alias("bytes")).first()["bytes"] or 0
    passes = max(1, -(-size // (limit or PASS_BYTES)))
    at = F.pmod(F.xxhash64("index"), F.lit(passes))
    sent = [_sent(written.where(at == p)) for p in range(passes)]
    first, *others = _rounds(index)
    found = reduce(DataFrame.unionByName, [_hits(part, first, k, work) for part in sent])
    for rest in others:
        kept = materialise(top_k(found, k), "first-hits")
        reached = kept.where(F.col("rank") == k)
        more = [_hits(part, rest, k, work, reached.where(at == p)) for p, part in enumerate(sent)]
        found = reduce(DataFrame.unionByName, more, kept.drop("rank"))
    return found


def top_k(scores: DataFrame, k: int = TOP_K, item: str = "chunk_index") -> DataFrame:
    """The first ``min(k, n)`` per question by falling score, then by ``item``.

    Planned with a group limit before the shuffle: each task sends at most ``k``
    rows per question.
    """
    order = W.partitionBy("index").orderBy(F.col("score").desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pad_zero_scores(hits: DataFrame, questions: DataFrame, n_chunks: Column, k: int) -> DataFrame:
    """Fill up to ``min(k, n_chunks)`` hits with the lowest chunks that scored 0.

    ``hits`` are the ranked positive scores. With fewer than ``k`` of them a
    question has all its matches there, and the ``k`` lowest chunk numbers always
    suffice as fillers, since numbers are dense. All lists have at most ``k`` items.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_index", "score")))
    lists = hits.groupBy("index").agg(ranked.alias("_hits"))
    wanted = F.col("_wanted")
    none = F.array().cast("array<bigint>")
    lowest = F.when(wanted > 0, F.sequence(F.lit(0).cast("long"), wanted - 1)).otherwise(none)
    found = F.coalesce(
        F.transform("_hits", lambda h: F.struct(h["chunk_index"], h["score"])),
        F.array().cast("array<struct<chunk_index:bigint,score:double>>"),
    )
    free = F.array_except(lowest, F.transform("_found", lambda h: h["chunk_index"]))
    gaps = F.greatest(wanted.cast("int") - F.size("_found"), F.lit(0))
    filler = F.transform(
        F.slice(free, F.lit(1), gaps),
        lambda c: F.struct(c.alias("chunk_index"), F.lit(0.0).alias("score")),
    )
    return (
        questions.select("index")
        .join(lists, "index", "left")
        .withColumns({"_found": found, "_wanted": F.least(F.lit(k).cast("long"), n_chunks)})
        .select("index", F.posexplode(F.concat("_found", filler)).alias("_at", "_hit"))
        .select(
            "index",
            F.col("_hit.chunk_index").alias("chunk_index"),
            F.col("_hit.score").alias("score"),
            (F.col("_at") + 1).alias("rank"),
        )
    )


def attach_text(hits: DataFrame, chunks: DataFrame, small: bool) -> DataFrame:
    """Add the chunk text. Few hits are broadcast, so the chunk texts do not move."""
    side = F.broadcast(hits) if small else hits
    return chunks.select("chunk_index", "text").join(side, "chunk_index")


def tfidf_retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    index: TfIdfIndex,
    k: int = TOP_K,
    pad: bool = True,
    small: bool | None = None,
) -> DataFrame:
    """``(index, rank, chunk_index, score, text)`` for every question. ``small`` says
    whether what derives from the questions may be broadcast; by default it is measured."""
    small = questions_fit(questions, k) if small is None else small
    asked = question_terms(questions, index.idf, small)
    hits = top_k((best_chunks if small else best_chunks_in_passes)(asked, index, k), k)
    if pad:
        hits = pad_zero_scores(hits, questions, corpus_size(chunks), k)
    return attach_text(hits, chunks, small).select("index", "rank", "chunk_index", "score", "text")


def gather_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Add ``retrieval_context`` (ranked list) and ``built_context`` (one text).

    A question without hits gets an empty list and an empty text. Each group has
    at most ``k`` rows.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    lists = hits.groupBy("index").agg(F.transform(ranked, lambda h: h["text"]).alias("_found"))
    empty = F.array().cast("array<string>")
    return (
        questions.join(lists, "index", "left")
        .withColumn("retrieval_context", F.coalesce(F.col("_found"), empty))
        .withColumn("built_context", build_context(F.col("retrieval_context")))
        .drop("_found")
    )


def build_context(retrieved: Column) -> Column:
    """Texts in rank order joined by one space."""
    return F.array_join(retrieved, " ")
