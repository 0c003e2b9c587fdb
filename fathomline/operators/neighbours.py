"""Dense nearest neighbours by Euclidean distance, all against all.

Distances are doubles rounded to six digits, and ties go to the lower id, so
results do not depend on the partitioning. No pair of question and vector is ever
a row: NumPy compares blocks and each task hands on at most ``k`` per question.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.storage import fits_in_memory, materialise

QUESTION_BYTES = 32 * 1024 * 1024
BLOCK_ROWS = 8192
ROWS_AT_ONCE = 256
VECTORS_AT_ONCE = 2048
#: tasks for the pairs of blocks
TASKS_PER_CORE = 4
#: bytes of vectors that meet others together
MEETING_BYTES = 4 * 1024 * 1024
PAIRS_AT_ONCE = 1 << 15
#: squared lengths up to which products fit single precision, and its hits a question that
#: are looked at again in double precision first
SINGLE_LIMIT = 1e30
SINGLE_HITS = 8
#: more than the six digits of a distance can hide
ROUNDING = 2e-6
_PACKED = "block long, ids binary, vectors binary, single boolean, limits binary, wanted array<long>"
NEIGHBOURS = "index long, vec_id long, distance double"
_ARROW = pa.schema(
    [("index", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())]
)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column to a matrix; all vectors must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) == 0:
        return flat.reshape(0, 0)
    if column.null_count or flat.size % len(column):
        raise ValueError("vectors must be present and have one dimension")
    width = flat.size // len(column)
    if not (np.diff(column.offsets.to_numpy()) == width).all():
        raise ValueError("vectors must have one dimension")
    return flat.reshape(len(column), width)


def _best(owner: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int):
    """The ``k`` smallest (distance, id) of each owner, sorted by owner."""
    order = np.lexsort((ids, distance, owner))
    owner, ids, distance = owner[order], ids[order], distance[order]
    first = np.searchsorted(owner, owner, side="left")
    keep = np.arange(owner.size) - first < k
    return owner[keep], ids[keep], distance[keep]


def _true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells of a matrix, in order; eight cells are read at once."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    cell, place = np.nonzero(flat[:whole].reshape(-1, 8)[eights])
    found = np.concatenate((eights[cell] * 8 + place, np.flatnonzero(flat[whole:]) + whole))
    return np.divmod(found, max(1, mask.shape[1]))


class _Nearest:
    """Up to ``k`` nearest vectors of some questions."""

    def __init__(self, questions: int, k: int) -> None:
        self.ids = np.full((questions, k), np.iinfo(np.int64).max)
        self.distance = np.full((questions, k), np.inf)

    def add(self, rows: np.ndarray, owner: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        """Hits of ``rows[owner]``, in order of ``owner``."""
        k = self.ids.shape[1]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
        new = _Nearest(len(rows), k)
        new.ids[owner, place], new.distance[owner, place] = ids, distance
        ids = np.concatenate((self.ids[rows], new.ids), axis=1)
        distance = np.concatenate((self.distance[rows], new.distance), axis=1)
        order = np.lexsort((ids, distance), axis=-1)[:, :k]
        self.ids[rows] = np.take_along_axis(ids, order, axis=1)
        self.distance[rows] = np.take_along_axis(distance, order, axis=1)

    def improve(
        self, asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, limits: np.ndarray | None = None
    ) -> None:
        """Compare every question with some more vectors.

        Products of blocks give lower bounds of squared distances with a known error. They
        only choose the vectors that may be among the first ``k``, and not beyond
        ``limits``; the distances of these are computed again from the differences, so they do
        not depend on the blocks. Questions with a limit are multiplied in single precision,
        with the wider bounds of its error; where these choose many, double precision chooses
        again. No more than ``ROWS_AT_ONCE`` by ``VECTORS_AT_ONCE`` cells are held at a time.
        """
        if len(vectors) and len(asked) and vectors.shape[1] != asked.shape[1]:
            raise ValueError(f"dimension {asked.shape[1]} differs from {vectors.shape[1]}")
        k = self.ids.shape[1]
        slack, wide = (8 * np.finfo(kind).eps * (asked.shape[1] + 4) for kind in (np.float64, np.float32))
        own = (asked**2).sum(axis=1)
        lifted = np.column_stack((asked * -2.0, np.ones(len(asked))))
        short = len(own) > 0 and own.max() < SINGLE_LIMIT and wide < 1
        single = lifted.astype(np.float32) if short else None
        for first in range(0, len(ids), VECTORS_AT_ONCE):
            some, names = vectors[first : first + VECTORS_AT_ONCE], ids[first : first + VECTORS_AT_ONCE]
            squares = (some**2).sum(axis=1)
            right = np.column_stack((some, squares * (1 - slack)))
            quick = None
            if short and squares.max() < SINGLE_LIMIT:
                quick = np.column_stack((some, squares * (1 - wide))).astype(np.float32)
            for low in range(0, len(asked), ROWS_AT_ONCE):
                at = slice(low, low + ROWS_AT_ONCE)
                part, base = asked[at], own[at] * (1 - slack)
                limit = self.distance[at, -1]
                if limits is not None:
                    limit = np.minimum(limit, limits[at])
                free = np.isinf(limit)
                # rounding to six digits may make a slightly farther vector equal
                reach = (limit + ROUNDING) ** 2 - base
                found = None
                if quick is not None and not free.any():
                    bound = (limit + ROUNDING) ** 2 - own[at] * (1 - wide)
                    with np.errstate(over="ignore"):  # infinity then, which leaves nothing out
                        bound = np.nextafter(bound.astype(np.float32), np.float32(np.inf))
                    found = _true(single[at] @ quick.T <= bound[:, None])
                if found is None or len(found[0]) > SINGLE_HITS * len(part):
                    # least squared distance, less ``base``
                    least = lifted[at] @ right.T
                    if free.any() and len(names) > k:
                        most = np.partition(least[free] + 2 * slack * squares, k - 1, axis=1)[:, k - 1]
                        most = np.sqrt(np.maximum(most + base[free] + 2 * slack * own[at][free], 0.0))
                        reach[free] = (most + ROUNDING) ** 2 - base[free]
                    found = _true(least <= reach[:, None])
                rows, cols = found
                distance = np.concatenate(
                    [np.zeros(0)]
                    + [
                        np.sqrt(((part[rows[x : x + PAIRS_AT_ONCE]] - some[cols[x : x + PAIRS_AT_ONCE]]) ** 2).sum(axis=1))
                        for x in range(0, len(rows), PAIRS_AT_ONCE)
                    ]
                )
                distance = np.round(distance, 6)
                held = distance <= limit[rows]
                owner, near, distance = _best(rows[held], names[cols[held]], distance[held], k)
                if len(owner):
                    who, place = np.unique(owner, return_inverse=True)
                    self.add(low + who, place, near, distance)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of questions, vector ids and distances."""
        owner, place = np.nonzero(np.isfinite(self.distance))
        return owner, self.ids[owner, place], self.distance[owner, place]

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        owner, ids, distance = self.hits()
        return pa.RecordBatch.from_arrays([pa.array(names[owner]), pa.array(ids), pa.array(distance)], schema=_ARROW)


def _nearest(asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Positions of questions, vector ids and distances: up to ``k`` per question."""
    best = _Nearest(len(asked), k)
    best.improve(asked, vectors, ids)
    return best.hits()


def knn_exact(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    small: bool | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(index, rank, vec_id, distance)``: the ``k`` nearest of every question.

    ``questions`` is ``(index, embedding)``, ``vectors`` is ``(vec_id, embedding)``.
    Questions that measure small are broadcast and the vectors stay in place.
    Otherwise both sides are packed into blocks of about ``block_rows`` that meet in pairs
    (see ``meet``); no row is copied for that.
    """
    if k < 1:
        raise ValueError("k must be positive")
    questions = questions.select("index", "embedding")
    vectors = vectors.select("vec_id", "embedding")
    if small is None:
        small = fits_in_memory(questions, F.size("embedding") * 8 + 8, QUESTION_BYTES)
    if small:
        return rank_neighbours(_against_broadcast(questions, vectors, k), k)
    asked, stored = (
        packed(side.withColumn("block", _hash_block(side, name, block_rows)), name)
        for side, name in ((questions, "index"), (vectors, "vec_id"))
    )
    return rank_neighbours(meet(asked, stored, k, together=True), k)


def rank_neighbours(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("index").orderBy("distance", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("index", "rank", "vec_id", "distance")
    )


def _against_broadcast(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    # bounded by QUESTION_BYTES, measured by the caller
    table = questions.toArrow()
    names = table.column("index").to_numpy()
    shared = questions.sparkSession.sparkContext.broadcast((names, _matrix(table.column("embedding"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, asked = shared.value
        best = _Nearest(len(labels), k)
        for batch in batches:
            if batch.num_rows and len(labels):
                best.improve(asked, _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy())
        yield best.rows(labels)

    return vectors.mapInArrow(search, NEIGHBOURS)


def _hash_block(df: DataFrame, name: str, block_rows: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(max(1, math.ceil(df.count() / block_rows)))).cast("long")


def packed(rows: DataFrame, name: str, limit: str | None = None, wanted: Callable | None = None) -> DataFrame:
    """Write one row per ``block``: its ids and vectors as bytes, and their limits.

    ``wanted`` gives the blocks that some vectors with limits want to meet."""
    single = dict(rows.dtypes)["embedding"] == "array<float>"

    def pack(table: pa.Table) -> pa.Table:
        matrix = _matrix(table.column("embedding"))
        limits = None if limit is None else table.column(limit).to_numpy()
        return pa.table(
            {
                "block": table.column("block").slice(0, 1),
                "ids": [table.column(name).to_numpy().tobytes()],
                "vectors": [matrix.astype(np.float32 if single else np.float64).tobytes()],
                "single": [single],
                "limits": pa.array([None if limits is None else limits.tobytes()], pa.binary()),
                "wanted": pa.array([None if wanted is None else wanted(matrix, limits)], pa.list_(pa.int64())),
            }
        )

    grouped = rows.groupBy("block").applyInArrow(pack, _PACKED)
    return materialise(grouped, "blocks")


def _unpacked(ids: pa.BinaryScalar, vectors: pa.BinaryScalar, single: bool) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids.as_buffer(), np.uint8).copy().view(np.int64)
    flat = np.frombuffer(vectors.as_buffer(), np.uint8).copy().view(np.float32 if single else np.float64)
    return names, flat.astype(np.float64).reshape(len(names), -1)


def _together(blocks: DataFrame) -> DataFrame:
    """Blocks of ``packed`` that have no limits put together to rows of about ``MEETING_BYTES``, each
    with the number of one of its blocks. As each row goes to a task once for every row that it
    meets, small blocks would move their bytes far more often than comparing them takes."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def joined() -> pa.RecordBatch:
            row = held[0] | {name: b"".join(h[name] for h in held) for name in ("ids", "vectors")}
            return pa.RecordBatch.from_pylist([row], schema=batch.schema)

        for batch in batches:
            for at in range(batch.num_rows):
                held += batch.slice(at, 1).to_pylist()
                size += len(held[-1]["vectors"])
                if size >= MEETING_BYTES:
                    yield joined()
                    held, size = [], 0
        if held:
            yield joined()

    return blocks.mapInArrow(join, blocks.schema)


def meet(asked: DataFrame, stored: DataFrame, k: int, together: bool = False) -> DataFrame:
    """Compare two tables of ``packed``, every block of one with those it wants of the other.

    Partitions of both sides meet in pairs, each read where it was written: nothing is copied
    or shuffled for a pair, and a question leaves a task with ``k`` rows at most. Blocks without
    limits may meet ``together``, as many as ``MEETING_BYTES`` hold.
    """
    side = math.ceil(math.sqrt(TASKS_PER_CORE * asked.sparkSession.sparkContext.defaultParallelism))
    asked, stored = (x.repartition(side) for x in (asked, stored.select("block", "ids", "vectors", "single")))
    if together:
        # written once: each partition is read for every partition of the other side
        asked, stored = (materialise(_together(x), "together").repartition(side) for x in (asked, stored))
    left, right = asked.select([F.col(c).alias(f"q_{c}") for c in asked.columns]), stored
    met = F.col("q_wanted").isNull() | F.array_contains("q_wanted", F.col("block"))
    pairs = left.hint("shuffle_replicate_nl").join(right, met).drop("q_wanted", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, names, matrix, limits = None, None, None, None, None
        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            for row in range(batch.num_rows):
                if at != (block := c["q_block"][row].as_py()):
                    if best is not None:
                        yield best.rows(names)
                    names, matrix = _unpacked(c["q_ids"][row], c["q_vectors"][row], c["q_single"][row].as_py())
                    told = c["q_limits"][row].as_py()
                    limits = None if told is None else np.frombuffer(told, np.float64)
                    at, best = block, _Nearest(len(names), k)
                ids, vectors = _unpacked(c["ids"][row], c["vectors"][row], c["single"][row].as_py())
                best.improve(matrix, vectors, ids, limits)
        if best is not None:
            yield best.rows(names)

    return pairs.mapInArrow(compare, NEIGHBOURS)


def _by_blocks(questions: DataFrame, vectors: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """Compare questions and vectors that share ``keys``, block against block.

    ``_qs`` and ``_vs`` say into how many blocks each side of a key is cut; every
    row is copied to all blocks of the other side. A key that holds a large share
    of the rows thus becomes many tasks of a bounded size, and nothing is dropped.
    """

    def fresh(name: str) -> list[Column]:
        # both sides may come from one table, so every column gets a new identity
        return [F.col(c).alias(c) for c in (*keys, "_q", "_v", name, "embedding")]

    left = (
        questions.withColumn("_q", F.pmod(F.xxhash64("index"), F.col("_qs")).cast("int"))
        .withColumn("_v", F.explode(F.sequence(F.lit(0), F.col("_vs") - 1)))
        .select(fresh("index"))
    )
    right = (
        vectors.withColumn("_v", F.pmod(F.xxhash64("vec_id"), F.col("_vs")).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1)))
        .select(fresh("vec_id"))
    )

    def compare(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if asked.num_rows == 0 or stored.num_rows == 0:
            return _ARROW.empty_table()
        owner, ids, distance = _nearest(
            _matrix(asked.column("embedding")),
            _matrix(stored.column("embedding")),
            stored.column("vec_id").to_numpy(),
            k,
        )
        names = asked.column("index").to_numpy()
        return pa.Table.from_arrays(
            [pa.array(names[owner]), pa.array(ids), pa.array(distance)], schema=_ARROW
        )

    group = [*keys, "_q", "_v"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, NEIGHBOURS)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate result also has."""
    hits = exact.select("index", "vec_id").join(
        approximate.select("index", "vec_id", F.lit(1).alias("_hit")), ["index", "vec_id"], "left"
    )
    return hits.agg(F.round(F.avg(F.coalesce(F.col("_hit"), F.lit(0))), 6).alias("recall"))
