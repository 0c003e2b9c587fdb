"""A kept index of vectors in cells, and exact search that skips cells.

Centres come from Lloyd steps over a sample; every vector belongs to the cell of its nearest
centre, and a cell's radius is the distance of its farthest vector. A vector of a cell
is no nearer to a question than the centre's distance less the radius, so a cell beyond
a question's k-th best distance holds none of its neighbours. Results equal
``knn_exact``; only the work depends on how well the vectors cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.neighbours import (
    _ARROW,
    NEIGHBOURS,
    QUESTION_BYTES,
    ROWS_AT_ONCE,
    _by_blocks,
    _matrix,
    _Nearest,
    _nearest,
    meet,
    packed,
    rank_neighbours,
)
from fathomline.storage import (
    bucketed,
    drop_table,
    fits_in_memory,
    materialise,
    open_bucketed,
    remove_scratch,
    scratch_path,
    share,
    table_name,
)

#: bytes of all centres, which every task holds
CENTRE_BYTES = 32 * 1024 * 1024
#: Lloyd steps, and vectors a cell in the sample they use
ROUNDS = 3
SAMPLE_PER_CELL = 64
#: vectors in a block of cells, the unit that is read or skipped
BLOCK_ROWS = 4096
LEAST_BLOCK = 64
#: vectors compared before a question's limit is looked at again; then ever more
FIRST_LOOK = 256
#: covers the rounding of distances to six digits on both sides of a bound
ROUNDED = 4e-6
RELATIVE = 1e-9
_PARTS = 1_000_000


@dataclass
class Cells:
    """Centres by cell number, their vectors and radius, and the blocks that hold them:
    ``parts`` blocks from ``block`` on."""

    middle: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    block: np.ndarray
    parts: np.ndarray

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance of each question to each centre's vectors."""
        sums = (asked**2).sum(axis=1)[:, None] + (self.middle**2).sum(axis=1)[None, :]
        squared = sums - 2.0 * (asked @ self.middle.T)
        error = sums * (4 * np.finfo(np.float64).eps * (asked.shape[1] + 4))
        slack = self.radius * (1 + RELATIVE) + ROUNDED
        low = np.sqrt(np.maximum(squared - error, 0.0)) - slack
        return low, np.sqrt(np.maximum(squared, 0.0) + error) + slack

    def home(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Question rows and cells: of each question the nearest cells by their centres that
        hold ``k`` vectors together."""
        low, high = self.bounds(asked)
        order = np.argsort(low + high, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        owner, place = np.nonzero(before < k)
        return owner, order[owner, place]

    def reached(self, asked: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Which cells may hold a vector within each question's limit."""
        low, _ = self.bounds(asked)
        return low <= (limits * (1 + RELATIVE) + ROUNDED)[:, None]


@dataclass(frozen=True)
class VectorIndex:
    """``vectors(vec_id, embedding, cell, away, block)`` in buckets of ``block``, and the
    cells as ``(cell, embedding, rows, radius, block, parts)``."""

    vectors: DataFrame
    cells: DataFrame

    def search(
        self, questions: DataFrame, k: int, small: bool | None = None, compared: Accumulator | None = None
    ) -> DataFrame:
        """``(index, rank, vec_id, distance)``: the ``k`` nearest of every question, exactly.

        ``questions`` is ``(index, embedding)``. The vectors of a question's nearest cells
        give its limit; then only cells within the limit are compared, and blocks without
        one are not read. Questions that measure small are sent to the vectors; others
        meet the blocks they need in grouped tasks. ``compared`` adds up the pairs whose
        distance was bounded by products (small questions only).
        """
        if k < 1:
            raise ValueError("k must be positive")
        questions = questions.select("index", "embedding")
        if small is None:
            small = fits_in_memory(questions, F.size("embedding") * 8 + 8, QUESTION_BYTES)
        cells = _collected(self.cells)
        if not len(cells.rows):
            return questions.sparkSession.createDataFrame([], "index long, rank int, vec_id long, distance double")
        search = _search_small if small else _search_blocks
        return rank_neighbours(search(self.vectors, cells, questions, k, compared), k)

    def close(self, remove: bool = False) -> None:
        """Take the table out of the session; ``remove`` also deletes scratch folders."""
        if remove:
            remove_scratch(self.vectors)
            remove_scratch(self.cells)
        drop_table(self.vectors)


def _collected(cells: DataFrame) -> Cells:
    # bounded by CENTRE_BYTES
    table = cells.orderBy("cell").toArrow()
    column = lambda name: table.column(name).to_numpy()
    return Cells(_matrix(table.column("embedding")), *(column(c) for c in ("rows", "radius", "block", "parts")))


def _first_centres(vectors: DataFrame, cells: int) -> np.ndarray:
    """Different vectors in a fixed pseudo-random order of their ids, ``cells`` at most."""
    key = F.md5(F.col("vec_id").cast("string"))
    chosen = vectors.select("vec_id", "embedding").orderBy(key, "vec_id").limit(cells)
    return np.unique(_matrix(chosen.toArrow().column("embedding")), axis=0)


def _lloyd_step(sample: DataFrame, middle: np.ndarray) -> np.ndarray:
    """Centres moved to the mean of their vectors; tasks add up, then cells do."""
    shared = share(sample.sparkSession, middle)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared()
        total, rows = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column("embedding"))
                _, cell, _ = _nearest(matrix, centres, np.arange(len(centres)), 1)
                np.add.at(total, cell, matrix)
                rows += np.bincount(cell, minlength=len(centres))
        held = np.flatnonzero(rows)
        flat = pa.array(total[held].ravel())
        offsets = pa.array(np.arange(len(held) + 1) * centres.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(rows[held]), pa.ListArray.from_arrays(offsets, flat)], ["cell", "rows", "total"]
        )

    sums = sample.select("embedding").mapInArrow(partial, "cell long, rows long, total array<double>")
    by_axis = sums.select("cell", "rows", F.posexplode("total").alias("axis", "value"))
    mean = F.sum("value") / F.sum("rows")
    moved = by_axis.groupBy("cell", "axis").agg(mean.alias("mean")).toArrow()
    middle = middle.copy()
    middle[moved.column("cell").to_numpy(), moved.column("axis").to_numpy()] = moved.column("mean").to_numpy()
    return middle


def _measured(vectors: DataFrame, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and radius of every cell."""
    shared = share(vectors.sparkSession, middle)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared()
        rows, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for batch in batches:
            if batch.num_rows:
                _, cell, away = _nearest(_matrix(batch.column("embedding")), centres, np.arange(len(centres)), 1)
                rows += np.bincount(cell, minlength=len(centres))
                np.maximum.at(radius, cell, away)
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(rows[held]), pa.array(radius[held])], ["cell", "rows", "radius"]
        )

    parts = vectors.select("embedding").mapInArrow(measure, "cell long, rows long, radius double")
    told = parts.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius")).toArrow()
    rows, radius = np.zeros(len(middle), np.int64), np.zeros(len(middle))
    rows[told.column("cell").to_numpy()] = told.column("rows").to_numpy()
    radius[told.column("cell").to_numpy()] = told.column("radius").to_numpy()
    return rows, radius


def _packed(middle: np.ndarray, rows: np.ndarray, radius: np.ndarray, block_rows: int) -> Cells:
    """Cells in blocks of about ``block_rows`` vectors: neighbours along the main axis of the
    centres share one, and a larger cell is cut into several."""
    held = np.flatnonzero(rows)
    middle, rows, radius = middle[held], rows[held], radius[held]
    moved = middle - middle.mean(axis=0)
    axis = np.linalg.eigh(moved.T @ moved)[1][:, -1]
    block, parts = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
    at, filled = 0, 0
    for c in np.argsort(moved @ axis, kind="stable"):
        if filled and filled + rows[c] > block_rows:
            at, filled = at + 1, 0
        block[c], parts[c] = at, -(-rows[c] // block_rows)
        filled += rows[c]
        if parts[c] > 1:
            at, filled = at + parts[c], 0
    return Cells(middle, rows, radius, block, parts)


def _placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Add the cell, the distance to its centre and the block of every vector."""
    shared = share(vectors.sparkSession, cells)
    kind = dict(vectors.dtypes)["embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for batch in batches:
            if batch.num_rows:
                _, cell, away = _nearest(
                    _matrix(batch.column("embedding")), known.middle, np.arange(len(known.rows)), 1
                )
                part = batch.column("part").to_numpy() % known.parts[cell]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("embedding"), pa.array(cell), pa.array(away), pa.array(known.block[cell] + part)],
                    ["vec_id", "embedding", "cell", "away", "block"],
                )

    part = F.pmod(F.xxhash64("vec_id"), F.lit(_PARTS)).alias("part")
    return vectors.select("vec_id", "embedding", part).mapInArrow(
        place, f"vec_id long, embedding {kind}, cell long, away double, block long"
    )


def vector_index(
    vectors: DataFrame,
    cells: int | None = None,
    path: str | None = None,
    rounds: int = ROUNDS,
    block_rows: int | None = None,
) -> VectorIndex:
    """Index a written table ``(vec_id, embedding)``; it is read once per step.

    ``cells`` is by default the square root of the number of vectors, as far as all centres
    take ``CENTRE_BYTES`` at most. Centres start as vectors and move ``rounds`` times to the
    mean of a hash sample of about ``SAMPLE_PER_CELL`` vectors a cell; all vectors are indexed.
    Neighbouring cells share a block of about ``block_rows`` vectors, a hot cell has several.
    With ``path`` the index is kept there for ``open_vector_index``, else in scratch folders.
    """
    if cells is not None and cells < 1:
        raise ValueError("cells must be positive")
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    count = vectors.count()
    first = vectors.select(F.size("embedding")).first()
    width = max(1, first[0] if first else 1)
    cells = max(1, min(cells or math.isqrt(count), CENTRE_BYTES // (8 * width)))
    if block_rows is None:
        block_rows = max(LEAST_BLOCK, min(BLOCK_ROWS, count // (2 * spark.sparkContext.defaultParallelism)))
    middle = _first_centres(vectors, cells)
    if count:
        share = min(1.0, cells * SAMPLE_PER_CELL / count)
        sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(_PARTS)) < share * _PARTS)
        for _ in range(rounds):
            middle = _lloyd_step(sample, middle)
        known = _packed(middle, *_measured(vectors, middle), block_rows)
    else:
        none = np.zeros(0, np.int64)
        known = Cells(middle, none, np.zeros(0), none, none)
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    buckets = max(1, min(most, int((known.block + known.parts).max(initial=1))))
    part = lambda name: None if path is None else f"{path}/{name}"
    placed = _placed(vectors, known).repartition(buckets, "block")
    written = bucketed(placed, "block", buckets, table_name("vectors"), "cell", path=part("vectors"))
    table = pa.table(
        {
            "cell": pa.array(np.arange(len(known.rows))),
            "embedding": pa.array(list(known.middle), pa.list_(pa.float64())),
            "rows": known.rows,
            "radius": known.radius,
            "block": known.block,
            "parts": known.parts,
        }
    )
    folder = part("cells") or scratch_path(spark, "cells")
    spark.createDataFrame(table).coalesce(1).write.parquet(folder)
    if path is not None:
        layout = spark.createDataFrame([(buckets, dict(vectors.dtypes)["embedding"])], "buckets int, kind string")
        layout.coalesce(1).write.json(part("layout"))
    return VectorIndex(written, spark.read.parquet(folder))


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``vector_index`` kept at ``path``."""
    layout = spark.read.schema("buckets int, kind string").json(f"{path}/layout").first()
    schema = f"vec_id BIGINT, embedding {layout['kind']}, cell BIGINT, away DOUBLE, block BIGINT"
    vectors = open_bucketed(spark, f"{path}/vectors", schema, "block", layout["buckets"], "vectors", "cell")
    return VectorIndex(vectors, spark.read.parquet(f"{path}/cells"))


def _read_blocks(vectors: DataFrame, cells: Cells, wanted: np.ndarray) -> DataFrame:
    """The vectors of the blocks that hold a wanted cell; other buckets are not read."""
    blocks = {b for c in np.flatnonzero(wanted) for b in range(cells.block[c], cells.block[c] + cells.parts[c])}
    if len(blocks) == int((cells.block + cells.parts).max()):
        return vectors
    return vectors.where(F.col("block").isin(sorted(int(b) for b in blocks)))


def _by_cell(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matrix and ids of a batch in order of cells, the cells there, and where each begins."""
    cell = batch.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    here, begins = np.unique(cell[order], return_index=True)
    ids = batch.column("vec_id").to_numpy()[order]
    return _matrix(batch.column("embedding"))[order], ids, here, np.append(begins, len(order))


def _compare(asked, limits, best: _Nearest, cells: Cells, batch: pa.RecordBatch, k: int) -> int:
    """Improve ``best`` by a batch of vectors; the number of pairs compared.

    For a block of questions the batch's cells come in order of their least distance, a
    few vectors first and then ever more; cells beyond a question's limit are left out.
    """
    matrix, ids, here, begins = _by_cell(batch)
    part = Cells(cells.middle[here], np.diff(begins), cells.radius[here], here, here)
    pairs = 0
    for low in range(0, len(asked), ROWS_AT_ONCE):
        rows = np.arange(low, min(low + ROWS_AT_ONCE, len(asked)))
        least, _ = part.bounds(asked[rows])
        order = np.argsort(least.min(axis=0), kind="stable")
        look = FIRST_LOOK
        while len(order):
            limit = np.minimum(limits[rows], best.distance[rows, -1])
            open_ = least <= (limit * (1 + RELATIVE) + ROUNDED)[:, None]
            order = order[open_[:, order].any(axis=0)]
            sizes = np.cumsum(part.rows[order])
            now, order = np.split(order, [int(np.searchsorted(sizes, look)) + 1])
            active = np.flatnonzero(open_[:, now].any(axis=1))
            if len(active):
                chosen = np.concatenate([np.arange(begins[c], begins[c + 1]) for c in now])
                part_best = _Nearest(len(active), k)
                part_best.improve(asked[rows[active]], matrix[chosen], ids[chosen], limit[active])
                best.add(rows[active], *part_best.hits())
                pairs += len(active) * len(chosen)
            look *= 4
    return pairs


def _search_small(
    vectors: DataFrame, cells: Cells, questions: DataFrame, k: int, compared: Accumulator | None
) -> DataFrame:
    # bounded by QUESTION_BYTES, measured by the caller
    table = questions.toArrow()
    asked = _matrix(table.column("embedding"))
    if len(asked) and asked.shape[1] != cells.middle.shape[1]:
        raise ValueError(f"dimension {asked.shape[1]} differs from {cells.middle.shape[1]}")
    # neighbouring questions stand together, so that their blocks skip the same cells
    at = lambda low: slice(low, low + ROWS_AT_ONCE)
    starts = range(0, len(asked), ROWS_AT_ONCE)
    home = [cells.home(asked[at(low)], k) for low in starts]
    owner = np.concatenate([np.zeros(0, np.int64)] + [o + low for (o, _), low in zip(home, starts)])
    place = np.concatenate([np.zeros(0, np.int64)] + [c for _, c in home])
    first = place[np.searchsorted(owner, np.arange(len(asked)))] if len(asked) else owner
    order = np.argsort(cells.block[first], kind="stable")
    names, asked = table.column("index").to_numpy()[order], asked[order]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    sort = np.lexsort((back[owner], place))
    owner, place = back[owner][sort], place[sort]
    spark = questions.sparkSession
    shared = share(spark, (names, asked, owner, place, cells))

    def near_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, owner, place, cells = shared()
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, ids, here, begins = _by_cell(batch)
            for c, low, high in zip(here, begins, begins[1:]):
                rows = owner[slice(*np.searchsorted(place, [c, c + 1]))]
                if len(rows):
                    who, found, distance = _nearest(asked[rows], matrix[low:high], ids[low:high], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[who]), pa.array(found), pa.array(distance)], schema=_ARROW
                    )

    homes = np.bincount(place, minlength=len(cells.rows)) > 0
    tried = _read_blocks(vectors, cells, homes).mapInArrow(near_home, NEIGHBOURS)
    last = rank_neighbours(tried, k).where(F.col("rank") == k).select("index", "distance").toArrow()
    limits = np.full(len(asked), np.inf)
    limits[last.column("index").to_numpy()] = last.column("distance").to_numpy()
    needed = np.zeros(len(cells.rows), bool)
    for low in starts:
        needed |= cells.reached(asked[at(low)], limits[at(low)]).any(axis=0)
    reach = share(spark, limits)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, _, _, cells = shared()
        best, pairs, within = _Nearest(len(asked), k), 0, reach()
        for batch in batches:
            if batch.num_rows:
                pairs += _compare(asked, within, best, cells, batch, k)
        if compared is not None:
            compared.add(pairs)
        yield best.rows(names)

    return _read_blocks(vectors, cells, needed).mapInArrow(search, NEIGHBOURS)


def _search_blocks(
    vectors: DataFrame, cells: Cells, questions: DataFrame, k: int, compared: Accumulator | None
) -> DataFrame:
    """Questions meet the blocks of their nearest cells, which limits them. Then those of one
    home are packed together and meet all blocks within their limits."""
    shared = share(questions.sparkSession, cells)
    kind = dict(questions.dtypes)["embedding"]
    stored = vectors.select("block", "vec_id", "embedding")

    def sent(rows: DataFrame, pick) -> DataFrame:
        """Questions with every block that ``pick`` names for them."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = shared()
            for batch in batches:
                for part in (batch.slice(low, ROWS_AT_ONCE) for low in range(0, batch.num_rows, ROWS_AT_ONCE)):
                    asked = _matrix(part.column("embedding"))
                    if asked.shape[1] != cells.middle.shape[1]:
                        raise ValueError(f"dimension {asked.shape[1]} differs from {cells.middle.shape[1]}")
                    owner, block = pick(cells, asked)
                    rows = part.take(pa.array(owner))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("index"), rows.column("embedding"), pa.array(block)], ["index", "embedding", "block"]
                    )

        return materialise(rows.mapInArrow(send, f"index long, embedding {kind}, block long"), "home")

    def sized(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("block").agg(F.count("*").alias("_n"))
        # one row per block, whose cells fit in memory
        return F.broadcast(
            counts.select("block", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_qs"), F.lit(1).alias("_vs"))
        )

    def home(cells: Cells, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner, cell = cells.home(asked, k)
        pair = np.unique(np.stack((owner, cells.block[cell] + owner % cells.parts[cell])), axis=1)
        return pair[0], pair[1]

    def within(asked: np.ndarray, limits: np.ndarray) -> list[int]:
        cells, needed = shared(), False
        for low in range(0, len(asked), ROWS_AT_ONCE):
            at = slice(low, low + ROWS_AT_ONCE)
            needed = needed | cells.reached(asked[at], limits[at]).any(axis=0)
        return sorted({int(b) for c in np.flatnonzero(needed) for b in range(cells.block[c], cells.block[c] + cells.parts[c])})

    homes = sent(questions, home)
    sizes = sized(homes)
    tried = rank_neighbours(
        _by_blocks(homes.join(sizes, "block"), stored.join(sizes, "block"), k, ("block",)), k
    )
    limits = materialise(tried.where(F.col("rank") == k).select("index", "distance"), "limits")
    # one home each, in parts of a bounded size
    asked = homes.groupBy("index", "embedding").agg(F.min("block").alias("block")).join(limits, "index", "left")
    part = F.pmod(F.xxhash64("index"), F.col("_qs"))
    asked = asked.join(sizes, "block").withColumns(
        {"distance": F.coalesce("distance", F.lit(float("inf"))), "block": F.col("block") * _PARTS + part}
    )
    return meet(packed(asked, "index", "distance", within), packed(stored, "vec_id"), k)


def knn_approx(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    cells: int | None = None,
    rounds: int = ROUNDS,
    block_rows: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """The ``k`` nearest of every question through an index of cells made for this search.

    It saves work as an approximate search does, and still finds every neighbour: the
    result is that of ``knn_exact``. Keep a ``vector_index`` if more searches follow.
    """
    if k < 1:
        raise ValueError("k must be positive")
    return vector_index(vectors, cells, rounds=rounds, block_rows=block_rows).search(questions, k, small)
