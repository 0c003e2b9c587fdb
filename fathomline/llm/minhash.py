"""Near-copies by SuperMinHash, banding, verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.components import components
from fathomline.llm.rows import BROADCAST_KEYS, KEY_BYTES, drop_rows, fresh, same_row, text_key
from fathomline.llm.words import mix, shingle_sets, text_chunks
from fathomline.storage import fits_in_memory, materialise

SLOTS = 120
BANDS = 24
SHINGLE_WORDS = 5
TILE_SETS = 512
TILE_SHINGLES = 1_000_000
COLUMNS = 4096
_RANK_BITS = np.uint64(48)
_STEP = np.uint64(0xD1B54A32D192ED03)
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(elements: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots) of the sets ``elements[bounds[i]:bounds[i + 1]]``.

    Every element carries its own random permutation of the slots, drawn step by step,
    and offers at step ``j`` the value ``(j, random)`` to the slot its permutation names.
    A slot keeps the least value. Step ``j`` is skipped for a row whose slots all hold
    values below ``j``: later offers cannot win (early stopping). All elements of all
    rows take a step together; taking minima in any order gives the same signature.
    An empty set has all slots at the largest value.
    """
    rows = len(bounds) - 1
    signature = np.full(rows * slots, _UNSET, np.uint64)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(rows), sizes)
    live = np.arange(len(elements))
    shuffled = None
    kind = np.uint8 if slots <= 256 else np.int32
    with np.errstate(over="ignore"):
        for step in range(slots):
            if step:
                worst = signature.reshape(rows, slots).max(axis=1)
                open_rows = (worst >= np.uint64(step) << _RANK_BITS) & (sizes > 0)
                keep = open_rows[owner[live]]
                if not keep.any():
                    break
                if not keep.all():
                    live = live[keep]
                    if shuffled is not None:
                        shuffled = shuffled[keep]
            state = mix(elements[live] + np.uint64(step + 1) * _STEP)
            rank = (np.uint64(step) << _RANK_BITS) | (state >> np.uint64(16))
            draw = (mix(state) >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)
            target = draw.astype(np.int64) + step
            if step == 0:
                slot = target
            else:
                if shuffled is None:  # replay the first swap for the elements that go on
                    shuffled = np.tile(np.arange(slots, dtype=kind), (len(live), 1))
                    first = mix(elements[live] + _STEP)
                    swapped = ((mix(first) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
                    at = np.arange(len(live))
                    shuffled[at, swapped] = 0
                    shuffled[:, 0] = swapped
                at = np.arange(len(live))
                slot = shuffled[at, target]
                shuffled[at, target] = shuffled[:, step]
                shuffled[:, step] = slot
                slot = slot.astype(np.int64)
            np.minimum.at(signature, owner[live] * slots + slot, rank)
    return signature.reshape(rows, slots)


_SIGNED = "doc_id long, key long, n long, set_id binary, buckets array<long>"


def _signed(slots: int, bands: int, words: int):
    """Task function: rows ``(doc_id, key, text)`` to set sizes, set ids and bucket values."""
    width = slots // bands

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for chunk in text_chunks(batch.column("text")):
                grams, bounds = shingle_sets(chunk, words)
                sizes = np.diff(bounds)
                signature = superminhash(grams, bounds, slots)
                with np.errstate(over="ignore"):
                    value = np.broadcast_to(salts, (chunk.rows, bands)).copy()
                    for k in range(width):
                        value = mix((value + signature[:, k : bands * width : width]) * _STEP)
                    total = np.zeros((chunk.rows, 2), np.uint64)
                    full = np.flatnonzero(sizes)
                    if len(full):
                        total[full, 0] = np.add.reduceat(mix(grams), bounds[:-1][full])
                        total[full, 1] = np.add.reduceat(mix(grams ^ _STEP), bounds[:-1][full])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(chunk.first, chunk.rows),
                        keys.slice(chunk.first, chunk.rows),
                        pa.array(sizes.astype(np.int64)),
                        pa.array([t.tobytes() for t in total], pa.binary()),
                        _lists(value.view(np.int64)),
                    ],
                    ["doc_id", "key", "n", "set_id", "buckets"],
                )

    return sign


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int):
    """Positions of all pairs of ``left`` and ``right`` sets that are linked.

    Intersections of all pairs come from products of 0/1 matrices over the elements that
    occur more than once, a few thousand elements at a time.
    """
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    number = np.cumsum(common) - 1
    shared = common[column]
    rows, column = rows[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    size = np.array([len(s) for s in sets])
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(common.sum()), COLUMNS):
        at, end = np.searchsorted(column, [low, low + COLUMNS])
        sides = []
        for side, many in ((0, len(left)), (1, len(right))):
            matrix = np.zeros((many, COLUMNS), np.float32)
            own = place[side, rows[at:end]]
            matrix[own[own >= 0], column[at:end][own >= 0] - low] = 1.0
            sides.append(matrix)
        both += sides[0] @ sides[1].T
    union = size[left][:, None] + size[right][None, :] - both
    i, j = np.nonzero((both * 100 >= union * percent) & (both > 0))
    a, b = left[i], right[j]
    return (a[a < b], b[a < b]) if left is right else (a, b)


def least_reachable(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` positions the least one it reaches by links ``(a, b)``."""
    root = np.arange(count)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _tile(percent: int, words: int):
    """Group function: the texts of a pair of blocks to links ``(a, b)`` that form a forest."""

    def link(group: pa.Table) -> pa.Table:
        own = group.column("own").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        sets = []
        for chunk in text_chunks(group.column("text")):
            grams, bounds = shingle_sets(chunk, words)
            sets += [grams[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        left = np.flatnonzero(own == low)
        right = left if low == high else np.flatnonzero(own == high)
        root = least_reachable(len(sets), *linked_pairs(sets, left, right, percent))
        moved = np.flatnonzero(root != np.arange(len(sets)))
        names = group.column("set_id").combine_chunks()
        return pa.table({"a": names.take(pa.array(moved)), "b": names.take(pa.array(root[moved]))})

    return link


def near_copies(
    docs: DataFrame,
    percent: int = 80,
    slots: int = SLOTS,
    bands: int = BANDS,
    words: int = SHINGLE_WORDS,
) -> DataFrame:
    """``(doc_id, key, n_shingles, component_id)`` for every row of ``docs``.

    Words are runs of non-space characters of the text with A-Z lower-cased; a row's set
    is its distinct shingles of ``words`` words, or the whole sequence if it has fewer.
    Rows are linked if ``100 * |intersection| >= percent * |union|``; links are confirmed
    on the full sets, and candidates share one of ``bands`` bands of the SuperMinHash
    signature. ``component_id`` is the least ``doc_id`` reachable by links. ``key`` is
    ``rows.text_key`` of the text.

    Rows with equal sets are one class from the start, and buckets with the same members
    are one bucket. The members of a bucket are dealt into blocks of about ``TILE_SETS``
    sets or ``TILE_SHINGLES`` shingles; each pair of blocks is one task group that computes
    all its intersections exactly and hands on a spanning forest. So a hot bucket becomes
    many groups of bounded size, and no pair is ever a row.

    Empty or null texts have no shingles and are linked with nothing: their component is
    their own id. Rows that repeat an id are told apart by their texts. A row without an
    id is grouped like any other but never names a group; a group without ids has a null
    component. An empty table gives an empty result. Other columns are ignored.
    """
    if slots % bands or not 0 < percent <= 100:
        raise ValueError("bands must divide slots, and percent lie in 1..100")
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text"
    )
    signed = materialise(plain.mapInArrow(_signed(slots, bands, words), _SIGNED), "signed")
    classes = materialise(
        signed.where("n > 0")
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct("doc_id", "key")).alias("row"),
            F.max("n").alias("n"),
            F.max("buckets").alias("buckets"),
        ),
        "classes",
    )
    roots = components(_links(plain, classes, percent, words))
    grouped = classes.join(roots, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "least_id", F.coalesce("root", "set_id").alias("root")
    )
    grouped = materialise(grouped, "grouped")
    least = materialise(grouped.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = materialise(grouped.join(least, "root").select("set_id", "component_id"), "named")
    rows = signed.select("doc_id", "key", F.col("n").alias("n_shingles"), "set_id")
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return (
        rows.where("n_shingles > 0")
        .join(named, "set_id")
        .select("doc_id", "key", "n_shingles", "component_id")
        .union(alone.select("doc_id", "key", "n_shingles", "component_id"))
    )


def _links(plain, classes, percent: int, words: int) -> DataFrame:
    """Links ``(a, b)`` between classes that share a bucket, as a forest of each tile."""
    members = classes.select(F.explode("buckets").alias("bucket"), "set_id", "n")
    # a bucket's content is told by its size and two sums without carry over its members
    contents = (
        members.groupBy("bucket")
        .agg(
            F.count("*").alias("size"),
            F.sum("n").alias("weight"),
            F.bit_xor(F.xxhash64("set_id")).alias("first"),
            F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("second"),
        )
        .where("size > 1")
        .groupBy("size", "weight", "first", "second")
        .agg(F.min("bucket").alias("bucket"))
    )
    blocks = F.greatest(F.ceil(F.col("size") / TILE_SETS), F.ceil(F.col("weight") / TILE_SHINGLES))
    kept = materialise(contents.select("bucket", blocks.cast("int").alias("blocks")), "buckets")
    placed = members.join(kept, "bucket").select(
        "bucket",
        "set_id",
        F.pmod(F.xxhash64(F.lit(2), "set_id"), F.col("blocks")).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    placed = materialise(
        placed.select(
            "bucket",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "own",
            "set_id",
        ),
        "placed",
    )
    texts = _candidate_texts(plain, classes, placed)
    tiles = placed.join(texts, "set_id").groupBy("bucket", "low", "high")
    return materialise(tiles.applyInArrow(_tile(percent, words), "a binary, b binary"), "links")


def _candidate_texts(plain: DataFrame, classes: DataFrame, placed: DataFrame) -> DataFrame:
    """``(set_id, text)``: one text of every class that shares a bucket with another."""
    wanted = materialise(placed.select("set_id").distinct(), "wanted")
    chosen = materialise(
        classes.join(wanted, "set_id", "left_semi")
        .select("set_id", F.col("row.doc_id").alias("_id"), F.col("row.key").alias("_key")),
        "chosen",
    )
    side = F.broadcast(chosen) if fits_in_memory(chosen, KEY_BYTES, BROADCAST_KEYS) else chosen
    found = plain.join(side, same_row(plain, side, "key")).select("set_id", "text")
    # rows that repeat both id and text give one copy each
    return materialise(found.dropDuplicates(["set_id"]), "texts")


def keep_one(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """``docs`` with one row of each group of near-copies: the one whose id names it.

    Rows that repeat both id and text of that row are copies too, and one of them stays.
    Groups without any id keep one row for each distinct text.
    """
    found = materialise(near_copies(docs, percent, **options), "near-copies")
    gone = materialise(
        found.where("doc_id != component_id or (doc_id is null and component_id is not null)")
        .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .distinct(),
        "gone",
    )
    left = drop_rows(docs, gone)
    repeated = found.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialise(
        repeated.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), "repeated"
    )
    if repeated.isEmpty():
        return left
    key = fresh(left, "_key")
    keyed = left.withColumn(key, text_key(F.col("text")))
    again = keyed.join(repeated, same_row(keyed, repeated, key), "left_semi")
    once = again.dropDuplicates(["doc_id", key]).drop(key)
    return drop_rows(left, repeated).union(once)
