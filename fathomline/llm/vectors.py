"""Near-copies among vectors by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.components import components
from fathomline.llm.minhash import least_reachable
from fathomline.storage import materialise

TILE = 1024
LEVELS = 127
PAIRS_AT_ONCE = 1 << 15
_TILE_ROWS = "set_id string, links long, root string"


def near_vectors(vectors: DataFrame, cosine: float = 0.98, tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row of ``vectors``.

    Rows are linked if their labels are equal and not null and the cosine of their
    vectors in double precision is at least ``cosine``. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the least ``vec_id`` reachable by links.

    Equal vectors of a label are one class. The classes of a label are dealt into blocks
    of about ``tile`` rows; each pair of blocks is one task group, so a hot label becomes
    many groups of bounded size. A group hands on link counts and a spanning forest,
    never pairs.

    A null label, and a vector that is null, empty, zero or holds a null or non-finite
    component, links with nothing: no links, its own component. Vectors of different
    lengths are not linked. Rows that repeat an id count as rows of their own; a row
    without an id counts as a link but never names a component. An empty table gives an
    empty result. Other columns are ignored.
    """
    value = F.col("embedding")
    sound = (
        F.col("label").isNotNull()
        & value.isNotNull()
        & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(value, lambda x: x != 0)
    )
    text = F.concat_ws(" ", F.col("label").cast("string"), F.concat_ws(",", value.cast("array<string>")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        value.cast("array<double>").alias("embedding"),
        F.when(F.coalesce(sound, F.lit(False)), F.sha2(text, 256)).alias("set_id"),
    )
    rows = materialise(rows, "vectors")
    classes = materialise(
        rows.where("set_id is not null")
        .groupBy("set_id")
        .agg(
            F.min("vec_id").alias("least_id"),
            F.count("*").alias("copies"),
            F.min("label").alias("label"),
            F.min("embedding").alias("embedding"),
        ),
        "classes",
    )
    told = materialise(_compared(classes, cosine, tile), "tiles")
    links = told.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = components(told.where("root != set_id").select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    grouped = (
        classes.join(roots, F.col("set_id") == F.col("node"), "left")
        .select("set_id", "least_id", "copies", F.coalesce("root", "set_id").alias("root"))
        .join(links, "set_id", "left")
    )
    grouped = materialise(grouped, "grouped")
    least = materialise(grouped.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = grouped.join(least, "root").select(
        "set_id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    named = materialise(named, "named")
    alone = rows.where("set_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = rows.where("set_id is not null").select("vec_id", "set_id").join(named, "set_id")
    return linked.select("vec_id", "n_links", "component_id").union(alone)


def _compared(classes: DataFrame, cosine: float, tile: int) -> DataFrame:
    """``(set_id, links, root)``: for each class with links in a pair of blocks, the rows it
    is linked with there and the root of its tree there."""
    sizes = classes.groupBy("label", F.size("embedding").alias("width")).agg(
        F.ceil(F.count("*") / tile).cast("int").alias("blocks")
    )
    sizes = materialise(sizes, "sizes")
    width = F.size("embedding")
    placed = classes.join(
        sizes, (classes["label"] == sizes["label"]) & (width == sizes["width"])
    ).select(
        classes["label"],
        "width",
        "set_id",
        "copies",
        "embedding",
        F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    placed = placed.select(
        "label",
        "width",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "own",
        "set_id",
        "copies",
        "embedding",
    )
    return placed.groupBy("label", "width", "low", "high").applyInArrow(_tile(cosine), _TILE_ROWS)


def _tile(cosine: float):
    def compare(group: pa.Table) -> pa.Table:
        own = group.column("own").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        flat = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix = flat.reshape(group.num_rows, -1)
        left = np.flatnonzero(own == low)
        right = left if low == high else np.flatnonzero(own == high)
        a, b = linked_pairs(matrix, left, right, cosine)
        copies = group.column("copies").to_numpy()
        links = np.zeros(group.num_rows, np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = least_reachable(group.num_rows, a, b)
        hit = np.flatnonzero(links)
        names = group.column("set_id").combine_chunks()
        return pa.table(
            {"set_id": names.take(pa.array(hit)), "links": links[hit], "root": names.take(pa.array(root[hit]))}
        )

    return compare


def quantised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of the unit vectors, their scales, and the exact length of what is lost."""
    # vectors are scaled by their largest component first, so squares neither vanish nor overflow
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / LEVELS
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((lost * lost).sum(axis=1))


def linked_pairs(matrix: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float):
    """Row numbers of all pairs of ``left`` and ``right`` rows with at least this cosine.

    With unit vectors u, w and their decoded codes u', w' the product u.w differs from
    u'.w' by at most |u - u'| + |u'| |w - w'|. Only pairs that may reach the threshold
    within that bound are computed again, in double precision. Codes are multiplied as
    whole numbers in floats that hold their sums exactly.
    """
    codes, scale, lost = quantised(matrix)
    exact = np.float32 if matrix.shape[1] * LEVELS * LEVELS < 1 << 24 else np.float64
    tall, wide = codes[left].astype(exact), codes[right].astype(exact).T
    found_a, found_b = [], []
    rows_at_once = max(1, (1 << 20) // max(len(right), 1))
    for at in range(0, len(left), rows_at_once):
        part = left[at : at + rows_at_once]
        product = (tall[at : at + rows_at_once] @ wide).astype(np.float64)
        product *= scale[part][:, None] * scale[right][None, :]
        slack = lost[part][:, None] + (1 + lost[part])[:, None] * lost[right][None, :] + 1e-9
        i, j = np.nonzero(product + slack >= cosine)
        a, b = part[i], right[j]
        if left is right:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), PAIRS_AT_ONCE):
            x, y = matrix[a[k : k + PAIRS_AT_ONCE]], matrix[b[k : k + PAIRS_AT_ONCE]]
            near = _cosine(x, y) >= cosine
            found_a.append(a[k : k + PAIRS_AT_ONCE][near])
            found_b.append(b[k : k + PAIRS_AT_ONCE][near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
