"""A Merkle tree over a document table: digests, membership proofs and their folding.

Every level is a table of nodes with their place in their group. Fixed-offset lag and
lead columns, masked by a node's slot and the length of its run, hold its siblings; the
first child of each run hashes the parent. Windows span one run, so a hot source only
means more runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.storage import broadcast_if_small, in_order, materialise, number_rows

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_GROUP_BYTES = 96


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _told(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's ``FIELDS``, some of them replaced by other columns."""
    return digest(*[_told(changed.get(c, F.col(c))) for c in FIELDS])


def _numbered(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """Add ``i``, the place in the group ``g``, and ``n``, the size of the group."""
    placed = number_rows(in_order(nodes, "g", *order), "_at", label)
    groups = placed.groupBy("g").agg(F.min("_at").alias("_start"), F.count("*").alias("n"))
    groups = broadcast_if_small(groups, F.octet_length("g") + _GROUP_BYTES)
    return placed.join(groups, "g").withColumn("i", F.col("_at") - F.col("_start")).drop("_at", "_start")


def _linked(level: DataFrame) -> DataFrame:
    """Add ``run``, ``slot`` and the siblings to the ``left`` and ``right``, as one text each."""
    cut = level.withColumns({"run": F.floor(F.col("i") / FANOUT), "slot": F.col("i") % FANOUT})
    length = F.least(F.lit(FANOUT), F.col("n") - F.col("run") * FANOUT)
    run = W.partitionBy("g", "run").orderBy("i")
    before = [
        F.when(F.col("slot") >= k, F.lag("node", k).over(run)).otherwise("") for k in range(FANOUT - 1, 0, -1)
    ]
    after = [F.when(F.col("slot") + k < length, F.lead("node", k).over(run)).otherwise("") for k in range(1, FANOUT)]
    return cut.withColumns({"left": F.concat(*before), "right": F.concat(*after)})


def _parents(level: DataFrame) -> DataFrame:
    first = _linked(level.where("n > 1")).where("slot = 0")
    above = F.ceil(F.col("n") / FANOUT)
    return first.select("g", F.col("run").alias("i"), above.alias("n"), digest(F.col("node"), F.col("right")).alias("node"))


def _climb(leaves: DataFrame, label: str) -> list[DataFrame]:
    """The levels ``(g, i, n, node)`` of all groups; a group of one node goes no higher."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(materialise(_parents(levels[-1].select("g", "i", "n", "node")), label))
        most = -(-most // FANOUT)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """``(g, node)``: what remains of every group."""
    found = [level.where("n = 1").select("g", "node") for level in levels]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _descend(levels: list[DataFrame], crown: DataFrame) -> DataFrame:
    """The nodes of the first level with ``path``, the siblings on the way up, and the other
    columns of ``crown(g, path, ...)``, which holds one row per group."""
    told = [c for c in crown.columns if c not in ("g", "path")]
    above = None
    for level in reversed(levels):
        own = [c for c in level.columns if c not in ("n",)]
        here = level.where("n = 1").join(crown, "g").select(*own, "path", *told)
        if above is not None:
            ways = above.select("g", F.col("i").alias("run"), "path", *told)
            step = F.array(F.struct("left", "right"))
            longer = _linked(level.where("n > 1")).join(ways, ["g", "run"])
            here = here.unionByName(longer.select(*own, F.concat(step, "path").alias("path"), *told))
        above = here
    return above


def proofs(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, source, place, leaf, subroot, root, path)`` for every row of ``docs``, and the
    columns ``carried``, computed from the row where its leaf is.

    Leaves are grouped by ``source`` and ordered by ``doc_id``; a null source is a group of its
    own. While a group has several nodes, every ``FANOUT`` consecutive ones become their
    digest; the node left is the group's ``subroot``. Subroots, in the order of their sources
    by UTF-8 bytes with null first, become ``root`` likewise. ``path`` is an array of
    ``(left, right)``: the siblings at every level, as concatenated digests.

    Null fields have a mark of their own in the leaf, so a null text differs from an empty
    one. Rows of a source that repeat a ``doc_id`` are ordered by their leaf, a null ``doc_id``
    comes first, and equal rows are leaves of their own. A table without rows gives none.
    Other columns are ignored.
    """
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf().alias("node"),
        *[value.alias(f"carried_{name}") for name, value in (carried or {}).items()],
    )
    leaves = _numbered(materialise(rows, "leaves"), ["doc_id", "node"], "placed")
    levels = _climb(leaves, "nodes")
    subroots = _tops(levels).withColumnRenamed("g", "name").withColumn("g", F.lit(""))
    crown = _climb(_numbered(subroots, ["name"], "subroots"), "crown")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = _tops(crown).select("g", nothing.alias("path"), F.col("node").alias("root"))
    ways = _descend(crown, root).select(F.col("name").alias("g"), "path", F.col("node").alias("subroot"), "root")
    # read for every level on the way down, one row per source
    found = _descend(levels, materialise(ways, "ways"))
    return found.select(
        "doc_id",
        "source",
        F.col("i").alias("place"),
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        "path",
        *[F.col(f"carried_{name}").alias(name) for name in carried or {}],
    )


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf_digest, lambda node, step: digest(step["left"], node, step["right"]))
