"""Connected components of links that stay distributed.

Tasks first reduce their own links to a spanning forest by union-find. Large-star and
small-star rounds then link every node to the least node it can see, until only stars
are left. No task or driver ever holds more than its share of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.storage import materialise


class Forest:
    """Union-find with path halving; the least node of a tree is its root."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, node):
        parent = self.parent
        parent.setdefault(node, node)
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    def union(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list, list]:
        nodes = [n for n in self.parent if self.root(n) != n]
        return nodes, [self.root(n) for n in nodes]


def _task_forest(edges: DataFrame) -> DataFrame:
    """Links of one task as stars around its least nodes."""
    kind = edges.schema["a"].dataType.simpleString()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, types = Forest(), None
        for batch in batches:
            types = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                forest.union(a, b)
        if types is not None:
            nodes, roots = forest.stars()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, types), pa.array(roots, types)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(reduce, f"a {kind}, b {kind}")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "links")
    least = materialise(both.groupBy("a").agg(F.min("b").alias("least")), "least")
    seen = both.join(least, "a").where(F.col("b") > F.col("a"))
    return seen.select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least one."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = edges.join(least, "a").where(F.col("b") > F.col("least"))
    return least.select("a", F.col("least").alias("b")).union(
        moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    )


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one link and no link leads to a node that has one."""
    many = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    chained = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return many.select("a").union(chained.select("b")).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)`` that is not a root.

    The root of a component is its least node. Links may repeat, run either way or
    join a node to itself; a link with a null end is left out.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = materialise(_task_forest(links).distinct(), "forest")
    while not _all_stars(links):
        wide = materialise(_large_star(links).distinct(), "large-star")
        links = materialise(_task_forest(_small_star(wide)).distinct(), "small-star")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
