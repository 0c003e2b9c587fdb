"""Merkle proofs against plain loops."""

from __future__ import annotations

import hashlib

import pytest
from fixtures import CLASHING, empty
from pyspark.sql import functions as F

from fathomline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def told(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row) -> str:
    i, text, lang, source, n = row
    return sha("".join(map(told, (i, source, lang, n, text))))


def tree(nodes):
    """What remains of ``nodes`` and each node's path."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for p, i in zip(paths, at):
            run, slot = runs[i // 16], i % 16
            p.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at = [i // 16 for i in at]
        level = [sha("".join(run)) for run in runs]
    return level[0], paths


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for s in sources:
        ordered = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, paths = tree([leaf(r) for r in ordered])
        subroots.append(subroot)
        found.append(list(zip([r[0] for r in ordered], [leaf(r) for r in ordered], paths)))
    root, tops = tree(subroots)
    return [
        (i, s, place, digest, subroot, root, path + top)
        for s, subroot, top, group in zip(sources, subroots, tops, found)
        for place, (i, digest, path) in enumerate(group)
    ]


def compared(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in [*CLASHING, "g", "i", "node", "run", "path"]})
    found = merkle.proofs(df.repartition(5), {"again": merkle.leaf(), "other": merkle.leaf(text=F.lit("x"))})
    folded = found.select("*", merkle.folded(F.col("again"), F.col("path")).alias("f"), merkle.folded(F.col("other"), F.col("path")).alias("o"))
    result = []
    for r in folded.collect():
        assert r["f"] == r["root"] and r["o"] != r["root"]
        result.append((*r[:6], [tuple(p) for p in r["path"]]))
    key = lambda r: (str(r[1]), r[2])
    assert sorted(result, key=key) == sorted(plain(rows), key=key)


def test_sizes_and_order(spark):
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "e": 256, "f": 257, "ä": 33, "": 3, "\U0001f600": 2, "�": 2, None: 18}
    rows = [(k * 7 % 1000, f"T {s} {k}", None, s, k) for s, n in sizes.items() for k in range(n)]
    rows += [(10_000 + k, "one", "en", f"s{k}", None) for k in range(9)]
    compared(spark, rows)


def test_one_hot_source(spark):
    compared(spark, [(k, f"text {k}", "en", "hot", k) for k in range(4100)])


@pytest.mark.parametrize("n", [1, 2])
def test_few_rows(spark, n):
    rows = [(1, None, None, None, None), (1, "", None, None, None)][:n]
    compared(spark, rows)


def test_repeats_and_nulls(spark):
    rows = [(5, "a", None, "s", 1)] * 20 + [(5, "b", None, "s", 1), (None, "é" * 5000, "x", "s", None), (None, None, None, "s", -1)]
    compared(spark, rows)


def test_empty(spark):
    assert merkle.proofs(empty(spark)).collect() == []
