"""Ranked search against scores of all documents in plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import CLASHING, documents, empty, sentence
from pyspark.sql import functions as F

from fathomline.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    size, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    found = []
    for item, wanted in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * size) // length
            score = sum(
                math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in wanted
                if t in c
            )
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        for rank, (score, real, i) in enumerate(sorted(scores)[:k], 1):
            found.append((item, rank, i if real else None, -score))
    return found


def compared(spark, docs, items, k=10, **options):
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(c) for c in CLASHING})
    found = ranked.ranked_search(documents(spark, docs).repartition(6), table, k, **options)
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(plain(docs, items, k), key=key)


def corpus(n=400):
    rng = random.Random(3)
    docs = [(i, sentence(rng, int(rng.paretovariate(0.8) * 10) % 700, 300)) for i in range(n)]
    items = [(i, sentence(rng, 25, 300)) for i in range(20)]
    docs += [(1000 + i, items[3][1]) for i in range(30)]
    docs += [(2000, items[4][1] + " " + sentence(rng, 4000, 300)), (2001, items[4][1] * 50)]
    return docs, items


@pytest.mark.parametrize("k", [1, 10])
def test_matches_all_scores(spark, monkeypatch, k):
    # the functions are pickled by value, so the tasks see these
    monkeypatch.setattr(ranked, "BUCKET", 16)
    monkeypatch.setattr(ranked, "LONGEST", 40)
    compared(spark, *corpus(), k=k)


def test_several_passes(spark):
    docs, items = corpus(80)
    compared(spark, docs, items, item_bytes=1500)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "... --"), (None, "alpha beta"), (None, "alpha"), (4, "ALPHA É beta"), (4, "alpha beta"),
        (4, "alpha beta"), (-5, "alpha beta"), (6, "alpha " * 20_000), (7, "x_alpha-beta2 ünï"), (8, " alpha"),
    ]
    items = [(1, "Alpha BETA"), (1, "ünï x"), (2, None), (3, "--"), (None, "é"), (4, "unknown words"), (5, " alpha alpha")]
    compared(spark, docs, items)
    compared(spark, docs, items, k=2)


def test_term_in_all_documents_weighs_little(spark):
    compared(spark, [(i, "same") for i in range(2000)], [(1, "same")])


def test_empty(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked.ranked_search(empty(spark), items).collect() == []
    docs = documents(spark, [(1, "alpha")])
    assert ranked.ranked_search(docs, items.limit(0)).collect() == []
    with pytest.raises(ValueError):
        ranked.ranked_search(docs, items, 0)


def test_bounds_drop_no_hit():
    rng = np.random.default_rng(5)
    weights = rng.integers(1, 20_000, 60)
    rows = [np.unique(rng.integers(0, 60, rng.integers(1, 30))) for _ in range(200)]
    places = np.concatenate(rows)
    impacts = weights[places] * rng.integers(1, 1000, len(places))
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    norms = np.sqrt([(impacts[a:b].astype(float) ** 2).sum() for a, b in zip(bounds, bounds[1:])])
    bucket = ranked._Bucket(places, impacts, bounds, norms, 60)
    for _ in range(50):
        asked = rng.permutation(60)[: rng.integers(1, 25)]
        asked = asked[np.argsort(-weights[asked])]
        exact = np.array([impacts[a:b][np.isin(places[a:b], asked)].sum() for a, b in zip(bounds, bounds[1:])])
        for threshold in (1, int(np.median(exact)), int(exact.max())):
            found, scores = bucket.over(asked, max(threshold, 1))
            assert found.tolist() == np.flatnonzero(exact >= max(threshold, 1)).tolist()
            assert scores.tolist() == exact[found].tolist()
