from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from fixtures import documents, empty, sentence
from pyspark.sql import functions as F

from fathomline.llm import langid, mixing, quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    return read("documents"), read("labels")


def ranked(truth, score):
    """Share of pairs of unlike labels that are in the right order."""
    truth, score = np.array(truth), np.array(score)
    up, down = score[truth == 1], score[truth == 0]
    order = np.searchsorted(np.sort(down), up, "left") + np.searchsorted(np.sort(down), up, "right")
    return order.mean() / 2 / len(down)


def held_out(found, labels, column):
    rows = found.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = rows.select(column, "score").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "..."), (5, "日本語 é"), (6, "word"), (6, "word"), (6, "other"), (None, "word")]


def test_toxicity_on_held_out_documents(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    truth, score = held_out(toxicity.score(docs, model), labels, "toxic")
    assert ranked(truth, score) > 0.96
    caught = np.array(score) >= 0.5
    assert caught[np.array(truth) == 1].mean() > 0.85 and caught[np.array(truth) == 0].mean() < 0.03


def test_toxicity_locates_the_sentence(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        parts = [sentence(rng, 8, 60) for _ in range(6)]
        if i % 2:
            parts[rng.randrange(6)] += " nasty"
        rows.append((i, ". ".join(parts)))
        labels.append((i, i % 2, 1))
    docs = documents(spark, rows)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    found = toxicity.score(docs, toxicity.train(docs, frame)).collect()
    texts = dict(rows)
    for r in found:
        assert (r["score"] >= 0.5) == bool(r["doc_id"] % 2)
        spans = [texts[r["doc_id"]].encode()[s["start"] : s["end"]] for s in r["offending"]]
        assert len(spans) == r["n_offending"] == r["doc_id"] % 2
        assert all(b"nasty" in s and b"." not in s for s in spans)
    left = toxicity.drop_toxic(docs, toxicity.train(docs, frame))
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == set(range(0, 400, 2))


def test_toxicity_edges(spark):
    docs = documents(spark, EDGES)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, nothing)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(EDGES)
    scores = {(r["doc_id"], r["n_sentences"]): r["score"] for r in found}
    assert scores[(1, 0)] == scores[(2, 0)] == scores[(3, 0)] == scores[(4, 0)] == 0.0
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = spark.createDataFrame(
        [(6, 1, 1), (6, 0, 0), (5, None, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int"
    )
    assert toxicity.score(docs, toxicity.train(docs, odd)).count() == len(EDGES)
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), odd)).count() == 0


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    truth, score = held_out(quality.score(docs, model), labels, "quality")
    assert ranked(truth, score) > 0.98
    assert ((np.array(score) >= 0.3) == np.array(truth)).mean() > 0.95


def test_quality_edges(spark):
    docs = documents(spark, EDGES)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, nothing)).collect()} == {0.5}
    odd = spark.createDataFrame(
        [(6, 1, 1), (6, 0, 0), (5, None, None), (None, 1, 1), (1, 1, 1), (2, 0, 0), (4, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    found = quality.score(docs, quality.train(docs, odd)).collect()
    assert len(found) == len(EDGES) and all(0 <= r["score"] <= 1 for r in found)
    assert quality.score(empty(spark), quality.train(empty(spark), odd)).count() == 0


def test_dual_descent_reaches_the_optimum():
    """The primal and dual objectives of the hinge-loss model meet."""
    rng = np.random.default_rng(4)
    examples = [np.unique(rng.integers(0, 30, 6)) for _ in range(80)]
    truth = np.where([e.sum() % 3 == 0 for e in examples], 1.0, -1.0)
    scale = rng.normal(size=30)
    quality_rounds, quality.ROUNDS = quality.ROUNDS, 3000
    try:
        weights, bias = quality._dual_descent(examples, scale, truth, rng)
    finally:
        quality.ROUNDS = quality_rounds
    rows = [scale[e] / np.linalg.norm(scale[e]) for e in examples]
    margin = truth * np.array([weights[e] @ v + bias for e, v in zip(examples, rows)])
    primal = 0.5 * (weights @ weights + bias**2) + quality.COST * np.maximum(0, 1 - margin).sum()
    # any other weights are no better
    for _ in range(200):
        w, b = weights + rng.normal(scale=0.02, size=30), bias + rng.normal(scale=0.02)
        other = truth * np.array([w[e] @ v + b for e, v in zip(examples, rows)])
        assert primal <= 0.5 * (w @ w + b * b) + quality.COST * np.maximum(0, 1 - other).sum() + 1e-4


def test_language_on_held_out_documents(tables):
    docs, _ = tables
    found = langid.predict(docs, langid.train(docs))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    rows = rows.select("lang", "lang_pred", "score", "rejected").collect()
    right = np.array([r["lang"] == r["lang_pred"] for r in rows])
    assert right.mean() > 0.99
    kept = np.array([not r["rejected"] for r in rows])
    assert kept.mean() > 0.9 and right[kept].mean() > 0.99
    assert abs(np.mean([r["score"] for r in rows]) - right.mean()) < 0.03


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 3) for i in range(30)] + [(100 + i, "le chat et le chien " * 3) for i in range(30)]
    lang = {i: "en" for i in range(30)} | {100 + i: "fr" for i in range(30)}
    docs = documents(spark, rows, lang)
    model = langid.train(docs)
    asked = documents(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "the dog"), (5, "le chien"), (6, "日本"), (None, "the"), (4, "the dog")])
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()]
    assert len(found) == 8
    told = {i: (l, s) for i, l, s in found}
    assert told[1] == told[2] == told[3] == ("und", 0.0)
    assert told[4][0] == "en" and told[5][0] == "fr" and told[6][0] in ("en", "fr")
    untrained = langid.train(documents(spark, rows))
    assert {r["lang_pred"] for r in langid.predict(asked, untrained).collect()} == {"und"}
    assert langid.predict(empty(spark), langid.train(empty(spark))).count() == 0


def test_labels_of_held_out_documents_are_not_read(spark):
    rows = [(i, f"good words here {i}" if i % 2 else f"bad stuff there {i}") for i in range(200)]
    docs = documents(spark, rows)
    labels = [(i, i % 2, 1 - i % 2) for i in range(200)]
    wrong = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    for module in (quality, toxicity):
        a, b = (module.train(docs, spark.createDataFrame(x, schema)) for x in (labels, wrong))
        assert (a.weights == b.weights).all() and a.bias == b.bias


def plain_rates(posterior, share, targets, steps):
    """Projected gradient with a constant step."""
    rate = np.ones(len(share))
    for _ in range(steps):
        excess = (share * rate) @ posterior - targets
        rate = np.maximum(0, rate - posterior @ excess)
    return rate


@pytest.mark.parametrize("targets", [[0.5, 0.3, 0.2], [0.0, 0.1, 0.9], [0.2, 0.2, 0.6]])
def test_fitted_rates(spark, targets):
    rng = np.random.default_rng(6)
    posterior = rng.dirichlet([0.3, 0.3, 0.3], 60)
    n = rng.integers(0, 400, 60)
    rows = [(i, i, int(n[i]), *map(float, posterior[i])) for i in range(60)]
    members = spark.createDataFrame(rows, "_id long, _key long, n long, p0 double, p1 double, p2 double")
    fitted = mixing.fit_rates(members, targets).orderBy("_id").toPandas()
    share = n / n.sum()
    expected = plain_rates(posterior, share, np.array(targets), 20_000)
    assert (fitted["rate"] >= 0).all()
    squares = [(((share * r) @ posterior - targets) ** 2).sum() for r in (fitted["rate"].to_numpy(), expected)]
    # the second targets are out of reach, and the last steps towards them are small
    assert squares[0] <= squares[1] + (1e-12 if targets[0] else 2e-4)


def test_mixing_meets_targets(tables):
    docs, labels = tables
    targets = {"prose": 0.7, "junk": 0.2, "toxic": 0.1}
    found = mixing.mix(docs, mixing.quality_domains(labels), targets).toPandas()
    tokens = found["n"].to_numpy()
    for k, name in enumerate(sorted(targets)):
        share = (tokens * found["rate"] * found[f"p{k}"]).sum() / tokens.sum()
        assert abs(share - targets[name]) < 1e-3
    both = found.merge(mixing.quality_domains(labels).toPandas(), left_on="_id", right_on="doc_id")
    assert (both["domain"] == both["label"]).mean() > 0.9


def test_mixing_edges(spark):
    rows = [(i, "alpha beta gamma delta") for i in range(20)] + [(50 + i, "one two three four") for i in range(20)]
    rows += [(90, None), (91, ""), (None, "alpha beta"), (0, "alpha beta gamma delta"), (0, "unknown")]
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(20)] + [(50 + i, 0, None) for i in range(20)] + [(None, 1, 1), (3, 1, 0), (4, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    docs = documents(spark, rows)
    domains = mixing.quality_domains(labels)
    found = mixing.mix(docs, domains, {"prose": 3.0, "junk": 1.0})
    rates = {(r["_id"], r["n"]): (r["domain"], r["rate"]) for r in found.collect()}
    assert len(rates) == 44  # one id and text occurs twice
    assert rates[(1, 4)][0] == "prose" and rates[(55, 4)][0] == "junk"
    assert rates[(1, 4)][1] > 1 > rates[(55, 4)][1]
    mixed = mixing.mixed_documents(docs, domains, {"prose": 3.0, "junk": 1.0})
    assert mixed.columns[: len(docs.columns)] == docs.columns and len(mixed.columns) == len(docs.columns) + 3
    assert mixed.where("_copies < 1").count() == 0
    assert mixing.mix(empty(spark), domains, {"prose": 1.0}).count() == 0
    nobody = mixing.mix(docs, domains.limit(0), {"prose": 1.0, "junk": 1.0}).collect()
    assert {r["p0"] for r in nobody} == {0.5}
    with pytest.raises(ValueError):
        mixing.mix(docs, domains, {})


def test_no_python_in_the_mixing_plan(spark):
    docs = documents(spark, [(1, "a b"), (2, "c d")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    plan = mixing.posteriors(docs, mixing.quality_domains(labels), ["junk", "prose"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
