from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import neighbours
from fathomline.operators.embedding import embed_texts
from fathomline.operators.neighbours import knn_exact, recall


def frame(spark, matrix, name):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} long, embedding array<float>"
    )


def brute(asked, stored, k):
    out = []
    for q, a in enumerate(np.float32(asked).astype(float)):
        d = np.round(np.sqrt(((np.float32(stored).astype(float) - a) ** 2).sum(axis=1)), 6)
        out += [(q, r + 1, int(i)) for r, i in enumerate(sorted(range(len(d)), key=lambda i: (d[i], i))[:k])]
    return out


def found(df):
    return sorted((r["index"], r["rank"], r["vec_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    stored = rng.normal(size=(300, 8))
    stored[100:200] = stored[0]  # a third of the vectors are copies
    stored[250] = 0
    return rng.normal(size=(40, 8)), stored


@pytest.mark.parametrize("k", [1, 5, 400])
@pytest.mark.parametrize("small", [True, False])
def test_exact(spark, data, k, small):
    asked, stored = data
    result = knn_exact(frame(spark, asked, "index"), frame(spark, stored, "vec_id").repartition(5), k, small, 64)
    assert found(result) == brute(asked, stored, k)


def test_recall(spark):
    exact = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 7)], "index long, vec_id long")
    assert recall(exact, exact).first()["recall"] == 1.0
    assert recall(exact, exact.where("index = 1")).first()["recall"] == 0.5


def test_equal_distances_go_to_the_lower_id(spark, data):
    _, stored = data
    result = found(knn_exact(frame(spark, stored[:1], "index"), frame(spark, stored, "vec_id").repartition(7), 4))
    assert [r[2] for r in result] == [0, 100, 101, 102]


def test_wrong_dimension_fails(spark, data):
    asked, stored = data
    with pytest.raises(Exception, match="dimension"):
        knn_exact(frame(spark, asked[:, :4], "index"), frame(spark, stored, "vec_id"), 2).collect()
    with pytest.raises(ValueError):
        knn_exact(frame(spark, asked, "index"), frame(spark, stored, "vec_id"), 0)


def test_without_questions_or_vectors(spark, data):
    asked, stored = data
    assert knn_exact(frame(spark, asked[:0], "index"), frame(spark, stored, "vec_id"), 2).count() == 0
    assert knn_exact(frame(spark, asked, "index"), frame(spark, stored[:0], "vec_id"), 2).count() == 0


def test_all_against_all_of_one_table(spark, data):
    _, stored = data
    table = frame(spark, stored, "vec_id")
    asked = table.withColumnRenamed("vec_id", "index")
    assert found(knn_exact(asked, table, 3)) == brute(stored, stored, 3)
    assert found(knn_exact(asked, table, 3, small=False, block_rows=50)) == brute(stored, stored, 3)


def test_blocks_meet_without_copies_of_rows(spark, data):
    _, stored = data
    table = frame(spark, stored, "vec_id")
    result = knn_exact(table.withColumnRenamed("vec_id", "index"), table, 3, small=False, block_rows=7)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert found(result) == brute(stored, stored, 3)


@pytest.mark.parametrize("size", [1, 40 * 8 * 8, 1 << 22])
def test_small_blocks_meet_together(spark, data, monkeypatch, tmp_path, size):
    """Blocks of seven vectors do not send their bytes to a task once for every other block."""
    _, stored = data
    monkeypatch.setattr(neighbours, "MEETING_BYTES", size, raising=False)
    seen = spark.sparkContext.accumulator(0)
    unpacked = neighbours._unpacked

    def counted(*row):
        seen.add(1)
        return unpacked(*row)

    monkeypatch.setattr(neighbours, "_unpacked", counted)
    table = frame(spark, stored, "vec_id")
    result = knn_exact(table.withColumnRenamed("vec_id", "index"), table, 3, small=False, block_rows=7)
    assert found(result) == brute(stored, stored, 3)
    # 43 blocks a side; otherwise a row for every partition at most
    assert (seen.value > 43 * 43) == (size == 1)


def test_embedder_callable(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")

    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    rows = embed_texts(df, embedder=lengths, dim=2).orderBy("id").collect()
    assert [list(r.embedding) for r in rows] == [[2.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="shape"):
        embed_texts(df, embedder=lengths, dim=3).select(F.size("embedding")).collect()


def test_an_embedders_texts_are_not_all_strings_at_once(spark):
    def make():
        import tracemalloc

        tracemalloc.start()

        def measured(texts):
            return [[tracemalloc.get_traced_memory()[1] / 1e6, len(texts)] for _ in texts]

        return measured

    df = spark.range(0, 8000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    most = embed_texts(df, make_embedder=make, dim=2).agg(F.max(F.get("embedding", 0)), F.max(F.get("embedding", 1)))
    held, texts = most.first()
    # 80 MB of texts come as one batch, and are read as bytes; 1,024 of them are strings besides
    assert texts == 1024 and held < 110


def test_every_text_is_embedded_once(spark, tmp_path):
    from fathomline.plans.rag import DenseRag

    log = str(tmp_path)

    def embedder(texts):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(texts))
        return np.array([[len(t), t.count("a")] for t in texts], dtype=float)

    chunks = spark.createDataFrame([(i, "a" * i + "b") for i in range(30)], "chunk_index long, text string")
    asked = spark.createDataFrame([(i, "q" * (i + 1)) for i in range(5)], "index long, question string")
    for options in ({}, {"approximate": {"cells": 4}}):
        rag = DenseRag(chunks, k=2, embedder=embedder, dim=2, **options)
        rag.retrieve(asked).collect()
        seen = [line for f in tmp_path.iterdir() for line in f.read_text().split("\n")]
        assert len(seen) == len(set(seen)) == 35
        for f in tmp_path.iterdir():
            f.unlink()


def test_true_cells_of_a_matrix():
    rng = np.random.default_rng(2)
    for shape, share in [((0, 5), 0.5), ((3, 0), 0.5), ((7, 9), 0.2), ((16, 64), 0.01), ((5, 5), 1.0)]:
        mask = rng.random(shape) < share
        assert [x.tolist() for x in neighbours._true(mask)] == [x.tolist() for x in np.nonzero(mask)]


@pytest.mark.parametrize(
    "scale, moved", [(1.0, 0.0), (1.0, 1e4), (1e3, 2e3), (1e-4, 0.0), (1e18, 0.0), (1e20, 0.0), (0.0, 3.0)]
)
def test_limited_questions_miss_nothing(scale, moved):
    rng = np.random.default_rng(3)
    stored, ids = rng.normal(size=(900, 16)) * scale + moved, np.arange(900)
    stored[300:320] = stored[7]
    distance = np.round(np.sqrt(((stored[:60, None] - stored[None]) ** 2).sum(axis=2)), 6)
    expected = [sorted(ids, key=lambda i: (row[i], i))[:5] for row in distance]
    limits = np.sort(distance, axis=1)[:, 6]
    best = neighbours._Nearest(60, 5)
    for low in (600, 0, 300):
        best.improve(stored[:60], stored[low : low + 300], ids[low : low + 300], limits)
    assert best.ids.tolist() == expected
    assert best.distance.tolist() == np.take_along_axis(distance, best.ids, axis=1).tolist()
