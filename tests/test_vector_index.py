"""Search in cells gives what comparing everything gives, with less work."""

from __future__ import annotations

import re

import numpy as np
import pytest
from test_neighbours import brute, found, frame

from fathomline.operators import vector_index as module
from fathomline.operators.neighbours import knn_exact
from fathomline.operators.vector_index import knn_approx, open_vector_index, vector_index


def clustered(groups, size, width=16, seed=12, spread=0.5):
    rng = np.random.default_rng(seed)
    return np.concatenate([m + rng.normal(size=(size, width)) * spread for m in rng.normal(size=(groups, width)) * 4])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    stored = rng.normal(size=(300, 8))
    stored[100:200] = stored[0]  # a third of the vectors are copies
    stored[250] = 0
    return rng.normal(size=(40, 8)), stored


@pytest.mark.parametrize("k", [1, 5, 400])
@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("options", [{}, {"cells": 1}, {"cells": 300, "rounds": 0, "block_rows": 7}])
def test_without_structure(spark, data, k, small, options):
    asked, stored = data
    result = knn_approx(frame(spark, asked, "index"), frame(spark, stored, "vec_id").repartition(5), k, small=small, **options)
    assert found(result) == brute(asked, stored, k)


@pytest.mark.parametrize("small", [True, False])
def test_clustered_with_distances(spark, small):
    rows = clustered(30, 40) * 1000
    table = frame(spark, rows, "vec_id")
    asked = table.withColumnRenamed("vec_id", "index")
    result = knn_approx(asked, table, 10, block_rows=100, small=small)
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, knn_exact(asked, table, 10).collect()))


def test_work_follows_structure(spark):
    rows = clustered(60, 50)
    table = frame(spark, rows, "vec_id")
    asked = table.withColumnRenamed("vec_id", "index").where("index % 10 = 0")
    pairs = spark.sparkContext.accumulator(0)
    result = vector_index(table).search(asked, 10, compared=pairs)
    assert found(result) == found(knn_exact(asked, table, 10))
    assert pairs.value <= 0.2 * len(rows) * len(rows) / 10


def test_reopened_reads_only_near_blocks(spark, tmp_path):
    rows = clustered(40, 50)
    table = frame(spark, rows, "vec_id")
    vector_index(table, path=str(tmp_path / "kept"), block_rows=100).close()
    index = open_vector_index(spark, str(tmp_path / "kept"))
    asked = table.where("vec_id in (3, 17)").withColumnRenamed("vec_id", "index")
    result = index.search(asked, 5)
    plan = result._jdf.queryExecution().executedPlan().toString()
    read, every = map(int, re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan).groups())
    assert every >= 10 and read <= every / 4
    assert found(result) == found(knn_exact(asked, table, 5))
    assert {r["cell"] for r in index.cells.collect()} == {r["cell"] for r in index.vectors.select("cell").distinct().collect()}
    index.close()


def test_blocks_within_the_limits_meet_without_copies(spark, data):
    _, stored = data
    table = frame(spark, stored, "vec_id")
    result = knn_approx(table.withColumnRenamed("vec_id", "index"), table, 3, block_rows=20, small=False)
    assert "CartesianProduct" in result._jdf.queryExecution().executedPlan().toString()
    assert found(result) == brute(stored, stored, 3)


def test_hot_cell_is_cut_into_blocks(spark):
    rows = np.concatenate((np.tile([1.0, 2.0, 3.0], (500, 1)), clustered(5, 20, 3)))
    index = vector_index(frame(spark, rows, "vec_id"), block_rows=64)
    sizes = [r["count"] for r in index.vectors.groupBy("block").count().collect()]
    assert max(sizes) < 150 and sum(sizes) == len(rows)
    for small in (True, False):
        assert found(index.search(frame(spark, rows[495:505], "index"), 7, small)) == brute(rows[495:505], rows, 7)


def test_cells_are_bounded_by_memory(spark, monkeypatch):
    monkeypatch.setattr(module, "CENTRE_BYTES", 8 * 3 * 4)
    index = vector_index(frame(spark, clustered(5, 20, 3), "vec_id"))
    assert index.cells.count() <= 4


def test_edges(spark, data):
    asked, stored = data
    q, v = frame(spark, asked, "index"), frame(spark, stored, "vec_id")
    for small in (True, False):
        assert knn_approx(q.limit(0), v, 2, small=small).count() == 0
        assert knn_approx(q, v.limit(0), 2, small=small).count() == 0
        with pytest.raises(Exception, match="dimension"):
            knn_approx(frame(spark, asked[:, :4], "index"), v, 2, small=small).collect()
    for wrong in ({"k": 0}, {"k": 1, "cells": 0}):
        with pytest.raises(ValueError):
            knn_approx(q, v, **wrong)


def test_kept_index_answers_without_embedding_again(spark, tmp_path):
    from fathomline.plans.rag import DenseRag

    chunks = spark.createDataFrame([(i, "a" * i + "b") for i in range(30)], "chunk_index long, text string")
    vectors = spark.createDataFrame([(i, [float(i + 1), float(i)]) for i in range(30)], "vec_id long, embedding array<float>")
    vector_index(vectors, path=str(tmp_path / "kept")).close()

    def only_questions(texts):
        if any(t.startswith("b") or t.startswith("a") for t in texts):
            raise ValueError("a chunk was embedded")
        return np.array([[len(t), t.count("a")] for t in texts], dtype=float)

    rag = DenseRag(chunks, k=2, embedder=only_questions, dim=2, index=open_vector_index(spark, str(tmp_path / "kept")))
    asked = spark.createDataFrame([(0, "q" + "a" * 4)], "index long, question string")
    assert [r["chunk_index"] for r in rag.retrieve(asked).orderBy("rank").collect()] == [4, 3]
