from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomline.operators import indexing, retrieval
from fathomline.operators.indexing import tfidf_index

CHUNKS = [
    "the cat sat on the mat",
    "the dog sat on the log",
    "cats and dogs the the the",
    "the cat sat on the mat",
    "x y z",
    "the " * 50 + "rare_word",
]
QUESTIONS = ["the cat", "rare_word dog", "unknownterm", "x", "sat sat the mat"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(enumerate(CHUNKS)), "chunk_index long, text string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "index long, question string")


@pytest.fixture(scope="module")
def index(chunks):
    return tfidf_index(chunks)


def by_hand(k: int, pad: bool):
    def terms(text):
        return Counter(re.findall(r"\w{2,}", text.lower()))

    counts = [terms(c) for c in CHUNKS]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(CHUNKS)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        v = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors, out = [unit(c) for c in counts], []
    for q, question in enumerate(QUESTIONS):
        asked = unit(terms(question))
        scores = [(-round(sum(w * v.get(t, 0.0) for t, w in asked.items()), 6), i) for i, v in enumerate(vectors)]
        best = [s for s in sorted(scores) if pad or s[0] < 0][:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return out


def rows(df):
    return sorted((r["index"], r["rank"], r["chunk_index"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("pad", [True, False])
def test_retrieval_equals_brute_force(spark, chunks, questions, index, k, pad):
    found = rows(retrieval.tfidf_retrieve(questions, chunks, index, k, pad))
    expected = sorted(by_hand(k, pad))
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert [f[3] for f in found] == pytest.approx([e[3] for e in expected], abs=1e-6)


def test_large_question_sets_give_the_same(spark, chunks, questions, index):
    asked = indexing.question_terms(questions, index.idf, small=False)
    scores = retrieval.tfidf_scores(asked, index, small=False)
    hits = retrieval.attach_text(retrieval.top_k(scores, 3), chunks, small=False)
    assert rows(hits) == rows(retrieval.tfidf_retrieve(questions, chunks, index, 3, pad=False))


def test_rare_terms_by_shuffle_give_the_same_weights(spark, chunks, index, monkeypatch):
    whole = {(r.chunk_index, r.term): r.weight for r in index.weights.collect()}
    monkeypatch.setattr(indexing, "BLOCK", 2)
    for limit in (0, 100, 1 << 20):
        other = tfidf_index(chunks, limit=limit)
        assert {(r.chunk_index, r.term): r.weight for r in other.weights.collect()} == pytest.approx(whole)


def test_weights_have_unit_length(spark, index):
    sums = index.weights.groupBy("chunk_index").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert [r.s for r in sums] == pytest.approx([1.0] * len(sums))


def test_views_of_the_blocks(spark, chunks, index):
    postings = {(r.chunk_index, r.term): r.tf for r in index.postings.collect()}
    assert postings == {(r.chunk_index, r.term): r.tf for r in indexing.term_frequencies(chunks).collect()}
    idf = {r.term: r.idf for r in index.idf.collect()}
    assert idf == {
        r.term: r.idf
        for r in indexing.inverse_document_frequency(index.postings, indexing.corpus_size(chunks)).collect()
    }
    lengths = {r.chunk_index: r.length for r in index.lengths.collect()}
    for chunk, length in lengths.items():
        assert length == pytest.approx(math.sqrt(sum((n * idf[t]) ** 2 for (c, t), n in postings.items() if c == chunk)))


def test_scoring_does_not_move_the_postings(spark, chunks, questions, index):
    for small in (True, False):
        asked = indexing.question_terms(questions, index.idf, small=True)
        best = retrieval.best_chunks if small else retrieval.best_chunks_in_passes
        text = plan(retrieval.top_k(best(asked, index, 3), 3))
        assert text.count("WindowGroupLimit") == 2
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        # one exchange, of the hits after the first group limit
        assert text.count("Exchange") == text.count("Exchange hashpartitioning(index") == 1
        assert "In(term" in text and "Join" not in text


def corpus(spark, n=5000, seed=2):
    """Chunks of a few topics, neighbours alike, and questions on them."""
    rng = random.Random(seed)
    topic = lambda i: [f"t{i}w{rng.randrange(40)}" for _ in range(12)]
    common = lambda m: [f"common{rng.randrange(8)}" for _ in range(m)]
    texts = [" ".join(topic(i // 100) + common(10)) for i in range(n)]
    texts[900:950] = [texts[899]] * 50
    asked = [" ".join(topic(rng.randrange(n // 100)) + common(4)) for _ in range(60)] + [texts[899], "common1", "none at all"]
    return (
        spark.createDataFrame(list(enumerate(texts)), "chunk_index long, text string"),
        spark.createDataFrame(list(enumerate(asked)), "index long, question string"),
    )


def test_bounds_leave_out_blocks_and_no_hit(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 5000)
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", 10)
    monkeypatch.setattr(retrieval, "BLOCK", 128)
    monkeypatch.setattr(indexing, "BLOCK", 128)
    chunks, questions = corpus(spark, 3000)
    index = tfidf_index(chunks, buckets=2)
    asked = indexing.question_terms(questions, index.idf, small=True)
    every = rows(retrieval.top_k(retrieval.tfidf_scores(asked, index, True).where("score > 0"), 5))
    work = retrieval.Work(spark)
    assert rows(retrieval.top_k(retrieval.best_chunks(asked, index, 5, work), 5)) == every
    assert work.skipped() > 0.3
    found = retrieval.best_chunks_in_passes(asked, index, 5, limit=2000)
    assert plan(found).count("MapInArrow") > 5
    assert rows(retrieval.top_k(found, 5)) == every


def test_empty_corpus(spark, questions):
    none = spark.createDataFrame([], "chunk_index long, text string")
    found = retrieval.tfidf_retrieve(questions, none, tfidf_index(none), 3)
    assert found.count() == 0
    gathered = retrieval.gather_context(questions, found).collect()
    assert all(r.built_context == "" and r.retrieval_context == [] for r in gathered)


def test_context_follows_the_rank(spark, questions):
    hits = spark.createDataFrame(
        [(0, 2, "b"), (0, 1, "a"), (0, 3, "c"), (1, 1, "z")], "index long, rank int, text string"
    ).repartition(4)
    rows_ = {r["index"]: r for r in retrieval.gather_context(questions, hits).collect()}
    assert rows_[0].retrieval_context == ["a", "b", "c"]
    assert rows_[0].built_context == "a b c"
    assert rows_[2].retrieval_context == []


def test_kept_index_opens_with_its_buckets(spark, chunks, questions, tmp_path):
    path = str(tmp_path / "index")
    built = tfidf_index(chunks, path=path, buckets=3)
    before = retrieval.tfidf_retrieve(questions, chunks, built, 3).collect()
    built.close()
    again = indexing.open_index(spark, path)
    after = retrieval.tfidf_retrieve(questions, chunks, again, 3)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, before))
    scored = again.blocks.groupBy("block").count()
    assert "Exchange" not in plan(scored) and "SelectedBucketsCount: 3 out of 3" in plan(scored)
    again.close()
    assert not [t for t in spark.catalog.listTables() if t.name in plan(scored)]


def test_index_of_other_blocks_is_refused(spark, chunks, tmp_path, monkeypatch):
    tfidf_index(chunks, path=str(tmp_path / "index")).close()
    monkeypatch.setattr(indexing, "BLOCK", 7)
    with pytest.raises(ValueError, match="build it again"):
        indexing.open_index(spark, str(tmp_path / "index"))


def test_scratch_index_is_removed(spark, chunks):
    import os

    built = tfidf_index(chunks)
    files = [f.removeprefix("file://") for f in built.blocks.inputFiles() + built.idf.inputFiles()]
    assert all(os.path.exists(f) for f in files)
    built.close(remove=True)
    assert not any(os.path.exists(f) for f in files)


def test_scan_reads_only_question_terms_and_sorts_no_pairs(spark, chunks, questions, index):
    asked = indexing.question_terms(questions, index.idf, True)
    found = plan(retrieval.best_chunks(asked, index, 3))
    assert "PushedFilters: [In(term" in found or "In(term" in found
    assert "Aggregate" not in found.split("MapInArrow")[0] and "Window" not in found


@pytest.mark.parametrize("terms, at_once", [(1, 3), (7, 1), (1 << 10, 100)])
def test_blocks_do_not_change_the_scores(spark, chunks, questions, index, monkeypatch, terms, at_once):
    monkeypatch.setattr(retrieval, "CELLS", terms * retrieval.BLOCK)
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", at_once)
    monkeypatch.setattr(retrieval, "PASS_BYTES", 100)
    small, large = (
        sorted(map(tuple, retrieval.tfidf_retrieve(questions, chunks, index, 3, small=s).collect())) for s in (True, False)
    )
    assert small == large


@pytest.mark.parametrize("cost", [0, 64, 1 << 40])
def test_pairs_and_products_give_the_same_scores(spark, chunks, questions, index, monkeypatch, cost):
    """Cost 0 makes every term one of pairs, the largest makes every term a row of a product."""
    asked = retrieval.question_terms(questions, index.idf, True)
    every = {(r["index"], r["chunk_index"]): r["score"] for r in retrieval.best_chunks(asked, index, 5).collect()}
    monkeypatch.setattr(retrieval, "PAIR_COST", cost)
    found = {(r["index"], r["chunk_index"]): r["score"] for r in retrieval.best_chunks(asked, index, 5).collect()}
    assert found == every


@pytest.mark.parametrize("groups, cells", [(1, 1 << 23), (5, 1 << 23), (1000, 1 << 23), (3, 8 * 128 * 4), (3, 0)])
def test_bounds_of_groups_leave_out_no_hit(spark, monkeypatch, groups, cells):
    """Chunks share terms, so that groups of columns bound scores from far above."""
    for name, value in (("GROUPS", groups), ("WIDE_CELLS", cells), ("QUESTIONS_AT_ONCE", 20), ("BLOCK", 128)):
        monkeypatch.setattr(retrieval, name, value)
    monkeypatch.setattr(indexing, "BLOCK", 128)
    chunks, questions = corpus(spark, 1000)
    index = tfidf_index(chunks, buckets=1)
    asked = indexing.question_terms(questions, index.idf, small=True)
    every = rows(retrieval.top_k(retrieval.tfidf_scores(asked, index, True).where("score > 0"), 5))
    assert rows(retrieval.top_k(retrieval.best_chunks(asked, index, 5), 5)) == every


def test_later_buckets_only_look_for_better_chunks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROUNDS_FROM", 1, raising=False)
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    monkeypatch.setattr(indexing, "BLOCK", 64)
    chunks, questions = corpus(spark, 3000)
    # every bucket has some of every topic
    chunks = chunks.withColumn("chunk_index", F.expr("chunk_index * 1009 % 3000"))
    buckets = 6 * spark.sparkContext.defaultParallelism
    index = tfidf_index(chunks, buckets=buckets)
    asked = indexing.question_terms(questions, index.idf, small=True)
    every = rows(retrieval.top_k(retrieval.tfidf_scores(asked, index, True).where("score > 0"), 5))
    hits = retrieval.best_chunks_in_passes(asked, index, 5)
    assert rows(retrieval.top_k(hits, 5)) == every
    # every bucket handed on five chunks a question
    assert hits.groupBy("index").count().agg(F.sum("count")).first()[0] < 4 * 5 * questions.count()
