from __future__ import annotations

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions import hashing, packing
from fathomline.functions import text as txt
from fathomline.operators import chunking
from fathomline.operators.cleaning import validate_records
from fathomline.plans.corpus import chunk_table, counted_chunk_table
from fathomline.sources.documents import load_pages


def column_of(spark, values, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r[1] for r in df.select("i", make(F.col("x"))).orderBy("i").collect()]


EDGES = [
    "a..b", "...", ". .", "a\tb", "a\x0bb", "a\xa0b", "a\x1cb", "a\x85b", "a b", "a　b",
    "  lead and trail  ", "", "a​b", "x....  y",
]


def python_clean(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\.{2,}", ".", text))


def test_clean_equals_python(spark):
    every = EDGES + [f"a{chr(c)}b" for c in range(1, 0x3100)]
    assert column_of(spark, every, txt.clean) == [python_clean(t) for t in every]


def test_only_runs_that_change_are_replaced(spark):
    # spaces between words made most of the time of cleaning
    texts = ["a b c", " ", "a  b", " \ta\n b", "\u3000 a\x1c"]
    counted = column_of(spark, texts, lambda x: F.regexp_count(x, F.lit(txt.WHITESPACE_RUN)))
    assert counted == [0, 0, 1, 2, 2]
    assert column_of(spark, texts, txt.collapse_whitespace) == ["a b c", " ", "a b", " a b", " a "]


def test_sentences(spark):
    texts = ["3.5 m. Next", "Hi!? Yes", "no end", "!!", "", "A. B. C."]
    found = column_of(spark, texts, lambda x: txt.sentences(txt.clean(x)))
    assert found == [["3.5 m.", "Next"], ["Hi!?", "Yes"], ["no end"], ["!!"], [], ["A.", "B.", "C."]]


def test_pieces_keep_the_digits_at_their_ends(spark):
    texts = ["0 a. 1 b 1. 21.2.3.4 c. 33", " 0, 1; 112 "]
    assert column_of(spark, texts, txt.sentences) == [["0 a.", "1 b 1.", "21.2.3.4 c.", "33"], ["0, 1; 112"]]
    assert column_of(spark, texts, txt.clauses)[1] == ["0,", "1;", "112"]


def test_token_counters(spark):
    assert column_of(spark, ["a b c", "a"], txt.count_tokens) == [3, 1]
    assert column_of(spark, ["abcde"], lambda x: txt.count_tokens(x, "chars")) == [2]
    with pytest.raises(ValueError):
        txt.count_tokens(F.lit("x"), "bytes")


def pack_by_hand(sizes, limit, overlap, least):
    total = [0]
    for n in sizes:
        total.append(total[-1] + n)
    out, start = [], 0
    for i in range(len(sizes)):
        if i - start >= least and total[i + 1] - total[start] > limit:
            out.append((start, i, total[i] - total[start]))
            start = next(
                j
                for j in range(start + 1, i + 1)
                if total[i] - total[j] <= overlap and (total[i + 1] - total[j] <= limit or j == i)
            )
    if sizes:
        out.append((start, len(sizes), total[-1] - total[start]))
    return out


@pytest.mark.parametrize("limit,overlap,least", [(10, 0, 1), (10, 4, 1), (10, 9, 3), (5, 5, 1), (50, 7, 2)])
def test_pack_equals_the_definition(spark, limit, overlap, least):
    rng = random.Random(limit * 100 + overlap)
    cases = [[], [99], [5, 5], [5, 5, 1], [1] * 30, [99, 1, 99]]
    cases += [[rng.randint(1, 12) for _ in range(rng.randint(1, 60))] for _ in range(30)]
    cases += [[rng.randint(1, 9) for _ in range(packing.BLOCK * 2 + 7)]]
    found = column_of(spark, cases, lambda x: packing.pack(x, limit, overlap, least), "array<int>")
    assert [[tuple(b) for b in row] for row in found] == [
        pack_by_hand(c, limit, overlap, least) for c in cases
    ]


def test_pack_at_breaks(spark):
    rng = random.Random(3)
    cases = []
    for n in [0, 1, 7, 40, packing.BLOCK + 30]:
        cases.append(([rng.randint(1, 9) for _ in range(n)], [rng.random() for _ in range(n)]))
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "i long, n array<int>, s array<double>"
    )
    rows = df.select("i", packing.pack_at_breaks(F.col("n"), F.col("s"), 20, 2, 0.3)).orderBy("i").collect()

    def by_hand(sizes, near):
        out, start = [], 0
        for i in range(len(sizes)):
            topic = i - start >= 2 and near[i] < 0.3
            if topic or (i > start and sum(sizes[start : i + 1]) > 20):
                out.append((start, i, sum(sizes[start:i])))
                start = i
        return out + ([(start, len(sizes), sum(sizes[start:]))] if sizes else [])

    assert [[tuple(b) for b in r[1]] for r in rows] == [by_hand(*c) for c in cases]


def test_hash_embedding(spark):
    import hashlib
    import math

    texts = ["Hello hello world_1", "", "a b c", "Über über ÜBER straße"]
    found = column_of(spark, texts, hashing.hash_embedding)
    for text, vector in zip(texts, found):
        counts = [0] * 64
        for term in re.findall(r"\w{2,}", text.lower()):
            counts[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % 64] += 1
        norm = math.sqrt(sum(c * c for c in counts)) or 1.0
        assert vector == pytest.approx([c / norm for c in counts])


def test_each_different_term_is_hashed_once(monkeypatch):
    import hashlib
    import math

    import pyarrow as pa

    seen, real = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda term, **told: seen.append(term) or real(term, **told))
    rows = [["ab", "cd", "ab"], None, [], ["ab", "é" * 2]]
    found = hashing.unit_counts(pa.array([["zz"], *rows, ["yy"]], pa.list_(pa.string())).slice(1, 4), 7).to_pylist()
    assert sorted(seen) == sorted(t.encode() for t in ("ab", "cd", "éé"))
    for row, vector in zip(rows, found):
        counts = [0] * 7
        for term in row or []:
            counts[int(real(term.encode()).hexdigest()[:8], 16) % 7] += 1
        norm = math.sqrt(sum(c * c for c in counts)) or 1.0
        assert vector == (None if row is None else [c / norm for c in counts])


def test_neighbour_similarities(spark):
    vectors = [[[1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [2.0, 0.0]], []]
    found = column_of(spark, vectors, hashing.neighbour_similarities, "array<array<double>>")
    assert found == [[0.0, 0.707107, 0.0, 0.0], []]


word = st.text(alphabet="abcdeé,;.!? ", min_size=0, max_size=200)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(word, min_size=1, max_size=5), st.integers(1, 30))
def test_nothing_is_lost_without_overlap(spark, texts, limit):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    pages = load_pages(docs).withColumn("text", txt.clean(F.col("text")))
    for chunks in (
        chunking.recursive_chunks(pages, limit),
        chunking.sentence_chunks(pages, limit, overlap=0),
    ):
        rows = sorted(chunks.collect(), key=lambda r: (r.doc_id, r.chunk_pos))
        for i, text in enumerate(texts):
            kept = "".join(r.text for r in rows if r.doc_id == i)
            assert kept.replace(" ", "") == python_clean(text).replace(" ", "")
    assert all(r.chunk_token_count <= limit for r in chunking.recursive_chunks(pages, limit).collect())


def test_unknown_chunker(spark):
    with pytest.raises(ValueError, match="not supported"):
        chunking.chunk_documents(spark.range(1), "token_chunker")


@pytest.mark.parametrize("partitions", [1, 7])
def test_chunk_numbers_are_dense_and_ordered(spark, partitions):
    rows = [(i * 10, ("One two. " * (i % 5)) + "\f" + "Three four five. " * 3, "s") for i in range(60)]
    rows.append((55, "", "empty"))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
    chunks = chunk_table(docs, chunk_size=6, overlap=0).collect()
    ordered = sorted(chunks, key=lambda r: (r.doc_id, r.page_no, r.chunk_pos))
    assert [r.chunk_index for r in ordered] == list(range(len(chunks)))
    assert 55 not in {r.doc_id for r in chunks}
    assert {r.page_no for r in chunks} == {0, 1}


def test_one_document_with_most_pages_is_spread(spark):
    text = "\f".join(f"Page {i} has words." for i in range(4000))
    docs = spark.createDataFrame([(1, text, "big"), (2, "Small one.", "s")], "doc_id long, text string, source string")
    chunks = chunk_table(docs)
    assert chunks.count() == 4001
    assert chunks.select(F.max("chunk_index")).first()[0] == 4000
    assert len(chunks.inputFiles()) > 1


def test_texts_are_read_once_and_counted_on_the_way(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(text):
        reads.add(1)
        return text

    rows = [(i % 40, f"One {i}.\fTwo {i}. Three.\f", "s") for i in range(100)] + [(7, None, "s"), (8, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    docs = docs.withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    chunks, counts = counted_chunk_table(docs, chunk_size=2, overlap=0)
    found = chunks.orderBy("chunk_index").collect()
    assert reads.value == len(rows)
    assert [r.chunk_index for r in found] == list(range(300))
    # pages that repeat an id keep numbers of their own, and their chunks stay together
    assert [(r.doc_id, r.page_no) for r in found] == sorted((r.doc_id, r.page_no) for r in found)
    assert all(b.chunk_pos in (0, a.chunk_pos + 1) for a, b in zip(found, found[1:]))
    assert {r.measure: r.n for r in counts.collect()} == {"pages": 301, "chunks": 300}
    assert spark.createDataFrame([], docs.schema).transform(chunk_table).count() == 0


def test_many_pages_number_the_same_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, "One. Two.\fThree. " * (i % 4), "s") for i in range(50)], "doc_id long, text string, source string"
    )
    whole = sorted(map(tuple, chunk_table(docs, chunk_size=1, overlap=0).collect()))
    monkeypatch.setattr(chunking, "broadcast_if_small", lambda df, size: df.hint("shuffle_hash"))
    assert sorted(map(tuple, chunk_table(docs, chunk_size=1, overlap=0).collect())) == whole


def test_validate_records(spark):
    df = spark.createDataFrame(
        [("q", ["a"]), (None, ["a"]), ("q", None), ("q", ["a", None])], "question string, docs array<string>"
    )
    valid, rejected = validate_records(df, ["question"], ["docs"])
    assert valid.count() == 1
    assert sorted(r.reason for r in rejected.collect()) == [
        "docs is incomplete", "docs is incomplete", "question is missing",
    ]
    with pytest.raises(TypeError):
        validate_records(df, ["docs"])
    with pytest.raises(TypeError):
        validate_records(df, [], ["question"])


def test_semantic_chunks_with_an_embedder(spark):
    import numpy as np

    def about(texts):
        return np.array([[1.0, 0.0] if "cat" in t else [0.0, 1.0] for t in texts])

    pages = spark.createDataFrame(
        [(1, 0, "A cat. My cat. Your dog. A dog. Old dog."), (2, 0, "")], "doc_id long, page_no int, text string"
    )
    chunks = chunking.chunk_documents(pages, "semantic_chunker", 100, min_sentences=1, embedder=about)
    assert [r.text for r in chunks.orderBy("chunk_pos").collect()] == ["A cat. My cat.", "Your dog. A dog. Old dog."]


def test_a_counter_of_the_caller(spark):
    from fathomline.operators import chunking

    pages = spark.createDataFrame(
        [(1, 0, "aa bb. cc dd, ee ff gg. hh.", ""), (2, 0, "", "")], "doc_id long, page_no int, text string, source string"
    )
    words = lambda texts: [len(t.split(" ")) for t in texts]
    for chunker in ("sentence_chunker", "recursive_chunker", "semantic_chunker"):
        built_in = chunking.chunk_documents(pages, chunker, 3)
        counted = chunking.chunk_documents(pages, chunker, 3, tokens=words)
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, built_in.collect()))
