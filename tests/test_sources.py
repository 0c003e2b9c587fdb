from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fathomline.schemas import require
from fathomline.sources.config import DEFAULT_CONFIG, metric_config, select_metrics
from fathomline.sources.delimited import read_delimited, write_delimited
from fathomline.sources import documents
from fathomline.sources.documents import list_documents, load_binary_pages, load_pages
from fathomline.sources.records import head_n, read_qa_dataset, rename_columns, write_json
from fathomline.sources.vectors import load_vectors


def test_json_array_empty_and_broken_files(spark, tmp_path):
    records = [{"index": i, "question": f"q{i} ü", "answer": "a", "context": "c"} for i in range(3)]
    (tmp_path / "good.json").write_text(json.dumps(records), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "cut.json").write_text('[{"index": 7, "question": "q')
    good, broken = read_qa_dataset(spark, str(tmp_path / "good.json"))
    assert [r.question for r in head_n(good, 2).collect()] == ["q0 ü", "q1 ü"]
    assert broken.count() == 0
    assert read_qa_dataset(spark, str(tmp_path / "empty.json"))[0].count() == 0
    good, broken = read_qa_dataset(spark, str(tmp_path / "cut.json"))
    assert good.count() == 0
    assert broken.first()["raw"].startswith('[{"index": 7')


def test_json_is_written_as_utf8(spark, tmp_path):
    path = str(tmp_path / "out")
    write_json(spark.createDataFrame([(1, "é ß 漢"), (2, None)], "index long, question string"), path)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "é ß 漢" in text
    assert read_qa_dataset(spark, path, array_files=False)[0].count() == 2


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\tc'), (2, "ü; ,")], "id long, text string")
    write_delimited(df, str(tmp_path / "t"))
    back = read_delimited(spark, str(tmp_path / "t"), "id long, text string", schema_map={"text": "body", "x": "y"})
    assert back.columns == ["id", "body"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_rename_ignores_unknown_names(spark):
    assert rename_columns(spark.range(1), {"id": "n", "nope": "m"}).columns == ["n"]
    assert rename_columns(spark.range(1), None).columns == ["id"]


def test_listing_filters_names_and_keeps_hidden_ones(spark, tmp_path, monkeypatch):
    (tmp_path / "sub" / "_deep").mkdir(parents=True)
    for name in ("a.pdf", "b.PDF", "c.txt", "sub/d.pdf", "_c.pdf", ".e.pdf", "sub/_deep/f g.pdf", "ü.pdf"):
        (tmp_path / name).write_text("x" * len(name))

    def names(root, **options):
        found = list_documents(spark, str(root), **options).collect()
        return sorted((r.path.removeprefix(f"{tmp_path}/"), r.length) for r in found)

    every = ["a.pdf", "sub/d.pdf", "_c.pdf", ".e.pdf", "sub/_deep/f g.pdf", "ü.pdf"]
    expected = sorted((n, len(n)) for n in every)
    assert names(tmp_path) == expected
    assert names(f"file://{tmp_path}") == expected
    # tasks list what the driver has not opened
    monkeypatch.setattr(documents, "OPENED_FOLDERS", 1)
    assert names(tmp_path) == expected
    assert names(tmp_path / "a.pdf") == [("a.pdf", 5)] and names(tmp_path / "c.txt") == []
    assert names(tmp_path / "none") == [] and names(tmp_path, suffix=".txt") == [("c.txt", 5)]


@pytest.mark.parametrize("task_bytes", [1, 40, 1 << 20])
def test_binary_pages_by_size(spark, tmp_path, task_bytes):
    (tmp_path / "_hidden").mkdir()
    sizes = {f"{'_hidden/' if i % 2 else ''}_{i}.bin": i for i in range(30)}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(b"x" * size)
    pages, failed = load_binary_pages(spark, str(tmp_path), lambda c: [str(len(c)), "end"], ".bin", task_bytes)
    found = sorted((r.source.removeprefix(f"{tmp_path}/"), r.page_no, r.text) for r in pages.collect())
    assert found == sorted((n, p, t) for n, size in sizes.items() for p, t in enumerate((str(size), "end")))
    assert failed.count() == 0 and pages.select("doc_id").distinct().count() == 30
    assert load_binary_pages(spark, str(tmp_path / "none"), lambda c: [""])[0].count() == 0


def test_pages(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one\ftwo\f", "s")], "doc_id long, text string, source string")
    assert [r.text for r in load_pages(docs).orderBy("page_no").collect()] == ["one", "two", ""]
    (tmp_path / "a.pdf").write_bytes(b"p1|p2")
    (tmp_path / "broken.pdf").write_bytes(b"\xff\xfe")
    pages, failed = load_binary_pages(spark, str(tmp_path), lambda content: content.decode().split("|"))
    assert [(r.source.endswith("broken.pdf"), r.reason[:18]) for r in failed.collect()] == [(True, "UnicodeDecodeError")]
    assert [(r.page_no, r.text) for r in pages.orderBy("page_no").collect()] == [(0, "p1"), (1, "p2")]
    with pytest.raises(ValueError):
        load_binary_pages(spark, None, lambda content: [])


def test_vectors_of_another_length_fail(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>").write.parquet(path)
    with pytest.raises(Exception, match="expected 2 dimensions, found 1"):
        load_vectors(spark, path, 2).collect()
    assert load_vectors(spark, path, 2).where("vec_id = 1").select("vec_id").count() == 1


def test_other_metric_parameters_are_reported():
    services = {"s": {"metrics": {"FaithfulnessMetric": {"threshold": 0.6, "strict_mode": True}, "Odd": None}}}
    assert select_metrics(services) == ({"Faithfulness": 0.6}, ["Odd", "FaithfulnessMetric.strict_mode"])


def test_metric_selection(spark):
    chosen, skipped = select_metrics(DEFAULT_CONFIG)
    assert list(chosen) == ["Answer Relevancy", "Faithfulness", "Contextual Recall", "Contextual Precision"]
    assert list(chosen.values()) == [0.5, 0.7, 0.7, 0.7]
    assert skipped == ["ContextualRelevanceMetric"]
    services = {"first": {"metrics": {"FaithfulnessMetric": None}}, "second": {"metrics": {}}}
    assert [tuple(r) for r in metric_config(spark, services).collect()] == [("Faithfulness", 0.5)]
    with pytest.raises(ValueError):
        select_metrics({})


def test_require(spark):
    df = spark.range(1).withColumn("text", F.lit("x"))
    assert require(df, id="bigint", text="string") is df
    with pytest.raises(ValueError):
        require(df, nope="string")
    with pytest.raises(TypeError):
        require(df, id="string")
