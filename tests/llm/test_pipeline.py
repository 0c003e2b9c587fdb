from __future__ import annotations

import random

import corpus_pipeline
import pytest
from fixtures import sentence
from test_decontaminate import plain as plain_leaks
from test_near_copies import grouped
from test_sanitise import plain_spans

from fathomline.storage import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, junk and toxic documents, copies, leaks and personal data."""
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = [], []
    for i in range(360):
        text = ". ".join(sentence(rng, 9, 90) for _ in range(6))
        toxic, junk = i % 6 == 1, i % 6 == 2
        if toxic:
            text = text.replace(". ", " vilewords. ", 1)
        if junk:
            text = " | ".join(text.split(" "))
        if i % 12 == 3:
            text += f" mail user{i}@x.org or 10.0.0.{i % 200}"
        docs.append((i, text))
        labels.append((i, 0 if junk else 1, 1 if toxic else 0))
    docs += [(1000 + i, docs[i * 6][1]) for i in range(5)] + [(2000, docs[0][1] + " tail"), (2001, None), (2002, "")]
    items = [(k, sentence(rng, 14, 400)) for k in range(4)]
    docs += [(3000 + k, f"start of it {t} and the end") for k, t in items]
    docs += [docs[6], (None, "a text without an id " + sentence(rng, 20))]
    frames = {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return path, docs, dict((i, (q, t)) for i, q, t in labels), items


def rows(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())


def test_stages_against_brute_force(spark, folder):
    path, docs, labels, items = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns = frame.columns
    (_, toxic), (_, copies), (_, leaks), (_, personal), (_, mix) = corpus_pipeline.STAGES

    kept = materialise(toxic(spark, frame, path), "a")
    assert kept.columns == columns
    assert rows(kept) == sorted((str(i), str(t)) for i, t in docs if "vilewords" not in (t or ""))

    given = [(r["doc_id"], r["text"]) for r in kept.collect()]
    kept = materialise(copies(spark, kept, path), "b")
    expected = grouped(given, 80)
    wanted = {k for k in expected if k[0] is None or k[0] == expected[k][1]}
    assert kept.columns == columns and rows(kept) == sorted((str(i), str(t)) for i, t in wanted)

    given = [(r["doc_id"], r["text"]) for r in kept.collect()]
    kept = materialise(leaks(spark, kept, path), "c")
    assert kept.columns == columns
    assert rows(kept) == sorted((str(i), str(t)) for i, t in given if not plain_leaks(t, items)[1])
    assert len(given) - kept.count() == 4

    given = {r["doc_id"]: r["text"] for r in kept.collect()}
    kept = materialise(personal(spark, kept, path), "d")
    assert kept.columns == columns and kept.count() == len(given)
    for r in kept.collect():
        before = given[r["doc_id"]]
        if not plain_spans(before):
            assert r["text"] == before
        else:
            assert not plain_spans(r["text"]) and "<EMAIL>" in r["text"] and "<IP>" in r["text"]

    given = rows(kept)
    mixed = mix(spark, kept, path)
    assert mixed.columns == [*columns, "domain", "rate", "copies"]
    found = mixed.collect()
    assert {(str(r["doc_id"]), str(r["text"])) for r in found} <= set(given)
    assert all(r["copies"] >= 1 for r in found)
    named = {r["doc_id"]: r["domain"] for r in found if r["doc_id"] in labels}
    assert all(named[i] == ("prose" if labels[i][0] else "junk") for i in named)


def test_run_applies_the_stages(spark, folder):
    path, *_ = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = materialise(stage(spark, df, path), name)
    assert rows(corpus_pipeline.run(spark, path)) == rows(df)


def test_empty_tables(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
