"""The registered queries that SQL cannot express, over whole tables."""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import pytest
from test_sanitise import plain_spans

from fathomline.llm import queries
from fathomline.llm.sanitise import KINDS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def collected(spark, name):
    return queries.queries()[name](spark, SF).collect()


def test_op2(spark, documents):
    found = collected(spark, "op2_personal_data")
    assert len(found) == len(documents)
    for r in found:
        spans = plain_spans(documents[r["doc_id"]]["text"])
        told = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS[:4]] == [sum(s[1] == i for s in spans) for i in range(4)]
        every = [s.split(":") for s in r["spans"].split(",") if s]
        assert set(told) <= {":".join(s) for s in every}
        places = [(int(a), KINDS.index(k)) for k, a, _ in every]
        assert places == sorted(places)
        assert spans or not every


@pytest.mark.parametrize("name, column, cut", [("op3_quality", "quality", 0.3), ("op7_toxicity", "toxic", 0.5)])
def test_scores(spark, documents, name, column, cut):
    found = collected(spark, name)
    assert sorted(r["doc_id"] for r in found) == sorted(documents)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learned = [r["predicted"] == labels[r["doc_id"]] for r in found if r["doc_id"] in labels and not r["held_out"]]
    assert sum(learned) / len(learned) > 0.9


def test_op4(spark, documents):
    found = collected(spark, "op4_mixing")
    assert sorted(r["doc_id"] for r in found) == sorted(documents)
    total = sum(r["n_tokens"] for r in found)
    for r in found:
        assert r["n_tokens"] == len(re.findall("[^\x20\x09-\x0d]+", (documents[r["doc_id"]]["text"] or "").lower()))
        assert r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        assert sum(r[f"p_{k}"] for k in queries.TARGETS) == pytest.approx(1, abs=1e-5)
    for name, share in queries.TARGETS.items():
        assert sum(r["rate"] * r["n_tokens"] * r[f"p_{name}"] for r in found) / total == pytest.approx(share, abs=1e-3)


def test_op8(spark, documents):
    found = collected(spark, "op8_language")
    assert sorted(r["doc_id"] for r in found) == sorted(documents)
    right = []
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        text = documents[r["doc_id"]]["text"]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if r["held_out"]:
            right.append(r["lang_pred"] == documents[r["doc_id"]]["lang"])
    assert sum(right) / len(right) > 0.98


def test_op10(spark):
    """These pages keep their text in one article of headings and paragraphs."""
    found = {r["page_id"]: r for r in collected(spark, "op10_main_text")}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S).group(1)
        pieces = re.split(r"</?(?:p|h1)[^>]*>", article.replace("<br>", " "))
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in pieces]
        told = found[page["page_id"]]
        assert told["text"] == "\n\n".join(t for t in texts if t) and told["url"] == page["url"]
        assert told["n_chars"] == len(told["text"])
