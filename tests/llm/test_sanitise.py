from __future__ import annotations

import re

import pytest
from fixtures import documents, empty
from pyspark.sql import functions as F

from fathomline.llm import sanitise


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    found = []
    text = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


TEXTS = [
    None,
    "",
    "no data here",
    "a@b.c",
    "a@b.c_x@d.e,f@g.h.",
    "x@y then .z@q.r and @@a@b..c",
    "😀 mail é.bob+1@x-y.example.com😀",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 0000000001.1.1.1 1..2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111",
    "4000000000000000006 40000000000000000000",
    "+1 (555) 123-4567 +49 30 1234567 +1234567890123456 +1( +12",
    "+4111 1111 1111 1111",
    "12 34 56 78 90 12 34 56 78 91.1.1.1",
    "1" * 5000,
    "a" * 5000 + "@" + "b" * 5000,
    "1.1.1.1 " * 300,
    "1.1.1.1 a@b.c " * 1000,
    "me@x.y\nme@x.y\tyou@x.y",
]


def test_base_spans(spark):
    docs = documents(spark, [*enumerate(TEXTS), (None, "a@b.c"), (3, "a@b.c")])
    found = sanitise.personal_spans(docs).collect()
    assert len(found) == len(TEXTS) + 2
    texts = dict(enumerate(TEXTS)) | {None: "a@b.c"}
    for r in found:
        got = [(s["start"], s["kind"], s["end"]) for s in r["base"]]
        assert got == plain_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:80]
        assert {(s["start"], s["kind"], s["end"]) for s in r["spans"]} >= set(got)


def revealing_rows():
    rows = [(i, f"The famous baker called bob@x.org about bread number{'x' * i} today.") for i in range(6)]
    rows += [(10 + i, "The people ate bread about noon and called someone today.") for i in range(40)]
    return rows


def test_terms_that_reveal(spark):
    docs = documents(spark, revealing_rows())
    spans = {
        r["doc_id"]: [s["value"] for s in r["spans"] if s["kind"] == 4] for r in sanitise.personal_spans(docs, 0.95).collect()
    }
    assert all(spans[i] == ["famous", "baker"] for i in range(6))
    assert all(spans[i] == [] for i in range(10, 50))


def test_disclosure_by_hand(spark):
    rows = revealing_rows()
    read = sanitise._read(documents(spark, rows))
    found = {r["term"]: r["disclosure"] for r in sanitise._revealing(documents(spark, rows), read, 0.0, 3).collect()}
    import math

    terms = [w for _, t in rows for w in re.findall(r"(?<=\s)[A-Za-z]{4,}(?=[.,;:!?]*\s)", f" {t} ".lower())]
    n = len(terms)
    expected = math.log(6 * n / (terms.count("bread") * 6)) / math.log(n / 6)
    assert found["bread"] == pytest.approx(expected)
    assert found["famous"] == pytest.approx(1.0)


def test_sanitised_texts(spark):
    rows = [*revealing_rows(), (90, "+4111 1111 1111 1111 x"), (91, None), (92, "1.1.1.1a@b.c 2.2.2.2"), (None, "q@w.e")]
    docs = documents(spark, rows)
    left = sanitise.sanitise(docs, 0.95)
    assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert len(texts) == len(rows)
    assert texts[0] == "The <TERM> <TERM> called <EMAIL> about bread number today."
    assert texts[10] == rows[6][1]
    assert texts[90] == "<PHONE> x" or texts[90].endswith(" x") and "1111" not in texts[90]
    assert texts[91] is None and texts[None] == "<EMAIL>"
    assert texts[92] == "<EMAIL> <IP>"


def test_empty_table(spark):
    assert sanitise.personal_spans(empty(spark)).count() == 0
    assert sanitise.sanitise(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = documents(spark, revealing_rows())
    plan = sanitise.sanitise(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_told(spark):
    df = documents(spark, [(1, "a@b.c 1.1.1.1")])
    row = sanitise.personal_spans(df).select(sanitise.told(F.col("base")).alias("t")).first()
    assert row["t"] == "email:0:5,ip:6:13"
