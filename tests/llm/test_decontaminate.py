from __future__ import annotations

import random
import re

from fixtures import documents, empty, sentence

from fathomline.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items):
    w = words(text)
    covered, named = set(), set()
    for item, t in items:
        v = words(t)
        size = min(10, len(v))
        if not size:
            continue
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                covered |= set(range(i, i + size))
                named.add(item)
    return len(w), len(covered), len(named - {None}), ",".join(sorted(str(i) for i in named - {None}))


def fixture():
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.choice([10, 12, 30]), 300)) for i in range(20)]
    items += [(30, "one two three"), (31, "Solo"), (32, None), (33, ""), (34, "..."), (35, "a a a a a a a a a a a a")]
    items += [(0, items[0][1]), (40, items[1][1]), (None, sentence(rng, 15))]
    docs = [(i, sentence(rng, rng.choice([0, 1, 9, 10, 60]), 300)) for i in range(60)]
    for i in range(60):
        item = words(items[rng.randrange(20)][1])
        low = rng.randrange(len(item))
        part = item[low : low + rng.randrange(1, 16)]
        docs.append((100 + i, f"{sentence(rng, 8)}, {' - '.join(part).upper()}! {sentence(rng, 8)}"))
    docs += [(200, items[3][1]), (201, items[-1][1]), (202, "x one. Two; three solo"), (203, "a " * 40), (204, None), (205, "")]
    docs += [(206, sentence(rng, 20_000) + " " + items[4][1]), (200, items[3][1]), (200, "other"), (None, items[5][1]), (207, "É " + items[6][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as size")
    found = decontaminate.leaks(documents(spark, docs), bench).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["item_ids"]) for r in found)
    want = sorted((str(i), *plain(t, items)) for i, t in docs)
    assert got == want


def test_clean_documents_stay(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.drop_leaks(documents(spark, docs), bench)
    got = sorted(str((r["doc_id"], r["text"])) for r in left.collect())
    assert got == sorted(str((i, t)) for i, t in docs if not plain(t, items)[1])


def test_empty_tables(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    none = decontaminate.leaks(documents(spark, docs), bench.limit(0)).where("n_hit > 0 or n_items > 0")
    assert none.count() == 0
    assert decontaminate.leaks(documents(spark, docs), bench.limit(0)).count() == len(docs)


def test_no_python_in_the_plan(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.leaks(documents(spark, docs), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
