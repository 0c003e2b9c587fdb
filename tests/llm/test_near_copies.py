from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures import documents, empty, sentence

from fathomline.llm import minhash
from fathomline.llm.components import components
from fathomline.llm.words import shingle_sets, text_chunks, word_spans

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def grouped(rows, percent):
    """Brute force: component of every (id, text), by the least id."""
    keys = list(dict.fromkeys(rows))
    sets = [plain_set(t) for _, t in keys]
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(keys):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return {
        key: (len(sets[i]), least.get(root(i)) if sets[i] else key[0]) for i, key in enumerate(keys)
    }


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def fixture_rows():
    rng = random.Random(3)
    rows = []
    for i in range(40):
        rows.append((i, sentence(rng, rng.choice([1, 3, 4, 5, 30, 200]))))
    base = sentence(rng, 150)
    rows += [(100 + i, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3]))) for i in range(120)]
    rows += [(300 + i, base.upper()) for i in range(30)]
    long = sentence(rng, 30_000)
    rows += [(400, long), (401, edited(rng, long, 3)), (402, long + " end")]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, " "), (504, "É é")]
    rows += [(0, rows[0][1]), (0, base), (None, base), (None, sentence(rng, 20)), (None, None)]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_matches_brute_force(spark, percent):
    rows = fixture_rows()
    docs = documents(spark, rows)
    expected = grouped(rows, percent)
    found = minhash.near_copies(docs, percent).collect()
    assert len(found) == len(rows)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found)
    want = sorted((str(k[0]), expected[k][0], str(expected[k][1])) for k in rows)
    assert got == want


def test_tiles_do_not_change_the_result(spark, monkeypatch):
    rows = fixture_rows()
    expected = grouped(rows, 85)
    monkeypatch.setattr(minhash, "TILE_SETS", 7)
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    found = minhash.near_copies(documents(spark, rows), 85).collect()
    assert sorted(str(r["component_id"]) for r in found) == sorted(str(expected[k][1]) for k in rows)


def test_keep_one_keeps_all_columns(spark):
    rows = fixture_rows()
    docs = documents(spark, rows)
    left = minhash.keep_one(docs, 85)
    assert left.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert len(found) == len(set(found))
    expected = grouped(rows, 85)
    named = {k for k in expected if k[0] is not None and k[0] == expected[k][1]}
    nameless = {k for k in expected if k[0] is None and expected[k][1] is None}
    assert set(found) == named | nameless


def test_empty_table(spark):
    assert minhash.near_copies(empty(spark)).count() == 0
    assert minhash.keep_one(empty(spark)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for size in (3, 20, 300, 3000):
        for share in (0.5, 0.8, 0.95):
            common = max(1, int(size * share))
            own = size - common
            pool = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
            a, b = pool[: common + own], np.concatenate([pool[:common], pool[common + own :]])
            signs = minhash.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            true = common / (common + 2 * own)
            errors.append(abs((signs[0] == signs[1]).mean() - true))
    assert max(errors) < 0.15 and np.mean(errors) < 0.04


def test_superminhash_is_sequential_definition():
    """Early stopping and joint steps give the signature of one element after another."""
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 2**63, 40).astype(np.uint64)
    joint = minhash.superminhash(elements, np.array([0, 40]), 16)
    single = [minhash.superminhash(elements[i : i + 1], np.array([0, 1]), 16)[0] for i in range(40)]
    assert (np.min(single, axis=0) == joint[0]).all()
    # one element fills all slots with a permutation of the steps
    assert sorted(int(v) >> 48 for v in single[0]) == list(range(16))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b.ﬀ😀", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_and_shingles(texts, limit):
    column = pa.array(texts, pa.string())
    sets, words = [], []
    for chunk in text_chunks(column, limit):
        grams, bounds = shingle_sets(chunk, 5)
        sets += [frozenset(grams[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
        starts, ends, rows = word_spans(chunk)
        for r in range(chunk.rows):
            words.append([bytes(chunk.data[a:b]).decode() for a, b, k in zip(starts, ends, rows) if k == r])
    assert words == [WORD.findall((t or "").translate(LOWER)) for t in texts]
    plain = [plain_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert (sets[i] == sets[j]) == (plain[i] == plain[j])


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(200, 260)] + [(1, x) for x in range(2, 90)] + [(7, 7), (500, 400), (400, 300)]
    links += [(None, 3), (3, None)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    expected = {i: 200 for i in range(201, 261)} | {i: 1 for i in range(2, 90)} | {400: 300, 500: 300}
    assert found == expected
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
