from __future__ import annotations

import numpy as np
import pytest

from fathomline.llm import vectors


def brute_force(rows, cosine):
    sound = [
        l is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)
        for _, v, l in rows
    ]
    links = [set() for _ in rows]
    for i, (_, v, l) in enumerate(rows):
        for j in range(i):
            _, w, k = rows[j]
            if sound[i] and sound[j] and l == k and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if (a @ b) / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    component = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component[i] = min(ids) if ids else None
    return sorted((str(r[0]), len(links[i]), str(component[i])) for i, r in enumerate(rows))


def fixture():
    rng = np.random.default_rng(8)
    rows, number = [], 0
    for label in (1, 2):
        for _ in range(25):
            centre = rng.normal(size=8)
            for _ in range(rng.integers(1, 6)):
                scale = rng.choice([1.0, 1e-3, 1e6])
                rows.append((number, [float(np.float32(x)) for x in scale * (centre + rng.normal(size=8) * 0.08)], label))
                number += 1
    hot = rows[0][1]
    rows += [(number + i, hot, 1) for i in range(40)]
    odd = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(1100, hot, None), (1101, hot[:4], 1), (1102, hot, 2), (0, hot, 1), (None, hot, 1), (1103, [1e-38] * 8, 1), (1104, [1e38] * 8, 1)]
    return rows


@pytest.mark.parametrize("tile", [1024, 16])
def test_matches_brute_force(spark, tile):
    rows = fixture()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 as own", "'x' as set_id", "2 as root", "3 as copies"
    )
    found = vectors.near_vectors(df, 0.98, tile).collect()
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in found)
    assert got == brute_force(rows, 0.98)


def test_bound_holds():
    """No pair at the threshold is lost to quantisation, whatever the vectors."""
    rng = np.random.default_rng(9)
    for width in (1, 2, 64, 2000):
        matrix = rng.normal(size=(120, width)) * rng.choice([1.0, 0.01, 100.0], size=(120, width))
        unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
        exact = unit @ unit.T
        codes, scale, lost = vectors.quantised(matrix)
        rough = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
        slack = lost[:, None] + (1 + lost)[:, None] * lost[None, :]
        assert (np.abs(rough - exact) <= slack + 1e-12).all()
        every = np.arange(120)
        a, b = vectors.linked_pairs(matrix, every, every, 0.3)
        i, j = np.nonzero(np.triu(exact >= 0.3, 1))
        assert set(zip(a, b)) == set(zip(i, j))


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(df).count() == 0
