"""Vector deduplication against brute force."""

import numpy as np
import pytest

from wavelode.llm import vector_dedup
from wavelode.llm.components import connected_components


def plain(rows, threshold=0.93):
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if k else None for r, k in zip(rows, ok, strict=True)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {(r[0], links[i], least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows)}


def test_links_equal_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((60, 16))
    rows = [(i, base[i].tolist(), i % 3) for i in range(60)]
    rows += [(100 + i, (base[i % 6] + 0.02 * r.standard_normal(16)).tolist(), (i % 6) % 3) for i in range(120)]
    rows += [(300 + i, base[7].tolist(), 1) for i in range(20)] + [(330, (2 * base[7]).tolist(), 1)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, base[7].tolist(), None), (405, [], 1), (406, [1.0, 2.0], 1), (407, [float("inf")] + [1.0] * 15, 2)]
    out = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {tuple(x) for x in out.collect()} == plain(rows)


def clumps(sizes, cosine, noise=0.012, dim=32, label=1, first=0):
    """Groups of vectors around centres of which each has the given cosine to the one before."""
    r, e = np.random.default_rng(8), np.eye(dim)
    centres = [e[0]]
    for g in range(1, len(sizes)):
        centres.append(cosine * centres[-1] + np.sqrt(1 - cosine**2) * e[g])
    rows = [(c + noise * r.standard_normal(dim)).tolist() for c, n in zip(centres, sizes, strict=True) for _ in range(n)]
    return [(first + i, x, label) for i, x in enumerate(rows)]


@pytest.mark.parametrize(
    "rows",
    [
        clumps([30, 30], 0.95),
        clumps([40, 40, 40], 0.95),
        clumps([120, 70, 5], 0.95) + clumps([14, 14], 0.97, label=2, first=500),
        # A pair of two that both sides' lists hide: a large group at a cosine where only some pairs are linked.
        clumps([90, 90], 0.933, 0.004),
    ],
)
def test_groups_around_close_centres(spark, rows):
    """Lists that are filled from inside one group, though there are links to the next."""
    out = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {tuple(x) for x in out.collect()} == plain(rows)


def test_doubles_extra_columns_and_ties(spark):
    """Vectors of doubles that differ beyond a float's digits, columns of clashing names, repeated rows and null ids."""
    e = np.eye(4)
    rows = [(1, (e[0] * 1e300).tolist(), 1), (2, (e[0] * (1 + 1e-12)).tolist(), 1), (2, (e[0] * (1 + 1e-12)).tolist(), 1), (None, (0.93 * e[0] + np.sqrt(1 - 0.9301**2) * e[1]).tolist(), 1), (5, e[2].tolist(), None)]
    df = spark.createDataFrame([(*r, 0, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, cls int, `a.b` string, SIM double")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(0, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1), (5, 0, 5)]


def test_poor_lists_are_not_relied_on(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "_audit", lambda *a: False)
    monkeypatch.setattr(vector_dedup, "_refine", lambda lists, homes, classes, threshold: lists.limit(0))
    r = np.random.default_rng(9)
    base = r.standard_normal((20, 16))
    rows = [(i, (base[i % 20] + 0.02 * r.standard_normal(16)).tolist(), i % 2) for i in range(60)]
    out = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {tuple(x) for x in out.collect()} == plain(rows)


def test_empty_table(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)] + [(50, 51), (51, 52), (60, 60)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(50):
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
