"""The filter audit against counting every order, and hard negatives against comparing all rows."""

import re
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import floor

import numpy as np
import pytest

from wavelode.llm import filter_audit, hard_negatives

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def plain_audit(docs, labels):
    failed = []
    for doc_id, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in docs)
        known = [x for x in labels if x[0] is not None and x[0] == doc_id]
        failed.append((source or "", {k for k in f if f[k]}, any(x[1] == 1 for x in known), any(x[2] == 1 for x in known)))
    out = set()
    for part in {p for p, *_ in failed}:
        mine = [x for x in failed if x[0] == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            for _, f, _, _ in mine:
                removed[next((x for x in order if x in f), None)] += 1
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                fails = sum(x in m[1] for m in mine)
                out.add((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(m[1] == {x} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone), removed[x]))
    return out


def audit_rows(df):
    return [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()]


def test_audit_equals_counting(spark):
    r = np.random.default_rng(2)
    docs = []
    for i in range(80):
        n = int(r.choice([0, 5, 199, 200, 260]))
        words = [f"w{x}" for x in r.integers(0, int(r.choice([40, 4000])), n)]
        words = [w.upper() for w in words] if r.random() < 0.2 else words
        docs.append((i, (" " * int(r.integers(0, 3))).join(["", " \t\x0b".join(words), "a#b" if r.random() < 0.3 else ""]), f"s{i % 3}" if i % 7 else None))
    docs += [(100 + i, docs[i % 5][1], "s9") for i in range(20)] + [(None, docs[0][1], "s0"), (0, docs[0][1], "s0"), (7, None, None), (-1, "", "s1")]
    labels = [(i, int(r.integers(0, 2)), int(r.integers(0, 2))) for i in range(0, 110, 2)] + [(2, 1, None), (2, None, 1), (None, 1, 1)]
    extra = [(*d, 1, "x") for d in docs]
    got = audit_rows(filter_audit.audit(spark.createDataFrame(extra, DOCS + ", mask int, PART string"), spark.createDataFrame([(*x, 5) for x in labels], LABELS + ", text int")))
    assert len(got) == len(set(got)) == 600 * len({d[2] or "" for d in docs})
    assert set(got) == plain_audit(docs, labels)


def test_audit_of_nothing_and_of_long_texts(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    rows = [(1, "word " * 400_000, "s"), (2, "word " * 400_000, "s")]
    got = set(audit_rows(filter_audit.audit(spark.createDataFrame(rows, DOCS), labels)))
    assert got == plain_audit(rows, [])


def plain_negatives(rows):
    ok = [(i, r[0], r[2] if r[0] is None or r[0] % 7 else (r[2] + 1) % 10, [floor(Fraction(x) * 256) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    last = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for i, a, label, v in ok:
        if a is None or a % 100:
            continue
        near = [(sum(p * q for p, q in zip(v, w, strict=True)), b, j, m == label) for j, b, m, w in ok if j != i and len(w) == len(v)]
        near.sort(key=last)
        for s, b, _, _ in [x for x in near if x[3]][:5]:
            far = [x for x in near if not x[3] and 30 * s <= 100 * x[0] <= 90 * s][:10]
            out += [(a, b, k, x[1], s, x[0]) for k, x in enumerate(far, 1)]
    return Counter(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "vec_id long, embedding array<double>, label int, score double, `a.b` string")
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df).collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    """Small intervals and blocks, so that searches need several rounds and groups."""
    monkeypatch.setattr(hard_negatives, "LEAST", 4)
    monkeypatch.setattr(hard_negatives, "WIDE", 8)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    r = np.random.default_rng(5)
    base = r.standard_normal((8, 6))
    rows = [(i, (base[i % 8] + 0.6 * r.standard_normal(6)).tolist(), int(r.integers(0, 4))) for i in range(0, 900, 3)]
    rows += [(1000 + i, [0.5, 0.5, -0.25, 0.0, 1.0, 0.125], i % 2) for i in range(60)]
    rows += [(2000, None, 1), (2100, [None] * 6, 1), (2200, [float("nan")] * 6, 1), (2300, [1.0] * 6, None), (None, rows[0][1], 2), (300, rows[100][1], 1), (3000, [1.0, 2.0], 1), (3001, [1.0, 2.5], 1), (3003, [1.0, 0.5], 2), (3100, [0.0] * 6, 3), (3200, [], 1), (3201, [], 1), (3202, [], 2), (-100, [-x for x in rows[1][1]], 0)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_scores_beyond_a_floats_digits(spark):
    rows = [(100 * i, [float((1 << 20) + i), 3.0], i % 2) for i in range(8)]
    rows += [(i + 1, [float((1 << 19) + i), 5.0 + i], i % 2) for i in range(20)]
    assert mined(spark, rows) == plain_negatives(rows)
    with pytest.raises(ValueError, match="scale"):
        mined(spark, [(100, [1e30, 1.0], 1)])


def test_no_vectors(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(100, [1.0], 1)])
