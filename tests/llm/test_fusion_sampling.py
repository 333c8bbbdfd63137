from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from moraine.llm.fusion import fuse, fused_first, fused_ranking
from moraine.llm.sampling import draw_sample, tilt

SCORES = ("a", "b")


def brute_fused(rows, k=60):
    best = {}
    for g, i, *s in rows:
        if i is None:
            continue
        s = [None if x is None or x != x else x for x in s]
        old = best.get((g, i), [None, None])
        best[(g, i)] = [y if x is None else x if y is None else max(x, y) for x, y in zip(old, s)]
    out = {}
    for (g, i), s in best.items():
        total = 0.0
        for j, v in enumerate(s):
            if v is not None:
                total += 1 / (k + 1 + sum(1 for (h, _), t in best.items() if h == g and t[j] is not None and t[j] > v))
        out[(g, i)] = round(total, 12)
    return out


def test_fusion_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(40), rng.choice([None, float("nan"), *map(float, range(6))]), rng.choice([None, 1e9, -5.0, 0.0])) for _ in range(150)]
    rows += rows[:20] + [(3, 7, None, None), (1, None, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "q long, f long, a double, b double, score string, rank double")
    want = brute_fused(rows)
    fused = fuse(df, "q", "f", SCORES)
    assert {(r["q"], r["f"]): r["fused"] for r in fused.collect()} == pytest.approx(want)
    first = {r["q"]: r["f"] for r in fused_first(fused, "q", "f").collect()}
    assert first == {g: min((i for h, i in want if h == g), key=lambda i: (-want[(g, i)], i)) for g, _ in want}
    places = {(r["q"], r["f"]): r["place"] for r in fused_ranking(fused, "q", "f").collect()}
    for g in first:
        own = sorted((i for h, i in want if h == g), key=lambda i: (-want[(g, i)], i))
        assert [places[(g, i)] for i in own] == list(range(1, len(own) + 1))
    assert fuse(df.limit(0), "q", "f", SCORES).count() == 0


TARGETS = [("nil", True, 0.5, 5, 40), ("known", False, 0.45, 5, 40), ("unseen", None, 0.05, 3, 40)]
TARGET_SCHEMA = "category string, value boolean, target_share double, min_rows int, sample_rows int"


def test_newton_meets_totals():
    counts = np.array([[100.0, 50.0, 3.0], [1e6, 20.0, 0.0]])
    totals = np.array([[20.0, 17.0, 3.0], [20.0, 18.0, 0.0]])
    p = tilt(counts, totals, np.minimum(1, 40 / counts.sum(1, keepdims=True)))
    assert np.allclose(counts * p, totals) and p.max() <= 1


def test_sample_meets_targets_and_reports_gaps(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for batch, size in ((1, 100), (2, 2000), (3, 30), (4, 1), (None, 10)):
        for _ in range(size):
            rows.append((n, batch, rng.choice([True, True, False, False, None])))
            n += 1
    rows += [(n, 5, None)] * 3 + rows[:50] + [(None, 1, True)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "item long, b int, v boolean, p int")
    targets = spark.createDataFrame(TARGETS, TARGET_SCHEMA)
    sample, report = draw_sample(df, "item", "b", "v", targets)
    drawn = sample.collect()
    of = {r[0]: (r[1], r[2]) for r in rows if r[0] is not None}
    name = {True: "nil", False: "known", None: "unseen"}
    assert len({r["item"] for r in drawn}) == len(drawn)
    assert all((r["b"], r["category"]) == (of[r["item"]][0], name[of[r["item"]][1]]) for r in drawn)
    have = Counter((b, name[v]) for b, v in of.values() if b is not None)
    got = {(r["b"], r["category"]): r for r in report.collect()}
    assert set(got) == {(b, c) for b in (1, 2, 3, 4, 5) for c in name.values()}
    for (b, c), r in got.items():
        share, floor = next((t[2], t[3]) for t in TARGETS if t[0] == c)
        need = max(share * 40, floor)
        assert r["available"] == have[(b, c)] and r["needed"] == need and r["met"] == (have[(b, c)] >= need)
        assert abs(r["drawn"] - r["target"]) < 1 + 1e-6 and r["gap"] == max(0, need - have[(b, c)])
    for b in (1, 2):
        assert sum(got[(b, c)]["drawn"] for c in name.values()) == 40
    again, _ = draw_sample(df, "item", "b", "v", targets)
    assert {r["item"] for r in again.collect()} == {r["item"] for r in drawn}


def test_sample_of_nothing(spark):
    df = spark.createDataFrame([], "item long, b int, v boolean")
    sample, report = draw_sample(df, "item", "b", "v", spark.createDataFrame(TARGETS, TARGET_SCHEMA))
    assert sample.count() == 0 and report.count() == 0


def test_draw_is_near_uniform(spark):
    hits = Counter()
    df = spark.createDataFrame([(i, 1, True) for i in range(60)], "item long, b int, v boolean")
    targets = spark.createDataFrame([("nil", True, 1.0, 1, 20)], TARGET_SCHEMA)
    for seed in range(6):
        hits.update(r["item"] for r in draw_sample(df, "item", "b", "v", targets, seed)[0].collect())
    assert sum(hits.values()) == 120 and len(hits) > 45
