from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.operators import metrics as M

SCHEMA = "item long, true_id string, pred_id string"


def cells(spark, rows):
    return M.contingency(spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], SCHEMA))


def test_worked_example(spark):
    c = cells(spark, [("A", "x"), ("A", "x"), ("A", "y"), ("B", "y"), ("B", "y")])
    assert tuple(M.bcubed(c).first())[:2] == pytest.approx((11 / 15, 11 / 15))
    assert tuple(M.muc(c).first()) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert tuple(M.ceaf_e(c).first()) == pytest.approx((0.8, 0.8, 0.8))
    assert M.aligned_count(c).first()[0] == 4


def test_swapped_ceaf(spark):
    c = cells(spark, [("A", "x"), ("A", "y")])
    assert tuple(M.ceaf_e(c).first())[:2] == pytest.approx((1 / 3, 2 / 3))
    assert tuple(M.ceaf_e(c, swapped=True).first())[:2] == pytest.approx((2 / 3, 1 / 3))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_the_best(n, m, seed):
    w = np.random.default_rng(seed).integers(0, 5, (n, m)).astype(float)
    small, wide = (w, m) if n <= m else (w.T, n)
    best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide), min(n, m)))
    i, j = np.nonzero(w)
    assert M.best_matching(i, j, w[i, j]) == pytest.approx(best)


def test_sure_edges_lose_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(f"t{rng.integers(0, 25)}", f"p{rng.integers(0, 25)}") for _ in range(300)]
    c = cells(spark, rows)
    got = c.collect()
    t, p = sorted({r["t"] for r in got}), sorted({r["p"] for r in got})
    a, b = np.array([t.index(r["t"]) for r in got]), np.array([p.index(r["p"]) for r in got])
    for weight, total in (("n", M.aligned_count(c).first()[0]), ("phi", M.matching_total(M._edges(M.phi4(c), "phi")).first()[0])):
        w = np.array([float(r["n"]) if weight == "n" else 2.0 * r["n"] / (r["nt"] + r["np"]) for r in got])
        assert total == pytest.approx(M.best_matching(a, b, w))
    assert M.matching_total(spark.createDataFrame([], "a long, b long, w double")).first()[0] == 0.0


def test_report_bounds_and_perfect_clusters(spark):
    rng = random.Random(1)
    rows = [(i, str(rng.randrange(6)), str(rng.randrange(6))) for i in range(80)] + [(99, None, "1")]
    r = M.clustering_report(spark.createDataFrame(rows, SCHEMA)).first().asDict()
    assert all(0 <= r[f"{m}_{k}"] <= 1 for m in ("muc", "b3", "ceaf") for k in ("precision", "recall", "f1"))
    same = spark.createDataFrame([(i, str(i % 7), "p" + str(i % 7)) for i in range(70)], SCHEMA)
    r = M.clustering_report(same).first()
    assert r["b3_f1"] == pytest.approx(1) and r["muc_f1"] == pytest.approx(1) and r["ceaf_f1"] == pytest.approx(1) and r["true_median_size"] == 10


def test_recalls(spark):
    ranks = spark.createDataFrame([(1, "a"), (2, "a"), (-1, "b"), (4, "b")], "gold_rank int, w string")
    assert {r["k"]: r["recall"] for r in M.recall_at(ranks, (1, 2, 3, 5)).collect()} == {1: 0.25, 2: 0.5, 3: 0.5, 5: 0.75}
    by = {(r["kind"], r["w"]): (r["n"], r["r2"]) for r in M.recall_by(ranks.unionByName(ranks.filter("w = 'a'")), "w", [2]).collect()}
    assert by == {("group", "a"): (4, 1.0), ("group", "b"): (2, 0.0), ("micro", None): (6, 4 / 6), ("macro", None): (6, 0.5)}
    assert {r["gold_rank"]: r["recall"] for r in M.recall_curve(ranks).collect()} == {1: 25.0, 2: 50.0, 4: 75.0}


def test_accuracies(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (-1, 0)], "label int, guess int")
    assert tuple(M.ranking_accuracy(df, "label", "guess", 4).first()) == (0.5, 0.25, 0.5)
    s = M.system_measures(spark.createDataFrame([("A", "A"), ("B", "NIL"), ("NIL", "C"), ("NIL", "NIL")], "g string, p string"), "g", "p").first()
    assert tuple(s) == (0.5, 0.5, 0.5)
    rows = [(1, False, False, 1, False, None), (1, False, False, 2, False, None), (5, True, True, None, False, None), (7, False, False, 3, True, [7]), (7, False, False, 3, True, [6, 7]), (7, False, False, 3, True, [6, 7, 8]), (7, False, True, None, False, None)]
    o = M.overall_accuracy(spark.createDataFrame(rows, "gold long, should_be_nil boolean, is_nil boolean, top_id long, top_added boolean, top_modes array<long>")).first()
    assert (o["linked_correct"], o["added_correct"], o["nil_correct"], o["overall_correct"], o["size"]) == (1, 2, 1, 4, 7)
    reports = spark.createDataFrame([(0, 10, 5, 0.5, 0.2), (1, 30, 25, 25 / 30, 0.4)], "batch long, size long, overall_correct long, overall_accuracy double, r double")
    m = M.mean_report(reports).first()
    assert m["overall_accuracy"] == 0.75 and m["r"] == pytest.approx(0.3) and m["size"] == 40
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int"), spark.createDataFrame([("y", 9)], "name string, v int")
    assert {tuple(r) for r in M.upsert_report(a, b).collect()} == {("x", 1), ("y", 9)}
