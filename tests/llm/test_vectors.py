"""Clusters and search against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from moraine.llm import clusters as C
from moraine.llm.search import ScanIndex, most_similar
from moraine.functions.vectors import rotation

DIM = 16


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(rng, sizes, noise=0.03):
    centres = unit(rng.standard_normal((len(sizes), DIM)))
    rows = np.vstack([unit(c + noise * rng.standard_normal((n, DIM))) for c, n in zip(centres, sizes, strict=True)])
    return rows.astype(np.float32), np.repeat(np.arange(len(sizes)), sizes)


def sequential(means, sizes, threshold):
    parts = {i: [i] for i in range(len(means))}
    m, n = {i: means[i].astype(float) for i in parts}, {i: float(sizes[i]) for i in parts}
    while True:
        best = max(((m[a] @ m[b], -a, -b) for a in parts for b in parts if a < b), default=(-2, 0, 0))
        if best[0] < threshold:
            return sorted(map(sorted, parts.values()))
        a, b = -best[1], -best[2]
        m[a] = (m[a] * n[a] + m[b] * n[b]) / (n[a] + n[b])
        n[a] += n[b]
        parts[a] += parts.pop(b)
        del m[b], n[b]


@pytest.mark.parametrize("seed", range(6))
def test_reciprocal_rounds_equal_single_merges(seed):
    rng = np.random.default_rng(seed)
    rows = unit(rng.standard_normal((30, 4)))
    label = C.reciprocal_merges(rows, np.ones(30), 0.6)
    got = sorted(sorted(np.flatnonzero(label == k).tolist()) for k in np.unique(label))
    assert got == sequential(rows, np.ones(30), 0.6)
    assert (label <= np.arange(30)).all()


def table(spark, rows, ids=None, extra=()):
    ids = range(len(rows)) if ids is None else ids
    data = [(int(i), None if r is None else [float(x) for x in r], "n", 0.5) for i, r in [*zip(ids, rows, strict=True), *extra]]
    return spark.createDataFrame(data, "item long, vector array<float>, node string, sim double")


def found(spark, items, **kw):
    members, vectors = C.average_linkage(items, DIM, **kw)
    return {r["item"]: r["cluster"] for r in members.collect()}, {tuple(r) for r in C.cluster_pairs(members, vectors, DIM, 0.8).collect()}, members, vectors


def test_planted_clusters_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    rows, truth = planted(rng, [1, 2, 3, 9, 30, 1, 2])
    rows = np.vstack([rows * 3, rows[:4] * 0.5])
    truth = np.append(truth, truth[:4])
    bad = [(900, None), (901, [0.0] * DIM), (902, [1.0] * 5), (903, [float("nan")] * DIM), (5, rows[5])]
    label, pairs, members, vectors = found(spark, table(spark, rows, extra=bad))
    assert set(label) == set(range(len(rows)))
    assert all(label[i] == min(np.flatnonzero(truth == truth[i])) for i in label)
    assert pairs == {(a, b) for a in label for b in label if a < b and truth[a] == truth[b]}
    names = spark.createDataFrame([(i, None if i % 2 else f"m{i}") for i in label], "item long, name string")
    typical = {r["cluster"]: r for r in C.typical_members(members, vectors, names, DIM).collect()}
    for c in set(label.values()):
        own = np.array([i for i in label if label[i] == c])
        assert typical[c]["size"] == len(own) and len(typical[c]["typical"]) == min(3, len(own))
        near = unit(rows[own].astype(float)) @ unit(unit(rows[own].astype(float)).sum(0))
        assert typical[c]["typical"][0]["nearness"] == pytest.approx(near.max(), abs=1e-5)


def test_large_components_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_COMPONENT", 8)
    monkeypatch.setattr(C, "WINDOW", 16)
    monkeypatch.setattr(C, "PAIR_BLOCK", 8)
    rng = np.random.default_rng(4)
    rows, truth = planted(rng, [60, 5, 1, 1, 20])
    label, pairs, _, _ = found(spark, table(spark, rows))
    assert all(label[i] == min(np.flatnonzero(truth == truth[i])) for i in label)
    assert pairs == {(a, b) for a in label for b in label if a < b and truth[a] == truth[b]}


def isolated_pairs(rng, n):
    """Pairs of cosine 0.82, of different pairs below 0.75."""
    rows = np.zeros((0, DIM))
    while len(rows) < 2 * n:
        x = unit(rng.standard_normal(DIM))
        y = rng.standard_normal(DIM)
        y = 0.82 * x + np.sqrt(1 - 0.82**2) * unit(y - (x @ y) * x)
        if not len(rows) or max((rows @ x).max(), (rows @ y).max()) < 0.75:
            rows = np.vstack([rows, x, y])
    return rows.astype(np.float32)


@pytest.mark.parametrize("exact", [True, False])
def test_late_isolated_pairs(spark, monkeypatch, exact):
    monkeypatch.setattr(C, "WINDOW", 2)
    if not exact:
        monkeypatch.setattr(C, "EXACT_NODES", 0, raising=False)
        monkeypatch.setattr(C, "MISS", 0.2, raising=False)  # nine epochs, not 39
    n = 12
    rows = isolated_pairs(np.random.default_rng(8), n)
    _, pairs, _, _ = found(spark, table(spark, rows), tables=1)
    assert pairs == {(2 * i, 2 * i + 1) for i in range(n)}


def test_all_pairs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "EXACT_BLOCK", 20)
    rows, _ = planted(np.random.default_rng(9), [30, 20, 1, 9], 0.15)
    nodes = C.clean_vectors(table(spark, rows).select("item", "vector"), "vector", DIM, unit=True).withColumnRenamed("item", "node")
    got = [tuple(r) for r in C.exact_graph(nodes, DIM, 0.8, len(rows)).select("a", "b").collect()]
    s = rows.astype(float) @ rows.astype(float).T
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if s[a, b] >= 0.8}
    assert len(got) == len(set(got)) and set(got) == want


def test_result_is_whole_at_any_size_whatever_buckets_miss(spark, monkeypatch):
    """Inputs of more than EXACT_NODES clusters ended by chance: pairs that the buckets never showed were lost."""
    monkeypatch.setattr(C, "EXACT_NODES", 0, raising=False)
    monkeypatch.setattr(C, "empty_epochs", lambda *a: 1)
    monkeypatch.setattr(C, "similarity_graph", lambda nodes, *a: nodes.sparkSession.createDataFrame([], "a long, b long, sim double"))
    monkeypatch.setattr(C, "EXACT_BLOCK", 4)
    monkeypatch.setattr(C, "STRIP", 16)
    n = 12
    _, pairs, _, _ = found(spark, table(spark, isolated_pairs(np.random.default_rng(8), n)))
    assert pairs == {(2 * i, 2 * i + 1) for i in range(n)}


def test_empty_epochs_follow_the_chance():
    assert C.empty_epochs(DIM, 0.99, 8) < C.empty_epochs(DIM, 0.8, 8) < C.empty_epochs(DIM, 0.8, 2)


def test_no_items(spark):
    label, pairs, members, vectors = found(spark, table(spark, []))
    assert label == {} and pairs == set()


def brute_top(x, keys, q, k):
    s = q.astype(np.float64) @ x.astype(np.float64).T
    return {(i, *keys[j]) for i in range(len(q)) for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 9), keys[j]))[: k[i]]}


def test_scan_equals_brute_force_on_near_queries():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((100, 64))
    x = (unit(np.repeat(centres, 15, 0) + 0.3 * rng.standard_normal((1500, 64))) * 9).astype(np.float32)
    q = (unit(centres[rng.integers(0, 100, 200)] + 0.3 * rng.standard_normal((200, 64))) * 9).astype(np.float32)
    k = rng.choice([1, 3, 10, 20], 200)
    index = ScanIndex(np.arange(1500), np.zeros(1500, int), rng.integers(0, 30, 1500), x, rotation(64, 1), 16, 3.0)
    qn, xn, _ = index.search(q, k, np.full(200, -np.inf))
    got = {(int(a), 0, int(b)) for a, b in zip(qn, index.ids[xn], strict=True)}
    want = brute_top(x, [(0, i) for i in range(1500)], q, k)
    assert len(got & want) / len(want) > 0.99 and len(got) == len(want)


def run_search(spark, x, keys, q, k, **kw):
    kb = spark.createDataFrame([(s, i, None if v is None else [float(z) for z in v]) for (s, i), v in zip(keys, x, strict=True)], "space int, id long, vector array<float>")
    asked = spark.createDataFrame([(i, n, None if v is None else [float(z) for z in v]) for i, (v, n) in enumerate(zip(q, k, strict=True))], "query_id long, top_k int, vector array<float>")
    return most_similar(kb, asked, DIM, block=4, **kw).collect()


def test_search_recall_ties_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, DIM)).astype(np.float32)
    x[100:110] = x[100]
    keys = [(10 if i % 3 else 20, i // 2 + i % 2 * 1000) for i in range(600)]
    q = np.vstack([rng.standard_normal((60, DIM)), x[100:101]]).astype(np.float32)
    k = [int(n) for n in rng.choice([1, 5, 20], 60)] + [4]
    want = brute_top(x, keys, q, k)
    bad_x, bad_q = [None, [0.0] * DIM, [float("inf")] * DIM, [1.0]], [None, [0.0] * DIM, q[0], q[0]]
    rows = run_search(spark, [*x, *bad_x, x[3]], [*keys, (10, 9001), (10, 9002), (20, 9003), (20, 9004), keys[3]], [*q, *bad_q], [*k, 3, 3, 0, None])
    got = {(r["query_id"], r["space"], r["id"]) for r in rows}
    assert len(got) == len(rows) == len(want) and len(got & want) / len(want) >= 0.97
    assert {g for g in got if g[0] == 60} == {w for w in want if w[0] == 60}
    for r in rows:
        j = keys.index((r["space"], r["id"]))
        assert r["score"] == pytest.approx(float(q[r["query_id"]].astype(float) @ x[j].astype(float)), abs=1e-6)


def test_least_cosine_keeps_ranks_and_saves_work(spark, monkeypatch):
    """Long entries of a low cosine take places of the top_k; entries that no result can depend on are not followed."""
    rng = np.random.default_rng(12)
    centres = unit(rng.standard_normal((60, DIM)))
    x = unit(np.repeat(centres, 8, 0) + 0.08 * rng.standard_normal((480, DIM))) * rng.uniform(0.6, 1.7, (480, 1))
    q = unit(centres[:50] + 0.08 * rng.standard_normal((50, DIM))) * rng.uniform(0.5, 2, (50, 1))
    x, q = x.astype(np.float32), q.astype(np.float32)
    keys, k = [(10, i) for i in range(480)], [int(n) for n in rng.choice([1, 3, 20], 50)]
    cosine = unit(q.astype(float)) @ unit(x.astype(float)).T
    top = brute_top(x, keys, q, k)
    want = {w for w in top if cosine[w[0], w[2]] >= 0.7}
    assert any(cosine[i, j] >= 0.7 and (i, 10, j) not in top for i in range(50) for j in range(480)) and len(want) < len(top)
    for c, kept in ((0.7, want), (-0.5, {w for w in top if cosine[w[0], w[2]] >= -0.5})):
        got = {(r["query_id"], r["space"], r["id"]) for r in run_search(spark, x, keys, q, k, z=8.0, least_cosine=c)}
        assert got == kept
    followed = []
    keep = ScanIndex._keep
    monkeypatch.setattr(ScanIndex, "_keep", lambda self, best, fresh, *a: followed.append(sum(len(f[0]) for f in fresh)) or keep(self, best, fresh, *a))
    index = ScanIndex(np.arange(480), np.zeros(480, int), rng.integers(0, 4, 480), x, rotation(DIM, 1), 4, 8.0)
    floor = 0.7 * np.linalg.norm(x.astype(float), axis=1).min() * np.linalg.norm(q.astype(float), axis=1)
    index.search(q, np.full(50, 480), floor)
    assert sum(followed) == (q.astype(float) @ x.astype(float).T >= floor[:, None]).sum()


def test_search_small_and_empty(spark):
    x = np.eye(DIM, dtype=np.float32)[:3]
    rows = run_search(spark, x, [(10, 1), (10, 2), (20, 1)], [x[0]], [10])
    assert len(rows) == 3 and run_search(spark, [], [], [x[0]], [2]) == [] and run_search(spark, x, [(10, 1), (10, 2), (20, 1)], [], []) == []
