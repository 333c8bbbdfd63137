from __future__ import annotations

import random

from moraine.operators.graph import connected_components
from moraine.operators.hierarchy import descendants, heavy_paths

SCHEMA = "node long, parent long"


def brute(rows):
    parent = {}
    for n, p in rows:
        if n is not None:
            old = parent.get(n)
            parent[n] = p if old is None else old if p is None else min(old, p)
    for n, p in parent.items():
        if p not in parent:
            parent[n] = None
    out = {}
    for n in parent:
        path, x, seen = [n], n, {n}
        while parent[x] is not None:
            x = parent[x]
            if x in seen:
                path = None
                break
            seen.add(x)
            path.append(x)
        out[n] = path[::-1] if path else None
    cyc = set()
    for n, p in out.items():
        if p is None:
            x, seen = n, []
            while x not in seen:
                seen.append(x)
                x = parent[x]
            cyc |= set(seen[seen.index(x):])
    return parent, out, cyc


def check(spark, rows):
    parent, paths, cyc = brute(rows)
    full = heavy_paths(spark.createDataFrame(rows, SCHEMA))
    got = {r["node"]: r for r in full.collect()}
    assert set(got) == set(parent)
    for n, p in paths.items():
        r = got[n]
        if p is None:
            assert r["state"] == ("cycle" if n in cyc else "stray") and r["root"] is None and r["path"] is None
        else:
            assert (r["path"], r["depth"], r["root"]) == (p, len(p) - 1, p[0])
            assert r["state"] == ("root" if len(p) == 1 else "child")
    good = [n for n, p in paths.items() if p]
    for n in good:  # the interval holds the descendants and nothing else
        inside = {m for m in good if got[m]["root"] == got[n]["root"] and got[n]["first"] < got[m]["first"] <= got[n]["last"]}
        assert inside == {m for m in good if n in paths[m][:-1]}
        assert got[n]["n_descendants"] == len(inside)
    want = {(a, n) for n in good for a in paths[n][:-1]}
    have = [tuple(r) for r in descendants(full).collect()]
    assert len(have) == len(set(have)) and set(have) == want


def test_random_forest_with_cycles_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, rng.randrange(60), rng.randrange(80), i - 1])) for i in range(60)]
    rows += rows[:5] + [(None, 3), (None, None)]
    check(spark, rows)


def test_deep_chain_and_hot_root(spark):
    rows = [(i, i - 1) for i in range(1, 70)] + [(0, None)] + [(1000 + i, 0) for i in range(100)]
    check(spark, rows)


def test_pure_cycles(spark):
    check(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 5), (7, 6)])


def test_empty_and_clashing_columns(spark):
    assert heavy_paths(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, None, 9, "x"), (2, 1, 8, "y")], "node long, parent long, size long, root string")
    assert {r["node"]: r["root"] for r in heavy_paths(df).collect()} == {1: 1, 2: 1}


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(None, 4), (5, 5)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(label)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
