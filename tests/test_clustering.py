from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from moraine.operators import blocks
from moraine.operators import clustering as C
from moraine.operators.retrieval import approximate_top_k, candidate_arrays, join_entities, merge_lists, rank_of_gold


def vectors(spark, rows, grp=1):
    return spark.createDataFrame([(grp, i, [float(x) for x in r]) for i, r in enumerate(rows)], "grp long, item long, vector array<float>")


def fold(n, links):
    label = list(range(n))
    for i in range(n):
        for j in range(n):
            if i != j and (min(i, j), max(i, j)) in links:
                label[j] = label[i]
    return label


def test_greedy_path_is_not_a_component(spark):
    pairs = spark.createDataFrame([(1, 3), (0, 3), (0, 2)], "a long, b long")
    got = {r["item"]: r["cluster"] for r in C.greedy_clusters(spark.range(4).withColumnRenamed("id", "item"), pairs).collect()}
    assert [got[i] for i in range(4)] == [1, 1, 0, 1]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_the_global_fold(spark, seed):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((40, 6))
    links = {(i, j) for i in range(40) for j in range(i + 1, 40) if np.float32(rows[i]).astype(float) @ np.float32(rows[j]).astype(float) > 4}
    items = vectors(spark, rows)
    pairs = blocks.group_pairs(items, 6, 4.0)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == links
    got = {r["item"]: r["cluster"] for r in C.greedy_clusters(items, pairs).collect()}
    assert [got[i] for i in range(40)] == fold(40, links)


def test_pairs_of_a_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "GROUP_BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = np.float32(rng.standard_normal((60, 4)))
    both = vectors(spark, rows, 1).unionByName(vectors(spark, rows[:9], 2)).unionByName(vectors(spark, rows[:3], 1))
    got = [tuple(r)[:3] for r in blocks.group_pairs(both, 4, 0.5, cosine=True, strict=False).collect()]
    u = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    want = {(g, i, j) for g, n in ((1, 60), (2, 9)) for i in range(n) for j in range(i + 1, n) if u[i] @ u[j] >= 0.5}
    assert len(got) == len(set(got)) and set(got) == want


def test_gate_of_the_centroid_merge(spark):
    def run(first):
        rows = [(1, 0, 0, [first, 0.0]), (1, 5, 5, [2.0, 0.01]), (1, 9, 9, [0.0, 1.0])]
        df = spark.createDataFrame(rows, "grp long, comp long, item long, vector array<float>")
        return {r["item"]: r["cluster"] for r in C.centroid_merge(df, 2, 0.05, 80.0).collect()}

    assert run(9.0) == {0: 0, 5: 0, 9: 9}
    assert run(80.0**0.5 - 1e-3) == {0: 0, 5: 5, 9: 9}


def test_packaging(spark):
    rows = spark.createDataFrame([(1, 10, "b"), (1, 11, "a"), (1, 12, "a"), (1, 13, None), (2, 20, "z"), (2, 21, "y")], "c long, i long, m string")
    v = spark.createDataFrame([(10, [1.0, 0.0]), (11, [3.0, 0.0]), (20, [0.0, 2.0])], "i long, vector array<float>")
    got = {r["c"]: r for r in C.package_clusters(rows, "c", "i", "m", v, 2).collect()}
    assert got[1]["title"] == "a" and got[2]["title"] == "y" and got[1]["n_elements"] == 4
    assert got[1]["mentions"] == ["b", "a", "a", None] and got[1]["mentions_id"] == [10, 11, 12, 13]
    import base64

    assert np.frombuffer(base64.b64decode(got[1]["center"]), "<f4").tolist() == [1.0, 0.0]  # the medoid, the smaller item on a tie


def test_medoid_and_modes(spark):
    items = vectors(spark, [[0.5], [1.5], [5.5]])
    assert [tuple(r) for r in C.medoids(items, 1).collect()] == [(1, 1, 5.0)]
    g = spark.createDataFrame([("x", 7), ("x", 7), ("x", 8), ("y", 7), ("y", 8), ("z", 7), ("z", 8), ("z", 9), ("z", None)], "c string, g long")
    assert {r["c"]: (r["mode"], r["modes"]) for r in C.gold_modes(g, "c", "g").collect()} == {"x": (7, [7]), "y": (None, [7, 8]), "z": (None, [7, 8, 9])}
    assert {r["grp"]: r["median"] for r in C.median_vectors(items, "grp").collect()} == {1: [1.5]}


def test_break_and_batches(spark):
    rows = [(1, i, f"mention{i % 30}") for i in range(60)] + [(2, 100 + i, "Same") for i in range(40)]
    df = spark.createDataFrame(rows, "c long, i long, m string")
    got = C.break_oversized(df, "c", "i", "m").collect()
    assert len({r["part"] for r in got if r["c"] == 1}) == 30 and {r["part"] for r in got if r["c"] == 2} == {None}
    b = {r["i"]: r["batch"] for r in C.batches_of(df, "i", 16).collect()}
    assert [sum(v == k for v in b.values()) for k in range(7)] == [16] * 6 + [4]


def test_feature_similarity_by_hand(spark):
    import math

    t = spark.createDataFrame([(1, "ab cd"), (1, "ab ce"), (1, "ab cd"), (1, None), (1, ""), (2, "ab cd")], "grp long, text string")
    got = [tuple(r) for r in C.feature_similarities(t, 0.3).collect()]
    idf = lambda df: math.log(5 / (1 + df)) + 1
    word = idf(3) ** 2 / math.sqrt(idf(3) ** 2 + idf(2) ** 2) / math.sqrt(idf(3) ** 2 + idf(1) ** 2)
    assert [(a, b, c) for a, b, c, _ in got] == [(1, "ab cd", "ab ce")] and got[0][3] == pytest.approx(0.8 * 3 / 4 + 0.2 * word)


def test_prefix_join_misses_no_pair(spark):
    rng = np.random.default_rng(6)
    names = ["".join(rng.choice(list("abc "), rng.integers(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i % 2, n) for i, n in enumerate(names)], "grp long, text string")
    wide = {tuple(r)[:3]: r["score"] for r in C.feature_similarities(df, 0.2001).collect()}
    for bar in (0.5, 0.8, 0.95):
        assert {tuple(r)[:3] for r in C.feature_similarities(df, bar).collect()} == {k for k, s in wide.items() if s > bar}


def test_feature_clusters_equal_the_fold(spark):
    rng = np.random.default_rng(9)
    words = ["red house", "red houses", "blue house", "mill", None]
    contexts = ["by the old river", "by the old river bank", "in town", ""]
    rows = [(int(rng.integers(0, 2)), i, words[rng.integers(0, 5)], contexts[rng.integers(0, 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "grp long, item long, mention string, context string")
    for bar in (0.5, 0.85, 0.95):
        pairs = df.filter("mention is not null").select("grp", F.col("mention").alias("text"), "context")
        wide = {(r["grp"], r["text_a"], r["context_a"], r["text_b"], r["context_b"]) for r in C.feature_similarities(pairs, bar).collect()}
        full = lambda w, c: (0.8 if len(w) > 1 else 0) + (0.2 if c else 0)
        want = {}
        for g in (0, 1):
            own = [r for r in rows if r[0] == g]
            label = {r[1]: r[1] for r in own}
            for _, i, w, c in own:
                for _, j, x, d in own:
                    same = w is not None and (w, c) == (x, d) and full(w, c) > bar
                    if same or (g, w, c, x, d) in wide or (g, x, d, w, c) in wide:
                        label[j] = label[i]
            want.update(label)
        assert {r["item"]: r["cluster"] for r in C.feature_clusters(df, bar).collect()} == want
    assert C.feature_clusters(df.limit(0), 0.9).count() == 0


def test_clusterers_under_one_interface(spark):
    rows = [(1, 1, "Rome", "", [9.0, 0.0]), (1, 2, "Rome", "", [9.0, 0.1]), (1, 3, "Roma", "", [9.0, 0.05]), (1, 4, "Oslo", "", [0.0, 9.0]), (1, 5, "Oslo", "", None)]
    df = spark.createDataFrame(rows, "grp long, item long, mention string, context string, vector array<float>")
    got = lambda kind: {r["item"]: r["cluster"] for r in C.cluster_mentions(df, 2, kind).collect()}
    assert got("three_step") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert got("greedy") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert got("feature") == {i: i for i in range(1, 6)}  # no context, no score above the share of the mention
    with pytest.raises(ValueError):
        C.cluster_mentions(df, 2, "other")


def test_exact_and_approximate_search(spark, monkeypatch):
    monkeypatch.setattr(blocks, "COLLECTION_BLOCK", 64)
    rng = np.random.default_rng(2)
    kb = np.float32(rng.standard_normal((300, 8)))
    q = np.float32(kb[:40] + 0.1 * rng.standard_normal((40, 8)))
    c = spark.createDataFrame([(10 + 10 * (i % 2), i // 2, [float(x) for x in r]) for i, r in enumerate(kb)], "space int, id long, vector array<float>")
    asked = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)] + [(99, None)], "query long, vector array<float>")
    got = {(r["query"], r["space"], r["rank"]): (r["id"], r["score"]) for r in blocks.exact_top_k(asked, c.unionByName(c.limit(9)), 8, 5).collect()}
    s = q.astype(float) @ kb.astype(float).T
    for i in range(40):
        for par, space in ((0, 10), (1, 20)):
            own = sorted(range(par, 300, 2), key=lambda j: (-s[i, j], j))[:5]
            assert [got[(i, space, k + 1)][0] for k in range(5)] == [j // 2 for j in own]
    assert len(got) == 400
    near = approximate_top_k(asked.filter("query < 99"), c, 5).collect()
    hits = sum((r["query"], r["space"], r["id"]) in {(k[0], k[1], v[0]) for k, v in got.items()} for r in near)
    assert hits / 400 >= 0.9
    assert blocks.exact_top_k(asked, c.limit(0), 8, 5).count() == 0


def test_candidates_with_dummies(spark):
    c = spark.createDataFrame([(1, 5, 10, 3.0, 5.0, 1.0), (1, 6, 10, 9.0, 5.0, 1.0), (1, 5, 20, 4.0, 5.0, 1.0), (2, 6, 10, 1.0, 0.0, 0.0)], "query long, id int, indexer int, raw_score double, query_norm double, entry_norm double")
    e = spark.createDataFrame([(5, 10, 77, "t", "x"), (5, 10, 77, "t", "x"), (5, 20, -1, "u", None)], "id int, indexer int, wikipedia_id int, title string, type_ string")
    ranked = merge_lists(join_entities(c, e))
    rows = {(r["query"], r["rank"]): r for r in ranked.collect()}
    assert (rows[1, 1]["indexer"], rows[1, 1]["url"]) == (20, "") and rows[1, 2]["norm_score"] == pytest.approx(0.12)
    d = rows[1, 3]
    assert (d["id"], d["score"], d["wikipedia_id"], d["title"], d["url"], d["dummy"], d["norm_score"]) == (6, -1000.0, 0, "", "", 1, None)
    gold = spark.createDataFrame([(1, 77), (2, 77), (3, None)], "query long, gold long")
    assert {r["query"]: r["gold_rank"] for r in rank_of_gold(ranked, gold).collect()} == {1: 2, 2: -1, 3: -1}
    assert [x["id"] for x in candidate_arrays(ranked).filter("query = 1").first()["candidates"]] == [5, 5, 6]


def test_top_lists_in_blocks_and_pieces_equal_all_products(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    base[base.any(axis=1) == 0] = 1.0
    c = [(s, i, 100 * i + s, base[(i + s) % 60].tolist()) for s in (1, 2) for i in range(60)]
    q = [(f"q{i}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(25)]
    q = [(n, v if any(v) else [1.0, 0, 0, 0]) for n, v in q]
    c_df, q_df = spark.createDataFrame(c, "space int, id long, tag long, vector array<double>"), spark.createDataFrame(q, "query string, vector array<double>")
    want = {(n, s): sorted((-float(np.dot(v, x)), i, t) for z, i, t, x in c if z == s)[:7] for n, v in q for s in (1, 2)}
    for asked, packed in ((16384, 16384), (3, 8), (10, 5)):
        monkeypatch.setattr(blocks, "QUERY_BLOCK", asked)
        monkeypatch.setattr(blocks, "COLLECTION_BLOCK", packed)
        got = {(r["query"], r["space"]): [(e["less"], e["id"], e["tag"]) for e in r["found"]] for r in blocks.top_lists(q_df, c_df, 4, 7).collect()}
        assert got == want
        flat = blocks.exact_top_k(q_df, c_df.drop("tag"), 4, 7)
        assert {(r["query"], r["space"], r["rank"]): (-r["score"], r["id"]) for r in flat.collect()} == {(*n, i + 1): e[:2] for n, x in want.items() for i, e in enumerate(x)}
        # queries are not copied to each block of the collection, nor candidates sorted in a window
        assert "Window" not in flat._jdf.queryExecution().toString()
