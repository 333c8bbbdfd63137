from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.operators import dataset as D
from moraine.operators import kb, nil


def test_score_statistics(spark):
    df = spark.createDataFrame([(1, 9.0), (1, 7.0), (1, 5.0), (2, 4.0), (3, 2.0), (3, 2.0), (3, None)], "q long, s double")
    r = {x["q"]: x for x in nil.score_statistics(df, "q", "s").collect()}
    assert (r[1]["max"], r[1]["second"], r[1]["secondiff"], r[1]["mean"], r[1]["median"], r[1]["stdev"]) == (9, 7, 2, 7, 7, 2)
    assert r[2]["second"] is None and r[2]["stdev"] is None and r[3]["second"] == 2 and r[3]["secondiff"] == 0


def test_features_and_dummies(spark):
    schema = "max_bi double, max_cross double, jaccard double, levenshtein double, mention string, title string, topcandidates array<struct<score double>>"
    rows = [(0.0, None, None, 0.5, "New York city", "new york", [(9.0,), (7.0,), (-1000.0,)]), (1.0, 2.0, None, None, None, None, [])]
    df = spark.createDataFrame(rows, schema)
    a, b = nil.nil_features(df).collect()
    assert a["jaccard"] == pytest.approx(2 / 3) and a["levenshtein"] == 0.5 and (a["mean"], a["secondiff"], a["median"]) == (8, 2, 8) and a["max_bi"] == 0.0
    assert b["jaccard"] is None and b["mean"] is None and b["stdev"] is None
    c = nil.nil_features(df, keep_dummies=True, zero_is_missing=True).first()
    assert c["mean"] == pytest.approx((9 + 7 - 1000) / 3) and c["max_bi"] is None and c["stdev"] == pytest.approx(statistics.stdev([9, 7, -1000]))


def test_client_features_and_decision(spark):
    df = spark.createDataFrame([(1, [(3.0, 1.0, "t")]), (2, []), (3, None)], "query long, candidates array<struct<score double, bi_score double, title string>>")
    r = {x["query"]: x for x in nil.client_features(df).collect()}
    assert (r[1]["is_nil"], r[1]["max_bi"], r[1]["title"]) == (None, 3.0, "t") and r[2]["is_nil"] and r[3]["is_nil"]
    x = nil.client_features(df, cross=True).filter("query = 1").first()
    assert (x["max_bi"], x["max_cross"]) == (1.0, 3.0)
    s = spark.createDataFrame([(0.5,), (0.49,), (None,)], "nil_score double")
    assert [r["is_nil"] for r in nil.decide(s).collect()] == [False, True, True]


def test_model_learns_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y), int(x - y > 0)) for i, (x, y) in enumerate(rng.standard_normal((400, 2)))] + [(900, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    model = nil.fit_nil_model(df.filter("k < 300 or k = 900"), ["a", "b"], "y")
    out = nil.predict_nil(model, df.filter("k >= 300"), ["a", "b"]).collect()
    got = [(r["y"], r["nil_score"]) for r in out if r["nil_score"] is not None]
    assert len(out) == 101 and sum((p > 0.5) == y for y, p in got) / len(got) > 0.93
    assert [r for r in out if r["k"] == 900][0]["nil_score"] is None
    under = nil.undersample(df.withColumn("y", F.when(F.col("k") < 50, 0).otherwise(1)), "y", "k").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in under} == {0: 50, 1: 50}


def test_measures_and_roc(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False), (None, True)], "t boolean, g boolean")
    m = nil.binary_measures(df, "t", "g").first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"], m["precision_1"], m["recall_1"], m["accuracy"]) == (2, 0, 1, 1, 1.0, 0.5, 0.75)
    assert tuple(nil.normalized_confusion(df, "t", "g").first()) == (1.0, 0.0, 0.5, 0.5)
    assert nil.binary_measures(df.limit(0), "t", "g").first()["f1_1"] == 0.0
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in nil.roc_points(spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int"), "s", "y").collect()}
    assert roc == {0.9: (0.0, 0.5), 0.8: (0.5, 1.0), 0.1: (1.0, 1.0)}


def test_prior_and_propagation(spark):
    f = spark.createDataFrame([(1, 2), (2, 4), (3, 2)], "wikiid long, freq long")
    p = {r["wikiid"]: r for r in D.nil_prior(f).collect()}
    assert p[1]["p_formula"] == pytest.approx(0.1) and p[2]["p_formula"] == pytest.approx(0.01) and p[1]["nil"] == (p[1]["p_uniform"] < 0.1)
    prior = spark.createDataFrame([(1, 2, 0.1, 0.05, True), (2, 4, 0.01, 0.5, False)], "wikiid long, freq long, p_formula double, p_uniform double, nil boolean")
    out = {r["wikiid"]: r for r in D.propagate_prior(spark.createDataFrame([(1,), (2,), (9,), (None,)], "wikiid long"), prior).collect()}
    assert (out[1]["freq"], out[1]["nil"]) == (0, True) and out[2]["freq"] == 4 and (out[9]["p_formula"], out[9]["nil"]) == (-1, False) and out[None]["nil"] is False


def test_samples_and_moves(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 3), ("b", 4), ("c", 2)) for i in range(n)], "k string, i int")
    for target in (0, 1, 5, 100):
        got = D.transplant_sample(rows, ["k"], target).orderBy("before").collect()
        total = sum(r["n"] for r in got)
        assert total >= min(target, 9) and (len(got) == 1 or total - got[-1]["n"] < target)
    chosen = D.transplant_sample(rows, ["k"], 1)
    left, moved = D.move_rows(rows, rows.limit(0), chosen, ["k"])
    assert left.count() + moved.count() == 9 and D.shared_keys(left, moved, ["k"]).isEmpty()


def test_stratified_batches(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.choice("aaaabc")) for i in range(203)], "i long, s string")
    got = D.stratified_batches(df, "s", "i", 10).collect()
    for s in (None, "a", "b", "c"):
        sizes = [sum(r["batch"] == b for r in got if s in (None, r["s"])) for b in range(10)]
        assert max(sizes) - min(sizes) <= 1


def test_kb_tables(spark, tmp_path):
    lines = spark.createDataFrame([(0, "https://x/wiki?curid=12", "T" * 120, "d"), (1, "77", "b", None), (2, "none", None, "e")], "line_no long, idx string, title string, text string")
    e = kb.catalogue_entities(lines)
    rows = {r["id"]: r for r in e.collect()}
    assert (rows[0]["wikipedia_id"], len(rows[0]["title"]), rows[1]["wikipedia_id"], rows[2]["wikipedia_id"], rows[2]["title"]) == (12, 100, 77, -1, "")
    with pytest.raises(ValueError):
        kb.assert_unique(e.unionByName(e), "id", "indexer")
    gone = spark.createDataFrame([(12,), (None,), (-1,)], "wikipedia_id int")
    assert {r["id"] for r in kb.delete_entities(e, gone).collect()} == {1}
    assert kb.delete_statement(gone).first()[0] == "DELETE FROM entities WHERE indexer=10 AND wikipedia_id IN (-1,12);"
    new = kb.grow(e, spark.createDataFrame([(5, "x", 2), (6, "y", 9), (7, None, 2)], "cluster long, title string, n_elements long"), 40)
    assert {r["cluster"]: (r["id"], r["wikipedia_id"], r["indexer"]) for r in new.collect()} == {6: (40, -1, 20), 5: (41, -1, 20), 7: (42, -1, 20)}
    path = str(tmp_path / "kb")
    kb.write_partition(e, path)
    kb.write_partition(new.drop("cluster"), path)
    kb.write_partition(new.drop("cluster").limit(1), path, "overwrite")
    assert {r["indexer"]: r["count"] for r in spark.read.parquet(path).groupBy("indexer").count().collect()} == {10: 3, 20: 1}
    assert kb.reset(e.unionByName(new.drop("cluster"))).count() == 3
    t = kb.title_lookup(spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6)], "id int, title string, descr string, wikipedia_id int")).first()
    assert (t["id"], t["descr"]) == (2, "y")


def test_ablation_tasks(spark):
    from moraine.operators import nil as N

    names = N.ABLATION_TASKS.split()
    assert len(names) == len(set(names)) == 19
    assert N.task_features("nilp_under_bi_max_stats10_jaccard") == (True, ["max", "mean", "median", "stdev", "jaccard"])
    rows = [(i, float(i % 10), (i % 7) / 7, int(i % 10 > 4), int(i % 10 > 4), int(i % 10 > 4)) for i in range(200)] + [(999, None, 0.1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "query long, max double, secondiff double, labels int, baseline int, correct int")
    got = {r["name"]: r for r in N.ablation_table(df, df, ("nilp_bi_max", "nilp_under_bi_max_secondiff")).collect()}
    assert got["nilp_bi_max"]["acc"] == 100.0 and got["nilp_bi_max"]["train_rows"] == 200 and got["nilp_bi_max"]["acc_adjusted"] < 100
    assert got["nilp_under_bi_max_secondiff"]["macro_f1"] > 99
