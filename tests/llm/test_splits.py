from __future__ import annotations

import random
import unicodedata

import pytest

from moraine.llm import queries, splits
from moraine.llm.splits import leakage_free_splits, linked_keys, linked_pairs, normal_word

SHARES = [("train", 0.8), ("dev", 0.1), ("test", 0.1)]
SCHEMA = "ex_id long, k long, w string, nil boolean, grp string"


def groups_of(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, k, w, *_ in rows:
        w = normal_word(w)
        nodes = [n for n in (("k", k) if k is not None else None, ("w", w) if w else None) if n] or [("r", i)]
        for n in nodes:
            parent[find(n)] = find(nodes[0])
        parent[find(("r", i))] = find(nodes[0])
    return {i: find(("r", i)) for i, *_ in rows}


def test_words_agree():
    e = unicodedata.normalize("NFD", "Café  Noir")
    assert normal_word(e) == normal_word("CAFÉ noir ") == normal_word("café noir")
    assert normal_word(" \t\n ") is None and normal_word("") is None and normal_word(None) is None
    assert normal_word("STRASSE") == normal_word("straße")


def test_related_records_stay_together(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        k = rng.choice([None, 7, 7, rng.randrange(300)])
        w = rng.choice([None, "", " ", f"W{rng.randrange(900)}", f"w{rng.randrange(900)} ", f"solo{i}"])
        rows.append((i, k, w, rng.choice([True, False, None]), "x"))
    rows += rows[:100]
    df = spark.createDataFrame(rows, SCHEMA)
    assignment, links, report = leakage_free_splits(df, "ex_id", "k", "w", "nil", SHARES)
    got = {r["ex_id"]: r for r in assignment.collect()}
    assert len(got) == 1500
    want = groups_of(rows[:1500])
    by = {}
    for i, g in want.items():
        by.setdefault(g, set()).add((got[i]["grp"], got[i]["split"]))
    assert all(len(v) == 1 for v in by.values())
    assert len({next(iter(v))[0] for v in by.values()}) == len(by)
    assert sum(r["records"] for r in report.collect()) == 1500
    keys = {k for _, k, *_ in rows if k is not None}
    root = {k: next(want[i] for i, kk, *_ in rows if kk == k) for k in keys}
    pairs = {tuple(r) for r in linked_pairs(links).collect()}
    assert pairs == {(a, b) for a in keys for b in keys if a < b and root[a] == root[b]}


def test_long_row_of_keys(spark):
    pairs = [(i, f"w{i}") for i in range(50)] + [(i + 1, f"w{i}") for i in range(50)]
    got = linked_keys(spark.createDataFrame([*pairs, (99, None), (None, "w3")], "key long, word string")).collect()
    assert {r["key"]: r["label"] for r in got} == {i: 0 for i in range(51)}


def test_shares_and_labels_are_close(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3000), f"s{i}", rng.random() < 0.3, "") for i in range(6000)]
    _, _, report = leakage_free_splits(spark.createDataFrame(rows, SCHEMA), "ex_id", "k", "w", "nil", SHARES)
    assert all(abs(r["share"] - r["target_share"]) < 0.02 for r in report.collect())


def test_too_many_classes_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(splits, "MAX_CLASSES", 2, raising=False)
    monkeypatch.setattr(splits, "MAX_LARGE_GROUPS", 2)
    rows = [(i, i, f"s{i}", (True, False, None)[i % 3], "") for i in range(9)]
    with pytest.raises(ValueError, match="more than 2 classes"):
        leakage_free_splits(spark.createDataFrame(rows, SCHEMA), "ex_id", "k", "w", "nil", SHARES)
    _, _, report = leakage_free_splits(spark.createDataFrame(rows, SCHEMA).filter("nil is not null"), "ex_id", "k", "w", "nil", SHARES)
    assert sum(r["records"] for r in report.collect()) == 6


def test_too_many_splits_are_an_error(spark, tmp_path):
    spark.createDataFrame([(f"s{i}", 0.01) for i in range(101)], "split_name string, target_share double").write.parquet(f"{tmp_path}/split_targets.parquet")
    spark.createDataFrame([(1, 2, "w", True)], "ex_id long, wikiid long, word string, nil boolean").write.parquet(f"{tmp_path}/mentions.parquet")
    with pytest.raises(ValueError, match="more than 100 splits"):
        queries.p6_splits(spark, str(tmp_path))


def test_no_records(spark):
    a, links, report = leakage_free_splits(spark.createDataFrame([], SCHEMA), "ex_id", "k", "w", "nil", SHARES)
    assert a.count() == links.count() == report.count() == 0
