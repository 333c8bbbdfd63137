from __future__ import annotations

from moraine.llm import sampling, splits


def test_undecided_units_meet_in_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK_ROWS", 4)
    rows = [(i, 1, i % 5 == 0) for i in range(300)] + [(1000 + i, 2, True) for i in range(7)]
    df = spark.createDataFrame(rows, "item long, batch int, nil boolean")
    targets = spark.createDataFrame([("nil", True, 0.25, 5, 40), ("known", False, 0.75, 5, 40)], "category string, value boolean, target_share double, min_rows int, sample_rows int")
    sample, report = sampling.draw_sample(df, "item", "batch", "nil", targets)
    got = sample.collect()
    assert len({r["item"] for r in got}) == len(got) and {(r["item"], r["batch"]) for r in got} <= {(i, b) for i, b, _ in rows}
    by = {(r["batch"], r["category"]): r for r in report.collect()}
    assert abs(by[1, "nil"]["drawn"] - 10) <= 1 and abs(by[1, "known"]["drawn"] - 30) <= 1 and by[1, "nil"]["drawn"] + by[1, "known"]["drawn"] == 40
    assert by[2, "nil"]["drawn"] == 7 and not by[2, "nil"]["met"] and not by[2, "nil"]["drawn_met"] and by[2, "nil"]["short"] == 3
    assert by[2, "known"]["drawn"] == 0 and by[2, "known"]["gap"] == 30
    assert {tuple(r) for r in sampling.draw_sample(df.repartition(7), "item", "batch", "nil", targets)[0].collect()} == {tuple(r) for r in got}


def test_linked_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(splits, "PAIR_BLOCK", 3)
    groups = {0: list(range(11)), 50: [50, 51], 70: [70]}
    labels = spark.createDataFrame([(k, g) for g, ks in groups.items() for k in ks], "key long, label long")
    got = [tuple(r) for r in splits.linked_pairs(labels).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for ks in groups.values() for a in ks for b in ks if a < b}
