from __future__ import annotations

import random
import statistics
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from moraine.operators.ranking import grouped_median, hash_uniform, rank_of_values, running_weight
from moraine.operators.skew import distinct_records, keyed_summary


def test_running_weight_of_hot_and_null_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([1, 2, 5, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, w int")
    got = {r["i"]: r["before"] for r in running_weight(df, ["g"], [F.col("i")], "w").collect()}
    sums = defaultdict(int)
    for g, i, w in rows:
        assert got[i] == sums[g]
        sums[g] += w or 0
    assert running_weight(df.limit(0), ["g"], [F.col("i")], "w").count() == 0


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", 1.0), ("b", 2.0)], "g string, v double")
    assert {(r["g"], r["v"]): r["rank"] for r in rank_of_values(df, ["g"], "v").collect()} == {("a", 3.0): 1, ("a", 1.0): 3, ("b", 2.0): 1}


def test_hash_uniform_is_stable(spark):
    u = [r[0] for r in spark.range(1000).select(hash_uniform(7, F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 1000 - 0.5) < 0.05


def test_keyed_summary_against_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["x", "y", "z", None, ""]), rng.choice([True, False, None]), rng.choice([None, 1, 2, 7])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k long, v string, f boolean, n int").withColumn("weight", F.lit("clash"))
    got = {r["k"]: r for r in keyed_summary(df, "k", "v", "f", "n").collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        counts = Counter(r[1] for r in own if r[1] is not None)
        top = min(counts, key=lambda v: (-counts[v], v))
        flags = [r[2] for r in own if r[2] is not None]
        r = got[k]
        assert (r["n_records"], r["n_values"], r["top_value"], r["top_count"]) == (len(own), len(counts), top, counts[top])
        assert abs(r["flag_share"] - sum(flags) / len(flags)) < 1e-12
        assert r["number_median"] == statistics.median(r[3] for r in own if r[3] is not None)
    assert keyed_summary(df.limit(0), "k", "v", "f", "n").count() == 0


def test_grouped_median(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 1.0, 2.5, 7.0, 9.0])) for _ in range(301)] + [("c", 4.0), ("d", None)]
    got = {r["g"]: r["median"] for r in grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {g: statistics.median(v for h, v in rows if h == g and v is not None) for g in ("a", "b", None, "c")}


def test_distinct_records(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (None, "z"), (2, None)], "k int, v string")
    assert {tuple(r) for r in distinct_records(df, "k", "v").collect()} == {(1, None), (2, None)}
