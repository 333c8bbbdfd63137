"""Linking and clustering measures over long tables (item, true_id, pred_id)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.operators.graph import connected_components
from moraine.session import cut, release

TINY = 1e-13


def contingency(df: DataFrame, true_id: str = "true_id", pred_id: str = "pred_id") -> DataFrame:
    """t, p, n, nt, np: items in both clusters, and in each. Rows with a null side do not count."""
    cells = df.filter(F.col(true_id).isNotNull() & F.col(pred_id).isNotNull()).groupBy(F.col(true_id).alias("t"), F.col(pred_id).alias("p")).agg(F.count("*").alias("n"))
    return cells.join(cells.groupBy("t").agg(F.sum("n").alias("nt")), "t").join(cells.groupBy("p").agg(F.sum("n").alias("np")), "p")


def bcubed(cells: DataFrame) -> DataFrame:
    """One row: precision, recall, f1 (B-cubed); null without items."""
    n = F.col("n").cast("double")
    sums = cells.agg(F.sum(n * n / F.col("np")).alias("p"), F.sum(n * n / F.col("nt")).alias("r"), F.sum(n).alias("all"))
    p, r = F.col("p") / F.col("all"), F.col("r") / F.col("all")
    return sums.select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"))


def muc(cells: DataFrame) -> DataFrame:
    """One row: MUC precision, recall, f1, each guarded by 1e-13."""
    sides = []
    for side, size, name in (("p", "np", "precision"), ("t", "nt", "recall")):
        per = cells.groupBy(side).agg(F.max(size).alias("s"), F.count("*").alias("k"))
        sides.append(per.agg((F.sum(F.col("s") - F.col("k")) / (F.sum(F.col("s") - 1) + TINY)).alias(name)))
    both = sides[0].crossJoin(F.broadcast(sides[1]))  # one row each
    p, r = F.col("precision"), F.col("recall")
    return both.select(p, r, (2 * p * r / (p + r + TINY)).alias("f1"))


def phi4(cells: DataFrame) -> DataFrame:
    return cells.select("t", "p", (2.0 * F.col("n") / (F.col("nt") + F.col("np"))).alias("phi"))


def best_matching(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Largest total of a matching over edges (a, b, w >= 0), a and b numbered from 0, each pair once.

    Shortest augmenting paths over the edges alone, with potentials; a row may also stay free at no gain.
    """
    n, m = int(a.max(initial=-1)) + 1, int(b.max(initial=-1)) + 1
    order = np.argsort(a, kind="stable")
    starts = np.searchsorted(a[order], np.arange(n + 1))
    ends, costs = b[order], -w[order].astype(float)
    u = np.array([min(0.0, costs[s:e].min(initial=0.0)) for s, e in zip(starts[:-1], starts[1:], strict=True)])
    v = np.zeros(m + n)  # column m + i stands for row i staying free
    owner, mine = np.full(m + n, -1), np.full(n, -1)
    for root in range(n):
        reach, back, done = {}, {}, {}
        heap: list[tuple[float, int]] = []
        row, at, goal = root, 0.0, -1
        while goal < 0:
            free = m + row
            for j, c in [*zip(ends[starts[row] : starts[row + 1]].tolist(), costs[starts[row] : starts[row + 1]].tolist(), strict=True), (free, 0.0)]:
                d = at + c - u[row] - v[j]
                if j not in done and d < reach.get(j, math.inf) - 1e-15:
                    reach[j], back[j] = d, row
                    heapq.heappush(heap, (d, j))
            while heap:
                at, j = heapq.heappop(heap)
                if j not in done and at <= reach[j]:
                    break
            done[j] = at
            if owner[j] < 0:
                goal = j
            else:
                row = owner[j]
        length = at
        u[root] += length
        for j, d in done.items():
            if owner[j] >= 0:
                u[owner[j]] += length - d
            v[j] -= length - d
        j = goal
        while True:
            i = back[j]
            freed, owner[j], mine[i] = mine[i], i, j
            if i == root:
                break
            j = freed
    value = {(x, y): z for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True)}
    return float(sum(value[(owner[j], j)] for j in range(m) if owner[j] >= 0))


def matching_total(edges: DataFrame) -> DataFrame:
    """One row `total`: the largest total of a one-to-one matching over edges (a long, b long, w > 0, each pair once).

    An edge that weighs at least as much as the best other edges of both of its ends together belongs to
    a best matching, so such edges are taken in rounds and their ends leave. What is left, cells that
    compete closely, splits into connected components, each solved in one task over its edges.
    """
    spark = edges.sparkSession
    live, taken = cut(edges.select("a", "b", F.col("w").cast("double").alias("w"))), 0.0
    while True:
        first = {}
        for side, other in (("a", "b"), ("b", "a")):
            best = Window.partitionBy(side).orderBy(F.col("w").desc(), other)
            top = live.withColumn("_r", F.row_number().over(best)).filter("_r <= 2")
            first[side] = top.groupBy(side).agg(
                F.max(F.when(F.col("_r") == 1, F.col(other))).alias(other), F.max(F.when(F.col("_r") == 1, F.col("w"))).alias("w"),
                F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("w"))), F.lit(0.0)).alias(f"rest_{side}"),
            )
        sure = cut(first["a"].join(first["b"].drop("w"), ["a", "b"]).filter(F.col("w") >= F.col("rest_a") + F.col("rest_b")).select("a", "b", "w"))
        gain = sure.agg(F.sum("w")).first()[0]
        if gain is None:
            break
        taken += gain
        old, live = live, cut(live.join(sure.select("a"), "a", "left_anti").join(sure.select("b"), "b", "left_anti").select("a", "b", "w"))
        release(old, sure)
    rest = 0.0
    if not live.isEmpty():
        name = lambda c, k: F.xxhash64(F.lit(k), F.col(c))
        comps = connected_components(live.select(name("a", 0).alias("a"), name("b", 1).alias("b")))

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"total": [best_matching(pd.factorize(frame["a"])[0], pd.factorize(frame["b"])[0], frame["w"].to_numpy())]})

        placed = live.withColumn("node", name("a", 0)).join(comps, "node")
        rest = placed.groupBy("comp").applyInPandas(solve, "total double").agg(F.sum("total")).first()[0] or 0.0
    return spark.createDataFrame([(taken + rest,)], "total double")


def _edges(cells: DataFrame, weight: str) -> DataFrame:
    """Cells as edges between hashed cluster names, of whatever kind these are."""
    return cells.select(F.xxhash64(F.col("t").cast("string")).alias("a"), F.xxhash64(F.col("p").cast("string")).alias("b"), F.col(weight).alias("w"))


def ceaf_e(cells: DataFrame, swapped: bool = False) -> DataFrame:
    """One row: entity CEAF precision, recall, f1, null without items; precision is over predicted, recall over true clusters.

    `swapped` exchanges the two, as the published evaluation does.
    """
    best = matching_total(_edges(phi4(cells), "phi"))
    counts = cells.agg(F.countDistinct("t").alias("nt"), F.countDistinct("p").alias("np"))
    both = best.crossJoin(F.broadcast(counts))  # one row each
    p, r = F.when(F.col("np") > 0, F.col("total") / F.col("np")), F.when(F.col("nt") > 0, F.col("total") / F.col("nt"))
    p, r = (r, p) if swapped else (p, r)
    return both.select(p.alias("precision"), r.alias("recall"), F.when(p.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))).alias("f1"))


def clustering_report(df: DataFrame, swapped: bool = False) -> DataFrame:
    """One row with all measures, the number of predicted clusters, the median true size and the mean of the three f1."""
    cells = cut(contingency(df))
    out = None
    for prefix, one in (("muc", muc(cells)), ("b3", bcubed(cells)), ("ceaf", ceaf_e(cells, swapped))):
        one = one.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("precision", "recall", "f1")])
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    sizes = cells.groupBy("t").agg(F.max("nt").alias("s")).agg(F.median("s").alias("true_median_size"), F.count("*").alias("true_clusters_len"))
    count = cells.agg(F.countDistinct("p").alias("pred_clusters_len"))
    out = out.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(count))
    return out.withColumn("evalcluster_mean", (F.col("muc_f1") + F.col("b3_f1") + F.col("ceaf_f1")) / 3)


def aligned_count(cells: DataFrame) -> DataFrame:
    """One row `aligned`: the most items that a one-to-one matching of true and predicted clusters can keep."""
    return matching_total(_edges(cells, "n")).withColumnRenamed("total", "aligned")


def recall_at(ranks: DataFrame, ks: Sequence[int] = (1, 2, 3, 5, 10, 30, 100), rank: str = "gold_rank") -> DataFrame:
    """k, recall: share of rows with 1 <= rank <= k; no rows: recall null."""
    wide = ranks.agg(*[F.avg(F.col(rank).between(1, k).cast("double")).alias(str(k)) for k in ks])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("recall")) for k in ks])).alias("r")).select("r.k", "r.recall")


def recall_by(ranks: DataFrame, group: str, ks: Sequence[int], rank: str = "gold_rank") -> DataFrame:
    """kind ('group', 'micro' over all rows, 'macro': means over groups), group, n and r<k>."""
    stats = [F.count("*").alias("n"), *[F.avg(F.col(rank).between(1, k).cast("double")).alias(f"r{k}") for k in ks]]
    none = F.lit(None).cast(dict(ranks.dtypes)[group])
    per = ranks.groupBy(group).agg(*stats).withColumn("kind", F.lit("group"))
    micro = ranks.agg(*stats).withColumn(group, none).withColumn("kind", F.lit("micro"))
    macro = per.agg(F.sum("n").alias("n"), *[F.avg(f"r{k}").alias(f"r{k}") for k in ks]).withColumn(group, none).withColumn("kind", F.lit("macro"))
    return per.unionByName(micro).unionByName(macro).select("kind", group, "n", *[f"r{k}" for k in ks])


def recall_curve(ranks: DataFrame, rank: str = "gold_rank") -> DataFrame:
    """rank, cumulative recall in per cent over all rows, for every rank that occurs."""
    from moraine.operators.ranking import running_weight

    counts = ranks.filter(F.col(rank) > 0).groupBy(rank).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    total = ranks.agg(F.count("*").alias("_total"))
    run = running_weight(counts, ["_all"], [F.col(rank)], "_n", "_before").crossJoin(F.broadcast(total))  # one row
    return run.select(rank, ((F.col("_before") + F.col("_n")) / F.col("_total") * 100).alias("recall"))


def ranking_accuracy(df: DataFrame, label: str, guess: str, all_samples: int) -> DataFrame:
    """One row over rows whose label is among the candidates (>= 0): normalised, unnormalised accuracy, candidate recall."""
    ok = (F.col(label) == F.col(guess)).cast("double")
    kept = df.filter(F.col(label) >= 0)
    return kept.agg(
        F.avg(ok).alias("normalized"), (F.sum(ok) / F.lit(all_samples)).alias("unnormalized"), (F.count("*") / F.lit(all_samples)).alias("candidate_recall")
    )


def system_measures(df: DataFrame, gold: str, guess: str, nil: str = "NIL") -> DataFrame:
    """One row: micro precision, recall, f1 of linked answers; a NIL answer is no true positive."""
    tp = F.sum(((F.col(gold) == F.col(guess)) & (F.col(guess) != nil)).cast("long"))
    said = F.sum((F.col(guess) != nil).cast("long"))
    real = F.sum((F.col(gold) != nil).cast("long"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = df.agg(safe(tp, said).alias("precision"), safe(tp, real).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return m.withColumn("f1", safe(2 * p * r, p + r))


def overall_accuracy(df: DataFrame) -> DataFrame:
    """One row over mentions: size and correct shares.

    df: gold, should_be_nil, is_nil (boolean), top_id (best candidate), top_added (it comes from the
    read-write index), top_modes (gold values tied as modes of its cluster). Right are linked
    mentions whose top candidate is the gold, or comes from an added cluster whose one mode is the
    gold or that has exactly two modes with the gold among them, and NIL mentions predicted NIL.
    """
    modes = F.coalesce("top_modes", F.array().cast(dict(df.dtypes)["top_modes"]))
    linked = ~F.col("is_nil") & ~F.col("top_added") & (F.col("top_id") == F.col("gold"))
    added = ~F.col("is_nil") & F.col("top_added") & (F.size(modes) <= 2) & F.array_contains(modes, F.col("gold"))
    nil = F.col("is_nil") & F.col("should_be_nil")
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    out = df.agg(F.count("*").alias("size"), count(linked).alias("linked_correct"), count(added).alias("added_correct"), count(nil).alias("nil_correct"))
    total = F.col("linked_correct") + F.col("added_correct") + F.col("nil_correct")
    return out.withColumn("overall_correct", total).withColumn("overall_accuracy", F.when(F.col("size") > 0, total / F.col("size")).otherwise(0.0))


def mean_report(reports: DataFrame) -> DataFrame:
    """One row over batch reports: means of numbers, sums of size and overall_correct, accuracy from the sums."""
    numbers = [c for c, t in reports.dtypes if t in ("double", "float", "int", "bigint") and c not in ("size", "overall_correct", "overall_accuracy", "batch")]
    out = reports.agg(*[F.avg(c).alias(c) for c in numbers], F.sum("size").alias("size"), F.sum("overall_correct").alias("overall_correct"))
    return out.withColumn("overall_accuracy", F.when(F.col("size") > 0, F.col("overall_correct") / F.col("size")).otherwise(0.0))


def upsert_report(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """Rows of old whose name is not in new, followed by new."""
    return old.join(new.select(name).distinct(), name, "left_anti").unionByName(new)
