"""Samples that meet target category shares: exponential tilting and the pivotal method."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.ranking import hash_uniform
from moraine.session import cut, shuffle_width

MAX_CATEGORIES = 1000
BLOCK_ROWS = 4096
EPS = 1e-9


def tilt(counts: np.ndarray, totals: np.ndarray, base: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Inclusion probabilities (strata x categories) with expected category totals `totals`.

    Newton iterations on the dual of minimal relative entropy to the base weights: with
    p = base * exp(l), the gradient is counts * p - totals and the Hessian diag(counts * p), as the
    categories are disjoint. Steps are clipped, which keeps far starts from overshooting.
    """
    feasible = (counts > 0) & (totals > 0)
    lam = np.zeros_like(totals)
    for _ in range(rounds):
        moment = counts * base * np.exp(lam)
        step = np.where(feasible, (moment - totals) / np.where(moment > 0, moment, 1.0), 0.0)
        lam -= np.clip(step, -2.0, 2.0)
        if np.abs(step).max(initial=0.0) < 1e-12:
            break
    return np.where(feasible, np.minimum(1.0, base * np.exp(lam)), 0.0)


def calibrate(counts: DataFrame, stratum: str, targets: list[tuple[str, float, int, int]]) -> DataFrame:
    """Per (stratum, category): available, needed, target, probability.

    counts: stratum, category, n. needed is the greater of share x sample size and the floor. target
    is what the sample aims at: a category whose floor exceeds its share is fixed at the floor, the
    others share the rest of the sample in proportion, and none aims at more than is available; a
    shortage is reported, not filled from other categories.
    """
    names = [t[0] for t in targets]
    share = np.array([t[1] for t in targets], float)
    floor = np.array([t[2] for t in targets], float)
    size = float(targets[0][3])
    needed = np.maximum(share * size, floor)
    fixed = share * size < floor
    rest = max(0.0, size - floor[fixed].sum())
    aim = np.where(fixed, floor, share / max(share[~fixed].sum(), EPS) * rest)

    wide = counts.groupBy(stratum).agg(*[F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i, c in enumerate(names)])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            have = frame[[f"c{i}" for i in range(len(names))]].to_numpy(float)
            if not len(have):
                continue
            totals = np.minimum(aim[None, :], have)
            held = np.maximum(have.sum(1, keepdims=True), 1.0)
            p = tilt(have, totals, np.minimum(1.0, size / held))
            yield pd.DataFrame(
                {
                    stratum: np.repeat(frame[stratum].to_numpy(), len(names)),
                    "category": names * len(frame),
                    "available": have.astype(np.int64).ravel(),
                    "needed": np.tile(needed, len(frame)),
                    "target": totals.ravel(),
                    "probability": p.ravel(),
                }
            )

    kind = dict(counts.dtypes)[stratum]
    return wide.mapInPandas(solve, f"{stratum} {kind}, category string, available long, needed double, target double, probability double")


def _duel(stratum: str, final: bool):
    """Sequential pivotal method over sorted rows: stratum, category, block, item, p (probability), u (uniform).

    One unit is undecided at a time; each arriving unit fights it and one of the two is settled. Only
    that unit is kept between batches. It changes with (stratum, category, block), and what is left is
    emitted undecided (p strictly between 0 and 1); with `final`, it changes with the stratum alone,
    and the last unit is drawn with its own probability.
    """
    width = 1 if final else 3
    names = [stratum, "category", "block", "item", "p", "u"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: tuple | None = None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                head, b, u = row[:4], row[4], row[5]
                if open_ is not None and open_[:width] != row[:width]:
                    out.append(_close(open_, final))
                    open_ = None
                if b <= EPS or b >= 1 - EPS:
                    out.append((*head, float(b >= 0.5), u))
                    continue
                if open_ is None:
                    open_ = row
                    continue
                both = open_[4] + b
                if both < 1 - EPS:  # one of the two takes both shares, the other leaves
                    stay, go = (row, open_) if u * both < b else (open_, row)
                    out.append((*go[:4], 0.0, go[5]))
                    open_ = (*stay[:4], both, stay[5])
                else:  # one of the two is drawn, the other keeps the rest
                    taken, stay = (open_, row) if u * (2 - both) < 1 - b else (row, open_)
                    out.append((*taken[:4], 1.0, taken[5]))
                    open_ = (*stay[:4], both - 1, stay[5])
                    if both - 1 <= EPS:
                        out.append((*stay[:4], 0.0, stay[5]))
                        open_ = None
            if out:
                yield pd.DataFrame(out, columns=names)
        if open_ is not None:
            yield pd.DataFrame([_close(open_, final)], columns=names)

    return run


def _close(row: tuple, final: bool) -> tuple:
    if not final:
        return row
    # the uniform of this unit has been used in its fights; a second one is folded out of it
    second = (row[5] * 65537.0) % 1.0
    return (*row[:4], float(second < row[4]), row[5])


def draw_sample(
    df: DataFrame, item: str, stratum: str, category: str, targets: DataFrame, seed: int = 1234
) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for strata of df.

    targets: category (name), value (of the category column; null stands for null), target_share,
    min_rows, sample_rows; at most MAX_CATEGORIES rows, read by the driver. sample: stratum, category,
    item, no repeats. report, a row for each stratum and category: available, needed, target, drawn,
    gap (needed less available, 0 if enough), met (enough available), short (needed less drawn, 0 if
    enough) and drawn_met: the draw holds the whole number of records below needed or more.

    Rows without stratum or item take no part; repeated rows of an item count once; values that are
    no category are not drawn. Empty input: both empty.

    The category counts of a stratum are the only moments the Newton iterations need. The draw runs
    over blocks of about BLOCK_ROWS hashed units of a category, so a hot stratum spreads over tasks;
    the units left undecided, at most one per block, meet again in blocks of blocks until a category has
    no more than BLOCK_ROWS of them, and these meet in a last pass per stratum. Each pass has its own
    random numbers. The same seed draws the same sample, whatever the partitions.
    """
    rows = targets.select("category", "value", "target_share", "min_rows", "sample_rows").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    rows = sorted(rows, key=lambda r: r["category"])
    kind = dict(df.dtypes)[stratum]
    item_kind = dict(df.dtypes)[item]
    one = (
        df.filter(F.col(item).isNotNull() & F.col(stratum).isNotNull())
        .groupBy(F.col(item).alias("item"))
        .agg(F.min(F.struct(F.col(stratum).alias("s"), F.col(category).alias("c"))).alias("r"))
        .select("item", F.col("r.s").alias(stratum), F.col("r.c").alias("_value"))
    )
    name = F.lit(None).cast("string")
    for r in rows:
        name = F.when(F.col("_value").eqNullSafe(F.lit(r["value"])), F.lit(r["category"])).otherwise(name)
    one = cut(one.select("item", stratum, name.alias("category")))
    # strata all of whose rows are no category still get their report
    counts = one.groupBy(stratum, "category").agg(F.count("*").alias("n"))
    plan = cut(calibrate(counts, stratum, [(r["category"], r["target_share"], r["min_rows"], r["sample_rows"]) for r in rows]))

    chance = plan.filter("probability > 0").select(stratum, "category", F.col("probability").alias("p"), "available")
    schema = f"{stratum} {kind}, category string, block long, item {item_kind}, p double, u double"
    spread = hash_uniform(seed + 1, F.col("item"))
    block = F.floor(spread * F.ceil(F.col("available") / BLOCK_ROWS))
    units = one.filter("category is not null").join(chance, [stratum, "category"]).select(
        stratum, "category", block.alias("block"), "item", "p", hash_uniform(seed, F.col("item")).alias("u")
    )
    undecided = f"p > {EPS} and p < {1 - EPS}"
    most = plan.agg(F.max("available")).first()[0] or 0
    settled, turn = [], 0
    while True:
        done = units.repartition(shuffle_width(df.sparkSession), stratum, "category", "block")
        done = cut(done.sortWithinPartitions(stratum, "category", "block", "item").mapInPandas(_duel(stratum, False), schema))
        settled.append(done.filter(f"not ({undecided})").filter("p > 0.5").select(stratum, "category", "item"))
        most, turn = -(-most // BLOCK_ROWS), turn + 1
        fresh = hash_uniform(seed + 1 + turn, F.col("item"))
        units = done.filter(undecided).select(stratum, "category", F.floor(F.col("block") / BLOCK_ROWS).alias("block"), "item", "p", fresh.alias("u"))
        if most <= BLOCK_ROWS:
            break
    last = units.repartition(stratum).sortWithinPartitions(stratum, "category", "item").mapInPandas(_duel(stratum, True), schema)
    sample = last.filter("p > 0.5").select(stratum, "category", "item")
    for part in settled:
        sample = sample.unionByName(part)
    sample = cut(sample.withColumnRenamed("item", item))

    drawn = sample.groupBy(stratum, "category").agg(F.count("*").alias("drawn"))
    report = plan.join(drawn, [stratum, "category"], "left").select(
        stratum, "category", "available", "needed", "target", F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"),
        F.greatest(F.lit(0.0), F.col("needed") - F.col("available")).alias("gap"),
        (F.col("available") >= F.col("needed")).alias("met"), F.greatest(F.lit(0.0), F.col("needed") - F.coalesce("drawn", F.lit(0))).alias("short"),
        (F.coalesce("drawn", F.lit(0)) >= F.floor(F.col("needed") + EPS)).alias("drawn_met"),
    )
    return sample, report
