"""Running sums and ranks inside groups of any size.

A window over a hot group would put the group into one task. Here rows are range-partitioned by
(group, order), summed inside each partition, and only the groups that straddle partitions get an
offset; there are fewer than two such rows per partition, so the offset table may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.session import cut, shuffle_width


def running_weight(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], weight: str, before: str = "before"
) -> DataFrame:
    """Add column `before`: the sum of `weight` over the earlier rows of the same group.

    `order` must be total inside a group for a reproducible result; rows with equal order share no
    guarantee. Null group values form a group of their own. A null weight counts as 0. An empty
    input gives an empty output.
    """
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return _running(df, groups, order, F.coalesce(F.col(weight), F.lit(0)), before, F.sum, add)


def running_max(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, before: str = "before"
) -> DataFrame:
    """Add column `before`: the largest non-null `value` over the earlier rows of the same group, null if there is none."""
    both = lambda a, b: F.greatest(a, b)
    return _running(df, groups, order, F.col(value), before, F.max, both)


def _running(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: Column, before: str, fold, both) -> DataFrame:
    parts = shuffle_width(df.sparkSession)
    ranged = cut(
        df.repartitionByRange(parts, *[F.col(g) for g in groups], *order).withColumn("_pid", F.spark_partition_id())
    )
    sums = ranged.groupBy(*groups, "_pid").agg(fold(value).alias("_part"))
    spread = Window.partitionBy(*groups)
    offsets = (
        sums.withColumn("_n", F.count("*").over(spread))
        .filter("_n > 1")
        .withColumn("_offset", fold("_part").over(spread.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_pid").alias("_opid"), "_offset")
    )
    inside = Window.partitionBy("_pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("_pid") == F.col("_opid")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        ranged.withColumn("_local", fold(value).over(inside))
        .join(F.broadcast(offsets), match, "left")
        .withColumn(before, both(F.col("_local"), F.col("_offset")))
        .drop("_pid", "_local", "_offset", "_opid", *[f"_g{i}" for i in range(len(groups))])
    )


def rank_of_values(df: DataFrame, groups: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """Competition rank (1 = highest) of each distinct value inside its group: groups, value, rank.

    Equal values are counted together before ranking, so a value that fills a hot group is one row.
    """
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_w"))
    ranked = running_weight(counts, groups, [F.col(value).desc()], "_w", "_before")
    return ranked.select(*groups, value, (F.col("_before") + 1).cast("long").alias(rank))


def grouped_median(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None, median: str = "median") -> DataFrame:
    """Exact (weighted) median of the non-null values of each group: groups, median.

    Values are counted first, then located by running sums over range partitions, so no aggregate has
    to hold the distinct values of a hot group. Groups without a value have no row.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(n.cast("long").alias("_w"))
    placed = running_weight(counts, groups, [F.col(value)], "_w", "_before")
    totals = counts.groupBy(*[F.col(g).alias(f"_t{i}") for i, g in enumerate(groups)]).agg(F.sum("_w").alias("_n"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_t{i}"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda at: ((F.col("_before") <= at) & (at < F.col("_before") + F.col("_w"))).cast("int")
    part = (holds(low) + holds(high)) * F.col(value).cast("double") / 2
    return placed.join(totals, same).groupBy(*groups).agg(F.sum(part).alias(median))


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A reproducible uniform number in [0, 1) from the first eight hex digits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
