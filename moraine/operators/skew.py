"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.ranking import grouped_median
from moraine.session import cut


def distinct_records(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per non-null key, with the least row of its columns: repeated deliveries count once.

    min over a struct aggregates on the map side, so a key repeated very often costs one row a task.
    """
    least = F.min(F.struct(*[F.col(c) for c in columns])).alias("_row")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(least).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def compress(df: DataFrame, key: str, values: Sequence[str], weight: str = "weight") -> DataFrame:
    """Value-frequency compression: one row per (key, values) with the number of rows it stands for."""
    return df.groupBy(key, *values).agg(F.count("*").alias(weight))


def keyed_summary(df: DataFrame, key: str, value: str, flag: str, number: str) -> DataFrame:
    """Exact statistics per key from compressed rows, without a task per hot key.

    Output: key, n_records, n_values (distinct non-null values), top_value (mode; ties: the smaller
    value), top_count, flag_share (share of true among non-null flags, null if none), number_median
    (exact, weighted). Rows with a null key form one group. No row: empty output.

    First (key, value, flag, number) is counted, which spreads a hot key over all tasks; then the
    counts meet per (key, value), and the last step per key only adds numbers. The median is located
    by running sums of the weighted values.
    """
    cells = cut(compress(df, key, [value, flag, number]))
    # salted by value: one row per (key, value) with partial sums; the weights of `number` are kept beside it
    per_value = (
        cells.groupBy(key, value)
        .agg(
            F.sum("weight").alias("w"),
            F.sum(F.when(F.col(flag), F.col("weight")).otherwise(0)).alias("yes"),
            F.sum(F.when(F.col(flag).isNotNull(), F.col("weight")).otherwise(0)).alias("said"),
        )
    )
    head = per_value.groupBy(key).agg(
        F.sum("w").alias("n_records"),
        F.count(value).alias("n_values"),
        F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("w")).alias("m"), F.col(value).alias("v")))).alias("_top"),
        F.sum("yes").alias("_yes"),
        F.sum("said").alias("_said"),
    )
    median = grouped_median(cells, [key], number, "weight", "number_median").withColumnRenamed(key, "_key")
    return head.join(median, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key,
        "n_records",
        "n_values",
        F.col("_top.v").alias("top_value"),
        (-F.col("_top.m")).alias("top_count"),
        F.when(F.col("_said") > 0, F.col("_yes") / F.col("_said")).alias("flag_share"),
        "number_median",
    )
