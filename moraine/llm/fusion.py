"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.ranking import rank_of_values, running_weight


def fuse(df: DataFrame, group: str, item: str, scores: Sequence[str], constant: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion inside each group: group, item, rank_<score>..., fused.

    fused is the sum over the scores of 1 / (constant + rank), rank 1 being the highest value of the
    score in the group. Equal values share the better rank. A null or NaN score adds nothing. Repeated
    rows of an item count once (the highest value of each score is kept). A null group is a group;
    rows without an item take no part. An empty input gives an empty output; other columns are ignored.

    Ranks come from counted distinct values, summed over range partitions, so neither a hot group nor
    a value shared by a third of all rows meets in one task.
    """
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(s) for s in scores]
    items = (
        df.filter(F.col(item).isNotNull())
        .select(group, item, *clean)
        .groupBy(group, item)
        .agg(*[F.max(s).alias(s) for s in scores])
    )
    long = items.select(
        group, item, F.explode(F.array(*[F.struct(F.lit(i).alias("score"), F.col(s).alias("value")) for i, s in enumerate(scores)])).alias("s")
    ).select(group, item, "s.score", "s.value").filter("value is not null")
    ranks = rank_of_values(long, [group, "score"], "value").select(
        F.col(group).alias("_g"), F.col("score").alias("_s"), F.col("value").alias("_v"), "rank"
    )
    on = F.col(group).eqNullSafe(F.col("_g")) & (F.col("score") == F.col("_s")) & (F.col("value") == F.col("_v"))
    placed = long.join(ranks, on).select(group, item, "score", "rank")
    # records without any score come in with rank null
    every = placed.unionByName(items.select(group, item, F.lit(None).cast("int").alias("score"), F.lit(None).cast("long").alias("rank")))
    wide = every.groupBy(group, item).agg(*[F.max(F.when(F.col("score") == i, F.col("rank"))).alias(f"rank_{s}") for i, s in enumerate(scores)])
    # added in a fixed order, so equal rank sets give equal sums only if permutation-free: round the noise away
    total = sum((F.coalesce(1 / (F.lit(constant) + F.col(f"rank_{s}")), F.lit(0.0)) for s in scores), F.lit(0.0))
    return wide.withColumn("fused", F.round(total, 12))


def fused_ranking(fused: DataFrame, group: str, item: str) -> DataFrame:
    """Add `place`: 1 for the highest fused value of the group; ties: the smaller item first."""
    placed = running_weight(fused.withColumn("_one", F.lit(1)), [group], [F.col("fused").desc(), F.col(item)], "_one", "_before")
    return placed.withColumn("place", (F.col("_before") + 1).cast("long")).drop("_one", "_before")


def fused_first(fused: DataFrame, group: str, item: str) -> DataFrame:
    """The first item of each group in that ranking: an aggregate, so no group is sorted for it."""
    best = F.min(F.struct((-F.col("fused")).alias("f"), F.col(item).alias("i"))).alias("_best")
    return fused.groupBy(group).agg(best).select(group, F.col("_best.i").alias(item))
