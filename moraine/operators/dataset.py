"""Dataset synthesis: NIL draw, transplanted samples, stratified batches, invariants, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.operators.ranking import hash_uniform, running_weight
from moraine.session import cut


def entity_frequency(mentions: DataFrame, entity: str = "wikiid") -> DataFrame:
    return mentions.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("freq"))


def nil_prior(frequencies: DataFrame, entity: str = "wikiid", share: float = 0.1, seed: int = 1234) -> DataFrame:
    """entity, freq, p_formula = share^(freq / median), p_uniform (hash of seed and entity), nil = uniform < formula."""
    median = frequencies.agg(F.median("freq").alias("_median"))
    return frequencies.crossJoin(F.broadcast(median)).select(  # one row
        entity, "freq", F.pow(F.lit(share), F.col("freq") / F.col("_median")).alias("p_formula"), hash_uniform(seed, F.col(entity)).alias("p_uniform")
    ).withColumn("nil", F.col("p_uniform") < F.col("p_formula"))


def propagate_prior(mentions: DataFrame, prior: DataFrame, entity: str = "wikiid") -> DataFrame:
    """Mentions with the draw of their entity; unseen entities get -1, -1 and false; freq is 0 where NIL."""
    p = prior.select(F.col(entity).alias("_e"), "freq", "p_formula", "p_uniform", "nil")
    both = mentions.drop("freq", "p_formula", "p_uniform", "nil").join(p, F.col(entity) == F.col("_e"), "left").drop("_e")
    both = both.fillna({"p_formula": -1.0, "p_uniform": -1.0}).withColumn("nil", F.coalesce("nil", F.lit(False)))
    return both.withColumn("freq", F.when(F.col("nil"), F.lit(0)).otherwise(F.coalesce("freq", F.lit(0))))


def transplant_sample(rows: DataFrame, keys: list[str], target: int, seed: int = 1234) -> DataFrame:
    """Whole groups of equal keys, in hashed order, until `target` rows are reached: keys, n, before.

    A group stays if the rows before it are fewer than the target, so the first group always does
    and the last may overshoot. A pool smaller than the target is taken whole.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    counts = counts.withColumn("_u", hash_uniform(seed, *[F.col(k) for k in keys])).withColumn("_all", F.lit(0))
    placed = running_weight(counts, ["_all"], [F.col("_u"), *[F.col(k) for k in keys]], "n", "before")
    return placed.filter((F.col("before") < target) | (F.col("before") == 0)).select(*keys, "n", "before")


def move_rows(source: DataFrame, target: DataFrame, chosen: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(source without the rows of the chosen keys, target with them)."""
    keys_of = chosen.select(*keys).distinct()
    return source.join(keys_of, keys, "left_anti"), target.unionByName(source.join(keys_of, keys, "left_semi"))


def distinct_mentions(mentions: DataFrame, keys: tuple[str, ...] = ("word", "wikiid"), order: str = "ex_id") -> DataFrame:
    """The first row, by `order`, of each combination of keys; null keys are equal to each other."""
    rest = [c for c in mentions.columns if c not in keys]
    first = F.min_by(F.struct(*rest), order).alias("_row")
    return mentions.groupBy(*keys).agg(first).select(*[k if k in keys else F.col(f"_row.{k}").alias(k) for k in mentions.columns])


def build_dataset(mentions: DataFrame, key: str, n_batches: int = 10, move: int = 500, seed: int = 1234) -> DataFrame:
    """The chain of dataset synthesis over mentions (key, word, wikiid): nil, freq and batch of each row kept.

    The prior makes entities NIL; whole (wikiid, word) groups of NIL mentions, in hashed order until
    `move` rows, leave the corpus as a pool for later transplants (batch -1); of what stays, the first
    row of each (word, wikiid) is kept and dealt into batches, stratified by NIL state and frequency
    (9 and more as one). Rows without a word or a wikiid take no part.
    """
    held = mentions.filter("word is not null and wikiid is not null").select(key, "word", "wikiid")
    held = held.select("*", F.lit(0).alias("freq"), F.lit(0.0).alias("p_formula"), F.lit(0.0).alias("p_uniform"), F.lit(False).alias("nil"))
    drawn = cut(propagate_prior(held, nil_prior(entity_frequency(held), seed=seed), "wikiid").select(key, "word", "wikiid", "nil", "freq"))
    chosen = transplant_sample(drawn.filter("nil"), ["wikiid", "word"], move, seed)
    stay, moved = move_rows(drawn, drawn.limit(0), cut(chosen), ["word", "wikiid"])
    kept = distinct_mentions(stay.select(key, "word", "wikiid", "nil", "freq"), ("word", "wikiid"), key)
    kept = kept.withColumn("stratum", F.concat_ws("-", F.col("nil").cast("int").cast("string"), F.least("freq", F.lit(9)).cast("string")))
    dealt = stratified_batches(kept, "stratum", key, n_batches, seed).drop("stratum")
    return dealt.unionByName(moved.select(*[c for c in dealt.columns if c != "batch"]).withColumn("batch", F.lit(-1)))


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by both splits: empty if the splits are disjoint."""
    return left.select(*keys).intersect(right.select(*keys))


def stratified_batches(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 1234) -> DataFrame:
    """Batch 0..n-1 such that the batches differ by at most one row in every stratum and in all.

    Rows are ordered by (stratum, hash); the batch is the global place modulo n, where the place is
    the stratum's offset plus the place inside, both from sums over range partitions.
    """
    one = rows.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)).withColumn("_u", hash_uniform(seed, F.col(key)))
    placed = running_weight(one, ["_all"], [F.col(stratum), F.col("_u"), F.col(key)], "_one", "_place")
    return placed.withColumn("batch", (F.col("_place") % n).cast("int")).drop("_one", "_all", "_u", "_place")


def batch_statistics(mentions: DataFrame, batch: str = "batch", entity: str = "wikiid", nil: str = "nil") -> DataFrame:
    """Per batch: mentions, NIL and known mentions, distinct entities in all, NIL and known."""
    n = F.col(nil)
    return mentions.groupBy(batch).agg(
        F.count("*").alias("n_mentions"), F.sum(F.coalesce(n, F.lit(False)).cast("long")).alias("n_nil"),
        F.sum(F.coalesce(~n, F.lit(False)).cast("long")).alias("n_known"), F.countDistinct(entity).alias("n_entities"),
        F.countDistinct(F.when(n, F.col(entity))).alias("n_nil_entities"), F.countDistinct(F.when(~n, F.col(entity))).alias("n_known_entities"),
    )


def nil_seen_before(mentions: DataFrame, batch: str = "batch", entity: str = "wikiid", nil: str = "nil") -> DataFrame:
    """Per batch: its NIL entities that are NIL in an earlier batch too, and their mentions in it."""
    cells = mentions.filter(F.col(nil) & F.col(entity).isNotNull() & F.col(batch).isNotNull()).groupBy(batch, entity).agg(F.count("*").alias("_n"))
    first = cells.groupBy(F.col(entity).alias("_e")).agg(F.min(batch).alias("_first"))
    seen = cells.join(first, F.col(entity) == F.col("_e")).filter(F.col("_first") < F.col(batch))
    counted = seen.groupBy(batch).agg(F.count("*").alias("n_seen"), F.sum("_n").alias("n_mentions"))
    return cells.select(batch).distinct().join(counted, batch, "left").fillna(0, ["n_seen", "n_mentions"])


def head_per_class(rows: DataFrame, label: str, n: int, order: str) -> DataFrame:
    """The first n rows of each class."""
    place = Window.partitionBy(label).orderBy(order)
    return rows.withColumn("_p", F.row_number().over(place)).filter(F.col("_p") <= n).drop("_p")
