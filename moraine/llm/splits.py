"""Splits that keep related records together."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from moraine.operators.graph import flatten
from moraine.operators.ranking import hash_uniform, running_weight
from moraine.session import cut

MAX_LARGE_GROUPS = 2000
MAX_CLASSES = 2000
PAIR_BLOCK = 1024


def normal_word(text: str | None) -> str | None:
    """Equal for texts that agree after ignoring case, composition and white space; None if blank."""
    if text is None:
        return None
    plain = " ".join(unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).casefold()).split())
    return plain or None


@F.pandas_udf(StringType())
def normal_words(texts: pd.Series) -> pd.Series:
    seen: dict[str | None, str | None] = {}
    for t in texts.unique():
        seen[t] = normal_word(t)
    return texts.map(seen)


def linked_keys(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Least key linked to each key (key, label) over a bipartite graph of (key, word) rows.

    Minimum-label propagation: a word takes the least label of its keys, a label the least of its
    words, followed to the end of its chain; edges are rewritten to labels, and words left with one label drop
    out, so a round touches open links only. Rows with a null side link nothing. Keys that share no
    word with another are not returned: their label is the key itself.
    """
    live = pairs.filter("key is not null and word is not null").select(F.col("key").alias("label"), "word").distinct()
    labels = None
    for _ in range(max_rounds):
        bridge = live.groupBy("word").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("word", "least")
        open_ = cut(live.join(bridge, "word"))
        if labels is None:
            labels = cut(open_.select(F.col("label").alias("key")).distinct().withColumn("label", F.col("key")))
        if open_.isEmpty():
            return labels
        hook = open_.groupBy(F.col("label").alias("x")).agg(F.min("least").alias("to")).filter("to < x")
        hook = flatten(hook).withColumnRenamed("x", "label")
        live = open_.join(hook, "label", "left").select(F.coalesce("to", "label").alias("label"), "word").distinct()
        labels = cut(labels.join(hook, "label", "left").select("key", F.coalesce("to", "label").alias("label")))
    raise RuntimeError(f"labels not stable after {max_rounds} rounds")


def _place_large(groups: list[tuple[str, np.ndarray]], want: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Largest first, each to the split where the squared deviation from the wanted counts grows least."""
    have = np.zeros_like(want)
    scale = np.maximum(want.sum(0), 1.0)
    chosen = {}
    for name, counts in sorted(groups, key=lambda g: (-g[1].sum(), g[0])):
        cost = [(((have[s] + counts - want[s]) ** 2 - (have[s] - want[s]) ** 2) / scale).sum() / max(want[s].sum(), 1.0) for s in range(len(want))]
        best = int(np.argmin(cost))
        have[best] += counts
        chosen[name] = best
    return chosen, have


def assign_splits(groups: DataFrame, classes: list[str], shares: list[tuple[str, float]], seed: int = 1234) -> DataFrame:
    """A split for each row of groups (grp string, one count column per class): grp, split.

    Groups of at least total / MAX_LARGE_GROUPS records (so at most MAX_LARGE_GROUPS of them) are
    placed by the driver, largest first, where the label distribution deviates least. The others are
    stratified by their most frequent class and cut by running size, in hashed order, at the shares
    each split still lacks of that class; an error is then below one small group per stratum.
    """
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes]).first()
    sums = np.array([total[c] for c in classes], float)
    names, want_share = [s for s, _ in shares], np.array([w for _, w in shares], float)
    want_share = want_share / want_share.sum()
    want = want_share[:, None] * sums[None, :]
    size = sum((F.col(c) for c in classes), F.lit(0))
    groups = groups.withColumn("_size", size.cast("long"))
    bound = max(2.0, sums.sum() / MAX_LARGE_GROUPS)
    large = groups.filter(F.col("_size") >= bound).collect()
    chosen, have = _place_large([(r["grp"], np.array([r[c] for c in classes], float)) for r in large], want)

    lack = np.maximum(want - have, 0.0)
    lack_share = np.where(lack.sum(0) > 0, lack / np.maximum(lack.sum(0), 1e-12), want_share[:, None])
    edges = np.cumsum(lack_share, axis=0)
    top = F.greatest(*[F.col(c) for c in classes]) if len(classes) > 1 else F.col(classes[0])
    stratum = F.lit(len(classes) - 1)
    for i in range(len(classes) - 2, -1, -1):
        stratum = F.when(F.col(classes[i]) == top, i).otherwise(stratum)
    small = groups.filter(F.col("_size") < bound).withColumn("_stratum", stratum)
    small = running_weight(small, ["_stratum"], [hash_uniform(seed, F.col("grp")), F.col("grp")], "_size", "_before")
    per = small.groupBy("_stratum").agg(F.sum("_size").alias("_all"))
    small = small.join(F.broadcast(per), "_stratum").withColumn("_at", (F.col("_before") + F.col("_size") / 2) / F.greatest("_all", F.lit(1)))
    split = F.lit(names[-1])
    for i in range(len(classes)):
        inner = F.lit(names[-1])
        for s in range(len(names) - 2, -1, -1):
            inner = F.when(F.col("_at") < float(edges[s, i]), names[s]).otherwise(inner)
        split = F.when(F.col("_stratum") == i, inner).otherwise(split)
    placed = small.select("grp", split.alias("split"))
    if chosen:
        spark = groups.sparkSession
        placed = placed.unionByName(spark.createDataFrame([(g, names[s]) for g, s in chosen.items()], "grp string, split string"))
    return placed


def leakage_free_splits(
    df: DataFrame, item: str, key: str, word: str, label: str, shares: list[tuple[str, float]], seed: int = 1234
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignment, links, report).

    assignment: item, grp, split, one row for each distinct non-null item. links: (key, label) of the
    keys that share words with others. report: split, class, records, share of the class, target, deviation.
    Items with equal key or equal normal word, directly or through others, share a group. A null key
    or a null or blank word links nothing; a record with neither is a group of its own. Repeated rows
    of an item count once. More than MAX_CLASSES labels are an error. Empty input: empty outputs.
    """
    one = df.filter(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(
        F.min(F.struct(F.col(key).alias("k"), F.col(word).alias("w"), F.col(label).alias("l"))).alias("r")
    )
    one = one.select("item", F.col("r.k").alias("key"), F.col("r.w").alias("raw"), F.col("r.l").alias("label"))
    pairs = one.groupBy("key", "raw").agg(F.count("*").alias("n"))
    cells = cut(pairs.withColumn("word", normal_words("raw")))
    labels = linked_keys(cells.select("key", "word"))

    # the group of each (key, raw word) cell
    named = cells.join(labels.withColumnRenamed("label", "_least"), "key", "left").withColumn("_least", F.coalesce("_least", "key"))
    by_word = named.filter("word is not null").groupBy("word").agg(F.min("_least").alias("_of_word"))
    with_word = named.filter("word is not null and key is null").join(by_word, "word", "left")
    group = lambda least: F.when(least.isNotNull(), F.concat(F.lit("k"), least.cast("string")))
    cell_group = (
        named.filter("key is not null").select("key", "raw", group(F.col("_least")).alias("grp"))
        .unionByName(with_word.select("key", "raw", F.coalesce(group(F.col("_of_word")), F.concat(F.lit("w"), "word")).alias("grp")))
        .select(F.col("key").alias("_k"), F.col("raw").alias("_r"), "grp")
    )
    same = F.col("key").eqNullSafe(F.col("_k")) & F.col("raw").eqNullSafe(F.col("_r"))
    records = cut(
        one.join(cell_group, same, "left").select(
            "item", F.coalesce("grp", F.concat(F.lit("r"), F.col("item").cast("string"))).alias("grp"),
            F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("class"),
        )
    )
    classes = sorted(r["class"] for r in records.select("class").distinct().limit(MAX_CLASSES + 1).collect())
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not classes:
        classes = ["none"]
    weights = records.groupBy("grp").agg(*[F.sum((F.col("class") == c).cast("long")).alias(f"n{i}") for i, c in enumerate(classes)])
    split = cut(assign_splits(weights, [f"n{i}" for i in range(len(classes))], shares, seed))
    assignment = cut(records.join(split, "grp").select(F.col("item").alias(item), "grp", "split", "class"))
    report = assignment.groupBy("class").agg(
        F.count("*").alias("_all"), *[F.sum((F.col("split") == s).cast("long")).alias(f"s{i}") for i, (s, _) in enumerate(shares)]
    ).select("_all", "class", F.explode(F.array(*[
        F.struct(F.lit(s).alias("split"), F.col(f"s{i}").alias("records"), F.lit(float(w)).alias("target_share")) for i, (s, w) in enumerate(shares)
    ])).alias("x")).select("x.split", "class", "x.records", (F.col("x.records") / F.col("_all")).alias("share"), "x.target_share", (F.col("x.records") / F.col("_all") - F.col("x.target_share")).alias("deviation"))
    return assignment.drop("class"), labels, report


def linked_pairs(labels: DataFrame) -> DataFrame:
    """Each two different keys of one group, the smaller first; the size of the result is that of its request.

    A group is dealt into blocks of about PAIR_BLOCK keys and each two blocks meet in one join key, so
    that a giant group is spread over tasks.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("_n"))
    dealt = labels.join(sizes, "label").withColumn("_k", F.ceil(F.col("_n") / PAIR_BLOCK).cast("int")).withColumn("_mine", F.pmod(F.xxhash64("key"), F.col("_k")).cast("int"))
    left = dealt.select(F.col("key").alias("key_a"), "label", F.col("_mine").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_j"))
    right = dealt.select(F.col("key").alias("key_b"), "label", F.col("_mine").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i"))
    return left.join(right, ["label", "_i", "_j"]).filter("key_a < key_b").select("key_a", "key_b")
