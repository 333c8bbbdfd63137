"""Clusterings of unlinked mentions, and the packaging of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.arrow import run_bounds, whole_groups
from moraine.functions.text import mention_key, words
from moraine.functions.vectors import clean_vectors, matrix, to_base64
from moraine.operators.blocks import group_pairs
from moraine.operators.graph import climb, connected_components
from moraine.operators.ranking import grouped_median, hash_uniform, running_max, running_weight
from moraine.session import cut, shuffle_width

MAX_MENTIONS = 25


def string_clusters(mentions: DataFrame, item: str, mention: str) -> DataFrame:
    """Single linkage at string distance below 0.2, in closed form: all items of one mention key.

    Output: item, cluster (the key). Only distance 0 lies below the threshold, so no pair is compared.
    A null mention is a cluster of its own key null.
    """
    return mentions.select(item, mention_key(mention).alias("cluster"))


def component_labels(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """item, comp: the smallest linked item of each item; items without a pair are their own component."""
    comps = connected_components(pairs.select("a", "b"))
    return items.select("item").distinct().join(comps.withColumnRenamed("node", "item"), "item", "left").select("item", F.coalesce("comp", "item").alias("comp"))


def semantic_subclusters(items: DataFrame, dim: int, max_distance: float = 0.036) -> DataFrame:
    """Inside each group (grp, item, vector): single linkage on cosine distance below max_distance.

    Output: item, comp. Items without a usable vector stay alone.
    """
    return component_labels(items, group_pairs(items, dim, 1 - max_distance, cosine=True))


def mean_vectors(items: DataFrame, dim: int, key: str = "comp") -> DataFrame:
    """key, vector (mean, binary), n, max_square (largest squared norm): summed on the map side per batch."""
    kind = dict(items.dtypes)[key]
    clean = clean_vectors(items.filter(F.col(key).isNotNull()).select(key, "vector"), "vector", dim)
    schema = f"{key} {kind}, total binary, n long, max_square double"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_pandas()
            codes, names = pd.factorize(keys)
            rows = matrix(batch.column(1), dim).astype(np.float64)
            total = np.zeros((len(names), dim))
            np.add.at(total, codes, rows)
            top = np.zeros(len(names))
            np.maximum.at(top, codes, (rows**2).sum(1))
            wide = [r.tobytes() for r in total]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(wide, pa.binary()), pa.array(np.bincount(codes, minlength=len(names))), pa.array(top)], [key, "total", "n", "max_square"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, n, top = None, None, 0, 0.0
        done: list[tuple] = []

        def close() -> None:
            if current is not None:
                done.append((current, (total / n).astype("<f4").tobytes(), n, top))

        for batch in batches:
            for k, t, m, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != current:
                    close()
                    current, total, n, top = k, np.zeros(dim), 0, 0.0
                total = total + np.frombuffer(t, np.float64)
                n, top = n + m, max(top, s)
            yield from _rows(done)
            done.clear()
        close()
        yield from _rows(done)

    def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.binary()), pa.array(c), pa.array(d)], [key, "vector", "n", "max_square"])

    parts = clean.mapInArrow(fold, schema)
    return parts.repartition(shuffle_width(items.sparkSession), key).sortWithinPartitions(key).mapInArrow(finish, f"{key} {kind}, vector binary, n long, max_square double")


def centroid_merge(items: DataFrame, dim: int, max_distance: float = 0.05, gate: float = 80.0) -> DataFrame:
    """Merge sub-clusters (grp, comp, item, vector) of a request grp whose mean vectors are close.

    Components of sub-clusters with cosine distance of means below max_distance merge as a whole if
    the first sub-cluster (smallest comp) holds a vector of squared norm above `gate`, else they stay
    apart: the closed form of comparing a cluster with itself. Output: item, cluster.
    """
    means = cut(mean_vectors(items, dim))
    where = items.groupBy("comp").agg(F.min("grp").alias("grp"))
    pairs = group_pairs(means.join(where, "comp").select("grp", F.col("comp").alias("item"), "vector"), dim, 1 - max_distance, cosine=True)
    joined = component_labels(items.select(F.col("comp").alias("item")), pairs).select(F.col("item").alias("comp"), F.col("comp").alias("top"))
    open_ = means.select(F.col("comp").alias("top"), (F.col("max_square") > gate).alias("_open"))
    joined = joined.join(open_, "top", "left").select("comp", F.when(F.col("_open"), F.col("top")).otherwise(F.col("comp")).alias("cluster"))
    return items.select("item", "comp").join(joined, "comp").select("item", "cluster")


def break_oversized(clusters: DataFrame, cluster: str, item: str, mention: str, limit: int = MAX_MENTIONS) -> DataFrame:
    """Clusters with more than `limit` distinct lower-cased mentions are split again by mention key.

    Output: item, cluster, part (the key within a broken cluster, else null).
    """
    wide = clusters.groupBy(F.col(cluster).alias("_c")).agg(F.countDistinct(F.lower(mention)).alias("_n")).filter(F.col("_n") > limit)
    both = clusters.join(wide, F.col(cluster) == F.col("_c"), "left")
    return both.select(item, cluster, F.when(F.col("_n").isNotNull(), mention_key(mention)).alias("part"))


def greedy_clusters(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy nearest-neighbour clustering: item, cluster (an item whose label it is).

    items: item (its order is the input order). pairs: a, b with a score above the threshold. The rule
    is sequential: each item in order gives its label to all it is linked to. At its turn an item holds
    the label that its largest smaller neighbour had at its own turn, and in the end the label of its
    largest neighbour. So labels are the ends of pointer chains, found by doubling, and no task holds a
    component. Items without a link keep their label.
    """
    links = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    near = links.groupBy(F.col("e.a").alias("item")).agg(F.max(F.when(F.col("e.b") < F.col("e.a"), F.col("e.b"))).alias("ptr"), F.max("e.b").alias("top"))
    return follow_labels(items, near)


def follow_labels(items: DataFrame, near: DataFrame) -> DataFrame:
    """item, cluster from near (item, ptr: its largest smaller neighbour, top: its largest neighbour, itself aside)."""
    near = cut(near)
    turn, _ = climb(near.select(F.col("item").alias("node"), "ptr"))
    turn = turn.select("node", "far")
    last = near.select("item", F.greatest("top", "item").alias("node")).join(turn, "node").select("item", F.col("far").alias("cluster"))
    return items.select("item").distinct().join(last, "item", "left").select("item", F.coalesce("cluster", "item").alias("cluster"))


def three_step_clusters(items: DataFrame, dim: int, semantic: float = 0.036, merge: float = 0.05, gate: float = 80.0, limit: int = MAX_MENTIONS) -> DataFrame:
    """String, semantic and centroid clustering and the break of oversized clusters, in one: item, cluster.

    items: grp (request, long), item (long, unique), mention, vector. cluster is the smallest item of a
    cluster. Mentions of one key form a group, a group falls into components at cosine distance below
    `semantic`, components of a request whose means lie closer than `merge` join behind the gate, and a
    cluster of more than `limit` distinct lower-cased mentions is split by mention key. Items without a
    usable vector are alone in the second step; a null grp or item takes no part.
    """
    one = items.filter("grp is not null and item is not null").withColumn("key", mention_key("mention"))
    heads = one.groupBy(F.col("grp").alias("_g"), F.col("key").alias("_k")).agg(F.min("item").alias("string"))
    held = cut(one.join(heads, (F.col("grp") == F.col("_g")) & F.col("key").eqNullSafe(F.col("_k"))).select("grp", "item", "mention", "vector", "string"))
    comps = semantic_subclusters(held.select(F.col("string").alias("grp"), "item", "vector"), dim, semantic)
    merged = centroid_merge(held.select("grp", "item", "vector").join(comps, "item"), dim, merge, gate)
    parts = cut(break_oversized(merged.join(held.select("item", "mention"), "item"), "cluster", "item", "mention", limit))
    names = parts.groupBy(F.col("cluster").alias("_c"), F.col("part").alias("_p")).agg(F.min("item").alias("name"))
    return parts.join(names, (F.col("cluster") == F.col("_c")) & F.col("part").eqNullSafe(F.col("_p"))).select("item", F.col("name").alias("cluster"))


def _bigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= 2, F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _weights(texts: DataFrame, terms: Column, idf: bool) -> DataFrame:
    """text, term, w: term counts, times idf over the texts of a request if wanted, scaled to length 1."""
    tf = texts.select("grp", "text", F.explode(terms).alias("term")).groupBy("grp", "text", "term").agg(F.count("*").cast("double").alias("w"))
    if idf:
        n = texts.groupBy("grp").agg(F.sum("copies").alias("_n"))
        df = tf.join(texts, ["grp", "text"]).groupBy("grp", "term").agg(F.sum("copies").alias("_df"))
        tf = tf.join(df, ["grp", "term"]).join(n, "grp").withColumn("w", F.col("w") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1)).drop("_df", "_n")
    length = tf.groupBy("grp", "text").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    return tf.join(length, ["grp", "text"]).select("grp", "text", "term", (F.col("w") / F.col("_l")).alias("w"))


def feature_similarities(items: DataFrame, threshold: float = 0.984375, char_share: float = 0.8) -> DataFrame:
    """Pairs of different (text, context) of a request with mixed text similarity above the threshold.

    items: grp, text (mention) [, context; without it the mention is its own context]. score =
    char_share x cosine of character-bigram counts of the texts + the rest x cosine of word TF-IDF of
    the contexts, idf = ln((1 + n) / (1 + df)) + 1 over the records of the request. Output: grp,
    text_a, text_b, score, and context_a, context_b if given, the smaller (text, context) first. Equal
    ones have score 1 by definition and are one node; a null or empty text has no terms. The threshold
    must lie above 1 - char_share.

    A score above the threshold needs a bigram cosine above (threshold - 1 + char_share) / char_share.
    Two unit vectors can only reach that if they share a term outside the tail whose norm is below it,
    so only the rarest terms of a mention, up to that tail, are joined; with contexts and a threshold
    above char_share, pairs of such a term and one of the context, by the same rule. The score is then
    taken over the whole vectors. No pair is missed.
    """
    if threshold <= 1 - char_share:
        raise ValueError("the threshold must lie above 1 - char_share")
    context = "context" in items.columns
    held = items.filter("grp is not null and text is not null")
    held = held.select("grp", "text", F.coalesce("context", F.lit("")).alias("context") if context else F.lit("").alias("context"))
    nodes = cut(held.groupBy("grp", "text", "context").agg(F.count("*").alias("copies")))
    texts = nodes.groupBy("grp", "text").agg(F.sum("copies").alias("copies"))
    chars = cut(_weights(texts, _bigrams(F.col("text")), False))
    source = nodes.groupBy("grp", F.col("context").alias("text")).agg(F.sum("copies").alias("copies")) if context else texts
    word = cut(_weights(source, words("text"), True))
    by_context = context and threshold > char_share
    listed = _by_rarity(chars).withColumnRenamed("l", "c")
    spread = _by_rarity(word).select("grp", F.col("text").alias("_of"), F.col("l").alias("t"))
    vectors = nodes.join(listed, ["grp", "text"]).withColumn("_of", F.col("context") if context else F.col("text"))
    vectors = cut(vectors.join(spread, ["grp", "_of"], "inner" if by_context else "left").select("grp", "text", "context", "c", "t"))
    prefix = _prefix(vectors, "c", "cterm", (threshold - 1 + char_share) / char_share)
    if by_context:
        prefix = _prefix(prefix, "t", "tterm", (threshold - char_share) / (1 - char_share))
    prefix = prefix.select("grp", "text", "context", F.col("cterm").alias("term") if not by_context else F.struct("cterm", "tterm").alias("term"))
    other = prefix.select("grp", "term", F.col("text").alias("text_b"), F.col("context").alias("context_b"))
    before = (F.col("text") < F.col("text_b")) | ((F.col("text") == F.col("text_b")) & (F.col("context") < F.col("context_b")))
    pairs = prefix.join(other, ["grp", "term"]).filter(before).select("grp", F.col("text").alias("text_a"), F.col("context").alias("context_a"), "text_b", "context_b").distinct()
    side = lambda n: vectors.select("grp", *[F.col(c).alias(f"{c}_{n}") for c in ("text", "context", "c", "t")])
    both = pairs.join(side("a"), ["grp", "text_a", "context_a"]).join(side("b"), ["grp", "text_b", "context_b"])
    score = char_share * _sparse_dot("c_a", "c_b") + (1 - char_share) * _sparse_dot("t_a", "t_b")
    names = ("grp", "text_a", "context_a", "text_b", "context_b") if context else ("grp", "text_a", "text_b")
    return both.select(*names, score.alias("score")).filter(F.col("score") > threshold)


def _prefix(vectors: DataFrame, terms: str, name: str, least: float) -> DataFrame:
    """A row for each term, from the rarest on, until the squared norm of those before exceeds 1 - least^2."""
    seen = F.aggregate(F.slice(terms, F.lit(1), F.col("_pos")), F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    opened = vectors.select("*", F.posexplode(terms).alias("_pos", "_e")).filter(seen <= 1 - least * least + 1e-9)
    return opened.withColumn(name, F.col("_e.term")).drop("_pos", "_e")


def _by_rarity(weights: DataFrame) -> DataFrame:
    """grp, text, l: its terms as structs (_df, term, w), the rarest of the request first."""
    held = weights.groupBy("grp", "term").agg(F.count("*").alias("_df"))
    return weights.join(held, ["grp", "term"]).groupBy("grp", "text").agg(F.array_sort(F.collect_list(F.struct("_df", "term", "w"))).alias("l"))


def feature_clusters(items: DataFrame, threshold: float = 0.984375, char_share: float = 0.8) -> DataFrame:
    """Greedy clustering by mixed text similarity: item, cluster.

    items: grp, item (long, unique, in input order), mention, context. Items of equal mention and
    context are one node of the similarity graph; the greedy rule then needs, for each item, the
    largest smaller item among all items of its node and the nodes linked to it, which running maxima
    over range partitions give. A null mention, or one without terms, is linked to nothing.
    """
    held = items.filter("grp is not null and item is not null").select("grp", "item", F.col("mention").alias("text"), F.coalesce("context", F.lit("")).alias("context"))
    held = cut(held)
    links = feature_similarities(held, threshold, char_share)
    node = lambda n: F.struct(F.col("grp"), F.col(f"text_{n}").alias("text"), F.col(f"context_{n}").alias("context"))
    pairs = links.select(node("a").alias("a"), node("b").alias("b"))
    # a node meets itself with the full share of each of its vectors that holds terms
    full = F.when(F.length("text") >= 2, char_share).otherwise(0.0) + F.when(F.size(words("context")) > 0, 1 - char_share).otherwise(0.0)
    own = held.filter(full > threshold).select(F.struct("grp", "text", "context").alias("a")).distinct()
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own.select("a", F.col("a").alias("b"))))
    named = held.select("item", F.struct("grp", "text", "context").alias("b"))
    asks = named.select(F.col("b").alias("a"), "item", F.lit(0).alias("gives"))
    gives = both.join(named, "b").select("a", "item", F.lit(1).alias("gives"))
    events = asks.unionByName(gives).groupBy("a", "item").agg(F.max(1 - F.col("gives")).alias("asks"), F.max("gives").alias("gives"))
    events = events.select(F.xxhash64("a").alias("h"), "a", "item", "asks", F.when(F.col("gives") == 1, F.col("item")).alias("_given"))
    run = running_max(running_max(events, ["h", "a"], [F.col("item")], "_given", "ptr"), ["h", "a"], [F.col("item").desc()], "_given", "_above")
    near = run.filter("asks = 1 and (ptr is not null or _above is not null)").select("item", "ptr", F.coalesce("_above", "ptr").alias("top"))
    return follow_labels(held, near)


def cluster_mentions(items: DataFrame, dim: int, kind: str = "greedy", threshold: float | None = None) -> DataFrame:
    """One of the three clusterers under one interface: item, cluster.

    items: grp, item, mention, vector, context. kind: 'greedy' (product of vectors above the threshold,
    80.98388671875 unless given), 'three_step', or 'feature' (0.984375 unless given).
    """
    if kind == "greedy":
        pairs = group_pairs(items.select("grp", "item", "vector"), dim, 80.98388671875 if threshold is None else threshold)
        return greedy_clusters(items, pairs)
    if kind == "three_step":
        return three_step_clusters(items, dim)
    if kind == "feature":
        return feature_clusters(items, 0.984375 if threshold is None else threshold)
    raise ValueError(f"no clusterer {kind!r}")


def _sparse_dot(a: str, b: str) -> Column:
    """Product of two arrays of (term, w), each term once; 0 if either is null."""
    other = F.map_from_arrays(F.transform(b, lambda x: x["term"]), F.transform(b, lambda x: x["w"]))
    return F.coalesce(F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(other, x["term"]), F.lit(0.0))), F.lit(0.0))


def mode_titles(rows: DataFrame, cluster: str, mention: str) -> DataFrame:
    """cluster, title, n_elements: the most frequent mention, ties to the smaller; nulls count as elements only."""
    counts = rows.groupBy(cluster, mention).agg(F.count("*").alias("_n"))
    best = F.min(F.when(F.col(mention).isNotNull(), F.struct((-F.col("_n")).alias("m"), F.col(mention).alias("t"))))
    return counts.groupBy(cluster).agg(best.alias("_b"), F.sum("_n").alias("n_elements")).select(cluster, F.col("_b.t").alias("title"), "n_elements")


def gold_modes(rows: DataFrame, cluster: str, gold: str) -> DataFrame:
    """cluster, mode (the single most frequent gold value, null on a tie), modes (all of them, sorted)."""
    counts = rows.filter(F.col(gold).isNotNull()).groupBy(cluster, gold).agg(F.count("*").alias("_n"))
    top = counts.groupBy(F.col(cluster).alias("_c")).agg(F.max("_n").alias("_m"))
    tied = counts.join(top, (F.col(cluster) == F.col("_c")) & (F.col("_n") == F.col("_m")))
    modes = tied.groupBy(cluster).agg(F.array_sort(F.collect_list(gold)).alias("modes"))
    return modes.select(cluster, F.when(F.size("modes") == 1, F.col("modes")[0]).alias("mode"), "modes")


def median_vectors(items: DataFrame, key: str = "cluster") -> DataFrame:
    """Element-wise median of array vectors per key: key, median (array<double>)."""
    parts = grouped_median(items.select(key, F.posexplode("vector").alias("i", "x")), [key, "i"], "x", median="m")
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("median"))


def medoids(items: DataFrame, dim: int) -> DataFrame:
    """grp, medoid, distance_sum: the member with the least sum of Euclidean distances, ties to the smaller item.

    items: grp long, item long, vector. Distances are summed block against block of a group, so a hot
    group is spread over tasks.
    """
    block = 1024
    v = cut(clean_vectors(items.select("grp", "item", "vector"), "vector", dim).groupBy("grp", "item").agg(F.min("vector").alias("vector")))
    sizes = v.groupBy("grp").agg(F.count("*").alias("_n"))
    dealt = v.join(sizes, "grp").withColumn("_k", F.ceil(F.col("_n") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("item"), F.col("_k")).cast("int"))
    # as summand (tag 0) a row goes to its own block's cells, as candidate (tag 1) to all cells of its row
    asked = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    left = asked.select(F.xxhash64("grp", "mine", "other").alias("key"), F.lit(1).alias("tag"), "grp", "item", "vector")
    right = asked.select(F.xxhash64("grp", F.col("other"), F.col("mine")).alias("key"), F.lit(0).alias("tag"), "grp", "item", "vector")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 2 * block, 64 * block):
            keys, tags, ids, groups = table["key"].to_numpy(), table["tag"].to_numpy(), table["item"].to_numpy(), table["grp"].to_numpy()
            rows = matrix(table["vector"], dim).astype(np.float64)
            bounds = run_bounds(keys)
            for a, e in zip(bounds[:-1], bounds[1:], strict=True):
                s, c = np.flatnonzero(tags[a:e] == 0) + a, np.flatnonzero(tags[a:e] == 1) + a
                for at in range(0, len(c), 512):
                    p = c[at : at + 512]
                    square = (rows[p] ** 2).sum(1)[:, None] + (rows[s] ** 2).sum(1)[None, :] - 2 * rows[p] @ rows[s].T
                    square[ids[p][:, None] == ids[s][None, :]] = 0
                    yield pa.RecordBatch.from_arrays([pa.array(groups[p]), pa.array(ids[p]), pa.array(np.sqrt(np.maximum(square, 0)).sum(1))], ["grp", "item", "d"])

    parts = left.unionByName(right).repartition(shuffle_width(items.sparkSession), "key").sortWithinPartitions("key", "tag")
    total = parts.mapInArrow(sums, "grp long, item long, d double").groupBy("grp", "item").agg(F.round(F.sum("d"), 6).alias("d"))
    best = F.min(F.struct("d", "item")).alias("b")
    return total.groupBy("grp").agg(best).select("grp", F.col("b.item").alias("medoid"), F.col("b.d").alias("distance_sum"))


def medoid_vectors(rows: DataFrame, cluster: str, item: str, vectors: DataFrame, dim: int) -> DataFrame:
    """cluster, vector (binary): the vector of the medoid of each cluster; vectors: item, vector."""
    usable = cut(clean_vectors(vectors.select(F.col(item).alias("item"), "vector"), "vector", dim).groupBy("item").agg(F.min("vector").alias("vector")))
    placed = rows.select(F.col(cluster).alias("grp"), F.col(item).alias("item")).join(usable, "item")
    best = medoids(placed, dim).select(F.col("grp").alias(cluster), F.col("medoid").alias("item"))
    return best.join(usable, "item").select(cluster, "vector")


def package_clusters(rows: DataFrame, cluster: str, item: str, mention: str, vectors: DataFrame | None = None, dim: int = 0) -> DataFrame:
    """cluster, title, n_elements, mentions, mentions_id (both in item order) [, center: base64 of the medoid's vector].

    The response form of the clusterers: its arrays are the requested output, one per cluster. A
    cluster without a usable vector has a null center.
    """
    lists = rows.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct(item, mention))).alias("_l"))
    out = mode_titles(rows, cluster, mention).join(
        lists.select(cluster, F.transform("_l", lambda s: s[mention]).alias("mentions"), F.transform("_l", lambda s: s[item]).alias("mentions_id")), cluster
    )
    if vectors is not None:
        centres = medoid_vectors(rows, cluster, item, vectors, dim)
        out = out.join(centres.select(cluster, to_base64(F.col("vector")).alias("center")), cluster, "left")
    return out


def rare_filter(df: DataFrame, entity: str, least: int) -> DataFrame:
    """Rows whose non-empty entity occurs at least `least` times; counted by aggregate, joined back."""
    kept = df.filter(F.col(entity) != "").groupBy(entity).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(entity)
    return df.join(kept, entity, "left_semi")


def batches_of(df: DataFrame, order: str, step: int, seed: int | None = None) -> DataFrame:
    """Micro-batch number of each document: place div step, in order or, with a seed, in a shuffle that the seed fixes."""
    u = F.lit(0.0) if seed is None else hash_uniform(seed, F.col(order))
    one = df.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)).withColumn("_u", u)
    placed = running_weight(one, ["_all"], [F.col("_u"), F.col(order)], "_one", "_before")
    return placed.withColumn("batch", F.floor(F.col("_before") / step).cast("int")).drop("_one", "_all", "_before", "_u")


