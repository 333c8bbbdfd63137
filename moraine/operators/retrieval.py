"""Candidate retrieval: entity lookup with dummies, merging of index lists, approximate search."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.text import page_url
from moraine.functions.vectors import augment, dot, norm_score

DUMMY_SCORE = -1000.0


def join_entities(candidates: DataFrame, entities: DataFrame, language: str = "en") -> DataFrame:
    """Candidates with what the entity table holds of them; columns query, id, indexer, raw_score [, norms].

    A candidate whose (id, indexer) the table does not hold stays as a dummy: score -1000,
    wikipedia_id 0, empty title and url. Repeated entity rows count once. Output: query, id, indexer,
    raw_score, score, norm_score (null without norms or for a dummy), wikipedia_id, title, type_, url,
    dummy (1 or null).
    """
    held = entities.groupBy("id", "indexer").agg(F.min(F.struct("wikipedia_id", "title", "type_")).alias("e"))
    both = candidates.join(held, ["id", "indexer"], "left")
    gone = F.col("e").isNull()
    scaled = norm_score(F.col("raw_score"), F.col("query_norm"), F.col("entry_norm")) if "query_norm" in candidates.columns else F.lit(None).cast("double")
    return both.select(
        "query", "id", "indexer", "raw_score",
        F.when(gone, F.lit(DUMMY_SCORE)).otherwise(F.col("raw_score")).alias("score"),
        F.when(~gone, scaled).alias("norm_score"),
        F.when(gone, F.lit(0)).otherwise(F.col("e.wikipedia_id")).cast("int").alias("wikipedia_id"),
        F.when(gone, F.lit("")).otherwise(F.col("e.title")).alias("title"),
        F.col("e.type_").alias("type_"),
        F.when(gone, F.lit("")).otherwise(page_url(F.col("e.wikipedia_id"), language)).alias("url"),
        F.when(gone, F.lit(1)).alias("dummy"),
    )


def merge_lists(candidates: DataFrame, score: str = "score") -> DataFrame:
    """Rank over all index lists of a query, by score descending: up to k per index stay, not k in all.

    Ties: smaller indexer, then smaller id. A null score ranks last. A list holds at most top_k entries
    of each index, so the window over a query is small and shares the shuffle of its aggregates.
    """
    order = Window.partitionBy("query").orderBy(F.col(score).desc_nulls_last(), "indexer", "id")
    return candidates.withColumn("rank", F.row_number().over(order))


def candidate_arrays(ranked: DataFrame) -> DataFrame:
    """One row per query: candidates, an array of structs in rank order."""
    fields = [c for c in ranked.columns if c not in ("query", "rank")]
    item = F.struct("rank", F.struct(*fields).alias("c"))
    return ranked.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["c"]).alias("candidates"))


def rank_of_gold(ranked: DataFrame, gold: DataFrame, gold_id: str = "wikipedia_id") -> DataFrame:
    """1-based rank of the gold entity among the candidates of each query of `gold` (query, gold); -1 if absent or null."""
    hits = ranked.join(gold.select("query", F.col("gold").alias("_gold")), "query").filter(F.col(gold_id) == F.col("_gold"))
    best = hits.groupBy("query").agg(F.min("rank").alias("_rank"))
    return gold.join(best, "query", "left").select("query", "gold", F.coalesce("_rank", F.lit(-1)).cast("int").alias("gold_rank"))


def approximate_top_k(queries: DataFrame, collection: DataFrame, k: int, tables: int = 12, bucket: float | None = None, seed: int = 7) -> DataFrame:
    """Approximate inner-product top-k by distance LSH on augmented vectors, rescored exactly.

    queries: query, vector (array). collection: space, id, vector (array). Vectors of the collection
    get sqrt(phi - |x|^2) appended, queries 0, which turns the product into a distance. Output as of
    exact_top_k without norms. Candidates are the pairs that share a bucket in any table; the recall
    against exact_top_k is measured in the tests.
    """
    phi = collection.agg(F.max(dot("vector", "vector"))).first()[0] or 0.0
    c = collection.select("space", "id", F.col("vector").alias("_v"), array_to_vector(augment("vector", float(phi))).alias("features"))
    q = queries.select("query", F.col("vector").alias("_q"), array_to_vector(F.concat(F.col("vector").cast("array<double>"), F.array(F.lit(0.0)))).alias("features"))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket or max(1e-6, float(phi) ** 0.5), numHashTables=tables, seed=seed)
    model = lsh.fit(c)
    hashed = lambda d, *keep: model.transform(d).select(*keep, F.posexplode(F.transform("hashes", lambda h: F.hash(h)))).withColumnRenamed("pos", "t")
    pairs = hashed(q, "query", "_q").join(hashed(c, "space", "id", "_v"), ["t", "col"]).dropDuplicates(["query", "space", "id"])
    scored = pairs.withColumn("score", dot("_q", "_v"))
    order = Window.partitionBy("query", "space").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "space", "id", "rank", "score")


