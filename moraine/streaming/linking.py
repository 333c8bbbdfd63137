"""Text to linked mentions in one plan: tagger, encoder, search, NIL rule, optional reranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.encoders import Encoder, annotate, capitalised_spans, encode_mentions, rerank
from moraine.operators import blocks, nil, retrieval


def link_text(
    texts: DataFrame,
    vectors: DataFrame,
    entities: DataFrame,
    make: Callable[[], Encoder],
    dim: int,
    top_k: int = 10,
    weights: tuple[tuple[str, float], ...] = (("best", 1.0),),
    intercept: float = 0.0,
    tagger: Callable[[str], list[tuple[int, int]]] = capitalised_spans,
    cross: Callable[[], Callable[[list[str], list[str]], np.ndarray]] | None = None,
) -> DataFrame:
    """Mentions of texts (key, text) with their candidates and NIL decision.

    Output: query, key, start_pos, end_pos, mention, candidates (best first, by cross score if a cross
    model is given), nil_score, is_nil. A mention without candidates is NIL. vectors: id, indexer,
    vector. The query number is a hash of key and span, so the plan needs no shuffle to number rows.
    """
    found = annotate(texts, "key", "text", tagger).withColumn("query", F.xxhash64("key", "start_pos", "end_pos"))
    # a mention text is encoded and searched once, however often it occurs
    coded = encode_mentions(found.select(F.col("mention").alias("query")).distinct(), make, "query")
    top = blocks.exact_top_k(coded.select("query", "vector"), vectors.select(F.col("indexer").alias("space"), "id", "vector"), dim, top_k)
    raw = top.select("query", "id", F.col("space").alias("indexer"), F.col("score").alias("raw_score"), "query_norm", "entry_norm")
    ranked = retrieval.merge_lists(retrieval.join_entities(raw, entities))
    name = "mention"
    if cross is not None:
        name = "query"
        ranked = found.select("query", "mention").join(ranked.withColumnRenamed("query", "mention"), "mention").drop("mention")
        pairs = ranked.join(found.select("query", F.concat_ws(" ", "context_left", "mention", "context_right").alias("_context")), "query")
        again = rerank(pairs, cross, "_context", "title").drop("_context", "rank")
        ranked = again.withColumnRenamed("cross_rank", "rank")
    best = ranked.groupBy(F.col("query").alias(name)).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    scored = found.select("query", "key", "start_pos", "end_pos", "mention").join(best, name, "left")
    scored = scored.withColumn("secondiff", F.col("best") - F.coalesce("second", F.lit(0.0))).withColumn("nil_score", nil.logistic(dict(weights), intercept))
    return nil.decide(scored).drop("best", "second", "secondiff").join(retrieval.candidate_arrays(ranked).withColumnRenamed("query", name), name, "left").select("query", "key", "start_pos", "end_pos", "mention", "nil_score", "is_nil", "candidates")
