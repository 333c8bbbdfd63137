"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.vectors import from_base64
from moraine.llm import clusters, fusion, mixing, quality, sampling, search, splits, tokens
from moraine.plans.sql import FLOATS, ITEMS
from moraine.session import table

SCORES = ("max_bi", "max_cross", "jaccard", "levenshtein")


DIM = 128
SAME = 0.8
NEAR = 0.7
MAX_SPLITS = 100


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "cluster_items", "item_id", "mentions", "embeddings", "encodings")
    text = F.when(F.length("embeddings") > 0, F.col("embeddings")).otherwise(F.col("encodings"))
    return t.select(F.col("item_id").alias("item"), F.col("mentions").alias("name"), from_base64(text).alias("vector"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical records, with their mentions, of every cluster."""
    items = _items(spark, sf_dir)
    members, vectors = clusters.average_linkage(items, DIM, SAME)
    return clusters.typical_members(members, vectors, items.select("item", "name"), DIM)


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every readable record."""
    members, _ = clusters.average_linkage(_items(spark, sf_dir), DIM, SAME)
    return members.select(F.col("item").alias("item_id"), "cluster")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records in one cluster whose own cosine reaches the threshold too, as the case is defined."""
    return clusters.cluster_pairs(*clusters.average_linkage(_items(spark, sf_dir), DIM, SAME), DIM, SAME)


def _neighbours(spark: SparkSession, sf_dir: str, **how: float) -> DataFrame:
    kb = table(spark, sf_dir, "kb_vectors", "id", "indexer", "encoding")
    asked = table(spark, sf_dir, "search_requests", "query_id", "encodings", "top_k")
    return search.most_similar(
        kb.select(F.col("indexer").alias("space"), "id", F.col("encoding").alias("vector")),
        asked.select("query_id", "top_k", from_base64(F.col("encodings")).alias("vector")),
        DIM,
        **how,
    ).withColumnRenamed("space", "indexer")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top_k entries of kb_vectors for every readable query, with product and cosine."""
    return _neighbours(spark, sf_dir).select("query_id", "indexer", "id", F.round("score", 4).alias("score"), F.round("cosine", 6).alias("cosine"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours whose cosine is at least NEAR."""
    return _neighbours(spark, sf_dir, block=48, least_cosine=NEAR).select("query_id", "indexer", "id")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(table(spark, sf_dir, "nil_features", "query_id", "feature_id", *SCORES), "query_id", "feature_id", SCORES)


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused value and place of every record in its query."""
    r = fusion.fused_ranking(_fused(spark, sf_dir), "query_id", "feature_id")
    return r.select("query_id", "feature_id", "fused", "place")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused_first(_fused(spark, sf_dir), "query_id", "feature_id")


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "sample_targets").withColumnRenamed("nil", "value")
    return sampling.draw_sample(table(spark, sf_dir, "mentions", "ex_id", "batch", "nil"), "ex_id", "batch", "nil", targets)


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[0]


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[1]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and categories with fewer records than needed; what the draw itself holds is in p4_report."""
    return _sample(spark, sf_dir)[1].filter("not met").select("batch", "category")


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    shares = [(r["split_name"], r["target_share"]) for r in table(spark, sf_dir, "split_targets").orderBy("split_name").limit(MAX_SPLITS + 1).collect()]
    if len(shares) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    m = table(spark, sf_dir, "mentions", "ex_id", "wikiid", "word", "nil")
    m = m.withColumn("wikiid", F.when(F.col("wikiid") != -1, F.col("wikiid")))
    return splits.leakage_free_splits(m, "ex_id", "wikiid", "word", "nil", shares)


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir)[0]


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir)[2]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = splits.linked_pairs(_splits(spark, sf_dir)[1])
    return links.select(F.col("key_a").alias("wikiid_a"), F.col("key_b").alias("wikiid_b"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of every document by byte_bpe_50k."""
    return tokens.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = tokens.token_counts(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "text", ["doc_id", "source"])
    return mixing.mix_sources(docs, table(spark, sf_dir, "mix_weights"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose tokens cannot reach their weight at their most repeats; what the mix holds is in p9_report."""
    return _mix(spark, sf_dir)[1].filter("not reached").select("source")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_statistics(spark, sf_dir).filter("is_prose = false").select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_clusters, p1_members, p1_found, p2_neighbours, p2_found, p3_ranking, p3_found, p4_sample, p4_report, p4_found,
        p6_splits, p6_report, p6_found, p8_ids, p9_mix, p9_report, p9_found, p10_statistics, p10_found,
    )
}

_FUSED = """
i AS (SELECT query_id, feature_id, max(max_bi) AS a, max(max_cross) AS b, max(jaccard) AS c, max(levenshtein) AS d
      FROM nil_features WHERE feature_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT query_id, feature_id,
      CASE WHEN a IS NOT NULL THEN 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST)) ELSE 0 END AS ra,
      CASE WHEN b IS NOT NULL THEN 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST)) ELSE 0 END AS rb,
      CASE WHEN c IS NOT NULL THEN 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST)) ELSE 0 END AS rc,
      CASE WHEN d IS NOT NULL THEN 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY d DESC NULLS LAST)) ELSE 0 END AS rd FROM i),
f AS (SELECT query_id, feature_id, round(ra + rb + rc + rd, 12) AS fused FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, feature_id) AS place FROM f)
"""

_SAME = f"""WITH RECURSIVE {ITEMS}, l AS MATERIALIZED (SELECT a.item AS a, b.item AS b FROM ok a JOIN ok b ON a.item < b.item WHERE list_cosine_similarity(a.e, b.e) >= {SAME})"""
_TOP = f"""WITH v AS MATERIALIZED (SELECT indexer, id, any_value(encoding)::DOUBLE[] AS e FROM kb_vectors WHERE len(encoding) = 128
    AND len(list_filter(encoding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(encoding, lambda x: x <> 0)) > 0 GROUP BY 1, 2),
s AS (SELECT query_id, any_value(top_k) AS k, regexp_replace(any_value(encodings), '\\s+', '', 'g') AS x FROM search_requests WHERE query_id IS NOT NULL AND top_k > 0 GROUP BY 1),
d AS (SELECT query_id, k, {FLOATS.format('x')} AS e FROM s WHERE length(x) = 684),
q AS MATERIALIZED (SELECT * FROM d WHERE len(list_filter(e, lambda y: isnan(y) OR isinf(y) OR abs(y) > 3.5e38)) = 0 AND len(list_filter(e, lambda y: y <> 0)) > 0),
p AS (SELECT query_id, k, indexer, id, list_inner_product(q.e, v.e) AS score, list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)) AS cosine FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, indexer, id) AS place FROM p)"""

ORACLE = {
    # clusters of these tables are such that all their pairs reach the threshold and no pair across does
    "p1_members": f"""{_SAME}, e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reach AS (SELECT item AS a, item AS b FROM ok UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
        SELECT a AS item_id, min(b) AS cluster FROM reach GROUP BY 1""",
    "p1_found": f"{_SAME} SELECT a AS item_a, b AS item_b FROM l",
    "p2_neighbours": f"{_TOP} SELECT query_id, indexer, id, round(score, 4) AS score, round(cosine, 6) AS cosine FROM r WHERE place <= k",
    "p2_found": f"{_TOP} SELECT query_id, indexer, id FROM r WHERE place <= k AND cosine >= {NEAR}",
    "p3_ranking": f"WITH {_FUSED} SELECT query_id, feature_id, fused, place FROM p",
    "p3_found": f"WITH {_FUSED} SELECT query_id, feature_id FROM p WHERE place = 1",
    "p4_found": """WITH m AS (SELECT DISTINCT ex_id, batch, nil FROM mentions WHERE batch IS NOT NULL AND ex_id IS NOT NULL)
        SELECT b.batch, t.category FROM (SELECT DISTINCT batch FROM m) b, sample_targets t
        LEFT JOIN (SELECT batch, nil, count(*) AS n FROM m GROUP BY 1, 2) c ON c.batch = b.batch AND c.nil IS NOT DISTINCT FROM t.nil
        WHERE coalesce(c.n, 0) < greatest(t.target_share * t.sample_rows, t.min_rows)""",
    "p6_found": """WITH RECURSIVE m AS (SELECT DISTINCT wikiid AS k, trim(regexp_replace(nfc_normalize(lower(nfc_normalize(word))), '[\\s\\x{00a0}\\p{Z}]+', ' ', 'g')) AS w FROM mentions
        WHERE wikiid IS NOT NULL AND wikiid <> -1 AND word IS NOT NULL), e AS (SELECT k, w FROM m WHERE w <> ''),
        l AS (SELECT DISTINCT x.k AS a, y.k AS b FROM e x JOIN e y ON x.w = y.w WHERE x.k <> y.k),
        c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
        SELECT a AS wikiid_a, b AS wikiid_b FROM c WHERE a < b""",
}
