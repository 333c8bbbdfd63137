"""Queries of retrieval, NIL prediction and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.text import multiset_jaccard, word_levenshtein
from moraine.functions.vectors import norm_score
from moraine.operators import blocks, legacy, metrics, nil, retrieval
from moraine.operators.kb import delete_entities
from moraine.operators.skew import distinct_records
from moraine.session import table

DIM, TOP = 128, 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kb_vectors", "indexer", "id", "encoding")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose id is divisible by 20 against all entries, per index."""
    kb = _vectors(spark, sf_dir)
    asked = kb.filter("id % 20 = 0").select((F.shiftleft(F.col("indexer").cast("long"), 40) + F.col("id")).alias("query"), F.col("encoding").alias("vector"))
    return blocks.exact_top_k(asked, kb.select(F.col("indexer").alias("space"), "id", F.col("encoding").alias("vector")), DIM, TOP)


def knn_topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).select("query", F.col("space").alias("indexer"), "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def knn_norm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = norm_score(F.col("score"), F.col("query_norm"), F.col("entry_norm"))
    return _search(spark, sf_dir).select("query", F.col("space").alias("indexer"), "id", F.round(s, 6).alias("norm_score"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nil_features", "feature_id", "query_id", "max_bi", "candidateid", "candidateindexer")
    one = distinct_records(n, "feature_id", "query_id", "max_bi", "candidateid", "candidateindexer")
    raw = one.select(F.col("query_id").alias("query"), F.col("candidateid").alias("id"), F.col("candidateindexer").alias("indexer"), F.col("max_bi").alias("raw_score"))
    entities = table(spark, sf_dir, "entities", "id", "indexer", "wikipedia_id", "title", "type_")
    return retrieval.join_entities(raw.filter("id is not null and indexer is not null"), entities)


def candidate_entity_join_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("query", "id", "indexer", "score", "wikipedia_id", "title", "url", "dummy")


def multi_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieval.merge_lists(_candidates(spark, sf_dir))
    return r.groupBy("query").agg(F.count("*").alias("n_candidates"), F.sum(F.when(F.col("rank") <= 3, F.col("id").cast("long"))).alias("top3_ids"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = distinct_records(table(spark, sf_dir, "mentions", "ex_id", "wikiid", "nil"), "ex_id", "wikiid", "nil")
    return m.select(F.col("ex_id").alias("query"), F.col("wikiid").alias("gold"), "nil")


def _ranked_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.merge_lists(_candidates(spark, sf_dir))
    asked = ranked.select("query").distinct().join(_gold(spark, sf_dir), "query").filter("nil = false").select("query", "gold")
    return retrieval.rank_of_gold(ranked, asked)


def linking_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_at(_ranked_gold(spark, sf_dir)).select(F.col("k").cast("long").alias("k"), F.round("recall", 9).alias("recall"))


def candidate_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = distinct_records(table(spark, sf_dir, "nil_features", "feature_id", "query_id", "max_bi"), "feature_id", "query_id", "max_bi")
    s = nil.score_statistics(n, "query_id", "max_bi")
    return s.select("query_id", "n", *[F.round(c, 6).alias(c) for c in ("max", "second", "secondiff", "min", "mean", "median", "stdev")])


def text_similarity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nil_features", "mention", "title").distinct()
    return n.select(
        "mention", "title", F.round(multiset_jaccard("mention", "title"), 6).alias("jaccard"), F.round(word_levenshtein("mention", "title"), 6).alias("levenshtein")
    )


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with candidates: should_be_nil, is_nil by a logistic rule on the best and second score, mitigated truth."""
    ranked = retrieval.merge_lists(_candidates(spark, sf_dir))
    per = ranked.groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("raw_score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("raw_score"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, F.col("wikipedia_id"))).alias("top_id"),
    )
    per = per.withColumn("secondiff", F.col("best") - F.col("second")).withColumn("nil_score", nil.logistic({"best": 0.01, "secondiff": 0.05}, -2.0))
    both = nil.decide(per).join(_gold(spark, sf_dir), "query").filter("nil is not null")
    wrong = F.coalesce(F.col("top_id") != F.col("gold"), F.lit(True))
    return both.withColumnRenamed("nil", "should_be_nil").withColumn("should_be_nil_mitigated", F.col("should_be_nil") | wrong)


def nil_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).groupBy("should_be_nil", "is_nil").agg(F.count("*").alias("n"))


_MEASURES = ("precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1", "accuracy", "macro_f1", "weighted_f1")


def nil_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nil.binary_measures(_decided(spark, sf_dir), "should_be_nil", "is_nil")
    return m.select("tn", "fp", "fn", "tp", *[F.round(c, 9).alias(c) for c in _MEASURES])


def nil_mitigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nil.binary_measures(_decided(spark, sf_dir), "should_be_nil_mitigated", "is_nil")
    return m.select("tn", "fp", "fn", "tp", *[F.round(c, 9).alias(c) for c in _MEASURES])


def nil_confusion_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nil.normalized_confusion(_decided(spark, sf_dir), "should_be_nil", "is_nil")
    return m.select(*[F.round(c, 9).alias(c) for c in ("tn", "fp", "fn", "tp")])


def delete_nil_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that stay when those of NIL mentions are deleted."""
    gone = table(spark, sf_dir, "mentions", "wikiid", "nil").filter("nil").select(F.col("wikiid").alias("wikipedia_id"))
    return delete_entities(table(spark, sf_dir, "entities", "id", "indexer", "wikipedia_id", "title"), gone).distinct()


def bm25_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions whose ex_id is divisible by 20 against all entities; links are the redirects to an entity."""
    e = table(spark, sf_dir, "entities", "id", "indexer", "redirects_to", "title", "descr").filter("indexer = 10")
    links = e.select("id", "redirects_to").distinct().groupBy(F.col("redirects_to").alias("id")).agg(F.count("*").alias("links"))
    docs = distinct_records(e, "id", "title", "descr").join(links, "id", "left")
    m = distinct_records(table(spark, sf_dir, "mentions", "ex_id", "word"), "ex_id", "word").filter("ex_id % 20 = 0")
    return legacy.lexical_candidates(m.select(F.col("ex_id").alias("query"), F.col("word").alias("text")), docs, k=5).select("query", "id", F.round("score", 4).alias("score"))


def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nil.undersample(_labelled(spark, sf_dir), "label", "query").select("query", "label")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decided(spark, sf_dir)
    right = F.coalesce(F.col("top_id") == F.col("gold"), F.lit(False))
    return d.withColumn("label", (~F.col("should_be_nil") & right).cast("int")).withColumn("baseline", right.cast("int"))


def ablation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir).filter("nil_score is not null")
    return nil.ablation_measures(d, "nil_score", "label", "baseline", "baseline", 10_000)


def overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, NIL and added-entity answers over mentions with candidates; the modes of an added entity are the golds of its title."""
    from moraine.operators.clustering import gold_modes

    ranked = retrieval.merge_lists(_candidates(spark, sf_dir)).filter("rank = 1")
    gold = _gold(spark, sf_dir)
    named = ranked.filter("indexer = 20").select("query", "id").join(gold.select("query", "gold"), "query")
    modes = gold_modes(named, "id", "gold").select(F.col("id").alias("_id"), "modes")
    top = ranked.select("query", F.col("id").alias("cand"), (F.col("indexer") == 20).alias("top_added")).join(modes, F.col("cand") == F.col("_id"), "left")
    d = _decided(spark, sf_dir).join(top.select("query", "top_added", F.when(F.col("top_added"), F.col("modes")).alias("top_modes")), "query")
    m = metrics.overall_accuracy(d)
    return m.withColumn("overall_accuracy", F.round("overall_accuracy", 9))


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk_inner_product, knn_norm_score, candidate_entity_join_dummy, multi_index_merge, linking_recall_at_k, candidate_score_stats,
        text_similarity_features, nil_decision, nil_classification_report, nil_confusion_normalized, nil_mitigated, delete_nil_entities,
        bm25_candidates, undersample, ablation_metrics, overall_accuracy,
    )
}

_KNN = """WITH v AS (SELECT indexer, id, any_value(encoding)::DOUBLE[] AS e FROM kb_vectors WHERE len(encoding) = 128
    AND len(list_filter(encoding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(encoding, lambda x: x <> 0)) > 0 GROUP BY 1, 2),
q AS (SELECT (indexer::BIGINT << 40) + id AS query, e FROM v WHERE id % 20 = 0),
s AS (SELECT query, indexer, id, round(list_inner_product(q.e, v.e), 9) AS s, list_inner_product(q.e, q.e) AS qq, list_inner_product(v.e, v.e) AS vv FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query, indexer ORDER BY s DESC, id) AS rank FROM s)
"""
_CAND = """n AS (SELECT feature_id, any_value(query_id) AS query, any_value(max_bi) AS raw_score, any_value(candidateid) AS id, any_value(candidateindexer) AS indexer
    FROM nil_features WHERE feature_id IS NOT NULL GROUP BY 1),
e AS (SELECT DISTINCT id, indexer, wikipedia_id, title FROM entities),
c AS (SELECT n.query, n.id, n.indexer, n.raw_score, CASE WHEN e.id IS NULL THEN -1000.0 ELSE n.raw_score END AS score, CASE WHEN e.id IS NULL THEN 0 ELSE e.wikipedia_id END AS wikipedia_id,
    CASE WHEN e.id IS NULL THEN '' ELSE e.title END AS title, CASE WHEN e.id IS NOT NULL AND e.wikipedia_id > 0 THEN 'https://en.wikipedia.org/wiki?curid=' || e.wikipedia_id ELSE '' END AS url,
    CASE WHEN e.id IS NULL THEN 1 END AS dummy FROM n LEFT JOIN e ON e.id = n.id AND e.indexer = n.indexer WHERE n.id IS NOT NULL AND n.indexer IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, indexer, id) AS rank FROM c),
g AS (SELECT ex_id AS query, any_value(wikiid) AS gold, any_value(nil) AS nil FROM mentions WHERE ex_id IS NOT NULL GROUP BY 1)
"""
_DECIDED = _CAND + """, p AS (SELECT query, max(raw_score) FILTER (rank = 1) AS best, max(raw_score) FILTER (rank = 2) AS second, max(wikipedia_id) FILTER (rank = 1) AS top_id FROM r GROUP BY 1),
d AS (SELECT p.query, top_id, gold, nil AS should_be_nil, 1 / (1 + exp(-(-2.0 + 0.01 * best + 0.05 * (best - second)))) AS nil_score FROM p JOIN g ON g.query = p.query WHERE nil IS NOT NULL),
x AS (SELECT *, coalesce(nil_score, 0) < 0.5 AS is_nil, should_be_nil OR coalesce(top_id <> gold, TRUE) AS mitigated, coalesce(top_id = gold, FALSE) AS good FROM d)
"""


def _report(truth: str) -> str:
    return f"""WITH {_DECIDED}, k AS (SELECT count(*) FILTER (NOT {truth} AND NOT is_nil) AS tn, count(*) FILTER (NOT {truth} AND is_nil) AS fp,
        count(*) FILTER ({truth} AND NOT is_nil) AS fn, count(*) FILTER ({truth} AND is_nil) AS tp FROM x),
    m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p1, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r1,
        coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) AS p0, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS r0 FROM k),
    f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0 FROM m)
    SELECT tn, fp, fn, tp, round(p0, 9) AS precision_0, round(r0, 9) AS recall_0, round(f0, 9) AS f1_0, round(p1, 9) AS precision_1, round(r1, 9) AS recall_1,
        round(f1, 9) AS f1_1, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 9) AS accuracy, round((f1 + f0) / 2, 9) AS macro_f1,
        round((f1 * (tp + fn) + f0 * (tn + fp)) / (tp + tn + fp + fn), 9) AS weighted_f1 FROM f"""


_WORDS = "list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"

ORACLE = {
    "knn_topk_inner_product": _KNN + "SELECT query, indexer, id, rank, round(s, 4) AS score FROM r WHERE rank <= 10",
    "knn_norm_score": _KNN + "SELECT query, indexer, id, round(s / greatest(qq, vv), 6) AS norm_score FROM r WHERE rank <= 10",
    "candidate_entity_join_dummy": f"WITH {_CAND} SELECT query, id, indexer, score, wikipedia_id, title, url, dummy FROM c",
    "multi_index_merge": f"WITH {_CAND} SELECT query, count(*) AS n_candidates, sum(id) FILTER (rank <= 3) AS top3_ids FROM r GROUP BY 1",
    "linking_recall_at_k": f"""WITH {_CAND}, a AS (SELECT DISTINCT r.query, g.gold FROM r JOIN g ON g.query = r.query WHERE g.nil = FALSE),
        h AS (SELECT a.query, min(r.rank) AS rank FROM a LEFT JOIN r ON r.query = a.query AND r.wikipedia_id = a.gold GROUP BY 1)
        SELECT k::BIGINT AS k, round(avg(CASE WHEN h.rank <= k THEN 1.0 ELSE 0.0 END), 9) AS recall FROM h, (SELECT unnest([1, 2, 3, 5, 10, 30, 100]) AS k) GROUP BY 1""",
    "candidate_score_stats": """WITH n AS (SELECT feature_id, any_value(query_id) AS query_id, any_value(max_bi) AS s FROM nil_features GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS k FROM n WHERE s IS NOT NULL)
        SELECT query_id, count(*) AS n, round(max(s), 6) AS max, round(max(s) FILTER (k = 2), 6) AS second, round(max(s) - max(s) FILTER (k = 2), 6) AS secondiff, round(min(s), 6) AS min,
        round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_samp(s), 6) AS stdev FROM r GROUP BY 1""",
    "text_similarity_features": f"""WITH n AS (SELECT DISTINCT mention, title, {_WORDS.format('mention')} AS a, {_WORDS.format('title')} AS b FROM nil_features),
        v AS (SELECT *, list_distinct(list_concat(a, b)) AS u FROM n),
        w AS (SELECT *, array_to_string(list_transform(a, lambda x: chr(list_position(u, x)::INT + 64)), '') AS ca, array_to_string(list_transform(b, lambda x: chr(list_position(u, x)::INT + 64)), '') AS cb,
            list_sum(list_transform(u, lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS lo,
            list_sum(list_transform(u, lambda x: greatest(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS hi FROM v)
        SELECT mention, title, CASE WHEN len(u) = 0 THEN 1.0 ELSE round(lo / hi::DOUBLE, 6) END AS jaccard,
            CASE WHEN len(u) = 0 THEN 1.0 ELSE round(1 - levenshtein(ca, cb) / greatest(len(a), len(b))::DOUBLE, 6) END AS levenshtein FROM w""",
    "nil_decision": f"WITH {_DECIDED} SELECT should_be_nil, is_nil, count(*) AS n FROM x GROUP BY 1, 2",
    "nil_classification_report": _report("should_be_nil"),
    "nil_mitigated": _report("mitigated"),
    "nil_confusion_normalized": f"""WITH {_DECIDED} SELECT round(avg((NOT is_nil)::INT) FILTER (NOT should_be_nil), 9) AS tn, round(avg(is_nil::INT) FILTER (NOT should_be_nil), 9) AS fp,
        round(avg((NOT is_nil)::INT) FILTER (should_be_nil), 9) AS fn, round(avg(is_nil::INT) FILTER (should_be_nil), 9) AS tp FROM x""",
    "delete_nil_entities": """SELECT DISTINCT id, indexer, wikipedia_id, title FROM entities e WHERE NOT (indexer = 10 AND EXISTS
        (SELECT 1 FROM mentions m WHERE m.nil AND m.wikiid = e.wikipedia_id))""",
    "bm25_candidates": f"""WITH e AS (SELECT DISTINCT id, redirects_to, title, descr FROM entities WHERE indexer = 10),
        l AS (SELECT redirects_to AS id, count(DISTINCT id) AS links FROM e GROUP BY 1),
        f AS (SELECT id, 't' AS field, 1.0::DOUBLE AS fw, {_WORDS.format('title')} AS ws FROM e UNION ALL SELECT id, 'd', 0.5, {_WORDS.format('descr')} FROM e),
        g AS (SELECT * FROM f WHERE len(ws) > 0), st AS (SELECT field, count(*) AS n, avg(len(ws)) AS mean FROM g GROUP BY 1),
        t AS (SELECT id, field, fw, len(ws) AS len, unnest(ws) AS term FROM g), tf AS (SELECT id, field, fw, len, term, count(*) AS tf FROM t GROUP BY ALL),
        df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2),
        p AS (SELECT tf.term, tf.id, fw * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS w FROM tf JOIN df USING (field, term) JOIN st USING (field)),
        m AS (SELECT DISTINCT ex_id AS query, word AS text FROM mentions WHERE ex_id % 20 = 0 AND word IS NOT NULL), tx AS (SELECT DISTINCT text FROM m),
        q AS (SELECT text, unnest(list_distinct({_WORDS.format('text')})) AS term FROM tx),
        s AS (SELECT text, p.id, round(sum(w) * log10(10 + coalesce(any_value(links), 0)), 6) AS score FROM q JOIN p USING (term) LEFT JOIN l ON l.id = p.id GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, id) AS rank FROM s)
        SELECT m.query, r.id, round(r.score, 4) AS score FROM m JOIN r USING (text) WHERE rank <= 5""",
    "undersample": f"""WITH {_DECIDED}, y AS (SELECT query, (NOT should_be_nil AND good)::INT AS label FROM x),
        o AS (SELECT query, label, row_number() OVER (ORDER BY ('0x' || substr(md5('1234|' || query), 1, 8))::BIGINT / 4294967296.0, query) AS k FROM y WHERE label = 1)
        SELECT query, label FROM y WHERE label = 0 UNION ALL SELECT query, label FROM o WHERE k <= (SELECT count(*) FROM y WHERE label = 0)""",
    "ablation_metrics": f"""WITH {_DECIDED}, y AS (SELECT nil_score AS p, (NOT should_be_nil AND good)::INT AS y, good::INT AS b, (nil_score > 0.5)::INT AS g FROM x WHERE nil_score IS NOT NULL),
        k AS (SELECT *, p <= 0.25 OR p >= 0.75 AS sure FROM y),
        f AS (SELECT count(*) AS size, avg(b) AS ba, avg((g = y)::INT) AS acc, sum((g = y)::INT) / 10000.0 AS adj, avg(CASE WHEN g = 1 THEN b ELSE (y = 0)::INT END) AS cor,
            coalesce(2.0 * count(*) FILTER (g = 0 AND y = 0) / nullif(2 * count(*) FILTER (g = 0 AND y = 0) + count(*) FILTER (g <> y), 0), 0) AS f0,
            coalesce(2.0 * count(*) FILTER (g = 1 AND y = 1) / nullif(2 * count(*) FILTER (g = 1 AND y = 1) + count(*) FILTER (g <> y), 0), 0) AS f1,
            avg((g = y)::INT) FILTER (sure) AS oa,
            coalesce(2.0 * count(*) FILTER (sure AND g = 0 AND y = 0) / nullif(2 * count(*) FILTER (sure AND g = 0 AND y = 0) + count(*) FILTER (sure AND g <> y), 0), 0) AS s0,
            coalesce(2.0 * count(*) FILTER (sure AND g = 1 AND y = 1) / nullif(2 * count(*) FILTER (sure AND g = 1 AND y = 1) + count(*) FILTER (sure AND g <> y), 0), 0) AS s1, avg(sure::INT) AS ks FROM k)
        SELECT size, round(ba * 100, 1) AS baseline, round(acc * 100, 1) AS acc, round(adj * 100, 1) AS acc_adjusted, round(cor * 100, 1) AS acc_correcting, round(f0 * 100, 1) AS f1_0, round(f1 * 100, 1) AS f1_1,
            round((f0 + f1) * 50, 1) AS macro_f1, round(oa * 100, 1) AS oracle_acc, round((s0 + s1) * 50, 1) AS oracle_macro_f1, round((1 - ks) * 100, 1) AS to_validator FROM f""",
    "overall_accuracy": f"""WITH {_DECIDED}, one AS (SELECT query, id, indexer FROM r WHERE rank = 1), k AS (SELECT o.id, g.gold, count(*) AS n FROM one o JOIN g ON g.query = o.query WHERE o.indexer = 20 AND gold IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT id, list(gold) AS modes FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY n DESC) AS p FROM k) WHERE p = 1 GROUP BY 1),
        z AS (SELECT x.*, o.indexer = 20 AS added, CASE WHEN o.indexer = 20 THEN t.modes END AS modes FROM x JOIN one o ON o.query = x.query LEFT JOIN t ON t.id = o.id),
        o2 AS (SELECT count(*) AS size, count(*) FILTER (NOT is_nil AND NOT added AND good) AS linked_correct,
            count(*) FILTER (NOT is_nil AND added AND len(modes) <= 2 AND list_contains(modes, gold)) AS added_correct, count(*) FILTER (is_nil AND should_be_nil) AS nil_correct FROM z)
        SELECT *, linked_correct + added_correct + nil_correct AS overall_correct, round((linked_correct + added_correct + nil_correct) / size::DOUBLE, 9) AS overall_accuracy FROM o2""",
}
