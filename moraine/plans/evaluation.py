"""Queries of the incremental loop, its services and clusterers, and of further measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.vectors import from_base64
from moraine.operators import clustering, kb, metrics, nil
from moraine.operators.skew import distinct_records
from moraine.plans import linking
from moraine.plans.sql import FLOATS, ITEMS, MENTIONS, WORDS
from moraine.session import cut, scratch, table
from moraine.streaming import incremental

DIM, STEPS = 128, 3
LINK = 100.0  # products above this link the vectors of search_requests
WEIGHTS, INTERCEPT = (("best", 0.05), ("secondiff", 0.05)), -5.0
FEATURE = 0.9  # contexts of the test tables hardly repeat, so the threshold of the clusterer lies lower
SHOWN = tuple(c for c in incremental.REPORT if "ceaf" not in c and "mean" not in c)  # SQL has no best matching


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that come with a vector (search_requests names their ex_id), in STEPS batches."""
    s = table(spark, sf_dir, "search_requests", "query_id", "encodings").filter("query_id is not null").groupBy("query_id").agg(F.max("encodings").alias("encodings"))
    m = distinct_records(table(spark, sf_dir, "mentions", "ex_id", "word", "wikiid", "nil", "batch"), "ex_id", "word", "wikiid", "nil", "batch")
    return s.join(m, F.col("query_id") == F.col("ex_id")).select(
        F.col("query_id").alias("query"), F.col("word").alias("mention"), F.col("wikiid").alias("gold"), F.coalesce("nil", F.lit(False)).alias("nil"),
        F.pmod(F.coalesce("batch", F.lit(0)), F.lit(STEPS)).alias("batch"), from_base64(F.col("encodings")).alias("vector"),
    )


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "kb_vectors", "id", "indexer", "encoding").filter("id is not null and indexer is not null")
    vectors = linking.blocks.clean_vectors(vectors.withColumnRenamed("encoding", "vector"), "vector", DIM).groupBy("id", "indexer").agg(F.min("vector").alias("vector"))
    names = [f.split()[0] for f in kb.ENTITY_SCHEMA.split(", ")]
    entities = table(spark, sf_dir, "entities", *names).distinct()
    return vectors.select("id", "indexer", "vector"), entities


def _settings(spark: SparkSession, **more) -> incremental.Settings:
    return incremental.Settings(state=scratch(spark), dim=DIM, nil_weights=WEIGHTS, nil_intercept=INTERCEPT, cluster_threshold=LINK, **more)


def incremental_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches that link, decide, cluster and grow, with the overall row."""
    settings = _settings(spark)
    incremental.start(spark, settings, *_base(spark, sf_dir))
    reports = incremental.run_all(cut(_asked(spark, sf_dir)), settings, list(range(STEPS)))
    return incremental.overall_report(reports).select("batch", F.col("size").cast("long").alias("size"), *[F.round(f"`{c}`", 6).alias(c) for c in SHOWN])


def one_pass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches at once, without growth."""
    settings = _settings(spark, grow=False)
    incremental.start(spark, settings, *_base(spark, sf_dir))
    report = incremental.run_one_pass(_asked(spark, sf_dir), settings)
    return report.select(F.col("batch").cast("string").alias("batch"), "size", *[F.round(f"`{c}`", 6).alias(c) for c in SHOWN])


def correct_steps_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches at once, each component judged on right answers of the ones before it."""
    settings = _settings(spark, correct_steps=True)
    incremental.start(spark, settings, *_base(spark, sf_dir))
    report = incremental.run_one_pass(_asked(spark, sf_dir), settings)
    shown = [c for c in SHOWN if "recall@" in c or "_cm_t" in c or "_cm_f" in c or "bcubed" in c]
    return report.select("size", "dropped", *[F.round(f"`{c}`", 6).alias(c) for c in shown])


def nil_training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, entities = _base(spark, sf_dir)
    t = incremental.training_frame(cut(_asked(spark, sf_dir)), vectors, entities, DIM, 100)
    numbers = [F.round(c, 6).alias(c) for c in ("max", "second", "secondiff", "min", "mean", "median", "stdev", "levenshtein", "jaccard")]
    return t.select("query", "top_id", "top_title", F.size("scores").alias("n_scores"), F.slice("nns", 1, 3).alias("nns"), "labels", *numbers)


def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every readable query, best first; the second list is that of the read-write index."""
    s = table(spark, sf_dir, "search_requests", "query_id", "encodings").filter("query_id is not null").groupBy("query_id").agg(F.max("encodings").alias("encoding"))
    got = incremental.search_request(s.withColumnRenamed("query_id", "query"), *_base(spark, sf_dir), DIM, 10)
    first = F.get("candidates", F.lit(0))
    return got.select("query", F.greatest(F.size("candidates"), F.lit(0)).alias("n"), first["id"].alias("id"), first["indexer"].alias("indexer"), first["title"].alias("title"), F.round(first["norm_score"], 6).alias("norm_score"))


def nil_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature records of mentions, with their candidates, filled and judged."""
    n = table(spark, sf_dir, "nil_features", "feature_id", "query_id", "mention", "title", "max_bi", "max_cross", "jaccard", "levenshtein")
    names = ("query_id", "mention", "title", "max_bi", "max_cross", "jaccard", "levenshtein")
    one = distinct_records(n, "feature_id", *names).filter("query_id is not null")
    lists = one.filter("max_bi is not null").groupBy("query_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("max_bi").alias("score"))))).alias("topcandidates"))
    records = one.join(lists, "query_id", "left")
    got = incremental.nil_request(records.drop("secondiff"), {"max_bi": 0.02, "secondiff": 0.05, "jaccard": 1.0}, -2.5)
    return got.select("feature_id", "is_nil", *[F.round(c, 6).alias(c) for c in ("nil_score", "jaccard", "levenshtein", "mean", "median", "stdev", "secondiff")])


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = distinct_records(table(spark, sf_dir, "cluster_items", "item_id", "request_id", "mentions", "embeddings", "encodings"), "item_id", "request_id", "mentions", "embeddings", "encodings")
    return t.select(F.col("request_id").alias("grp"), F.col("item_id").alias("item"), F.col("mentions").alias("mention"), F.lit("").alias("context"), "embeddings", "encodings")


def cluster_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of cluster_items answered by the greedy clusterer, with titles, members and centers."""
    got = incremental.cluster_request(_requests(spark, sf_dir).filter("grp is not null"), DIM, "greedy", 60.0)
    center = from_base64(F.col("center"))
    return got.select("cluster", "title", "n_elements", "mentions_id", F.octet_length(center).alias("center_bytes"))


def three_step_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_items by mention, vectors inside it, means and size."""
    text = F.when(F.length("embeddings") > 0, F.col("embeddings")).otherwise(F.col("encodings"))
    items = _requests(spark, sf_dir).select("grp", "item", "mention", from_base64(text).alias("vector"))
    return clustering.three_step_clusters(items, DIM, semantic=0.15, merge=0.2, gate=80.0, limit=5)


def feature_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a batch by their text and contexts."""
    names = ("word", "batch", "left_context_text", "right_context_text")
    m = distinct_records(table(spark, sf_dir, "mentions", "ex_id", *names), "ex_id", *names).filter("batch is not null")
    context = F.concat_ws(" ", F.coalesce("left_context_text", F.lit("")), F.coalesce("right_context_text", F.lit("")))
    items = m.select(F.col("batch").cast("long").alias("grp"), F.col("ex_id").alias("item"), F.col("word").alias("mention"), context.alias("context"))
    return clustering.feature_clusters(items, FEATURE)


def kb_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read-write index after its reset and two growths by the NIL mentions of even and odd batches, clustered by key."""
    entities = kb.reset(_base(spark, sf_dir)[1])
    m = distinct_records(table(spark, sf_dir, "mentions", "ex_id", "word", "nil", "batch"), "ex_id", "word", "nil", "batch").filter("nil and batch is not null and word is not null")
    c = cut(clustering.string_clusters(m, "ex_id", "word").join(m, "ex_id"))
    for part in (0, 1):
        titles = clustering.mode_titles(c.filter(F.col("batch") % 2 == part), "cluster", "word")
        entities = cut(entities.unionByName(kb.grow(entities, titles, kb.next_position(entities)).drop("cluster")))
    return entities.groupBy("indexer").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last")).unionByName(
        entities.filter("indexer = 20").select(F.lit(None).cast("int").alias("indexer"), F.length("title").cast("long").alias("n"), F.lit(None).cast("long").alias("ids"), F.col("id").alias("first"), F.col("wikipedia_id").alias("last"))
    )


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, gold_rank and the mention type of mentions that are not NIL."""
    kind = table(spark, sf_dir, "nil_features", "query_id", "mentiontype").filter("query_id is not null").groupBy("query_id").agg(F.min("mentiontype").alias("kind"))
    return linking._ranked_gold(spark, sf_dir).join(kind, F.col("query") == F.col("query_id")).select("query", "gold_rank", "kind")


def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate recall per mention type, over all and as a mean over types."""
    got = metrics.recall_by(_ranks(spark, sf_dir).withColumnRenamed("kind", "type"), "type", [1, 3, 10])
    return got.select("kind", "type", "n", *[F.round(f"r{k}", 9).alias(f"r{k}") for k in (1, 3, 10)])


def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.recall_curve(linking._ranked_gold(spark, sf_dir))
    return got.select(F.col("gold_rank").cast("long").alias("gold_rank"), F.round("recall", 6).alias("recall"))


def ranking_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate as the answer of a ranker over the candidates: label is the place of the gold, -1 if absent."""
    r = linking._ranked_gold(spark, sf_dir).select((F.greatest("gold_rank", F.lit(0)) - 1).alias("label"), F.lit(0).alias("guess"))
    return metrics.ranking_accuracy(r, "label", "guess", 10_000).select(*[F.round(c, 9).alias(c) for c in ("normalized", "unnormalized", "candidate_recall")])


def system_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the linked answers, NIL answers aside."""
    d = linking._decided(spark, sf_dir)
    name = lambda nil_, c: F.when(nil_, "NIL").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("none")))
    m = metrics.system_measures(d.select(name(F.col("should_be_nil"), "gold").alias("gold"), name(F.col("is_nil"), "top_id").alias("guess")), "gold", "guess")
    return m.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mention type with size, recalls and accuracy, replaced and appended as a summary."""
    r = _ranks(spark, sf_dir).withColumn("rows", F.lit(1))
    new = r.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold_rank") == 1).cast("double")), 9).alias("accuracy"), F.round(F.avg(F.col("gold_rank").between(1, 10).cast("double")), 9).alias("recall_10"))
    old = spark.createDataFrame([("person", 0, 0.0, 0.0), ("earlier", 1, 1.0, 1.0)], "name string, n long, accuracy double, recall_10 double")
    return metrics.upsert_report(old, new)


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nil.roc_points(linking._labelled(spark, sf_dir), "nil_score", "label")
    return got.select(*[F.round(c, 9).alias(c) for c in ("threshold", "fpr", "tpr")])


def score_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of the NIL score per label on a grid."""
    got = nil.density_points(linking._labelled(spark, sf_dir), "nil_score", "label", 0.0, 1.0, 21, 0.05)
    return got.select("label", F.round("at", 6).alias("at"), F.round("density", 6).alias("density"))


QUERIES = {
    f.__name__: f
    for f in (
        incremental_report, one_pass_report, correct_steps_report, nil_training_frame, search_response, nil_response, cluster_response, three_step_clusters,
        feature_clusters, kb_growth, recall_by_type, recall_curve, ranking_accuracy, system_measures, benchmark_table, roc_points, score_density,
    )
}

_START = f"""{MENTIONS}, sx AS (SELECT query_id AS query, max(encodings) AS x FROM search_requests WHERE query_id IS NOT NULL GROUP BY 1),
sv AS (SELECT query, regexp_replace(x, '\\s+', '', 'g') AS x FROM sx),
sq AS MATERIALIZED (SELECT query, CASE WHEN length(x) = 684 THEN {FLOATS.format('x')} END AS e0 FROM sv),
q AS MATERIALIZED (SELECT query, word AS mention, wikiid AS gold, coalesce(nil, FALSE) AS nil, coalesce(batch, 0) % {STEPS} AS step,
    CASE WHEN len(list_filter(e0, lambda v: isnan(v) OR isinf(v) OR abs(v) > 3.5e38)) = 0 AND len(list_filter(e0, lambda v: v <> 0)) > 0 THEN e0 END AS e FROM sq JOIN m ON m.ex_id = sq.query),
kv AS MATERIALIZED (SELECT id, indexer, any_value(encoding)::DOUBLE[] AS e FROM kb_vectors WHERE len(encoding) = 128
    AND len(list_filter(encoding, lambda v: isnan(v) OR isinf(v))) = 0 AND len(list_filter(encoding, lambda v: v <> 0)) > 0 GROUP BY 1, 2),
en AS MATERIALIZED (SELECT DISTINCT id, indexer, wikipedia_id, title FROM entities)"""


def _ranked(k: str, mentions: str, vectors: str, entities: str, top: int = 10) -> str:
    return f"""s{k} AS (SELECT q.query, v.indexer, v.id, round(list_inner_product(q.e, v.e), 9) AS raw, list_inner_product(q.e, q.e) AS qq, list_inner_product(v.e, v.e) AS vv FROM {mentions} q, {vectors} v WHERE q.e IS NOT NULL),
    t{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, indexer ORDER BY raw DESC, id) AS p FROM s{k}) WHERE p <= {top}),
    r{k} AS MATERIALIZED (SELECT t.*, n.title, CASE WHEN n.id IS NULL THEN -1000.0 ELSE raw END AS score, CASE WHEN n.id IS NULL THEN 0 ELSE n.wikipedia_id END AS wid,
        row_number() OVER (PARTITION BY query ORDER BY CASE WHEN n.id IS NULL THEN -1000.0 ELSE raw END DESC, t.indexer, t.id) AS rank FROM t{k} t LEFT JOIN {entities} n ON n.id = t.id AND n.indexer = t.indexer)"""


def _step(k: int, mentions: str, vectors: str, entities: str, added: str, modes: str, correct: bool = False) -> str:
    """CTEs of one batch: j (judged mentions), c (clusters of the unlinked), and the grown tables with the next number."""
    who = "should" if correct else "is_nil"
    return f"""{_ranked(str(k), mentions, vectors, entities)},
    g{k} AS (SELECT q.query, coalesce(min(r.rank), -1) AS gold_rank FROM {mentions} q LEFT JOIN r{k} r ON r.query = q.query AND r.wid = q.gold GROUP BY 1),
    p{k} AS (SELECT query, max(score) FILTER (rank = 1) AS best, max(score) FILTER (rank = 2) AS second, max(id) FILTER (rank = 1) AS id, max(indexer) FILTER (rank = 1) AS indexer, max(wid) FILTER (rank = 1) AS top, count(*) AS n FROM r{k} GROUP BY 1),
    d{k} AS (SELECT q.*, g.gold_rank, p.top, p.indexer = 20 AS on_added, p.n, o.modes, coalesce(1 / (1 + exp(-({INTERCEPT} + {WEIGHTS[0][1]} * best + {WEIGHTS[1][1]} * (best - coalesce(second, 0))))), 0) < 0.5 AS is_nil, q.nil AND NOT EXISTS (SELECT 1 FROM {added} a WHERE a.gold = q.gold) AS should
        FROM {mentions} q JOIN g{k} g USING (query) LEFT JOIN p{k} p ON p.query = q.query LEFT JOIN {modes} o ON o.id = p.id AND p.indexer = 20),
    a{k} AS MATERIALIZED (SELECT *, should OR coalesce(top <> gold, TRUE) AS mitigated, nil OR (gold_rank > 0 AND gold_rank < n) AS usable FROM d{k}),
    j{k} AS MATERIALIZED (SELECT * FROM a{k} {"WHERE coalesce(usable, FALSE)" if correct else ""}),
    u{k} AS MATERIALIZED (SELECT query, mention, gold, e FROM j{k} WHERE {who}),
    l{k} AS (SELECT x.query AS a, y.query AS b FROM u{k} x, u{k} y WHERE x.query <> y.query AND x.e IS NOT NULL AND y.e IS NOT NULL AND list_inner_product(x.e, y.e) > {LINK}),
    near{k} AS MATERIALIZED (SELECT a AS item, max(b) FILTER (b < a) AS ptr, max(b) AS top FROM l{k} GROUP BY 1),
    turn{k} AS (SELECT item, item AS root FROM near{k} WHERE ptr IS NULL UNION ALL SELECT near{k}.item, turn{k}.root FROM near{k} JOIN turn{k} ON near{k}.ptr = turn{k}.item),
    c{k} AS MATERIALIZED (SELECT u.*, coalesce(t.root, u.query) AS cluster FROM u{k} u LEFT JOIN near{k} n ON n.item = u.query LEFT JOIN turn{k} t ON t.item = greatest(n.top, n.item))"""


def _grown(k: int, vectors: str, entities: str, added: str, modes: str) -> str:
    return f"""w{k} AS (SELECT cluster, mention, count(*) AS n FROM c{k} GROUP BY 1, 2),
    z{k} AS (SELECT cluster, coalesce(arg_min(mention, (-n, mention)) FILTER (mention IS NOT NULL), '') AS title, sum(n) AS size FROM w{k} GROUP BY 1),
    new{k} AS MATERIALIZED (SELECT *, (SELECT coalesce(max(id), -1) + 1 FROM (SELECT id, indexer FROM {vectors} UNION ALL SELECT id, indexer FROM {entities}) WHERE indexer = 20) + row_number() OVER (ORDER BY size DESC, cluster) - 1 AS id FROM z{k}),
    dist{k} AS (SELECT x.cluster, x.query, round(sum(list_distance(x.e, y.e)), 6) AS d FROM c{k} x JOIN c{k} y ON x.cluster = y.cluster WHERE x.e IS NOT NULL AND y.e IS NOT NULL GROUP BY 1, 2),
    med{k} AS (SELECT cluster, arg_min(query, (d, query)) AS query FROM dist{k} GROUP BY 1),
    gm{k} AS (SELECT cluster, gold, rank() OVER (PARTITION BY cluster ORDER BY count(*) DESC) AS p FROM c{k} WHERE gold IS NOT NULL GROUP BY 1, 2),
    kv{k} AS MATERIALIZED (SELECT id, indexer, e FROM {vectors} UNION ALL SELECT n.id, 20, u.e FROM new{k} n JOIN med{k} USING (cluster) JOIN u{k} u ON u.query = med{k}.query),
    en{k} AS MATERIALIZED (SELECT id, indexer, wikipedia_id, title FROM {entities} UNION ALL SELECT id, 20, -1, title FROM new{k}),
    ad{k} AS MATERIALIZED (SELECT gold FROM {added} UNION SELECT gold FROM u{k}),
    mo{k} AS MATERIALIZED (SELECT id, modes FROM {modes} UNION ALL SELECT n.id, list(gold) FILTER (p = 1) FROM new{k} n LEFT JOIN gm{k} g USING (cluster) GROUP BY 1)"""


def _figures(k: int, name: str) -> str:
    """SELECT of the report columns of step k."""
    cells = {"tn": "NOT {t} AND NOT is_nil", "fp": "NOT {t} AND is_nil", "fn": "{t} AND NOT is_nil", "tp": "{t} AND is_nil"}
    out = [f"'{name}' AS batch", "count(*)::BIGINT AS size"]
    out += [f'(SELECT avg((gold_rank BETWEEN 1 AND {r})::INT::DOUBLE) FROM a{k} WHERE NOT nil) AS "linking_recall@{r}"' for r in incremental.RECALLS]
    for mark, t in (("", "should"), ("mitigated_", "mitigated")):
        n = {c: f"count(*) FILTER ({w.format(t=t)})::DOUBLE" for c, w in cells.items()}
        of = {"tn": f"count(*) FILTER (NOT {t})", "fp": f"count(*) FILTER (NOT {t})", "fn": f"count(*) FILTER ({t})", "tp": f"count(*) FILTER ({t})"}
        out += [f"{n[c]} AS nil_prediction_{mark}cm_{c}" for c in cells] + [f"coalesce({n[c]} / nullif({of[c]}, 0), 0) AS nil_prediction_{mark}cm_normalized_{c}" for c in cells]
        for side, good, given in (("NIL", "tp", "is_nil"), ("not-NIL", "tn", "NOT is_nil")):
            p, r = f"coalesce({n[good]} / nullif(count(*) FILTER ({given}), 0), 0)", f"coalesce({n[good]} / nullif({of[good]}, 0), 0)"
            m = mark.rstrip("_")
            out += [f'{p} AS "{side}-{m}-precision"', f'{r} AS "{side}-{m}-recall"', f'coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0) AS "{side}-{m}-f1-score"', f'{of[good]}::DOUBLE AS "{side}-{m}-support"']
    cell = f"(SELECT n, sum(n) OVER (PARTITION BY gold) AS nt, sum(n) OVER (PARTITION BY cluster) AS np, gold, cluster FROM (SELECT gold, cluster, count(*) AS n FROM c{k} WHERE gold IS NOT NULL GROUP BY 1, 2))"
    b3p, b3r = f"(SELECT sum(n * n / np::DOUBLE) / sum(n) FROM {cell})", f"(SELECT sum(n * n / nt::DOUBLE) / sum(n) FROM {cell})"
    mp = f"(SELECT sum(s - c) / (sum(s - 1) + 1e-13) FROM (SELECT max(np) AS s, count(*) AS c FROM {cell} GROUP BY cluster))"
    mr = f"(SELECT sum(s - c) / (sum(s - 1) + 1e-13) FROM (SELECT max(nt) AS s, count(*) AS c FROM {cell} GROUP BY gold))"
    pre = "eval_clustering_"
    out += [f"{b3p} AS nil_clustering_bcubed_precision", f"{b3r} AS nil_clustering_bcubed_recall", f"{mp} AS {pre}muc_precision", f"{mr} AS {pre}muc_recall", f"2 * {mp} * {mr} / ({mp} + {mr} + 1e-13) AS {pre}muc_f1",
            f"{b3p} AS {pre}b3_precision", f"{b3r} AS {pre}b3_recall", f"2 * {b3p} * {b3r} / ({b3p} + {b3r}) AS {pre}b3_f1", f"(SELECT count(DISTINCT cluster)::DOUBLE FROM {cell}) AS {pre}pred_clusters_len"]
    linked, back = "count(*) FILTER (NOT nil AND NOT is_nil AND top = gold)::DOUBLE", "count(*) FILTER (nil AND NOT should AND NOT is_nil AND on_added AND len(modes) <= 2 AND list_contains(modes, gold))::DOUBLE"
    good = "count(*) FILTER (should AND is_nil)::DOUBLE"
    of = lambda a, b: f"coalesce({a} / nullif(count(*) FILTER ({b}), 0), 0)"
    out += [f"{of(linked, 'NOT nil')} AS overall_to_link_correct", f"{good} AS should_be_nil_correct", "count(*) FILTER (should)::DOUBLE AS should_be_nil_total", f"{of(good, 'should')} AS should_be_nil_correct_normalized",
            f"{back} AS should_be_linked_to_prev_added_correct", "count(*) FILTER (nil AND NOT should)::DOUBLE AS should_be_linked_to_prev_added_total", f"{of(back, 'nil AND NOT should')} AS should_be_linked_to_prev_added_correct_normalized",
            f"{linked} + {good} + {back} AS overall_correct", f"({linked} + {good} + {back}) / count(*) AS overall_accuracy"]
    return f"SELECT {', '.join(out)} FROM j{k}"


_NONE = "ad AS (SELECT 0::BIGINT AS gold WHERE FALSE), mo AS (SELECT 0 AS id, [0::BIGINT] AS modes WHERE FALSE), kr AS (SELECT * FROM kv WHERE indexer <> 20), er AS (SELECT * FROM en WHERE indexer <> 20)"
_Q = ", ".join(f"q{k} AS (SELECT * FROM q WHERE step = {k})" for k in range(STEPS))


def _names(k: int) -> tuple[str, str, str, str]:
    return ("kr", "er", "ad", "mo") if k == 0 else (f"kv{k - 1}", f"en{k - 1}", f"ad{k - 1}", f"mo{k - 1}")


_LOOP = f"WITH RECURSIVE {_START}, {_NONE}, {_Q}, " + ", ".join(_step(k, f"q{k}", *_names(k)) + (", " + _grown(k, *_names(k)) if k + 1 < STEPS else "") for k in range(STEPS))
_ROWS = " UNION ALL ".join(_figures(k, str(k)) for k in range(STEPS))
_ROUND = ", ".join(f'round("{c}", 6) AS "{c}"' for c in SHOWN)
_MEANS = ", ".join(f'avg("{c}") AS "{c}"' for c in SHOWN if c not in ("overall_correct", "overall_accuracy"))
_ALL = f"WITH RECURSIVE {_START}, {_NONE}, " + _step(0, "q", "kr", "er", "ad", "mo")
_RIGHT = f"WITH RECURSIVE {_START}, {_NONE}, " + _step(0, "q", "kr", "er", "ad", "mo", correct=True)
_KEPT = [c for c in SHOWN if "recall@" in c or "_cm_t" in c or "_cm_f" in c or "bcubed" in c]

_C, _D = linking._CAND, linking._DECIDED
_GOLD = f"""{_C}, a AS (SELECT DISTINCT r.query, g.gold FROM r JOIN g ON g.query = r.query WHERE g.nil = FALSE),
    h AS (SELECT a.query, coalesce(min(r.rank), -1) AS rank FROM a LEFT JOIN r ON r.query = a.query AND r.wikipedia_id = a.gold GROUP BY 1),
    y AS (SELECT query_id, min(mentiontype) AS type FROM nil_features WHERE query_id IS NOT NULL GROUP BY 1), z AS (SELECT h.*, y.type FROM h JOIN y ON y.query_id = h.query)"""
_HITS = ", ".join(f"avg((rank BETWEEN 1 AND {k})::INT::DOUBLE) AS r{k}" for k in (1, 3, 10))
_KEY = "CASE WHEN length({0}) < 4 THEN 's:' || {0} WHEN {0} IS NOT NULL THEN 'l:' || lower({0}) END"
_SIM = """CASE WHEN len(u) = 0 THEN 1.0 ELSE lo / hi::DOUBLE END AS jac, CASE WHEN len(u) = 0 THEN 1.0 ELSE 1 - levenshtein(ca, cb) / greatest(len(wa), len(wb))::DOUBLE END AS lev"""


def _similar(source: str, a: str, b: str) -> str:
    """CTEs that add jac and lev of two text columns to a source."""
    return f"""x1 AS (SELECT *, {WORDS.format(a)} AS wa, {WORDS.format(b)} AS wb FROM {source}), x2 AS (SELECT *, list_distinct(list_concat(wa, wb)) AS u FROM x1),
    x3 AS (SELECT *, array_to_string(list_transform(wa, lambda x: chr(list_position(u, x)::INT + 64)), '') AS ca, array_to_string(list_transform(wb, lambda x: chr(list_position(u, x)::INT + 64)), '') AS cb,
        list_sum(list_transform(u, lambda x: least(len(list_filter(wa, lambda y: y = x)), len(list_filter(wb, lambda y: y = x))))) AS lo,
        list_sum(list_transform(u, lambda x: greatest(len(list_filter(wa, lambda y: y = x)), len(list_filter(wb, lambda y: y = x))))) AS hi FROM x2),
    x4 AS (SELECT *, {_SIM} FROM x3)"""


ORACLE = {
    "incremental_report": f"""{_LOOP}, rows_ AS MATERIALIZED ({_ROWS}), every AS (SELECT * FROM rows_ UNION ALL BY NAME
        SELECT 'incremental_overall' AS batch, sum(size)::BIGINT AS size, {_MEANS}, sum(overall_correct) AS overall_correct, sum(overall_correct) / sum(size) AS overall_accuracy FROM rows_)
        SELECT batch, size, {_ROUND} FROM every""",
    "one_pass_report": f"{_ALL}, every AS ({_figures(0, '0')}) SELECT batch, size, {_ROUND} FROM every",
    "correct_steps_report": f"""{_RIGHT}, every AS ({_figures(0, '0')}) SELECT (SELECT count(*) FROM a0) AS size, (SELECT count(*) FROM a0 WHERE NOT coalesce(usable, FALSE)) AS dropped, {', '.join(f'round("{c}", 6) AS "{c}"' for c in _KEPT)} FROM every""",
    "nil_training_frame": f"""WITH {_START}, {_ranked('0', 'q', 'kv', 'en', 100)}, f AS (SELECT query, max(wid) FILTER (rank = 1) AS top_id, max(title) FILTER (rank = 1) AS t1, max(score) FILTER (rank = 1) AS s1,
        coalesce(list(score ORDER BY rank) FILTER (wid > 0), []) AS sc, coalesce(list(wid ORDER BY rank) FILTER (wid > 0), []) AS ns FROM r0 GROUP BY 1),
        b AS (SELECT q.query, q.mention, q.gold, q.nil, f.top_id, CASE WHEN s1 = -1000 THEN '' ELSE t1 END AS top_title, coalesce(sc, []) AS sc, coalesce(ns, []) AS ns FROM q LEFT JOIN f ON f.query = q.query), {_similar('b', 'mention', 'top_title')}
        SELECT query, top_id, top_title, len(sc)::INT AS n_scores, ns[1:3] AS nns, coalesce(NOT nil AND gold = top_id, FALSE)::INT AS labels, round(list_max(sc), 6) AS max, round(CASE WHEN len(sc) > 1 THEN sc[2] END, 6) AS second,
            round(CASE WHEN len(sc) > 1 THEN sc[1] - sc[2] END, 6) AS secondiff, round(list_min(sc), 6) AS min, round(list_avg(sc), 6) AS mean, round(list_median(sc), 6) AS median, round(CASE WHEN len(sc) > 1 THEN list_stddev_samp(sc) END, 6) AS stdev,
            round(lev, 6) AS levenshtein, round(jac, 6) AS jaccard FROM x4""",
    "search_response": f"""WITH {_START}, qs AS (SELECT query, CASE WHEN len(list_filter(e0, lambda v: isnan(v) OR isinf(v) OR abs(v) > 3.5e38)) = 0 AND len(list_filter(e0, lambda v: v <> 0)) > 0 THEN e0 END AS e FROM sq), {_ranked('0', 'qs', 'kv', 'en')}
        SELECT qs.query, count(r.id)::INT AS n, max(r.id) FILTER (rank = 1) AS id, max(r.indexer) FILTER (rank = 1) AS indexer, max(CASE WHEN score = -1000 THEN '' ELSE title END) FILTER (rank = 1) AS title,
            round(max(CASE WHEN score <> -1000 THEN raw / greatest(qq, vv) END) FILTER (rank = 1), 6) AS norm_score FROM qs LEFT JOIN r0 r ON r.query = qs.query GROUP BY 1""",
    "nil_response": f"""WITH n AS (SELECT feature_id, any_value(query_id) AS query_id, any_value(mention) AS mention, any_value(title) AS title, any_value(max_bi) AS max_bi, any_value(max_cross) AS max_cross, any_value(jaccard) AS jaccard, any_value(levenshtein) AS levenshtein
            FROM nil_features WHERE feature_id IS NOT NULL GROUP BY 1), k AS (SELECT * FROM n WHERE query_id IS NOT NULL), {_similar('k', 'mention', 'title')},
        l AS (SELECT query_id, list(max_bi ORDER BY max_bi DESC) AS s FROM n WHERE max_bi IS NOT NULL AND query_id IS NOT NULL GROUP BY 1),
        v AS (SELECT feature_id, max_bi, coalesce(jaccard, CASE WHEN mention IS NOT NULL OR title IS NOT NULL THEN jac END) AS j, coalesce(levenshtein, CASE WHEN mention IS NOT NULL OR title IS NOT NULL THEN lev END) AS v,
            list_filter(s, lambda x: x > -1000) AS s FROM x4 LEFT JOIN l USING (query_id)),
        w AS (SELECT *, CASE WHEN len(s) > 1 THEN s[1] - s[2] END AS sd FROM v), y AS (SELECT *, 1 / (1 + exp(-(-2.5 + 0.02 * max_bi + 0.05 * sd + j))) AS p FROM w)
        SELECT feature_id, coalesce(p, 0) < 0.5 AS is_nil, round(p, 6) AS nil_score, round(j, 6) AS jaccard, round(v, 6) AS levenshtein, round(CASE WHEN len(s) > 0 THEN list_avg(s) END, 6) AS mean,
            round(CASE WHEN len(s) > 0 THEN list_median(s) END, 6) AS median, round(CASE WHEN len(s) > 1 THEN list_stddev_samp(s) END, 6) AS stdev, round(sd, 6) AS secondiff FROM y""",
    "cluster_response": f"""WITH RECURSIVE {ITEMS}, l AS (SELECT x.item AS a, y.item AS b FROM ok x JOIN ok y ON x.grp = y.grp AND x.item <> y.item WHERE list_inner_product(x.e, y.e) > 60),
        near AS MATERIALIZED (SELECT a AS item, max(b) FILTER (b < a) AS ptr, max(b) AS top FROM l GROUP BY 1),
        turn AS (SELECT item, item AS root FROM near WHERE ptr IS NULL UNION ALL SELECT near.item, turn.root FROM near JOIN turn ON near.ptr = turn.item),
        c AS (SELECT i.item, i.name, coalesce(t.root, i.item) AS cluster, ok.item IS NOT NULL AS good FROM it i LEFT JOIN near n ON n.item = i.item LEFT JOIN turn t ON t.item = greatest(n.top, n.item) LEFT JOIN ok ON ok.item = i.item WHERE i.grp IS NOT NULL),
        w AS (SELECT cluster, name, count(*) AS n FROM c GROUP BY 1, 2), z AS (SELECT cluster, arg_min(name, (-n, name)) FILTER (name IS NOT NULL) AS title, sum(n)::BIGINT AS n_elements FROM w GROUP BY 1)
        SELECT cluster, title, n_elements, list(item ORDER BY item) AS mentions_id, max(CASE WHEN good THEN 512 END)::INT AS center_bytes FROM c JOIN z USING (cluster) GROUP BY 1, 2, 3""",
    "three_step_clusters": f"""WITH RECURSIVE {ITEMS}, h AS (SELECT item, name, grp, {_KEY.format('name')} AS key FROM it WHERE grp IS NOT NULL), v AS MATERIALIZED (SELECT h.item, h.name, h.grp, h.key, ok.e FROM h LEFT JOIN ok ON ok.item = h.item),
        l AS (SELECT a.item AS a, b.item AS b FROM v a JOIN v b ON a.grp = b.grp AND a.key IS NOT DISTINCT FROM b.key AND a.item <> b.item WHERE a.e IS NOT NULL AND b.e IS NOT NULL AND list_cosine_similarity(a.e, b.e) > 1 - 0.15),
        reach AS (SELECT item AS a, item AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b), comp AS MATERIALIZED (SELECT a AS item, min(b) AS comp FROM reach GROUP BY 1),
        vc AS MATERIALIZED (SELECT v.*, comp.comp FROM v JOIN comp ON comp.item = v.item), x AS (SELECT comp, min(grp) AS grp, i, avg(e[i]) AS y FROM vc, range(1, 129) r(i) WHERE e IS NOT NULL GROUP BY 1, 3),
        mean AS MATERIALIZED (SELECT comp, grp, list(y ORDER BY i) AS e FROM x GROUP BY 1, 2), sq AS (SELECT comp, max(list_inner_product(e, e)) AS s FROM vc GROUP BY 1),
        l2 AS (SELECT a.comp AS a, b.comp AS b FROM mean a JOIN mean b ON a.grp = b.grp AND a.comp <> b.comp WHERE list_cosine_similarity(a.e, b.e) > 1 - 0.2),
        reach2 AS (SELECT DISTINCT comp AS a, comp AS b FROM vc UNION SELECT r.a, l2.b FROM reach2 r JOIN l2 ON l2.a = r.b), top AS (SELECT a AS comp, min(b) AS t FROM reach2 GROUP BY 1),
        cl AS MATERIALIZED (SELECT vc.item, vc.name, vc.key, CASE WHEN sq.s > 80 THEN top.t ELSE vc.comp END AS cluster FROM vc JOIN top ON top.comp = vc.comp JOIN sq ON sq.comp = top.t),
        wide AS (SELECT cluster FROM cl GROUP BY 1 HAVING count(DISTINCT lower(name)) > 5)
        SELECT item, min(item) OVER (PARTITION BY cluster, CASE WHEN cluster IN (SELECT cluster FROM wide) THEN key END) AS cluster FROM cl""",
    "feature_clusters": f"""WITH RECURSIVE {MENTIONS}, d AS MATERIALIZED (SELECT ex_id AS item, batch AS grp, word AS text, coalesce(l, '') || ' ' || coalesce(r, '') AS ctx FROM m WHERE batch IS NOT NULL),
        b AS (SELECT item, unnest(list_transform(range(1, length(text)), lambda i: substr(lower(text), i, 2))) AS term FROM d WHERE text IS NOT NULL), bt AS (SELECT item, term, count(*)::DOUBLE AS w FROM b GROUP BY 1, 2),
        w AS (SELECT item, grp, unnest({WORDS.format('ctx')}) AS term FROM d WHERE text IS NOT NULL), wt AS (SELECT item, grp, term, count(*)::DOUBLE AS tf FROM w GROUP BY 1, 2, 3),
        n AS (SELECT grp, count(*) AS n FROM d WHERE text IS NOT NULL GROUP BY 1), df AS (SELECT grp, term, count(*) AS df FROM wt GROUP BY 1, 2),
        wi AS (SELECT item, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM wt JOIN df USING (grp, term) JOIN n USING (grp)),
        z AS MATERIALIZED (SELECT d.grp, x.* FROM (SELECT item, 'c' || term AS term, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS w, 0.8 AS s FROM bt UNION ALL SELECT item, 'w' || term, w / sqrt(sum(w * w) OVER (PARTITION BY item)), 0.2 FROM wi) x JOIN d USING (item)),
        l AS (SELECT x.item AS a, y.item AS b FROM z x JOIN z y ON x.grp = y.grp AND x.term = y.term AND x.item <> y.item GROUP BY 1, 2 HAVING sum(x.s * x.w * y.w) > {FEATURE}),
        near AS MATERIALIZED (SELECT a AS item, max(b) FILTER (b < a) AS ptr, max(b) AS top FROM l GROUP BY 1),
        turn AS (SELECT item, item AS root FROM near WHERE ptr IS NULL UNION ALL SELECT near.item, turn.root FROM near JOIN turn ON near.ptr = turn.item)
        SELECT d.item, coalesce(t.root, d.item) AS cluster FROM d LEFT JOIN near n ON n.item = d.item LEFT JOIN turn t ON t.item = greatest(n.top, n.item)""",
    "kb_growth": f"""WITH {MENTIONS}, k AS (SELECT batch % 2 AS part, {_KEY.format('word')} AS c, word, count(*) AS n FROM m WHERE nil AND batch IS NOT NULL AND word IS NOT NULL GROUP BY 1, 2, 3),
        z AS (SELECT part, c, arg_min(word, (-n, word)) AS title, sum(n) AS n FROM k GROUP BY 1, 2), p AS (SELECT *, (row_number() OVER (ORDER BY part, n DESC, c) - 1)::INT AS id FROM z),
        e AS (SELECT DISTINCT * FROM entities WHERE indexer <> 20)
        SELECT indexer, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first, max(id) AS last FROM e GROUP BY 1
        UNION ALL SELECT 20, count(*), count(DISTINCT id), min(id), max(id) FROM p UNION ALL SELECT NULL, length(substr(title, 1, 100)), NULL, id, -1 FROM p""",
    "recall_by_type": f"""WITH {_GOLD}, t AS (SELECT type, count(*) AS n, {_HITS} FROM z GROUP BY 1), o AS (SELECT 'group' AS kind, * FROM t UNION ALL SELECT 'micro', NULL, count(*), {_HITS} FROM z UNION ALL SELECT 'macro', NULL, sum(n)::BIGINT, avg(r1), avg(r3), avg(r10) FROM t)
        SELECT kind, type, n, round(r1, 9) AS r1, round(r3, 9) AS r3, round(r10, 9) AS r10 FROM o""",
    "recall_curve": f"WITH {_GOLD}, rc AS (SELECT rank, count(*) AS n FROM h WHERE rank > 0 GROUP BY 1) SELECT rank::BIGINT AS gold_rank, round(sum(n) OVER (ORDER BY rank) * 100.0 / (SELECT count(*) FROM h), 6) AS recall FROM rc",
    "ranking_accuracy": f"WITH {_GOLD} SELECT round(avg((rank = 1)::INT), 9) AS normalized, round(count(*) FILTER (rank = 1) / 10000.0, 9) AS unnormalized, round(count(*) / 10000.0, 9) AS candidate_recall FROM h WHERE rank > 0",
    "system_measures": f"""WITH {_D}, s AS (SELECT CASE WHEN should_be_nil THEN 'NIL' ELSE coalesce(gold::VARCHAR, 'none') END AS g, CASE WHEN is_nil THEN 'NIL' ELSE coalesce(top_id::VARCHAR, 'none') END AS a FROM x),
        k AS (SELECT count(*) FILTER (g = a AND a <> 'NIL')::DOUBLE AS tp, nullif(count(*) FILTER (a <> 'NIL'), 0) AS said, nullif(count(*) FILTER (g <> 'NIL'), 0) AS really FROM s),
        pr AS (SELECT coalesce(tp / said, 0) AS p, coalesce(tp / really, 0) AS r FROM k) SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM pr""",
    "benchmark_table": f"""WITH {_GOLD}, t AS (SELECT type AS name, count(*) AS n, round(avg((rank = 1)::INT), 9) AS accuracy, round(avg((rank BETWEEN 1 AND 10)::INT), 9) AS recall_10 FROM z GROUP BY 1)
        SELECT * FROM t UNION ALL SELECT * FROM (VALUES ('person', 0, 0.0, 0.0), ('earlier', 1, 1.0, 1.0)) o(name, n, accuracy, recall_10) WHERE name NOT IN (SELECT name FROM t WHERE name IS NOT NULL)""",
    "roc_points": f"""WITH {_D}, y AS (SELECT nil_score AS t, (NOT should_be_nil AND good)::INT AS y FROM x WHERE nil_score IS NOT NULL), yc AS (SELECT t, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM y GROUP BY 1)
        SELECT round(t, 9) AS threshold, round(sum(n) OVER (ORDER BY t DESC) / nullif((SELECT sum(n) FROM yc), 0)::DOUBLE, 9) AS fpr, round(sum(p) OVER (ORDER BY t DESC) / nullif((SELECT sum(p) FROM yc), 0)::DOUBLE, 9) AS tpr FROM yc""",
    "score_density": f"""WITH {_D}, y AS (SELECT nil_score AS t, (NOT should_be_nil AND good)::INT AS label FROM x WHERE nil_score IS NOT NULL)
        SELECT label, round(g * 0.05, 6) AS at, round(avg(exp(-0.5 * pow((g * 0.05 - t) / 0.05, 2))) / (0.05 * sqrt(2 * pi())), 6) AS density FROM y, range(0, 21) r(g) GROUP BY 1, 2, g""",
}
