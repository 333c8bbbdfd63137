"""Queries of clustering, its measures, dataset synthesis and knowledge-base construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.text import mention_key
from moraine.functions.vectors import to_arrays
from moraine.operators import blocks, clustering, dataset, kb_etl, metrics
from moraine.operators.skew import distinct_records
from moraine.session import cut, table

DIM = 64  # of the embeddings table
LINK = 0.3  # embeddings there are unit vectors without signal: a product above this links


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_records(table(spark, sf_dir, "mentions", "ex_id", "word", "wikiid", "nil", "batch"), "ex_id", "word", "wikiid", "nil", "batch")


def string_key_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clustering.string_clusters(_mentions(spark, sf_dir), "ex_id", "word")
    return c.groupBy("cluster").agg(F.count("*").alias("n"), F.min("ex_id").alias("first_id"))


def oversized_cluster_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by wikiid, those with over 25 distinct mentions split by key."""
    b = clustering.break_oversized(_mentions(spark, sf_dir).filter("wikiid is not null and word is not null"), "wikiid", "ex_id", "word")
    return b.groupBy("wikiid", "part").agg(F.count("*").alias("n"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))


def cosine_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _embeddings(spark, sf_dir)
    return clustering.semantic_subclusters(items, DIM, 1 - LINK).select("item", F.col("comp").alias("cluster"))


def centroid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-clusters per label merged where their means are close; the gate is scaled to unit vectors."""
    items = cut(_embeddings(spark, sf_dir))
    comps = clustering.semantic_subclusters(items, DIM, 1 - LINK)
    return clustering.centroid_merge(items.join(comps, "item"), DIM, max_distance=0.8, gate=0.5)


def greedy_nn_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cut(_embeddings(spark, sf_dir))
    return clustering.greedy_clusters(items, blocks.group_pairs(items, DIM, LINK))


def feature_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = distinct_records(table(spark, sf_dir, "cluster_items", "item_id", "request_id", "mentions"), "item_id", "request_id", "mentions")
    p = clustering.feature_similarities(t.select(F.col("request_id").alias("grp"), F.col("mentions").alias("text")), 0.9)
    return p.select("grp", "text_a", "text_b", F.round("score", 6).alias("score"))


def cluster_title_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.mode_titles(_mentions(spark, sf_dir).filter("wikiid is not null"), "wikiid", "word")


def cluster_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.medoids(_embeddings(spark, sf_dir), DIM).select(F.col("grp").alias("label"), "medoid", F.round("distance_sum", 4).alias("distance_sum"))


def cluster_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise mean and median of each label, exploded."""
    items = cut(_embeddings(spark, sf_dir))
    means = to_arrays(clustering.mean_vectors(items, DIM, "grp").select("grp", "vector"), "vector", DIM)
    mean = means.select("grp", F.posexplode("vector").alias("i", "mean"))
    median = clustering.median_vectors(items, "grp").select("grp", F.posexplode("median").alias("i", "median"))
    return mean.join(median, ["grp", "i"]).select(F.col("grp").alias("label"), "i", F.round(F.col("mean").cast("double"), 5).alias("mean"), F.round("median", 6).alias("median"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold is the wikiid, predicted the string key."""
    m = _mentions(spark, sf_dir)
    return m.select(F.col("ex_id").alias("item"), F.col("wikiid").alias("true_id"), mention_key("word").alias("pred_id"))


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contingency(_clustered(spark, sf_dir))


def bcubed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bcubed(metrics.contingency(_clustered(spark, sf_dir))).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def muc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.muc(cut(metrics.contingency(_clustered(spark, sf_dir)))).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def ceaf_phi4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.phi4(metrics.contingency(_clustered(spark, sf_dir))).select("t", "p", F.round("phi", 9).alias("phi"))


def clustering_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clustering measures, entity CEAF included."""
    return metrics.clustering_report(_clustered(spark, sf_dir))


def cluster_gold_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.gold_modes(_clustered(spark, sf_dir).filter("pred_id is not null"), "pred_id", "true_id")


def low_frequency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).select("ex_id", F.col("wikiid").cast("string").alias("entity"))
    return clustering.rare_filter(m, "entity", 3)


def nil_prior_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dataset.nil_prior(dataset.entity_frequency(_mentions(spark, sf_dir)))
    return p.select("wikiid", "freq", F.round("p_formula", 9).alias("p_formula"), F.round("p_uniform", 9).alias("p_uniform"), "nil")


def transplant_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of (wikiid, word) of NIL mentions until 500 are reached."""
    m = _mentions(spark, sf_dir).filter("nil and word is not null and wikiid is not null")
    return dataset.transplant_sample(m, ["wikiid", "word"], 500)


def split_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, wikiid) keys shared by two batches of the corpus, odd and even."""
    m = _mentions(spark, sf_dir).filter("batch is not null")
    return dataset.shared_keys(m.filter("batch % 2 = 0"), m.filter("batch % 2 = 1"), ["word", "wikiid"])


def stratified_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).select("ex_id", F.coalesce(F.col("nil").cast("string"), F.lit("none")).alias("stratum"))
    return dataset.stratified_batches(m, "stratum", "ex_id", 10)


def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.batch_statistics(_mentions(spark, sf_dir))


def nil_seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.nil_seen_before(_mentions(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", *columns)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = kb_etl.wiki_links(_documents(spark, sf_dir), "doc_id", "text")
    return links.select("doc_id", F.col("pos").cast("long").alias("pos"), "target")


def incoming_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "entities", "id", "indexer", "title").filter("indexer = 10").select(F.col("id").cast("long").alias("id"), "title").distinct()
    return kb_etl.incoming_links(kb_etl.wiki_links(_documents(spark, sf_dir), "doc_id", "text"), titles)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", kb_etl.token_count("text").cast("long").alias("num_tokens"))


def intro_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and first of the sentences of each document's intro."""
    d = _documents(spark, sf_dir, "title").select("doc_id", kb_etl.intro_sentences("text", "title").alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("sent_desc_1"))


def disambiguation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb_etl.indexable(_documents(spark, sf_dir, "title"), 50).select("doc_id")


def title_then_id_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir, "title", "wikiid").select(F.col("doc_id").alias("page"), "title", F.col("wikiid").alias("wikipedia_id"))
    m = table(spark, sf_dir, "entities", "title", "wikipedia_id", "wikidata_qid").filter("wikidata_qid is not null")
    return kb_etl.link_by_title_then_id(d, m.select("title", F.col("wikipedia_id").cast("long").alias("wikipedia_id"), F.col("wikidata_qid").alias("wikidata_id")))


QUERIES = {
    f.__name__: f
    for f in (
        string_key_clusters, oversized_cluster_break, cosine_components, centroid_merge, greedy_nn_clusters, feature_similarity_pairs, cluster_title_mode,
        cluster_medoid, cluster_centroid, contingency, bcubed, muc, ceaf_phi4, clustering_report, cluster_gold_modes, low_frequency_filter, nil_prior_draw,
        transplant_sample, split_disjointness, stratified_batches, batch_statistics, nil_seen_before, page_links, incoming_links, token_counts,
        intro_sentences, disambiguation_filter, title_then_id_link,
    )
}

_M = """m AS (SELECT ex_id, any_value(word) AS word, any_value(wikiid) AS wikiid, any_value(nil) AS nil, any_value(batch) AS batch FROM mentions WHERE ex_id IS NOT NULL GROUP BY 1)"""
_KEY = "CASE WHEN length(word) < 4 THEN 's:' || word WHEN word IS NOT NULL THEN 'l:' || lower(word) END"
_CELLS = f"""{_M}, k AS (SELECT wikiid AS t, {_KEY} AS p FROM m WHERE wikiid IS NOT NULL AND word IS NOT NULL),
    g AS (SELECT t, p, count(*) AS n FROM k GROUP BY 1, 2), c AS (SELECT t, p, n, sum(n) OVER (PARTITION BY t)::BIGINT AS nt, sum(n) OVER (PARTITION BY p)::BIGINT AS np FROM g)"""
_HASH = "('0x' || substr(md5('1234|' || {0}), 1, 8))::BIGINT / 4294967296.0"
_PAIRS = """v AS (SELECT vec_id AS item, label AS grp, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT a.item AS a, b.item AS b, a.grp FROM v a JOIN v b ON a.grp = b.grp AND a.item < b.item WHERE list_inner_product(a.e, b.e) > 0.3),
    l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)"""
_COMPS = f"""{_PAIRS}, reach AS (SELECT item AS a, item AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b), comp AS (SELECT a AS item, min(b) AS cluster FROM reach GROUP BY 1)"""
_WORDS = "list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"
_LINES = "list_filter(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ') <> '')"
_LINKS = "k AS (SELECT doc_id, regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|([^\\]]*))?\\]\\]', 1) AS x FROM documents WHERE text IS NOT NULL)"

ORACLE = {
    "string_key_clusters": f"WITH {_M} SELECT {_KEY} AS cluster, count(*) AS n, min(ex_id) AS first_id FROM m GROUP BY 1",
    "oversized_cluster_break": f"""WITH {_M}, w AS (SELECT wikiid FROM m WHERE word IS NOT NULL AND wikiid IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(word)) > 25)
        SELECT wikiid, CASE WHEN wikiid IN (SELECT wikiid FROM w) THEN {_KEY} END AS part, count(*) AS n FROM m WHERE word IS NOT NULL AND wikiid IS NOT NULL GROUP BY 1, 2""",
    "cosine_components": f"WITH RECURSIVE {_COMPS} SELECT item, cluster FROM comp",
    "centroid_merge": f"""WITH RECURSIVE {_COMPS}, u AS (SELECT c.cluster AS item, any_value(v.grp) AS grp, max(list_inner_product(e, e)) AS sq FROM comp c JOIN v ON v.item = c.item GROUP BY 1),
        x AS (SELECT c.cluster AS item, i, avg(e[i]::DOUBLE) AS y FROM comp c JOIN v ON v.item = c.item, range(1, 65) r(i) GROUP BY 1, 2), m AS (SELECT item, list(y ORDER BY i) AS e FROM x GROUP BY 1),
        p2 AS (SELECT a.item AS a, b.item AS b FROM u a JOIN u b ON a.grp = b.grp AND a.item <> b.item JOIN m ma ON ma.item = a.item JOIN m mb ON mb.item = b.item WHERE list_cosine_similarity(ma.e, mb.e) > 1 - 0.8),
        r2 AS (SELECT item AS a, item AS b FROM u UNION SELECT r2.a, p2.b FROM r2 JOIN p2 ON p2.a = r2.b), top AS (SELECT a AS item, min(b) AS t FROM r2 GROUP BY 1)
        SELECT c.item, CASE WHEN u.sq > 0.5 THEN top.t ELSE c.cluster END AS cluster FROM comp c JOIN top ON top.item = c.cluster JOIN u ON u.item = top.t""",
    "greedy_nn_clusters": f"""WITH RECURSIVE {_PAIRS}, x AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM v), n AS (SELECT count(*) AS n FROM x),
        adj AS (SELECT xa.i, list(xb.i) AS nb FROM l JOIN x xa ON xa.item = l.a JOIN x xb ON xb.item = l.b GROUP BY 1),
        t AS (SELECT 0 AS k, range(n) AS labels FROM n UNION ALL
            SELECT t.k + 1, list_transform(range(n.n), lambda j: CASE WHEN list_contains(coalesce(adj.nb, []), j) THEN t.labels[t.k + 1] ELSE t.labels[j + 1] END)
            FROM t JOIN n ON t.k < n.n LEFT JOIN adj ON adj.i = t.k),
        z AS (SELECT labels FROM t JOIN n ON t.k = n.n) SELECT x.item, y.item AS cluster FROM x, z JOIN x y ON y.i = z.labels[x.i + 1]""",
    "feature_similarity_pairs": f"""WITH d AS (SELECT item_id, any_value(request_id) AS grp, any_value(mentions) AS text FROM cluster_items GROUP BY 1),
        t AS (SELECT grp, text, count(*) AS copies FROM d WHERE text IS NOT NULL AND grp IS NOT NULL GROUP BY 1, 2),
        b AS (SELECT grp, text, unnest(list_transform(range(1, length(text)), lambda i: substr(lower(text), i, 2))) AS term FROM t),
        w AS (SELECT grp, text, unnest({_WORDS.format('text')}) AS term FROM t),
        bt AS (SELECT grp, text, term, count(*)::DOUBLE AS w FROM b GROUP BY ALL), n AS (SELECT grp, sum(copies) AS n FROM t GROUP BY 1),
        wt AS (SELECT grp, text, term, count(*)::DOUBLE AS tf FROM w GROUP BY ALL), df AS (SELECT grp, term, sum(copies) AS df FROM wt JOIN t USING (grp, text) GROUP BY 1, 2),
        wi AS (SELECT grp, text, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM wt JOIN df USING (grp, term) JOIN n USING (grp)),
        z AS (SELECT grp, text, 'c' || term AS term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, text)) AS w, 0.8 AS s FROM bt
              UNION ALL SELECT grp, text, 'w' || term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, text)), 0.2 FROM wi)
        SELECT x.grp, x.text AS text_a, y.text AS text_b, round(sum(x.s * x.w * y.w), 6) AS score FROM z x JOIN z y ON x.grp = y.grp AND x.term = y.term AND x.text < y.text GROUP BY 1, 2, 3 HAVING sum(x.s * x.w * y.w) > 0.9""",
    "cluster_title_mode": f"""WITH {_M}, c AS (SELECT wikiid, word, count(*) AS n FROM m WHERE wikiid IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY wikiid ORDER BY word IS NULL, n DESC, word) AS k FROM c)
        SELECT wikiid, max(word) FILTER (k = 1) AS title, sum(n)::BIGINT AS n_elements FROM r GROUP BY 1""",
    "cluster_medoid": """WITH v AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT a.label, a.vec_id, round(sum(list_distance(a.e, b.e)), 6) AS d FROM v a JOIN v b ON a.label = b.label GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k FROM s) SELECT label, vec_id AS medoid, round(d, 4) AS distance_sum FROM r WHERE k = 1""",
    "cluster_centroid": """SELECT label::BIGINT AS label, (i - 1)::INT AS i, round(avg(embedding[i]::DOUBLE)::FLOAT::DOUBLE, 5) AS mean, round(median(embedding[i]::DOUBLE), 6) AS median
        FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2""",
    "contingency": f"WITH {_CELLS} SELECT t, p, n, nt, np FROM c",
    "bcubed": f"""WITH {_CELLS}, s AS (SELECT sum(n * n / np::DOUBLE) / sum(n) AS p, sum(n * n / nt::DOUBLE) / sum(n) AS r FROM c)
        SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM s""",
    "muc": f"""WITH {_CELLS}, a AS (SELECT max(np) AS s, count(*) AS k FROM c GROUP BY p), b AS (SELECT max(nt) AS s, count(*) AS k FROM c GROUP BY t),
        s AS (SELECT (SELECT sum(s - k) / (sum(s - 1) + 1e-13) FROM a) AS p, (SELECT sum(s - k) / (sum(s - 1) + 1e-13) FROM b) AS r)
        SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r + 1e-13), 9) AS f1 FROM s""",
    "ceaf_phi4": f"WITH {_CELLS} SELECT t, p, round(2.0 * n / (nt + np), 9) AS phi FROM c",
    "cluster_gold_modes": f"""WITH {_M}, c AS (SELECT {_KEY} AS pred_id, wikiid, count(*) AS n FROM m WHERE word IS NOT NULL AND wikiid IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, rank() OVER (PARTITION BY pred_id ORDER BY n DESC) AS k FROM c), z AS (SELECT pred_id, list(wikiid ORDER BY wikiid) AS modes FROM r WHERE k = 1 GROUP BY 1)
        SELECT pred_id, CASE WHEN len(modes) = 1 THEN modes[1] END AS mode, modes FROM z""",
    "low_frequency_filter": f"WITH {_M} SELECT ex_id, wikiid::VARCHAR AS entity FROM m WHERE wikiid IN (SELECT wikiid FROM m GROUP BY 1 HAVING count(*) >= 3)",
    "nil_prior_draw": f"""WITH {_M}, f AS (SELECT wikiid, count(*) AS freq FROM m WHERE wikiid IS NOT NULL GROUP BY 1), q AS (SELECT median(freq) AS md FROM f),
        x AS (SELECT wikiid, freq, pow(0.1, freq / md) AS pf, {_HASH.format('wikiid')} AS pu FROM f, q)
        SELECT wikiid, freq, round(pf, 9) AS p_formula, round(pu, 9) AS p_uniform, pu < pf AS nil FROM x""",
    "transplant_sample": f"""WITH {_M}, c AS (SELECT wikiid, word, count(*) AS n, {_HASH.format("wikiid || '|' || word")} AS u FROM m WHERE nil AND word IS NOT NULL AND wikiid IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT wikiid, word, n, coalesce(sum(n) OVER (ORDER BY u, wikiid, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c) SELECT * FROM r WHERE before < 500""",
    "split_disjointness": f"""WITH {_M} SELECT word, wikiid FROM m WHERE batch % 2 = 0 INTERSECT SELECT word, wikiid FROM m WHERE batch % 2 = 1""",
    "stratified_batches": f"""WITH {_M}, x AS (SELECT ex_id, coalesce(nil::VARCHAR, 'none') AS stratum FROM m)
        SELECT ex_id, stratum, ((row_number() OVER (ORDER BY stratum, {_HASH.format('ex_id')}, ex_id) - 1) % 10)::INT AS batch FROM x""",
    "batch_statistics": f"""WITH {_M} SELECT batch, count(*) AS n_mentions, count(*) FILTER (nil) AS n_nil, count(*) FILTER (NOT nil) AS n_known, count(DISTINCT wikiid) AS n_entities,
        count(DISTINCT wikiid) FILTER (nil) AS n_nil_entities, count(DISTINCT wikiid) FILTER (NOT nil) AS n_known_entities FROM m GROUP BY 1""",
    "nil_seen_before": f"""WITH {_M}, c AS (SELECT batch, wikiid, count(*) AS n FROM m WHERE nil AND wikiid IS NOT NULL AND batch IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT *, min(batch) OVER (PARTITION BY wikiid) < batch AS seen FROM c) SELECT batch, count(*) FILTER (seen) AS n_seen, coalesce(sum(n) FILTER (seen), 0)::BIGINT AS n_mentions FROM s GROUP BY 1""",
    "page_links": f"WITH {_LINKS} SELECT doc_id, unnest(range(len(x))) AS pos, trim(unnest(x)) AS target FROM k",
    "incoming_links": f"""WITH {_LINKS}, l AS (SELECT replace(trim(unnest(x)), '_', ' ') AS target FROM k), c AS (SELECT target, count(*) AS n FROM l GROUP BY 1),
        e AS (SELECT DISTINCT id::BIGINT AS id, title FROM entities WHERE indexer = 10), h AS (SELECT title, min(id) AS id FROM e GROUP BY 1),
        d AS (SELECT c.*, h.id FROM c LEFT JOIN h ON h.title = c.target), s AS (SELECT d.n, h.id FROM d JOIN h ON h.title = upper(substr(target, 1, 1)) || lower(substr(target, 2)) WHERE d.id IS NULL),
        t AS (SELECT id, sum(n)::BIGINT AS n FROM (SELECT id, n FROM d WHERE id IS NOT NULL UNION ALL SELECT id, n FROM s) GROUP BY 1)
        SELECT i.id, coalesce(t.n, 0) AS n_links FROM (SELECT DISTINCT id FROM e) i LEFT JOIN t ON t.id = i.id""",
    "token_counts": f"SELECT doc_id, CASE WHEN len({_LINES}) > 0 THEN len(string_split(array_to_string({_LINES}, ' '), ' ')) ELSE 0 END AS num_tokens FROM documents",
    "disambiguation_filter": f"""WITH d AS (SELECT doc_id, title, CASE WHEN len({_LINES}) > 0 THEN len(string_split(array_to_string({_LINES}, ' '), ' ')) ELSE 0 END AS n, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
        f AS (SELECT *, coalesce(nullif(regexp_extract(t, '^(.*?[.!?…])[''"”’»)\\]]*\\s+[\\p{{Lu}}\\p{{N}}"“«–—]', 1), ''), t) AS first FROM d)
        SELECT doc_id FROM f WHERE n >= 50 AND NOT contains(lower(coalesce(title, '')), '(disambiguation)') AND NOT regexp_matches(lower(first), '\\bmay (also )?refer to\\b')""",
    "intro_sentences": f"""WITH d AS (SELECT doc_id, trim(coalesce(title, ''), ' ') AS title, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM documents),
        i AS (SELECT doc_id, title, x, list_position(list_transform(x, lambda l: starts_with(l, 'Section::::') OR starts_with(l, '</doc>')), TRUE) AS stop FROM d),
        b AS (SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(CASE WHEN coalesce(stop, 0) > 0 THEN x[1:stop - 1] ELSE x END, lambda l: trim(l, ' ') <> title AND NOT starts_with(l, 'Section::::')), ' '), '\\s+', ' ', 'g')) AS t FROM i),
        s AS (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE string_split(regexp_replace(t, '([.!?…])[''"”’»)\\]]*\\s+([\\p{{Lu}}\\p{{N}}"“«–—])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344)) END AS s FROM b)
        SELECT doc_id, len(s[1:10]) AS n, s[1] AS sent_desc_1 FROM s""",
    "title_then_id_link": """WITH m AS (SELECT title, wikipedia_id, wikidata_qid AS q FROM entities WHERE wikidata_qid IS NOT NULL),
        a AS (SELECT title, min(q) AS q FROM m WHERE title IS NOT NULL GROUP BY 1), b AS (SELECT wikipedia_id, min(q) AS q FROM m WHERE wikipedia_id IS NOT NULL GROUP BY 1)
        SELECT doc_id AS page, d.title, d.wikiid AS wikipedia_id, coalesce(a.q, b.q) AS wikidata_id FROM documents d LEFT JOIN a ON a.title = d.title LEFT JOIN b ON b.wikipedia_id = d.wikiid""",
}
