"""Queries of text functions, mention enrichment, dictionary and coreference steps, and model hooks."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import encoders, text, vectors
from moraine.operators import clustering, dataset, kb_etl, legacy
from moraine.operators.ranking import hash_uniform
from moraine.operators.skew import distinct_records
from moraine.plans import linking
from moraine.plans.sql import FLOATS, MENTIONS, WORDS
from moraine.session import cut, table
from moraine.streaming.linking import link_text

NAMES = ("left_context_text", "word", "right_context_text", "wikiid", "y_title", "nil", "batch")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_records(table(spark, sf_dir, "mentions", "ex_id", *NAMES), "ex_id", *NAMES)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", "title")


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded vectors decoded, encoded again, and their first numbers, norm and augmented length."""
    s = table(spark, sf_dir, "search_requests", "query_id", "encodings").filter("query_id is not null").groupBy("query_id").agg(F.max("encodings").alias("x"))
    held = vectors.clean_vectors(s.select("query_id", vectors.from_base64(F.col("x")).alias("vector")), "vector", 128)
    wide = vectors.to_arrays(held, "vector", 128)
    longer = F.size(vectors.augment("vector", 1000.0))
    spare = F.element_at(vectors.augment("vector", 1000.0), -1)
    return wide.select("query_id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"), F.round(vectors.norm("vector"), 6).alias("norm"), longer.alias("n"), F.round(spare, 6).alias("spare"))


def string_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nil_features", "mention", "title").distinct()
    return n.select("mention", "title", F.round(text.set_jaccard_distance("mention", "title"), 6).alias("jaccard"), F.round(text.jaccard_levenshtein_distance("mention", "title"), 6).alias("mixed"))


def search_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents and mentions as search-engine queries, with an operator word and an escaped sign put in."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat_ws(" ", F.lit("OR OR-2 AND\\+x"), F.regexp_replace("text", r"\s+", " "), F.lit("AND")).alias("t"))
    return d.select("id", text.search_escape("t").alias("query"))


def mention_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token windows of 16 around mentions, of unequal sides."""
    m = _mentions(spark, sf_dir)
    own = F.concat(F.array(F.lit("[S]")), text.words("word"), F.array(F.lit("[E]")))
    w = text.mention_window(text.words("left_context_text"), own, text.words("right_context_text"), 16)
    return m.filter(F.size(own) <= 12).select("ex_id", F.array_join(w, " ").alias("window"), F.size(w).alias("n"))


def pair_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate tokens, the pair of mention and candidate, and the lengths left of a pair cut to twelve tokens."""
    e = table(spark, sf_dir, "entities", "id", "indexer", "title", "descr").distinct().filter("indexer = 10")
    t, d = text.words("title"), text.words("descr")
    c = text.candidate_tokens(t, d, 12)
    left = text.truncated_lengths(t, d, 6)
    return e.select("id", F.array_join(c, " ").alias("candidate"), F.array_join(text.pair_tokens(F.concat(F.array(F.lit("[CLS]")), t), c, 10), " ").alias("pair"), left["a"].alias("a"), left["b"].alias("b"))


def context_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts cut to words, and sentences chosen around a mention."""
    m = _mentions(spark, sf_dir)
    before, own, after = F.coalesce(F.trim("left_context_text"), F.lit("")), F.coalesce(F.trim("word"), F.lit("")), F.coalesce(F.trim("right_context_text"), F.lit(""))
    return m.select(
        "ex_id", text.last_words("left_context_text", 10).alias("left_10"), text.first_words("right_context_text", 25).alias("right_25"),
        F.md5(text.sentence_context(before, own, after, "prev_next").cast("binary")).alias("both"), F.md5(text.sentence_context(before, own, after, "next").cast("binary")).alias("following"),
    )


def masked_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of the candidates of each query by their first score, those without a title masked out, and the best place."""
    n = distinct_records(table(spark, sf_dir, "nil_features", "feature_id", "query_id", "max_bi", "jaccard"), "feature_id", "query_id", "max_bi", "jaccard").filter("max_bi is not null and query_id is not null")
    a = n.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", (F.col("max_bi") / 10).alias("s"), F.coalesce((F.col("jaccard") > 0).cast("int"), F.lit(0)).alias("m")))).alias("l"))
    s, m = F.transform("l", lambda x: x["s"]), F.transform("l", lambda x: x["m"])
    p = text.softmax(s, m)
    return a.select("query_id", F.round(F.array_max(p), 6).alias("top"), text.argmax(s).cast("long").alias("best"), F.size("l").alias("n"))


def alias_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities", "id", "indexer", "title").distinct().filter("indexer = 10")
    return e.select("id", text.quoted_aliases(F.array(F.col("title"), F.lit("!?"), F.upper("title"))).alias("aliases"), text.page_url(F.col("id") - 1500).alias("url"))


def enriched_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a batch as a document: sentence before and after, short contexts, escaped mention."""
    m = _mentions(spark, sf_dir).filter("batch is not null")
    rows = m.select(F.col("batch").alias("doc"), F.col("ex_id").alias("pos"), F.col("word").alias("mention"), F.col("left_context_text").alias("context_left"), F.col("right_context_text").alias("context_right"), F.col("wikiid").alias("gold"))
    sentences = rows.select("doc", "pos", F.coalesce("mention", F.lit("")).alias("text"))
    got = legacy.enrich_mentions(rows, sentences)
    return got.select(F.col("pos").alias("ex_id"), "query_mention", "previous", "current", "next", "left_10", "right_10")


def sentence_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each sentence of a batch, a sentence holding those of ten neighbouring ids."""
    m = _mentions(spark, sf_dir).filter("batch is not null")
    rows = m.select(F.col("batch").alias("doc"), F.floor(F.col("ex_id") / 10).alias("pos"), F.col("ex_id").alias("start"), F.coalesce("word", F.lit("")).alias("mention"))
    sentences = m.select(F.col("batch").alias("doc"), F.floor(F.col("ex_id") / 10).alias("pos")).unionByName(m.select(F.col("batch").alias("doc"), F.lit(-1).cast("long").alias("pos"))).distinct()
    return legacy.mention_sentences(rows, sentences).select("doc", "pos", F.array_join("mentions", "|").alias("mentions"))


def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local ids of golds, -1 where the index holds none, and the place of the gold among the candidates."""
    local = table(spark, sf_dir, "entities", "id", "indexer", "wikipedia_id").filter("indexer = 10").select(F.col("wikipedia_id").cast("long").alias("wikipedia_id"), F.col("id").alias("local_id"))
    ranked = linking.retrieval.merge_lists(linking._candidates(spark, sf_dir))
    lists = ranked.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("nns"))
    rows = lists.join(linking._gold(spark, sf_dir).filter("gold is not null"), "query").select("query", "gold", "nns")
    return legacy.gold_among_candidates(legacy.map_labels(rows, local, consider_all=True), keep_all=True).select("query", "label_id", "label")


def correct_candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = linking.retrieval.merge_lists(linking._candidates(spark, sf_dir))
    gold = linking._ranked_gold(spark, sf_dir)
    lists = linking.retrieval.candidate_arrays(ranked).join(gold, "query")
    return legacy.correct_candidates(lists).select("query", F.transform("candidates", lambda c: c["wikipedia_id"]).alias("ids"))


def coreference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a batch as a document; candidates are their golds, persons the golds with even numbers."""
    m = cut(_mentions(spark, sf_dir).filter("batch is not null and word is not null"))
    rows = m.select(F.col("batch").alias("doc"), F.col("ex_id").alias("item"), F.col("word").alias("mention"))
    known = m.filter("wikiid is not null and wikiid <> -1")
    found = known.select(F.col("ex_id").alias("item"), F.col("wikiid").alias("entity"), F.lit(1.0).alias("p"))
    persons = known.filter("wikiid % 2 = 0").select(F.col("wikiid").alias("entity"))
    return legacy.coreference(rows, found, persons).select("item", "entity", F.round("p", 6).alias("p"))


def seen_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of odd batches by whether an even batch holds their entity."""
    m = _mentions(spark, sf_dir).filter("batch is not null").select("ex_id", "wikiid", "batch")
    seen, rest = legacy.seen_split(m.filter("batch % 2 = 1"), "wikiid", m.filter("batch % 2 = 0").filter("wikiid is not null"))
    return seen.select("ex_id", F.lit(True).alias("seen")).unionByName(rest.select("ex_id", F.lit(False).alias("seen")))


def word_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context vectors of the sixth word of each document, with word lengths and first letters as vectors."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(text.words("text")).alias("at", "word"))
    d = cut(d)
    v = d.select("word").distinct().filter("length(word) > 3").select("word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double")).alias("vector"))
    items = d.filter("at = 5").select(F.col("doc").alias("item"), "doc", "at")
    got = legacy.word_context_vectors(items, d, v, 10, 50, 0.6)
    return got.select("item", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


def _two_names(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[A-Z][a-z]+ [A-Z][a-z]+", t)]


def annotated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two capitalised words as mentions: a tagger given as a function."""
    got = encoders.annotate(_documents(spark, sf_dir), "doc_id", "text", _two_names)
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start_pos").cast("long").alias("first"), F.max("end_pos").cast("long").alias("last"), F.min("mention").alias("least"))


def reranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates sorted again by a cross model that scores a title by its length."""
    ranked = linking.retrieval.merge_lists(linking._candidates(spark, sf_dir)).withColumn("context", F.lit("x"))
    got = encoders.rerank(ranked, lambda: lambda contexts, titles: np.array([float(len(t)) for t in titles]), "context", "title")
    return got.filter("cross_rank <= 3").select("query", "id", "indexer", "cross_rank", "cross_score")


def encoded_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions encoded once per distinct pair; their vectors have length 1, or 0 without text."""
    e = table(spark, sf_dir, "entities", "id", "indexer", "title", "descr").distinct().select("id", "indexer", F.concat_ws(" ", "title", "descr").alias("t"))
    got = encoders.encode_mentions(e, lambda: encoders.hashing_encoder(32), "t")
    return got.select("id", "indexer", F.size("vector").alias("n"), F.round(vectors.norm("vector"), 4).alias("norm"))


def linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the documents linked to entity titles by a hashing encoder: all that the tagger finds, with three candidates each."""
    e = table(spark, sf_dir, "entities", "id", "indexer", "wikipedia_id", "title", "type_").distinct().filter("indexer = 10")
    coded = encoders.encode_mentions(e.select("id", "indexer", "title"), lambda: encoders.hashing_encoder(64), "title").select(F.col("id").cast("long").alias("id"), "indexer", "vector")
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("key"), "text")
    got = link_text(d, coded, e, lambda: encoders.hashing_encoder(64), 64, 3, (("best", 10.0),), -8.0, tagger=_two_names)
    return got.groupBy("key").agg(F.count("*").alias("n"), F.min(F.size("candidates")).alias("least"))


def nil_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset chain: prior, NIL draw, transplants from known to NIL mentions, distinct pairs, stratified batches."""
    m = _mentions(spark, sf_dir).filter("wikiid is not null and word is not null").select("ex_id", "word", "wikiid")
    got = dataset.build_dataset(m, "ex_id", n_batches=10, move=100)
    return got.select("ex_id", "word", "wikiid", "nil", "batch")


def propagated_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NIL draw carried to all mentions: defaults for unknown entities, frequency 0 where NIL."""
    m = _mentions(spark, sf_dir).select("ex_id", "wikiid", F.lit(0).alias("freq"), F.lit(0.0).alias("p_formula"), F.lit(0.0).alias("p_uniform"), "nil")
    got = dataset.propagate_prior(m, dataset.nil_prior(dataset.entity_frequency(m)), "wikiid")
    return got.select("ex_id", "nil", "freq", F.round("p_formula", 9).alias("p_formula"), F.round("p_uniform", 9).alias("p_uniform"))


def head_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three mentions of each NIL state of a batch."""
    m = _mentions(spark, sf_dir).filter("batch is not null").withColumn("class", F.concat_ws("-", F.col("batch").cast("string"), F.coalesce(F.col("nil").cast("string"), F.lit("none"))))
    return dataset.head_per_class(m, "class", 3, "ex_id").select("ex_id", "class")


def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in steps of 64, in the order of their ids and in a seeded shuffle."""
    d = table(spark, sf_dir, "documents", "doc_id")
    return clustering.batches_of(d, "doc_id", 64).join(clustering.batches_of(d, "doc_id", 64, seed=7).select("doc_id", F.col("batch").alias("shuffled")), "doc_id").select("doc_id", "batch", "shuffled")


def intro_sentences_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of descriptions that end in a full stop before a capital letter, as numbered columns."""
    e = table(spark, sf_dir, "entities", "id", "indexer", "title", "descr").distinct().filter("indexer = 10 and descr is not null")
    s = e.select("id", kb_etl.intro_sentences(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("descr"), F.lit("\nSection::::x\nLater.")), "title").alias("s"))
    return kb_etl.sentence_columns(s, "s", 3).select("id", F.size("s").alias("n"), "sent_desc_1")


QUERIES = {
    f.__name__: f
    for f in (
        vector_codes, string_distances, search_escape, mention_windows, pair_inputs, context_choices, masked_softmax, alias_texts, enriched_mentions, sentence_mentions, label_mapping,
        correct_candidate_lists, coreference, seen_split, word_contexts, annotated_texts, reranked_candidates, encoded_mentions, linked_texts, nil_dataset, propagated_prior, head_per_class,
        document_batches, intro_sentences_marked,
    )
}

_H = "('0x' || substr(md5('{1}|' || {0}), 1, 8))::BIGINT / 4294967296.0"
_CTX = "list_filter(string_split(regexp_replace(CASE WHEN {0} = 'EMPTYCTXT' THEN '' ELSE coalesce({0}, '') END, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')"
_LAST = "array_to_string(({w})[greatest(1, len({w}) - {n} + 1):], ' ')"
_E = "e AS (SELECT DISTINCT id, indexer, wikipedia_id, title, descr FROM entities WHERE indexer = 10)"

ORACLE = {
    "vector_codes": f"""WITH s AS (SELECT query_id, regexp_replace(max(encodings), '\\s+', '', 'g') AS x FROM search_requests WHERE query_id IS NOT NULL GROUP BY 1), v AS (SELECT query_id, {FLOATS.format('x')} AS e FROM s WHERE length(x) = 684)
        SELECT query_id, round(e[1], 6) AS first, round(sqrt(list_inner_product(e, e)), 6) AS norm, 129 AS n, round(sqrt(greatest(0, 1000.0 - list_inner_product(e, e))), 6) AS spare FROM v
        WHERE len(list_filter(e, lambda y: isnan(y) OR isinf(y) OR abs(y) > 3.5e38)) = 0 AND len(list_filter(e, lambda y: y <> 0)) > 0""",
    "string_distances": f"""WITH n AS (SELECT DISTINCT mention, title, {WORDS.format('mention')} AS a, {WORDS.format('title')} AS b FROM nil_features), j AS (SELECT *, len(list_distinct(list_concat(a, b))) AS u, len(list_intersect(a, b)) AS i,
        string_split(lower(coalesce(mention, '')), '') AS x, string_split(lower(coalesce(title, '')), '') AS y FROM n), c AS (SELECT *, list_distinct(list_concat(x, y)) AS cu, length(coalesce(mention, '')) AS nx, length(coalesce(title, '')) AS ny FROM j),
        d AS (SELECT *, CASE WHEN u = 0 THEN 0.0 ELSE 1 - i / u::DOUBLE END AS jd, CASE WHEN nx = 0 THEN '' ELSE array_to_string(list_transform(x, lambda z: chr(list_position(cu, z)::INT + 32)), '') END AS cx,
            CASE WHEN ny = 0 THEN '' ELSE array_to_string(list_transform(y, lambda z: chr(list_position(cu, z)::INT + 32)), '') END AS cy FROM c)
        SELECT mention, title, round(jd, 6) AS jaccard, round((jd + CASE WHEN greatest(nx, ny) = 0 THEN 0.0 ELSE levenshtein(cx, cy) / greatest(nx, ny)::DOUBLE END) / 2, 6) AS mixed FROM d""",
    "search_escape": """WITH d AS (SELECT doc_id AS id, concat_ws(' ', 'OR OR-2 AND\\+x', regexp_replace(text, '\\s+', ' ', 'g'), 'AND') AS t FROM documents),
        w AS (SELECT id, array_to_string(list_transform(string_split(t, ' '), lambda x: CASE WHEN x IN ('OR', 'AND') THEN lower(x) ELSE x END), ' ') AS t FROM d)
        SELECT id, regexp_replace(regexp_replace(t, '([+\\-&|!(){}\\[\\]^"~*?:/])', '\\\\\\1', 'g'), '\\\\\\\\([+\\-&|!(){}\\[\\]^"~*?:/])', '\\\\\\1', 'g') AS query FROM w""",
    "mention_windows": f"""WITH {MENTIONS}, t AS (SELECT ex_id, {WORDS.format('l')} AS l, list_concat(['[S]'], {WORDS.format('word')}, ['[E]']) AS w, {WORDS.format('r')} AS r FROM m),
        q AS (SELECT *, greatest(0, (16 - len(w)) // 2 - 1) AS lq FROM t WHERE len(w) <= 12), k AS (SELECT *, greatest(0, 16 - len(w) - lq - 2) AS rq FROM q),
        z AS (SELECT *, CASE WHEN len(l) <= lq THEN len(l) WHEN len(r) <= rq THEN least(len(l), lq + rq - len(r)) ELSE lq END AS lt, CASE WHEN len(r) <= rq THEN len(r) WHEN len(l) <= lq THEN least(len(r), rq + lq - len(l)) ELSE rq END AS rt FROM k),
        o AS (SELECT ex_id, list_concat(['[CLS]'], CASE WHEN lt > 0 THEN l[len(l) - lt + 1:] ELSE [] END, w, CASE WHEN rt > 0 THEN r[1:rt] ELSE [] END, ['[SEP]']) AS a FROM z)
        SELECT ex_id, array_to_string(list_concat(a, list_transform(range(0, 16 - len(a)), lambda i: '')), ' ') AS window, 16 AS n FROM o""",
    "pair_inputs": f"""WITH {_E}, t AS (SELECT id, {WORDS.format('title')} AS t, {WORDS.format('descr')} AS d FROM e), c AS (SELECT *, list_concat(['[CLS]'], list_concat(t, ['[unused2]'], d)[1:10], ['[SEP]']) AS c0 FROM t),
        p AS (SELECT *, list_concat(c0, list_transform(range(0, 12 - len(c0)), lambda i: '')) AS c, len(t) AS la, len(d) AS lb FROM c),
        r AS (SELECT *, greatest(0, la + lb - 6) AS over FROM p), s AS (SELECT *, CASE WHEN la > lb THEN least(over, la - lb) ELSE 0 END AS fa, CASE WHEN lb > la THEN least(over, lb - la) ELSE 0 END AS fb FROM r)
        SELECT id, array_to_string(c, ' ') AS candidate, array_to_string(list_concat(['[CLS]'], t, c[2:])[1:10], ' ') AS pair, (la - fa - (over - fa - fb) // 2)::INT AS a, (lb - fb - (over - fa - fb + 1) // 2)::INT AS b FROM s""",
    "context_choices": f"""WITH {MENTIONS}, t AS (SELECT ex_id, {_CTX.format('l')} AS lw, {_CTX.format('r')} AS rw, coalesce(trim(l, ' '), '') AS b, coalesce(trim(word, ' '), '') AS o, coalesce(trim(r, ' '), '') AS a FROM m)
        SELECT ex_id, {_LAST.format(w='lw', n=10)} AS left_10, array_to_string(rw[1:25], ' ') AS right_25, md5(trim(b || ' ' || o || ' ' || a, ' ')) AS both, md5(trim(o || ' ' || a, ' ')) AS following FROM t""",
    "masked_softmax": """WITH n AS (SELECT feature_id, any_value(query_id) AS query_id, any_value(max_bi) / 10 AS s, coalesce(any_value(jaccard) > 0, FALSE) AS m FROM nil_features WHERE feature_id IS NOT NULL GROUP BY 1),
        k AS (SELECT *, CASE WHEN m THEN s ELSE -1000.0 END AS x FROM n WHERE s IS NOT NULL AND query_id IS NOT NULL), t AS (SELECT *, max(x) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY feature_id) - 1 AS pos FROM k)
        SELECT query_id, round(1 / sum(exp(x - top)), 6) AS top, arg_min(pos, (-s, pos)) AS best, count(*)::INT AS n FROM t GROUP BY 1""",
    "alias_texts": f"""WITH {_E} SELECT id, CASE WHEN title IS NULL THEN '' WHEN regexp_matches(title, '[\\p{{L}}\\p{{N}}]') THEN '"' || title || '" "' || upper(title) || '"' ELSE '' END AS aliases,
        CASE WHEN id > 1500 THEN 'https://en.wikipedia.org/wiki?curid=' || (id - 1500) ELSE '' END AS url FROM (SELECT DISTINCT id, title FROM e)""",
    "enriched_mentions": f"""WITH {MENTIONS}, t AS (SELECT *, coalesce(lag(coalesce(word, '')) OVER w, '') AS previous, coalesce(word, '') AS current, coalesce(lead(coalesce(word, '')) OVER w, '') AS next, {_CTX.format('l')} AS lw, {_CTX.format('r')} AS rw
            FROM m WHERE batch IS NOT NULL WINDOW w AS (PARTITION BY batch ORDER BY ex_id))
        SELECT ex_id, regexp_replace(word, '([+\\-&|!(){{}}\\[\\]^"~*?:/])', '\\\\\\1', 'g') AS query_mention, previous, current, next, {_LAST.format(w='lw', n=10)} AS left_10, array_to_string(rw[1:10], ' ') AS right_10 FROM t WHERE wikiid IS NOT NULL""",
    "sentence_mentions": f"""WITH {MENTIONS}, k AS (SELECT batch AS doc, ex_id // 10 AS pos, string_agg(coalesce(word, ''), '|' ORDER BY ex_id) AS mentions FROM m WHERE batch IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM k UNION ALL SELECT DISTINCT doc, -1, '' FROM k""",
    "label_mapping": f"""WITH {linking._CAND}, l AS (SELECT wikipedia_id, min(id) AS id FROM entities WHERE indexer = 10 GROUP BY 1), a AS (SELECT query, list(id ORDER BY rank) AS nns FROM r GROUP BY 1)
        SELECT a.query, coalesce(l.id, -1) AS label_id, greatest(0, coalesce(list_position(nns, coalesce(l.id, -1)), 0) - 1)::INT AS label FROM a JOIN g ON g.query = a.query LEFT JOIN l ON l.wikipedia_id = g.gold WHERE g.gold IS NOT NULL""",
    "correct_candidate_lists": f"""WITH {linking._CAND}, a AS (SELECT query, list(wikipedia_id ORDER BY rank) AS w, count(*) AS n FROM r GROUP BY 1), h AS (SELECT a.*, min(r.rank) AS k FROM a JOIN g ON g.query = a.query JOIN r ON r.query = a.query AND r.wikipedia_id = g.gold WHERE g.nil = FALSE GROUP BY ALL)
        SELECT query, list_concat(w[k:], list_transform(range(1, k), lambda i: w[n])) AS ids FROM h WHERE k < n""",
    "coreference": f"""WITH {MENTIONS}, t AS (SELECT ex_id AS item, batch AS doc, wikiid AS e, lower(word) AS x, ' ' || trim(regexp_replace(lower(word), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS y FROM m WHERE batch IS NOT NULL AND word IS NOT NULL),
        c AS (SELECT a.item, b.e FROM t a JOIN t b ON a.doc = b.doc AND length(b.x) > length(a.x) AND contains(b.y, a.y) WHERE b.e IS NOT NULL AND b.e <> -1 AND b.e % 2 = 0 AND trim(a.y) <> ''),
        n AS (SELECT item, count(*) AS n FROM c GROUP BY 1) SELECT c.item, c.e AS entity, round(count(*) / n.n::DOUBLE, 6) AS p FROM c JOIN n USING (item) GROUP BY c.item, c.e, n.n
        UNION ALL SELECT item, e, 1.0 FROM t WHERE e IS NOT NULL AND e <> -1 AND item NOT IN (SELECT item FROM n)""",
    "seen_split": f"WITH {MENTIONS} SELECT ex_id, coalesce(wikiid IN (SELECT wikiid FROM m WHERE batch % 2 = 0 AND wikiid IS NOT NULL), FALSE) AS seen FROM m WHERE batch % 2 = 1",
    "word_contexts": f"""WITH d AS (SELECT doc_id AS doc, {WORDS.format('text')} AS w FROM documents), p AS (SELECT doc, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d), v AS (SELECT *, length(word)::DOUBLE AS a, unicode(word)::DOUBLE AS b FROM p WHERE length(word) > 3),
        h AS (SELECT doc, avg(a) AS a, avg(b) AS b FROM v WHERE pos < 50 GROUP BY 1), i AS (SELECT doc FROM p WHERE pos = 5), n AS (SELECT doc, avg(a) AS a, avg(b) AS b FROM v WHERE pos <= 15 GROUP BY 1)
        SELECT i.doc AS item, [round(0.6 * coalesce(n.a, 0) + 0.4 * coalesce(h.a, 0), 5), round(0.6 * coalesce(n.b, 0) + 0.4 * coalesce(h.b, 0), 5)] AS vector FROM i JOIN h USING (doc) LEFT JOIN n ON n.doc = i.doc""",
    "annotated_texts": """WITH k AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+') AS f FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, len(f) AS n, length(regexp_extract(text, '(?s)^(.*?)[A-Z][a-z]+ [A-Z][a-z]+', 1)) AS first,
            length(text) - length(list_last(regexp_split_to_array(text, '[A-Z][a-z]+ [A-Z][a-z]+'))) AS last, list_min(list_transform(f, lambda x: lower(x))) AS least FROM k WHERE len(f) > 0""",
    "linked_texts": "SELECT doc_id AS key, len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) AS n, 3 AS least FROM documents WHERE len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) > 0",
    "reranked_candidates": f"""WITH {linking._CAND}, x AS (SELECT *, length(coalesce(title, ''))::DOUBLE AS cross_score, row_number() OVER (PARTITION BY query ORDER BY length(coalesce(title, '')) DESC, rank)::INT AS cross_rank FROM r)
        SELECT query, id, indexer, cross_rank, cross_score FROM x WHERE cross_rank <= 3""",
    "encoded_mentions": "SELECT id, indexer, 32 AS n, 1.0 AS norm FROM (SELECT DISTINCT id, indexer, title, descr FROM entities)",
    "nil_dataset": f"""WITH {MENTIONS}, k AS (SELECT ex_id, word, wikiid FROM m WHERE wikiid IS NOT NULL AND word IS NOT NULL), f AS (SELECT wikiid, count(*) AS freq FROM k GROUP BY 1), q AS (SELECT median(freq) AS md FROM f),
        d AS (SELECT wikiid, {_H.format('wikiid', 1234)} < pow(0.1, freq / md) AS nil, CASE WHEN {_H.format('wikiid', 1234)} < pow(0.1, freq / md) THEN 0 ELSE freq END AS freq FROM f, q),
        a AS (SELECT k.*, d.nil, d.freq, {_H.format('k.ex_id', 1234)} AS u FROM k JOIN d USING (wikiid)),
        c AS (SELECT wikiid, word, count(*) AS n, {_H.format("wikiid || '|' || word", 1234)} AS u FROM a WHERE nil GROUP BY 1, 2),
        t AS (SELECT wikiid, word, coalesce(sum(n) OVER (ORDER BY u, wikiid, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
        mv AS (SELECT wikiid, word FROM t WHERE before < 100), b AS (SELECT a.*, mv.word IS NOT NULL AS moved FROM a LEFT JOIN mv ON mv.word = a.word AND mv.wikiid = a.wikiid),
        o AS (SELECT *, row_number() OVER (PARTITION BY word, wikiid ORDER BY ex_id) AS k FROM b WHERE NOT moved),
        z AS (SELECT *, nil::INT || '-' || least(freq, 9) AS s FROM o WHERE k = 1)
        SELECT ex_id, word, wikiid, nil, ((row_number() OVER (ORDER BY s, u, ex_id) - 1) % 10)::INT AS batch FROM z UNION ALL SELECT ex_id, word, wikiid, nil, -1 FROM b WHERE moved""",
    "propagated_prior": f"""WITH {MENTIONS}, f AS (SELECT wikiid, count(*) AS freq FROM m WHERE wikiid IS NOT NULL GROUP BY 1), q AS (SELECT median(freq) AS md FROM f), x AS (SELECT wikiid, freq, pow(0.1, freq / md) AS pf, {_H.format('wikiid', 1234)} AS pu FROM f, q)
        SELECT ex_id, coalesce(pu < pf, FALSE) AS nil, CASE WHEN pu < pf THEN 0 ELSE coalesce(freq, 0) END AS freq, round(coalesce(pf, -1), 9) AS p_formula, round(coalesce(pu, -1), 9) AS p_uniform FROM m LEFT JOIN x USING (wikiid)""",
    "head_per_class": f"""WITH {MENTIONS}, k AS (SELECT ex_id, batch || '-' || coalesce(nil::VARCHAR, 'none') AS class FROM m WHERE batch IS NOT NULL)
        SELECT ex_id, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ex_id) AS p FROM k) WHERE p <= 3""",
    "document_batches": f"""SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::INT AS batch, ((row_number() OVER (ORDER BY {_H.format('doc_id', 7)}, doc_id) - 1) // 64)::INT AS shuffled FROM documents""",
    "intro_sentences_marked": f"""WITH {_E}, t AS (SELECT id, trim(regexp_replace(CASE WHEN trim(descr, ' ') = trim(coalesce(title, ''), ' ') THEN '' ELSE descr END, '\\s+', ' ', 'g')) AS d FROM e WHERE descr IS NOT NULL),
        b AS (SELECT id, CASE WHEN d = '' THEN [] ELSE string_split(regexp_replace(d, '([.!?…])[''"”’»)\\]]*\\s+([\\p{{Lu}}\\p{{N}}"“«–—])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) END AS s FROM t)
        SELECT id, len(s[1:10])::INT AS n, s[1] AS sent_desc_1 FROM b""",
}
