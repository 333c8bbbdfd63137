"""Queries that write the driver tables in the formats of the sources and read them back."""

from __future__ import annotations

import os
import sqlite3
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.vectors import clean_vectors, from_base64, to_base64
from moraine.operators import dataset, kb, kb_etl
from moraine.operators.skew import distinct_records
from moraine.plans import linking
from moraine.plans.sql import MENTIONS
from moraine.session import cut, scratch, table
from moraine.sources import files
from moraine.sources.sqlite import read_sqlite

DIM = 128


def _mentions(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return distinct_records(table(spark, sf_dir, "mentions", "ex_id", *names), "ex_id", *names)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities", *[f.split()[0] for f in kb.ENTITY_SCHEMA.split(", ")]).distinct()


def mention_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as gzip JSON lines, a folder per batch, read back as one under its schema with the names of the dataset."""
    where = scratch(spark)
    m = table(spark, sf_dir, "mentions", "ex_id", "left_context_text", "word", "right_context_text", "url", "wikiid", "y_title", "batch").withColumn("batch", F.coalesce("batch", F.lit(-1)))
    m = m.withColumnRenamed("wikiid", "wikiId")
    files.write_batches(m, where, gzip=True)
    back = files.rename_mentions(files.read_batches(spark, where, files.MENTION_SCHEMA)).drop("wikiurl")
    return back.select("query_id", "mention", "Wikipedia_ID", "Wikipedia_title", "label_id", F.length("context_left").alias("n_left"), F.length("context_right").alias("n_right"))


def catalogue_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read-only entities as a gzip catalogue in id order, loaded with line numbers as ids."""
    where = scratch(spark)
    e = _entities(spark, sf_dir).filter("indexer = 10").groupBy("id").agg(F.min(F.struct("wikipedia_id", "title", "descr")).alias("e"))
    line = F.to_json(F.struct(F.concat(F.lit("https://kb.example/wiki?curid="), F.col("e.wikipedia_id").cast("string")).alias("idx"), F.col("e.title").alias("title"), F.col("e.descr").alias("text")))
    e.coalesce(1).sortWithinPartitions("id").select(line.alias("value")).write.option("compression", "gzip").text(where)
    return kb.catalogue_entities(files.read_catalogue(spark, where)).select("id", "indexer", "wikipedia_id", "title", "descr")


def catalogue_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kb.assert_unique(_entities(spark, sf_dir), "id", "indexer").filter("indexer = 10")
    return kb.title_lookup(e).select("title", "id", "wikipedia_id")


def table_load_and_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities loaded by partition; the read-write partition is replaced by other rows and the read-only one stays."""
    where = scratch(spark)
    e = _entities(spark, sf_dir)
    kb.write_partition(e, where)
    kb.write_partition(e.filter("indexer = 20 and redirects_to is not null"), where, "overwrite")
    return spark.read.parquet(where).select("id", F.col("indexer").cast("int").alias("indexer"), "wikipedia_id", "title")


def index_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.reset(_entities(spark, sf_dir)).select("id", "indexer", "title")


def delete_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE texts for the entities of NIL mentions: number of ids and of texts, and that no text is too long."""
    gone = table(spark, sf_dir, "mentions", "wikiid", "nil").filter("nil").select(F.col("wikiid").alias("wikipedia_id"))
    s = cut(kb.delete_statement(gone).withColumn("n", F.size(F.split("statement", ","))))
    ok = F.col("statement").rlike(r"^DELETE FROM entities WHERE indexer=10 AND wikipedia_id IN \(-?\d+(,-?\d+)*\);$")
    return s.agg(F.sum("n").alias("n_ids"), F.min(ok.cast("int")).alias("well_formed"))


def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows dumped as {encoding, label, wikipedia_id, title} and read back, vectors decoded from base64."""
    where = scratch(spark)
    v = clean_vectors(table(spark, sf_dir, "kb_vectors", "id", "indexer", "encoding").filter("indexer = 10 and id is not null").withColumnRenamed("encoding", "vector"), "vector", DIM)
    v = v.groupBy("id").agg(F.min("vector").alias("vector"))
    e = _entities(spark, sf_dir).filter("indexer = 10").select(F.col("id").cast("long").alias("id"), "wikipedia_id", "title")
    files.write_encodings(v.join(e, "id"), where)
    back = spark.read.parquet(where)
    return back.select("label", "wikipedia_id", "title", (to_base64(from_base64(F.col("encoding"))) == F.col("encoding")).alias("same"), F.octet_length(from_base64(F.col("encoding"))).alias("bytes"))


def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates dumped as {labels, scores, nns} and read back."""
    where = scratch(spark)
    ranked = linking.retrieval.merge_lists(linking._candidates(spark, sf_dir))
    gold = linking._gold(spark, sf_dir).select("query", "gold").join(ranked.select("query").distinct(), "query")
    files.write_scores(ranked, gold, where)
    return spark.read.parquet(where).select("query", "kind", "labels", F.transform("scores", lambda s: F.round(s, 4)).alias("scores"), "nns")


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark)
    files.write_report(dataset.batch_statistics(_mentions(spark, sf_dir, "wikiid", "nil", "batch")), where)
    return spark.read.option("header", True).schema("batch int, n_mentions long, n_nil long, n_known long, n_entities long, n_nil_entities long, n_known_entities long").csv(where)


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per language: share of documents with a wikiid, appended in two calls and read back as numbered lines."""
    where = scratch(spark)
    d = table(spark, sf_dir, "documents", "lang", "wikiid").filter("lang is not null").groupBy(F.lower("lang").alias("lang")).agg(F.avg(F.col("wikiid").isNotNull().cast("double")).alias("r"))
    runs = cut(d.select(F.col("lang").alias("query"), F.lit("title").alias("keys"), F.lit("d1").alias("dump_id"), F.create_map(F.lit("overall"), "r", F.lit("again"), "r").alias("recalls")))
    files.append_run_results(runs.filter("query < 'f'"), where)
    files.append_run_results(runs.filter("query >= 'f'"), where)
    return spark.read.text(where).select(F.col("value").alias("line"))


def sqlite_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and wikidata ids in a SQLite file, read in row ranges. The file is local to the driver, so this query is for one machine."""
    folder = tempfile.mkdtemp(prefix="moraine-sqlite-")
    path = os.path.join(folder, "mapping.db")
    m = _entities(spark, sf_dir).filter("wikidata_qid is not null").select("title", "wikipedia_id", "wikidata_qid").distinct()
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE mapping (title TEXT, wikipedia_id INTEGER, wikidata_id INTEGER)")
        db.executemany("INSERT INTO mapping VALUES (?, ?, ?)", (tuple(r) for r in m.toLocalIterator()))
    return read_sqlite(spark, path, "mapping", "title string, wikipedia_id long, wikidata_id long")


def wikidata_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as a bz2 dump of one item a line inside brackets, with a comma at the end, filtered and projected."""
    where = scratch(spark)
    e = _entities(spark, sf_dir).filter("wikidata_qid is not null").select("id", "indexer", "wikidata_qid", "title", "descr").distinct()
    name = lambda c: F.struct(c.alias("value"))
    item = F.to_json(F.struct(
        F.concat(F.lit("Q"), F.col("wikidata_qid").cast("string")).alias("id"),
        F.when(F.col("indexer") == 10, F.struct(F.struct(F.col("title").alias("title")).alias("enwiki"), F.struct(F.lower("title").alias("title")).alias("enwikiquote"))).alias("sitelinks"),
        F.struct(name(F.col("title")).alias("en")).alias("labels"), F.struct(F.array(name(F.upper("title")), name(F.lower("title"))).alias("en")).alias("aliases"),
        F.struct(name(F.coalesce("descr", F.lit("none"))).alias("en")).alias("descriptions"),
    ))
    lines = e.select(F.concat(item, F.lit(",")).alias("value"))
    brackets = spark.createDataFrame([("[",), ("]",), ("",)], "value string")
    lines.unionByName(brackets).write.option("compression", "bzip2").text(where)
    got = kb_etl.wikidata_items(files.read_json_dump(spark, where))
    return got.select("id", "title", "aliases", "wikidata_label", "description", "enwikiquote_title")


def document_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as <doc> records, read back with intro lines and token counts."""
    where = scratch(spark)
    d = table(spark, sf_dir, "documents", "doc_id", "title", "text")
    quoted = F.regexp_replace(F.coalesce("title", F.lit("")), '"', "'")
    head = F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('" url="u?curid='), F.col("doc_id").cast("string"), F.lit('" title="'), quoted, F.lit('">\n'))
    d.select(F.concat(head, F.coalesce("text", F.lit("")), F.lit("\nSection::::History.\nlater\n")).alias("value")).write.option("lineSep", "</doc>\n").text(where)
    back = files.read_doc_dump(spark, where)
    intro = F.filter(kb_etl.intro_lines("text"), lambda x: ~x.rlike(r"^[\s\p{Z}]*$"))
    return back.select("page_id", "url", "title", kb_etl.token_count("text").cast("long").alias("num_tokens"), F.array_contains(kb_etl.lines_of("text"), "later").alias("whole"), F.array_contains(intro, "later").alias("in_intro"))


def page_link_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity titles as pages with two links each, one of them percent-encoded; redirecting entities give pages that are no XML."""
    e = _entities(spark, sf_dir).filter("indexer = 10").groupBy("id").agg(F.min(F.struct("title", "redirects_to")).alias("e")).select("id", "e.title", "e.redirects_to")
    plain = F.regexp_replace(F.coalesce("title", F.lit("")), r"[<>&\"']", "")
    href = F.regexp_replace(F.regexp_replace(plain, "%", "%25"), " ", "%20")
    text = F.concat(F.lit('See <a href="'), href, F.lit('">'), plain, F.lit('</a> and <a href="x%2By">other</a>.'), F.when(F.col("redirects_to").isNotNull(), F.lit(" <br> R&D")).otherwise(F.lit("")))
    return kb_etl.page_anchors(e.select("id", text.alias("text")), "id", "text")


def indexed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the documents to entities by title, or through an index of lower-cased titles."""
    e = _entities(spark, sf_dir).filter("indexer = 10").groupBy("id").agg(F.min(F.struct("title", "wikidata_qid")).alias("e")).select("id", "e.title", "e.wikidata_qid")
    pages = e.filter("id % 2 = 0").select(F.col("id").alias("page"), "title", F.col("wikidata_qid").alias("wikidata_id"))
    index = e.filter("wikidata_qid is not null").select(F.regexp_replace("title", " ", "_").alias("link_title"), F.col("wikidata_qid").alias("wikidata_id"))
    links = kb_etl.wiki_links(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return kb_etl.incoming_links_indexed(links, pages, index)


def conll_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions as a token file of one document each, read back with their places and aligned with the corpus."""
    where = scratch(spark)
    m = _mentions(spark, sf_dir, "word", "wikiid").filter("word is not null")
    words = F.split(F.trim(F.regexp_replace("word", r"[\s\p{Z}\p{C}]+", " ")), " ")
    row = lambda w, i: F.concat(w, F.lit("\t"), F.when(i == 0, "B").otherwise("I"), F.lit("\t"), F.regexp_replace("word", r"[\s\p{Z}\p{C}]+", " "), F.lit("\tx\t"), F.coalesce(F.col("wikiid").cast("string"), F.lit("none")), F.lit("\tz"))
    lines = F.concat(
        F.array(F.concat(F.lit("-DOCSTART- ("), F.col("ex_id").cast("string"), F.lit(" x)")), F.lit("It"), F.lit("rained"), F.lit(""), F.lit("Then")), F.transform(words, row), F.array(F.lit("left"), F.lit(""))
    )
    m.filter(F.trim(F.regexp_replace("word", r"[\s\p{Z}\p{C}]+", " ")) != "").select(F.array_join(lines, "\n").alias("value")).write.text(where)
    _, marked = files.read_conll_sentences(spark, where)
    marked = cut(marked.withColumn("doc", F.col("doc").cast("long")))
    ours = m.select(F.col("ex_id").alias("doc"), F.lit(1).cast("long").alias("item"), F.upper("word").alias("mention"))
    got = files.align_mentions(ours.join(marked.select("doc").distinct(), "doc"), marked)
    return got.join(marked.withColumn("number", F.col("number").cast("long")), ["doc", "number"]).select("doc", "number", "sent", "start", "end", "entity")


def token_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from their numbered words, and the bounds of a window around the middle word."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    tokens = d.select("doc_id", F.posexplode("w").alias("pos", "token"))
    back = kb_etl.document_texts(tokens, "doc_id", "pos", "token").join(d.select("doc_id", F.size("w").alias("n")), "doc_id")
    b = kb_etl.window_bounds(F.floor(F.col("n") / 4).cast("int"), F.col("n"), 64)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), b["first"].alias("first"), b["last"].alias("last"))


def sentence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions written one a line in id order, read as numbered sentences."""
    where = scratch(spark)
    e = _entities(spark, sf_dir).filter("indexer = 10").groupBy("id").agg(F.min("descr").alias("descr"))
    line = F.trim(F.regexp_replace(F.coalesce("descr", F.lit("")), r"\s+", " "))
    e.coalesce(1).sortWithinPartitions("id").select(line.alias("value")).write.text(where)
    return files.read_sentences(spark, where).select("line_no", "sentence")


def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs as gzip JSON lines, read with their target."""
    where = scratch(spark)
    n = distinct_records(table(spark, sf_dir, "nil_features", "feature_id", "mention", "title", "jaccard"), "feature_id", "mention", "title", "jaccard")
    n.select(F.concat_ws("|", F.col("feature_id").cast("string"), "mention").alias("query"), F.col("title").alias("candidate"), (F.coalesce("jaccard", F.lit(0.0)) < 0.5).cast("int").alias("neg")).write.option("compression", "gzip").json(where)
    return files.read_training_lines(spark, where).select("query", "candidate", "neg", "target")


def mention_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions dumped per NIL state with their contexts, read back."""
    where = scratch(spark)
    m = _mentions(spark, sf_dir, "left_context_text", "word", "right_context_text", "wikiid", "nil")
    files.write_mentions_by_dataset(
        m.select(F.coalesce(F.col("nil").cast("string"), F.lit("none")).alias("dataset_name"), F.col("word").alias("mention"), F.col("wikiid").alias("gold"), F.lit(1).alias("gold_pos"), F.array("ex_id").alias("candidates"),
                 F.lit("Before.").alias("previous"), F.col("left_context_text").alias("left"), F.col("right_context_text").alias("right"), F.lit(None).cast("string").alias("next")), where)
    back = spark.read.schema("dataset_name string, candidates array<long>, gold long, gold_pos int, text string, tagged_query_context_sent_prev_curr_next array<string>, tagged_query_context_sent_curr array<string>").json(where)
    wide = F.get("tagged_query_context_sent_prev_curr_next", F.lit(0))
    return back.select(F.get("candidates", F.lit(0)).alias("ex_id"), "dataset_name", "gold", "text", F.length(wide).alias("n_before"), F.length(F.get("tagged_query_context_sent_curr", F.lit(1))).alias("n_after"))


def mention_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p(entity | mention) of the corpus as a dictionary file, read back and looked up for lower-cased mentions."""
    from moraine.operators import legacy

    where = scratch(spark)
    plain = F.lower(F.trim(F.regexp_replace("word", r"[\s\p{Z}\p{C}]+", " ")))
    m = cut(_mentions(spark, sf_dir, "word", "wikiid").filter("wikiid is not null").withColumn("mention", plain).filter("mention <> ''"))
    n = m.groupBy("mention", "wikiid").agg(F.count("*").alias("n"))
    all_ = n.groupBy(F.col("mention").alias("_m")).agg(F.sum("n").alias("all"))
    cell = F.concat_ws(",", F.col("wikiid").cast("string"), F.format_string("%.6f", F.col("n") / F.col("all")), F.concat(F.lit("E"), F.col("wikiid").cast("string")))
    lines = n.join(all_, F.col("mention") == F.col("_m")).groupBy("mention", "all").agg(F.array_join(F.array_sort(F.collect_list(cell)), "\t").alias("cells"))
    lines.select(F.concat_ws("\t", "mention", F.col("all").cast("string"), "cells").alias("value")).write.text(where)
    found = legacy.dictionary_lookup(m.select(F.col("ex_id").alias("item"), F.upper("mention").alias("mention")), files.read_mention_dictionary(spark, where))
    return found.groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("p"), F.max_by("entity", F.struct("p", "entity")).alias("top"))


QUERIES = {
    f.__name__: f
    for f in (
        mention_files, catalogue_entities, catalogue_titles, table_load_and_reset, index_reset, delete_statements, vector_files, score_files, report_file, run_results,
        sqlite_mapping, wikidata_dump, document_dump, page_link_scan, indexed_links, conll_mentions, token_texts, sentence_lines, training_lines, mention_dumps, mention_dictionary,
    )
}

_E = "e AS (SELECT DISTINCT id, indexer, wikipedia_id, wikidata_qid, redirects_to, title, descr, type_ FROM entities)"
_BLANK = "'[\\s\\p{Z}\\p{C}]+'"
_LINKS = "k AS (SELECT doc_id, regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|([^\\]]*))?\\]\\]', 1) AS x FROM documents WHERE text IS NOT NULL)"
_LINES = "list_filter(string_split(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ') <> '')"

ORACLE = {
    "mention_files": "SELECT ex_id AS query_id, word AS mention, wikiid AS Wikipedia_ID, y_title AS Wikipedia_title, url AS label_id, length(left_context_text) AS n_left, length(right_context_text) AS n_right FROM mentions",
    "catalogue_entities": f"""WITH {_E}, g AS (SELECT id, any_value(wikipedia_id) AS wikipedia_id, any_value(title) AS title, any_value(descr) AS descr FROM e WHERE indexer = 10 GROUP BY 1)
        SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS id, 10 AS indexer, wikipedia_id, substr(coalesce(title, ''), 1, 100) AS title, descr FROM g""",
    "catalogue_titles": f"WITH {_E} SELECT title, max(id) AS id, arg_max(wikipedia_id, id) AS wikipedia_id FROM e WHERE indexer = 10 GROUP BY 1",
    "table_load_and_reset": f"WITH {_E} SELECT id, indexer, wikipedia_id, title FROM e WHERE indexer <> 20 OR redirects_to IS NOT NULL",
    "index_reset": f"WITH {_E} SELECT id, indexer, title FROM e WHERE indexer <> 20",
    "delete_statements": "SELECT count(DISTINCT wikiid) AS n_ids, 1 AS well_formed FROM mentions WHERE nil AND wikiid IS NOT NULL",
    "vector_files": f"""WITH {_E}, v AS (SELECT DISTINCT id FROM kb_vectors WHERE indexer = 10 AND len(encoding) = 128 AND len(list_filter(encoding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(encoding, lambda x: x <> 0)) > 0)
        SELECT v.id AS label, wikipedia_id, title, TRUE AS same, 512 AS bytes FROM v JOIN e ON e.id = v.id AND e.indexer = 10""",
    "score_files": f"""WITH {linking._CAND} SELECT r.query, 'bi' AS kind, g.gold AS labels, list(round(r.score, 4) ORDER BY rank) AS scores, list(r.wikipedia_id ORDER BY rank) AS nns FROM r JOIN g ON g.query = r.query GROUP BY 1, 3""",
    "report_file": f"""WITH {MENTIONS} SELECT batch, count(*) AS n_mentions, count(*) FILTER (nil) AS n_nil, count(*) FILTER (NOT nil) AS n_known, count(DISTINCT wikiid) AS n_entities,
        count(DISTINCT wikiid) FILTER (nil) AS n_nil_entities, count(DISTINCT wikiid) FILTER (NOT nil) AS n_known_entities FROM m GROUP BY 1""",
    "run_results": """SELECT format('again - {:.2f} --- overall - {:.2f} === Q: `{}` === K: `title` === ID: `d1`', r, r, lang) AS line
        FROM (SELECT lower(lang) AS lang, avg((wikiid IS NOT NULL)::INT::DOUBLE) AS r FROM documents WHERE lang IS NOT NULL GROUP BY 1)""",
    "sqlite_mapping": f"WITH {_E} SELECT DISTINCT title, wikipedia_id::BIGINT AS wikipedia_id, wikidata_qid::BIGINT AS wikidata_id FROM e WHERE wikidata_qid IS NOT NULL",
    "wikidata_dump": f"""WITH {_E} SELECT 'Q' || wikidata_qid AS id, title, [upper(title), lower(title)] AS aliases, title AS wikidata_label, coalesce(descr, 'none') AS description, lower(title) AS enwikiquote_title
        FROM (SELECT DISTINCT id, indexer, wikidata_qid, title, descr FROM e) WHERE wikidata_qid IS NOT NULL AND indexer = 10""",
    "document_dump": f"""WITH d AS (SELECT doc_id, replace(coalesce(title, ''), '"', '''') AS title, {_LINES.format("coalesce(text, '') || chr(10) || 'Section::::History.' || chr(10) || 'later'")} AS x FROM documents)
        SELECT doc_id AS page_id, 'u?curid=' || doc_id AS url, title, len(string_split(array_to_string(x, ' '), ' ')) AS num_tokens, TRUE AS whole, FALSE AS in_intro FROM d""",
    "page_link_scan": f"""WITH {_E}, g AS (SELECT id, any_value(title) AS title, any_value(redirects_to) AS up FROM e WHERE indexer = 10 GROUP BY 1), p AS (SELECT id, regexp_replace(coalesce(title, ''), '[<>&"'']', '', 'g') AS t, up IS NULL AS x FROM g)
        SELECT id, 0 AS pos, t AS href, t AS text, x AS from_xml FROM p UNION ALL SELECT id, 1, 'x+y', 'other', x FROM p""",
    "indexed_links": f"""WITH {_LINKS}, {_E}, g AS (SELECT id, any_value(title) AS title, any_value(wikidata_qid) AS q FROM e WHERE indexer = 10 GROUP BY 1), l AS (SELECT trim(unnest(x)) AS target FROM k),
        pg AS (SELECT * FROM g WHERE id % 2 = 0), ix AS (SELECT replace(title, ' ', '_') AS t, min(q) AS q FROM g WHERE q IS NOT NULL AND title IS NOT NULL GROUP BY 1),
        d AS (SELECT target, count(*) AS n FROM l WHERE target IN (SELECT title FROM pg) GROUP BY 1), o AS (SELECT replace(target, ' ', '_') AS t, count(*) AS n FROM l WHERE target NOT IN (SELECT title FROM pg WHERE title IS NOT NULL) GROUP BY 1),
        w AS (SELECT coalesce(a.q, b.q) AS q, sum(n) AS n FROM o LEFT JOIN ix a ON a.t = o.t LEFT JOIN ix b ON b.t = upper(substr(o.t, 1, 1)) || lower(substr(o.t, 2)) GROUP BY 1)
        SELECT pg.id AS page, (coalesce(d.n, 0) + coalesce(w.n, 0))::BIGINT AS n_links FROM pg LEFT JOIN d ON d.target = pg.title LEFT JOIN w ON w.q = pg.q""",
    "conll_mentions": f"""WITH {MENTIONS}, k AS (SELECT ex_id, wikiid, trim(regexp_replace(word, {_BLANK}, ' ', 'g')) AS w FROM m WHERE word IS NOT NULL)
        SELECT ex_id AS doc, 1::BIGINT AS number, 1 AS sent, 1 AS start, 1 + len(string_split(w, ' ')) AS "end", coalesce(wikiid::VARCHAR, 'none') AS entity FROM k WHERE w <> ''""",
    "token_texts": """WITH d AS (SELECT doc_id, text, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL), a AS (SELECT *, n // 4 - 32 AS f, n // 4 + 32 AS l FROM d),
        b AS (SELECT *, CASE WHEN f < 0 THEN least(l - f, n - 1) ELSE l END AS l2, greatest(f, 0) AS f2 FROM a)
        SELECT doc_id, md5(text) AS digest, CASE WHEN l2 > n - 1 THEN greatest(f2 - l2 + n - 1, 0) ELSE f2 END AS first, least(l2, n - 1) AS last FROM b""",
    "sentence_lines": f"""WITH {_E}, g AS (SELECT id, trim(regexp_replace(coalesce(any_value(descr), ''), '\\s+', ' ', 'g')) AS s FROM e WHERE indexer = 10 GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS line_no, s FROM g)
        SELECT line_no, s AS sentence FROM n WHERE s <> ''""",
    "training_lines": """WITH n AS (SELECT feature_id, any_value(mention) AS mention, any_value(title) AS title, any_value(jaccard) AS j FROM nil_features WHERE feature_id IS NOT NULL GROUP BY 1)
        SELECT concat_ws('|', feature_id::VARCHAR, mention) AS query, title AS candidate, (coalesce(j, 0) < 0.5)::INT AS neg, (coalesce(j, 0) >= 0.5)::INT AS target FROM n""",
    "mention_dumps": f"""WITH {MENTIONS} SELECT ex_id, coalesce(nil::VARCHAR, 'none') AS dataset_name, wikiid AS gold, word AS text, length(trim('Before. ' || coalesce(l, ''), ' ')) AS n_before, length(trim(coalesce(r, ''), ' ')) AS n_after FROM m""",
    "mention_dictionary": f"""WITH {MENTIONS}, k AS (SELECT ex_id, wikiid, lower(trim(regexp_replace(word, {_BLANK}, ' ', 'g'))) AS w FROM m WHERE wikiid IS NOT NULL AND word IS NOT NULL), h AS (SELECT * FROM k WHERE w <> ''),
        c AS (SELECT w, wikiid, count(*) AS n FROM h GROUP BY 1, 2), p AS (SELECT w, wikiid, round(n / sum(n) OVER (PARTITION BY w)::DOUBLE, 6) AS p FROM c)
        SELECT h.ex_id AS item, count(*) AS n, round(sum(p), 4) AS p, arg_max('E' || p.wikiid, (p, 'E' || p.wikiid)) AS top FROM h JOIN p ON p.w = h.w GROUP BY 1""",
}
