"""Older candidate generation: lexical scoring, mention dictionaries, within-document coreference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.text import words
from moraine.session import cut


def lexical_candidates(queries: DataFrame, entities: DataFrame, k: int = 80, descr_weight: float = 0.5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 candidates over titles, plus down-weighted descriptions, times log10(10 + incoming links).

    queries: query, text. entities: id, title, descr, links. Output: query, id, rank, score. Texts are
    lower-cased words; a query word counts once. Equal query texts are scored once and their answers
    joined back. The score of a word in a field is idf x tf (k1 + 1) / (tf + k1 (1 - b + b len / mean
    len)), idf = ln(1 + (n - df + 0.5) / (df + 0.5)).

    The k-th best posting of any word of a query is a floor of its k-th score. Words whose largest
    weights together lie below that floor cannot bring an entity in by themselves, so only the posting
    lists of the other words are read for candidates, and the weak words, the frequent ones as a rule,
    are looked up for those of them that may still reach the floor. No result changes.
    """
    fields = entities.select("id", "links", F.explode(F.array(
        F.struct(F.lit("t").alias("field"), words("title").alias("ws"), F.lit(1.0).alias("fw")),
        F.struct(F.lit("d").alias("field"), words("descr").alias("ws"), F.lit(descr_weight).alias("fw")),
    )).alias("f")).select("id", "links", "f.field", "f.ws", "f.fw", F.size("f.ws").alias("len")).filter("len > 0")
    stats = fields.groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = fields.select("id", "links", "field", "fw", "len", F.explode("ws").alias("term")).groupBy("field", "term", "id", "links", "fw", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    postings = tf.join(df, ["field", "term"]).join(F.broadcast(stats), "field").select("term", "id", "links", (F.col("fw") * weight).alias("w"))  # two rows
    texts = queries.select(F.col("text").alias("_text")).filter("_text is not null").distinct()
    asked = texts.select("_text", F.explode(F.array_distinct(words("_text"))).alias("term"))
    # the factor of an entity goes into its postings, so that a score is a plain sum over terms
    postings = postings.withColumn("w", F.col("w") * F.log10(F.lit(10) + F.coalesce("links", F.lit(0)))).groupBy("term", "id").agg(F.sum("w").alias("w"))
    postings = cut(postings)
    rank = Window.partitionBy("term").orderBy(F.col("w").desc())
    best = postings.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= k)
    bounds = best.groupBy("term").agg(F.max("w").alias("most"), F.max(F.when(F.col("_r") == k, F.col("w"))).alias("kth"))
    asked = asked.join(bounds, "term")
    ordered = asked.groupBy("_text").agg(F.coalesce(F.max("kth"), F.lit(0.0)).alias("bar"), F.array_sort(F.collect_list(F.struct("most", "term"))).alias("terms"))
    spare = F.aggregate(F.slice("terms", F.lit(1), F.col("pos") + 1), F.lit(0.0), lambda s, t: s + t["most"])
    split = ordered.select("_text", "bar", "terms", F.posexplode("terms").alias("pos", "t")).select("_text", F.col("t.term").alias("term"), (spare < F.col("bar") * (1 - 1e-9)).alias("weak"))
    split = cut(split)
    strong = split.filter("not weak").join(postings, "term").select("_text", "id", "w")
    # what a candidate has to hold already, as all weak words together add less than the rest of the bar
    bar = F.col("bar") * (1 - 1e-9)
    need = ordered.select("_text", (bar - F.aggregate("terms", F.lit(0.0), lambda s, t: F.when(s + t["most"] < bar, s + t["most"]).otherwise(s))).alias("need"))
    found = strong.groupBy("_text", "id").agg(F.sum("w").alias("w")).join(need, "_text").filter(F.col("w") >= F.col("need")).select("_text", "id", "w")
    found = cut(found)
    extra = found.select("_text", "id").join(split.filter("weak").select("_text", "term"), "_text").join(postings, ["term", "id"]).select("_text", "id", "w")
    score = found.unionByName(extra).groupBy("_text", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    order = Window.partitionBy("_text").orderBy(F.col("score").desc(), "id")
    top = score.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("_text", "id", "rank", "score")
    return queries.join(top, F.col("text") == F.col("_text")).select("query", "id", "rank", "score")


def dictionary_lookup(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidates p(entity | mention) for mentions (item, mention) from a dictionary (mention, entity, p).

    Exact form or title case, whichever the dictionary holds with more weight; if neither, the
    lower-cased form against lower-cased entries, whose p are averaged. Output: item, entity, p.
    """
    weight = dictionary.groupBy("mention").agg(F.count("*").alias("_w"))
    tried = mentions.filter("mention is not null").select("item", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("mention").alias("m")), F.struct(F.lit(1).alias("o"), F.initcap("mention").alias("m")))).alias("t"))
    held = tried.select("item", "t.o", F.col("t.m").alias("mention")).join(weight, "mention")
    best = held.groupBy("item").agg(F.min(F.struct((-F.col("_w")).alias("w"), "o", "mention")).alias("b")).select("item", F.col("b.mention").alias("mention"))
    exact = best.join(dictionary, "mention").select("item", "entity", "p")
    rest = mentions.join(best.select("item"), "item", "left_anti").select("item", F.lower("mention").alias("mention"))
    lowered = dictionary.groupBy(F.lower("mention").alias("mention"), "entity").agg(F.avg("p").alias("p"))
    return exact.unionByName(rest.join(lowered, "mention").select("item", "entity", "p"))


def coreference(mentions: DataFrame, candidates: DataFrame, persons: DataFrame) -> DataFrame:
    """Within-document coreference: item, entity, p after averaging over longer person mentions.

    mentions: doc, item, mention. candidates: item, entity, p. persons: entity. A mention takes the
    candidates of the other mentions of its document that contain it on word boundaries and whose best
    candidate is a person, each p summed and divided by their number; a mention without such keeps its
    own. Containment is an equi-join: each distinct longer text of a document lists its runs of words,
    and a shorter text meets the runs equal to it.
    """
    best = candidates.groupBy("item").agg(F.max(F.struct("p", "entity")).alias("b")).select("item", F.col("b.entity").alias("entity"))
    named = best.join(persons.select("entity").distinct(), "entity", "left_semi").select("item")
    plain = F.trim(F.regexp_replace(F.lower("mention"), r"[^\p{L}\p{N}]+", " "))
    texts = cut(mentions.select("doc", "item", F.lower("mention").alias("_text"), plain.alias("_plain")).filter("_plain <> ''"))
    longer = texts.join(named, "item", "left_semi")
    w = F.split("_plain", " ")
    runs = longer.select("doc", "_text", "_plain").distinct().withColumn("_w", w).withColumn("_from", F.explode(F.sequence(F.lit(1), F.size("_w"))))
    runs = runs.select("doc", F.col("_text").alias("_long"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("_from") + 1), lambda n: F.array_join(F.slice("_w", F.col("_from"), n), " "))).alias("_plain")).distinct()
    kinds = texts.select("doc", "_text", "_plain").distinct().join(runs, ["doc", "_plain"]).filter(F.length("_long") > F.length("_text")).select("doc", "_text", "_long").distinct()
    found = longer.select("doc", F.col("item").alias("other"), F.col("_text").alias("_long"))
    coref = cut(texts.join(kinds, ["doc", "_text"]).join(found, ["doc", "_long"]).select("item", "other"))
    n = coref.groupBy("item").agg(F.count("*").alias("_n"))
    pooled = coref.join(candidates.withColumnRenamed("item", "other"), "other").groupBy("item", "entity").agg(F.sum("p").alias("_p"))
    pooled = pooled.join(n, "item").select("item", "entity", (F.col("_p") / F.col("_n")).alias("p"))
    return candidates.join(n.select("item"), "item", "left_anti").select("item", "entity", "p").unionByName(pooled)


def correct_candidates(df: DataFrame) -> DataFrame:
    """Oracle chain: candidates (array, best first) cut so that the gold comes first, padded with the last.

    df: candidates with field wikipedia_id, gold_rank (1-based, -1 if absent). Mentions whose gold is
    not found, or last, are dropped; the length of a list stays.
    """
    n, r = F.size("candidates"), F.col("gold_rank")
    kept = df.filter((r > 0) & (r < n))
    tail = F.slice("candidates", r, n - r + 1)
    return kept.withColumn("candidates", F.concat(tail, F.array_repeat(F.element_at("candidates", -1), r - 1)))


def seen_split(rows: DataFrame, entity: str, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose entity is seen, the others); a null entity is unseen."""
    known = seen.select(F.col(entity)).distinct()
    return rows.join(known, entity, "left_semi"), rows.join(known, entity, "left_anti")


def sentence_neighbours(sentences: DataFrame, doc: str = "doc", pos: str = "pos", text: str = "text", quirk: bool = False) -> DataFrame:
    """previous and next sentence within a document, '' at the ends; with `quirk` sentence 0 is never a previous one."""
    w = Window.partitionBy(doc).orderBy(pos)
    before = F.coalesce(F.lag(text).over(w), F.lit(""))
    if quirk:
        before = F.when(F.lag(pos).over(w) > 0, before).otherwise("")
    return sentences.withColumn("previous", before).withColumn("next", F.coalesce(F.lead(text).over(w), F.lit("")))


def enrich_mentions(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Mentions (doc, pos, mention, context_left, context_right, gold) with query contexts and sentence triple.

    Rows without a gold id are dropped. Adds query_mention (escaped), contexts of all, the nearest 25
    and 10 words on either side, and the previous, current and next sentence of (doc, pos), '' where
    there is none. `sentences`: doc, pos, text, one row per sentence.
    """
    from moraine.functions.text import clean_context, first_words, last_words, search_escape

    triple = sentence_neighbours(sentences).select("doc", "pos", "previous", F.col("text").alias("current"), "next")
    kept = mentions.filter("gold is not null").join(triple, ["doc", "pos"], "left").fillna("", ["previous", "current", "next"])
    return kept.withColumns(
        {
            "query_mention": search_escape("mention"),
            "left_full": search_escape(clean_context("context_left")), "right_full": search_escape(clean_context("context_right")),
            "left_25": last_words("context_left", 25), "right_25": first_words("context_right", 25),
            "left_10": last_words("context_left", 10), "right_10": first_words("context_right", 10),
        }
    )


def map_labels(rows: DataFrame, local_ids: DataFrame, consider_all: bool = False) -> DataFrame:
    """label_id of each row's gold wikipedia_id (`gold`) from local_ids (wikipedia_id, local_id).

    An unknown gold drops the row, or with consider_all gets -1. Of repeated wikipedia_ids the
    smallest local id counts.
    """
    held = local_ids.groupBy(F.col("wikipedia_id").alias("gold")).agg(F.min("local_id").alias("label_id"))
    both = rows.join(held, "gold", "left" if consider_all else "inner")
    return both.withColumn("label_id", F.coalesce("label_id", F.lit(-1)))


def gold_among_candidates(rows: DataFrame, keep_all: bool = False) -> DataFrame:
    """label: 0-based place of label_id in the array `nns`; rows without it are dropped, or get label 0 with keep_all."""
    place = F.array_position("nns", F.col("label_id")) - 1
    placed = rows.withColumn("label", place.cast("int"))
    return placed.withColumn("label", F.greatest(F.lit(0), "label")) if keep_all else placed.filter("label >= 0")


def mention_sentences(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Mentions of each sentence (doc, pos), in order of start, beside the sentence's text."""
    lists = mentions.groupBy("doc", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "mention"))), lambda s: s["mention"]).alias("mentions"))
    return sentences.join(lists, ["doc", "pos"], "left").withColumn("mentions", F.coalesce("mentions", F.array().cast("array<string>")))


def word_context_vectors(mentions: DataFrame, words_: DataFrame, vectors: DataFrame, window: int = 10, head: int = 50, near: float = 0.6) -> DataFrame:
    """item, vector: near x mean word vector of the window around a mention + the rest x mean of the document's head.

    mentions: item, doc, at (word number). words_: doc, at, word. vectors: word, vector (array). Words
    without a vector do not count; a mention without any has no row.
    """
    spread = F.posexplode("vector").alias("i", "x")
    tops = words_.filter(F.col("at") < head).join(vectors, "word").select("doc", spread).groupBy("doc", "i").agg(F.avg("x").alias("_head"))
    # the places of a window are listed and met by equality, before any vector is unfolded
    places = mentions.select("item", "doc", F.explode(F.sequence(F.col("at") - window, F.col("at") + window)).alias("at"))
    around = places.join(words_, ["doc", "at"]).join(vectors, "word").select("item", "doc", spread).groupBy("item", "doc", "i").agg(F.avg("x").alias("_near"))
    both = mentions.select("item", "doc").join(tops, "doc").join(around, ["item", "doc", "i"], "full")
    mixed = both.select("item", "i", (near * F.coalesce("_near", F.lit(0.0)) + (1 - near) * F.coalesce("_head", F.lit(0.0))).alias("x"))
    return mixed.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
