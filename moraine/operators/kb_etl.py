"""Knowledge-base construction from text dumps: documents, links, sentences, joins with mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: marks of the dump formats
SECTION, DOC_END = "Section::::", "</doc>"
#: a link: its target in double or single quotes or bare, further attributes, and the shortest text up to the end tag
ANCHOR = r"""(?s)<a\s+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)</a>"""
WIKI_LINK = r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]"
SENTENCE_BREAK = r"(?<=[.!?…])['\"”’»)\]]*\s+(?=[\p{Lu}\p{N}\"“«–—])"


def lines_of(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")


def intro_lines(text: str | Column) -> Column:
    """Lines before the first section mark or the end of the document."""
    lines = lines_of(text)
    stop = F.array_position(F.transform(lines, lambda x: x.startswith(SECTION) | x.startswith(DOC_END)), True)
    return F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)


def token_count(text: str | Column) -> Column:
    """Parts between single spaces of the non-blank lines joined by a space; 0 without one."""
    kept = F.filter(lines_of(text), lambda x: F.trim(x) != "")
    return F.when(F.size(kept) > 0, F.size(F.split(F.array_join(kept, " "), " "))).otherwise(0)


def sentences(text: str | Column) -> Column:
    """Sentences of a text, split after an end mark before a capital, digit or opening quote."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, SENTENCE_BREAK))


def intro_sentences(text: str | Column, title: str | Column, n: int = 10) -> Column:
    """The first n sentences of the intro, without a first line equal to the title and section lines."""
    title = F.col(title) if isinstance(title, str) else title
    body = F.filter(intro_lines(text), lambda x: (F.trim(x) != F.coalesce(title, F.lit(""))) & ~x.startswith(SECTION))
    return F.slice(sentences(F.array_join(body, " ")), 1, n)


def sentence_columns(df: DataFrame, array: str, n: int = 10) -> DataFrame:
    return df.select("*", *[F.get(array, F.lit(i)).alias(f"sent_desc_{i + 1}") for i in range(n)])


def unquote(text: Column) -> Column:
    """Percent-decoding that keeps '+' and, where it cannot be decoded, the text itself."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)


def anchors(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, raw, href (percent-decoded), text of every <a href=...> link, in order; a null text has none."""
    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ANCHOR), F.lit(0)))
    parts = df.filter(F.col(text).isNotNull()).select(key, found.alias("pos", "raw"))
    href = F.concat(*[F.regexp_extract("raw", ANCHOR, i) for i in (1, 2, 3)])  # at most one of them is not empty
    return parts.select(key, "pos", "raw", unquote(href).alias("href"), F.regexp_extract("raw", ANCHOR, 4).alias("text"))


def page_anchors(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, href, text, from_xml: the links of a page, as children of its XML where the page parses, else by pattern.

    Only <a> elements right below the page count as XML children; their text is trimmed.
    """
    page = df.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    schema = "a array<struct<_href string, _VALUE string>>, _corrupt_record string"
    parsed = page.withColumn("_x", F.from_xml(F.concat(F.lit("<doc>"), F.col("_text"), F.lit("</doc>")), schema, {"rowTag": "doc"}))
    good = F.col("_x").isNotNull() & F.col("_x._corrupt_record").isNull()
    children = parsed.filter(good).select(key, F.posexplode("_x.a").alias("pos", "e"))
    children = children.select(key, "pos", unquote(F.coalesce("e._href", F.lit(""))).alias("href"), F.trim(F.coalesce("e._VALUE", F.lit(""))).alias("text"), F.lit(True).alias("from_xml"))
    other = anchors(parsed.filter(~good).select(key, F.col("_text").alias(text)), key, text)
    return children.unionByName(other.select(key, "pos", "href", "text", F.lit(False).alias("from_xml")))


def wiki_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, target, text of every [[target]] or [[target|text]] link, in order."""
    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(WIKI_LINK), F.lit(0)))
    parts = df.filter(F.col(text).isNotNull()).select(key, found.alias("pos", "raw"))
    shown = F.regexp_extract("raw", WIKI_LINK, 2)
    target = F.trim(F.regexp_extract("raw", WIKI_LINK, 1))
    return parts.select(key, "pos", target.alias("target"), F.when(shown != "", shown).otherwise(target).alias("text"))


def incoming_links(links: DataFrame, titles: DataFrame) -> DataFrame:
    """id, n_links for every row of titles (id, title): links by title; a title with '_' reads as spaces, and
    a link that matches nothing tries its capitalised form. Links are counted before they are joined."""
    plain = F.regexp_replace("target", "_", " ")
    counts = links.select(plain.alias("target")).groupBy("target").agg(F.count("*").alias("n"))
    held = titles.groupBy("title").agg(F.min("id").alias("id"))
    direct = counts.join(held, counts["target"] == held["title"], "left").select("target", "n", "id")
    missed = direct.filter("id is null").withColumn("title", F.concat(F.upper(F.substring("target", 1, 1)), F.lower(F.expr("substring(target, 2)"))))
    second = missed.drop("id").join(held, "title").select("target", "n", "id")
    total = direct.filter("id is not null").unionByName(second).groupBy("id").agg(F.sum("n").alias("n_links"))
    return titles.select("id").distinct().join(total, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def incoming_links_indexed(links: DataFrame, pages: DataFrame, index: DataFrame) -> DataFrame:
    """page, n_links for every row of pages (page, title, wikidata_id): links by title, and links found through an index.

    links: target. A target that is the title of a page counts for it. Any other is looked up in the
    index (link_title, wikidata_id) with '_' for spaces, then with only its first letter in upper case,
    and counts for all pages of that wikidata_id. Of repeated link titles the smallest id counts; links
    are counted before they are joined.
    """
    counts = links.filter("target is not null").groupBy("target").agg(F.count("*").alias("n"))
    titles = pages.filter("title is not null").select(F.col("title").alias("target")).distinct()
    direct = counts.join(titles, "target", "left_semi")
    missed = counts.join(titles, "target", "left_anti").withColumn("_k", F.regexp_replace("target", " ", "_"))
    held = index.filter("link_title is not null").groupBy("link_title").agg(F.min("wikidata_id").alias("wikidata_id"))
    first = missed.join(held.select(F.col("link_title").alias("_k"), F.col("wikidata_id").alias("_w1")), "_k", "left")
    first = first.withColumn("_c", F.concat(F.upper(F.substring("_k", 1, 1)), F.lower(F.expr("substring(_k, 2)"))))
    both = first.join(held.select(F.col("link_title").alias("_c"), F.col("wikidata_id").alias("_w2")), "_c", "left")
    found = both.select(F.coalesce("_w1", "_w2").alias("wikidata_id"), "n").filter("wikidata_id is not null").groupBy("wikidata_id").agg(F.sum("n").alias("_by_id"))
    out = pages.join(direct.select(F.col("target").alias("title"), F.col("n").alias("_by_title")), "title", "left").join(found, "wikidata_id", "left")
    return out.select("page", (F.coalesce("_by_title", F.lit(0)) + F.coalesce("_by_id", F.lit(0))).alias("n_links"))


def document_texts(tokens: DataFrame, doc: str, pos: str, token: str) -> DataFrame:
    """doc, text: the tokens of each document in order, joined by spaces; a document is the requested output and one row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(token, F.lit("")).alias("t"))))
    return tokens.filter(F.col(doc).isNotNull()).groupBy(doc).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"))


def window_bounds(at: Column, length: Column, window: int = 128) -> Column:
    """Struct (first, last) of the words of a window around word `at` of a text of `length` words, kept inside the
    text: what one side lacks goes to the other. A window of odd size is halved and rounded to even."""
    half = round(window / 2)
    last = length - 1
    first, end = at - half, at + half
    end = F.when(first < 0, F.least(end - first, last)).otherwise(end)
    first = F.greatest(first, F.lit(0))
    first = F.when(end > last, F.greatest(first - end + last, F.lit(0))).otherwise(first)
    return F.struct(first.cast("int").alias("first"), F.least(end, last).cast("int").alias("last"))


def link_by_title_then_id(pages: DataFrame, mapping: DataFrame) -> DataFrame:
    """pages (page, title, wikipedia_id) with the wikidata_id of the mapping (title, wikipedia_id, wikidata_id):
    by title, else by id. A key held more than once gives its smallest wikidata_id; null matches nothing."""
    by_title = mapping.filter("title is not null").groupBy("title").agg(F.min("wikidata_id").alias("_t"))
    by_id = mapping.filter("wikipedia_id is not null").groupBy("wikipedia_id").agg(F.min("wikidata_id").alias("_i"))
    both = pages.join(by_title, "title", "left").join(by_id, "wikipedia_id", "left")
    return both.select("page", "title", "wikipedia_id", F.coalesce("_t", "_i").alias("wikidata_id"))


def wikidata_items(lines: DataFrame, language: str = "en") -> DataFrame:
    """Items of a dump of one JSON object a line (value): those with a page in the language, projected."""
    schema = (
        "id string, sitelinks map<string, struct<title string>>, aliases map<string, array<struct<value string>>>, "
        "labels map<string, struct<value string>>, descriptions map<string, struct<value string>>"
    )
    item = F.from_json(F.regexp_replace("value", r",\s*$", ""), schema)
    wiki = f"{language}wiki"
    return lines.select(item.alias("j")).filter(F.col(f"j.sitelinks.{wiki}").isNotNull()).select(
        "j.id", F.col(f"j.sitelinks.{wiki}.title").alias("title"), F.transform(F.col(f"j.aliases.{language}"), lambda a: a["value"]).alias("aliases"),
        F.col(f"j.labels.{language}.value").alias("wikidata_label"), F.col(f"j.descriptions.{language}.value").alias("description"),
        F.col(f"j.sitelinks.{language}wikiquote.title").alias("enwikiquote_title"),
    )


def indexable(docs: DataFrame, min_tokens: int = 0, drop_disambiguation: bool = True) -> DataFrame:
    """Rows (text, title) worth indexing: enough tokens, and no disambiguation page by title or first sentence."""
    kept = docs.filter(token_count("text") >= min_tokens)
    if drop_disambiguation:
        first = F.coalesce(F.get(sentences("text"), F.lit(0)), F.lit(""))
        kept = kept.filter(~F.lower(F.coalesce("title", F.lit(""))).contains("(disambiguation)") & ~F.lower(first).rlike(r"\bmay (also )?refer to\b"))
    return kept
