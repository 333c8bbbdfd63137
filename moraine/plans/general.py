"""Queries of the general problems: hierarchies (p5) and skewed keys (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators.hierarchy import descendants, heavy_paths
from moraine.operators.skew import distinct_records, keyed_summary
from moraine.session import cut, table

HEAVY_SHARE = 0.02


def _pack(indexer: str, id_: str) -> F.Column:
    return F.shiftleft(F.col(indexer).cast("long"), 32) + F.col(id_).cast("long")


def _indexer(node: str | F.Column) -> F.Column:
    return F.shiftright((F.col(node) if isinstance(node, str) else node) + F.lit(1 << 31), 32).cast("int")


def _id(node: str | F.Column) -> F.Column:
    node = F.col(node) if isinstance(node, str) else node
    return (node - F.shiftleft(_indexer(node).cast("long"), 32)).cast("int")


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entities as (node, parent); (indexer, id) becomes one long, and a negative redirect no parent."""
    e = table(spark, sf_dir, "entities", "id", "indexer", "redirects_to").filter("id is not null and indexer is not null")
    return e.select(
        _pack("indexer", "id").alias("node"), F.when(F.col("redirects_to") >= 0, _pack("indexer", "redirects_to")).alias("parent")
    )


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root, number of descendants and state of every entity."""
    h = heavy_paths(redirects(spark, sf_dir))
    return h.select(
        _indexer("node").alias("indexer"), _id("node").alias("id"), _id("root").alias("root_id"), "depth",
        F.transform("path", _id).alias("path"), "n_descendants", "state",
    )


def p5_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain and preorder interval of every entity that reaches a root: its descendants are those of its root with a place inside."""
    h = heavy_paths(redirects(spark, sf_dir), paths=False).filter("root is not null")
    return h.select(_indexer("node").alias("indexer"), _id("node").alias("id"), _id("root").alias("root_id"), _id("chain").alias("chain"), "position", "first", "last")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of an entity and an entity that leads to it."""
    d = descendants(heavy_paths(redirects(spark, sf_dir)))
    return d.select(_indexer("node").alias("indexer"), _id("node").alias("id"), _id("descendant").alias("descendant_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that are no roots, with their root, or -1 where the chain never reaches one."""
    h = heavy_paths(redirects(spark, sf_dir), paths=False).filter("state <> 'root'")
    return h.select(_indexer("node").alias("indexer"), _id("node").alias("id"), F.coalesce(_id("root"), F.lit(-1)).alias("root_id"))


def mention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per wikiid: records, distinct words, most frequent word, NIL share, median word length."""
    m = table(spark, sf_dir, "mentions", "ex_id", "wikiid", "word", "nil")
    m = distinct_records(m, "ex_id", "wikiid", "word", "nil").withColumn("word_length", F.length("word"))
    return keyed_summary(m, "wikiid", "word", "nil", "word_length")


def p7_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mention_summary(spark, sf_dir).filter("wikiid is not null and wikiid <> -1")
    return s.select(
        "wikiid", "n_records", F.col("n_values").alias("n_words"), F.col("top_value").alias("top_word"), "top_count",
        F.round("flag_share", 9).alias("nil_share"), F.col("number_median").alias("median_word_length"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wikiids with more than 2 % of the distinct records; the total comes from the same summary."""
    s = cut(mention_summary(spark, sf_dir).select("wikiid", "n_records"))
    total = s.agg(F.sum("n_records").alias("_all"))
    return (
        s.crossJoin(F.broadcast(total))  # one row
        .filter((F.col("n_records") > HEAVY_SHARE * F.col("_all")) & F.col("wikiid").isNotNull() & (F.col("wikiid") != -1))
        .select("wikiid")
    )


QUERIES = {f.__name__: f for f in (p5_hierarchy, p5_intervals, p5_descendants, p5_found, p7_keys, p7_found)}

_NODES = """
n AS (SELECT DISTINCT id, indexer, CASE WHEN redirects_to >= 0 THEN redirects_to END AS up FROM entities),
t AS (SELECT n.id, n.indexer, p.id AS up FROM n LEFT JOIN (SELECT DISTINCT id, indexer FROM entities) p ON p.id = n.up AND p.indexer = n.indexer),
w AS (SELECT indexer, id, id AS root_id, 0 AS depth, [id] AS path FROM t WHERE up IS NULL
      UNION ALL SELECT t.indexer, t.id, w.root_id, w.depth + 1, list_append(w.path, t.id) FROM w JOIN t ON t.up = w.id AND t.indexer = w.indexer)
"""

_M = "m AS (SELECT ex_id, any_value(wikiid) AS wikiid, any_value(word) AS word, any_value(nil) AS nil FROM mentions WHERE ex_id IS NOT NULL GROUP BY ex_id)"

ORACLE = {
    "p5_found": f"""WITH RECURSIVE {_NODES}
        SELECT t.indexer, t.id, coalesce(w.root_id, -1) AS root_id FROM t LEFT JOIN w ON w.id = t.id AND w.indexer = t.indexer WHERE t.up IS NOT NULL""",
    "p5_hierarchy": f"""WITH RECURSIVE {_NODES}, lost AS (SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.id = t.id AND w.indexer = t.indexer)),
        go AS (SELECT indexer, id AS start, up AS now, 1 AS k FROM lost UNION ALL SELECT go.indexer, start, lost.up, k + 1 FROM go JOIN lost ON lost.id = go.now AND lost.indexer = go.indexer WHERE go.now <> go.start AND k < 100000 AND k <= (SELECT count(*) FROM lost)),
        ring AS (SELECT DISTINCT indexer, start AS id FROM go WHERE now = start),
        below AS (SELECT indexer, unnest(path) AS id, count(*) - 1 AS n FROM w GROUP BY 1, 2)
        SELECT w.indexer, w.id, root_id, depth, path, n AS n_descendants, CASE WHEN depth = 0 THEN 'root' ELSE 'child' END AS state FROM w JOIN below USING (indexer, id)
        UNION ALL SELECT indexer, id, NULL, NULL, NULL, NULL, CASE WHEN EXISTS (SELECT 1 FROM ring r WHERE r.id = lost.id AND r.indexer = lost.indexer) THEN 'cycle' ELSE 'stray' END FROM lost""",
    "p5_intervals": f"""WITH RECURSIVE {_NODES}, size AS (SELECT indexer, unnest(path) AS id, count(*) AS n FROM w GROUP BY 1, 2),
        kid AS (SELECT t.indexer, t.id, t.up, s.n, row_number() OVER (PARTITION BY t.indexer, t.up ORDER BY s.n DESC, t.id) = 1 AS heavy FROM t JOIN size s ON s.indexer = t.indexer AND s.id = t.id WHERE t.up IS NOT NULL),
        sib AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY indexer, up ORDER BY heavy DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM kid),
        d AS (SELECT indexer, id, id AS root_id, id AS chain, 0 AS position, 0::BIGINT AS first FROM t WHERE up IS NULL UNION ALL
            SELECT k.indexer, k.id, d.root_id, CASE WHEN k.heavy THEN d.chain ELSE k.id END, CASE WHEN k.heavy THEN d.position + 1 ELSE 0 END, d.first + 1 + k.earlier FROM d JOIN sib k ON k.indexer = d.indexer AND k.up = d.id)
        SELECT d.indexer, d.id, root_id, chain, position, first, first + n - 1 AS last FROM d JOIN size USING (indexer, id)""",
    "p5_descendants": f"""WITH RECURSIVE {_NODES}
        SELECT indexer, unnest(path[:-2]) AS id, id AS descendant_id FROM w WHERE depth > 0""",
    "p7_keys": f"""WITH {_M}, c AS (SELECT wikiid, word, count(*) AS n FROM m WHERE word IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY wikiid ORDER BY n DESC, word) AS k FROM c)
        SELECT m.wikiid, count(*) AS n_records, count(DISTINCT m.word) AS n_words, any_value(r.word) AS top_word, any_value(r.n) AS top_count,
               round(avg(CASE WHEN m.nil IS NULL THEN NULL WHEN m.nil THEN 1.0 ELSE 0.0 END), 9) AS nil_share,
               quantile_cont(length(m.word)::DOUBLE, 0.5) AS median_word_length
        FROM m LEFT JOIN r ON r.wikiid = m.wikiid AND r.k = 1 WHERE m.wikiid IS NOT NULL AND m.wikiid <> -1 GROUP BY m.wikiid""",
    "p7_found": f"""WITH {_M} SELECT wikiid FROM m WHERE wikiid IS NOT NULL AND wikiid <> -1 GROUP BY wikiid
        HAVING count(*) > 0.02 * (SELECT count(*) FROM m)""",
}
