"""The knowledge base: entity table, growth, deletion, reset, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

READ_ONLY, READ_WRITE = 10, 20
TITLE_LENGTH, TYPE_LENGTH = 100, 20
ENTITY_SCHEMA = "id int, indexer int, wikipedia_id int, wikidata_qid int, redirects_to int, title string, descr string, type_ string"


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or an error naming the number of keys held more than once."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").count()
    if twice:
        raise ValueError(f"{twice} repeated keys of {', '.join(keys)}")
    return df


def catalogue_entities(lines: DataFrame, indexer: int = READ_ONLY) -> DataFrame:
    """Entity rows from catalogue lines (line_no, idx, title, text): the id is the line number, wikipedia_id
    what follows "curid=" in idx or idx itself (-1 if it is no number), titles are cut to 100 characters."""
    number = F.element_at(F.split("idx", "curid="), -1)
    return lines.select(
        F.col("line_no").cast("int").alias("id"), F.lit(indexer).alias("indexer"), F.coalesce(number.try_cast("int"), F.lit(-1)).alias("wikipedia_id"),
        F.lit(None).cast("int").alias("wikidata_qid"), F.lit(None).cast("int").alias("redirects_to"),
        F.substring(F.coalesce("title", F.lit("")), 1, TITLE_LENGTH).alias("title"), F.col("text").alias("descr"), F.lit(None).cast("string").alias("type_"),
    )


def title_lookup(entities: DataFrame) -> DataFrame:
    """title, id, descr, wikipedia_id: of several entities of a title the last (largest id) wins."""
    return entities.groupBy("title").agg(F.max(F.struct("id", "descr", "wikipedia_id")).alias("e")).select("title", "e.id", "e.descr", "e.wikipedia_id")


def delete_entities(entities: DataFrame, nil_ids: DataFrame, indexer: int = READ_ONLY) -> DataFrame:
    """entities without those of the indexer whose wikipedia_id is in nil_ids (wikipedia_id); null ids delete nothing."""
    gone = nil_ids.filter("wikipedia_id is not null").select(F.col("wikipedia_id").alias("_w")).distinct()
    return entities.join(gone, (F.col("wikipedia_id") == F.col("_w")) & (F.col("indexer") == indexer), "left_anti")


def delete_statement(nil_ids: DataFrame, indexer: int = READ_ONLY, per_statement: int = 1000) -> DataFrame:
    """SQL text, one DELETE per row for up to per_statement ids."""
    ids = nil_ids.filter("wikipedia_id is not null").select("wikipedia_id").distinct()
    part = F.pmod(F.xxhash64("wikipedia_id"), F.greatest(F.lit(1), F.ceil(F.lit(ids.count()) / per_statement)))
    listed = ids.groupBy(part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("wikipedia_id")), lambda i: i.cast("string")), ",").alias("ids"))
    return listed.select(F.concat(F.lit(f"DELETE FROM entities WHERE indexer={indexer} AND wikipedia_id IN ("), "ids", F.lit(");")).alias("statement"))


def reset(entities: DataFrame, indexer: int = READ_WRITE) -> DataFrame:
    """The table without an index: rows of other indexers stay."""
    return entities.filter(F.col("indexer") != indexer)


def grow(entities: DataFrame, clusters: DataFrame, next_id: int, indexer: int = READ_WRITE) -> DataFrame:
    """Entity rows for clusters (cluster, title, n_elements): the next positional ids, larger clusters first.

    Added entities have wikipedia_id -1. The number of clusters of a batch is that of its new
    entities; ids come from sums over range partitions.
    """
    from moraine.operators.ranking import running_weight

    one = clusters.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    placed = running_weight(one, ["_all"], [F.col("n_elements").desc(), F.col("cluster")], "_one", "_before")
    return placed.select(
        "cluster", (F.lit(next_id) + F.col("_before")).cast("int").alias("id"), F.lit(indexer).alias("indexer"), F.lit(-1).alias("wikipedia_id"),
        F.lit(None).cast("int").alias("wikidata_qid"), F.lit(None).cast("int").alias("redirects_to"), F.substring(F.coalesce("title", F.lit("")), 1, TITLE_LENGTH).alias("title"),
        F.lit(None).cast("string").alias("descr"), F.lit(None).cast("string").alias("type_"),
    )


def next_position(rows: DataFrame, indexer: int = READ_WRITE) -> int:
    """The position of the next entity of an index (rows: id, indexer): one past its largest id, 0 if it holds none."""
    last = rows.filter(F.col("indexer") == indexer).agg(F.max("id")).first()[0]
    return 0 if last is None else int(last) + 1


def write_partition(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows, or replace only the partitions they hold, of a table partitioned by indexer."""

    writer = df.write.partitionBy("indexer").mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the last in order."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_p", F.row_number().over(last)).filter("_p = 1").drop("_p")
