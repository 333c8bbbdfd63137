"""File sources and sinks of entity linking: corpora, catalogues, dumps, reports."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.session import shuffle_width

MENTION_SCHEMA = "ex_id long, left_context_text string, word string, right_context_text string, url string, wikiId long, wikiurl string, y_title string"
_NO_VALUE, _UNSAFE = "__HIVE_DEFAULT_PARTITION__", re.compile(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]")  # as Spark names partition folders
#: names of the raw corpus and of the written dataset
RENAMES = {
    "left_context_text": "context_left", "word": "mention", "right_context_text": "context_right", "ex_id": "query_id", "url": "label_id",
    "wikiId": "Wikipedia_ID", "wikiurl": "Wikipedia_URL", "y_title": "Wikipedia_title",
}


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Rows of one or more JSON-lines files (plain, gz or bz2) under a fixed schema; unreadable lines give nulls."""
    return spark.read.schema(schema).json(paths if isinstance(paths, str) else list(paths))


def rename_mentions(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (0-based, in file order) and value of a text file, without pulling lines to one task.

    Each partition numbers its lines; the offsets are sums of the counts of earlier partitions, one
    row per partition.
    """
    from moraine.session import cut

    lines = cut(spark.read.text(path).withColumn("_pid", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = lines.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_row").alias("_from"))
    order = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    return lines.join(F.broadcast(offsets), "_pid").select((F.col("_before") + F.col("_row") - F.col("_from")).alias("line_no"), "value")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """line_no, idx, title, text of an entity catalogue (JSON lines, plain or gz); line numbers hold for one file, as
    the order of several files is Spark's own."""
    item = F.from_json("value", "idx string, title string, text string")
    return numbered_lines(spark, path).select("line_no", item.alias("j")).select("line_no", "j.idx", "j.title", "j.text")


def read_doc_dump(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, title, text of <doc id= url= title=> ... </doc> records, each split off by its end mark."""
    raw = spark.read.option("lineSep", "</doc>").text(path)
    head = r'<doc id="([^"]*)" url="([^"]*)" title="([^"]*)"[^>]*>\r?\n?'
    part = raw.filter(F.col("value").rlike("<doc id="))
    get = lambda i: F.regexp_extract("value", head, i)
    body = F.regexp_replace("value", r'(?s)^.*?<doc id="[^>]*>\r?\n?', "")
    return part.select(get(1).cast("long").alias("page_id"), get(2).alias("url"), get(3).alias("title"), F.regexp_replace(body, r"\s+$", "").alias("text"))


def read_json_dump(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a dump with one object a line inside an array: brackets and blank lines dropped; bz2 is split."""
    return spark.read.text(path).filter(~F.trim("value").isin("", "[", "]"))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """Mentions of a token file (token, B/I, mention, ..., id by tabs; -DOCSTART- lines start documents).

    Output: doc, start (token number), mention, entity. Running sums over the token number of a file
    give document and mention numbers; a document is a group of its own after the first pass.
    """
    lines = numbered_lines(spark, path)
    parts = F.split("value", "\t")
    t = lines.select("line_no", F.col("value").startswith("-DOCSTART-").alias("head"), F.get(parts, F.lit(0)).alias("token"), F.get(parts, F.lit(1)).alias("tag"), F.get(parts, F.lit(2)).alias("mention"), F.get(parts, F.lit(3)).alias("entity"))
    from moraine.operators.ranking import running_weight

    t = running_weight(t.withColumn("_h", F.col("head").cast("long")).withColumn("_all", F.lit(0)), ["_all"], [F.col("line_no")], "_h", "_d")
    t = t.withColumn("doc", F.col("_d") + F.col("_h") - 1).filter("not head and token <> ''")
    w = Window.partitionBy("doc").orderBy("line_no")
    t = t.withColumn("start", F.row_number().over(w) - 1).filter("tag = 'B'")
    return t.select("doc", F.col("start").cast("long").alias("start"), "mention", "entity")


def read_conll_sentences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, mentions) of a token file with sentences ended by blank lines.

    tokens: doc (name after -DOCSTART- without its parenthesis), sent, pos, token. mentions: doc,
    number, sent, start, end (past the last token), text, entity, from lines of at least six fields:
    token, B/I, mention, title, entity, ...; an I line prolongs the mention before it. Documents and
    mentions are numbered by running sums over line numbers; sentences and places by windows over one
    document. A document name has to occur once in a file.
    """
    from moraine.operators.ranking import running_weight

    parts = F.split(F.trim("value"), "\t")
    t = numbered_lines(spark, path).select("line_no", F.trim("value").alias("value"), parts.alias("c"))
    t = t.withColumn("head", F.col("value").startswith("-DOCSTART-")).withColumn("_h", F.col("head").cast("long")).withColumn("_all", F.lit(0))
    t = running_weight(t, ["_all"], [F.col("line_no")], "_h", "_d").withColumn("_doc", F.col("_d") + F.col("_h"))
    names = t.filter("head").select("_doc", F.expr("substring(split(value, '\\\\s+')[1], 2)").alias("doc"))
    body = t.filter("not head")
    inside = Window.partitionBy("_doc").orderBy("line_no")
    body = body.withColumn("sent", F.sum((F.col("value") == "").cast("int")).over(inside)).filter("value <> ''")
    body = body.withColumn("pos", F.row_number().over(Window.partitionBy("_doc", "sent").orderBy("line_no")) - 1)
    marked = F.size("c") >= 6
    body = body.withColumn("number", F.sum((marked & (F.get("c", F.lit(1)) != "I")).cast("int")).over(inside)).withColumn("_m", marked).join(names, "_doc")
    tokens = body.select("doc", "sent", "pos", F.get("c", F.lit(0)).alias("token"))
    held = body.filter("_m and number > 0").groupBy("doc", "number").agg(
        F.min("sent").alias("sent"), F.min("pos").alias("start"), (F.min("pos") + F.count("*")).cast("int").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.get("c", F.lit(0)).alias("t")))), lambda s: s["t"]), " ").alias("text"),
        F.min_by(F.get("c", F.lit(4)), "line_no").alias("entity"),
    )
    return tokens, held


def align_mentions(mentions: DataFrame, marked: DataFrame) -> DataFrame:
    """doc, item, number: the marked mention (doc, number, text) of each mention (doc, item, mention), in order.

    Each mention in item order takes the next marked one of equal lower-cased text without punctuation;
    marked ones passed over stay unused, and once a mention finds none, neither do those after it. A
    document is one group: its own mentions only.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", "")
    kind = dict(mentions.dtypes)
    rows = mentions.select("doc", F.col("item").alias("n"), plain("mention").alias("key"), F.lit(1).alias("side"))
    rows = rows.unionByName(marked.select("doc", F.col("number").cast(kind["item"]).alias("n"), plain("text").alias("key"), F.lit(0).alias("side")))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, keys, numbers, at = None, [], [], 0
        for frame in frames:
            out = []
            for d, side, n, key in frame.itertuples(index=False, name=None):
                if d != doc:
                    doc, keys, numbers, at = d, [], [], 0
                if side == 0:
                    keys.append(key)
                    numbers.append(n)
                    continue
                while at < len(keys) and keys[at] != key:
                    at += 1
                if at < len(keys):
                    out.append((d, n, numbers[at]))
                    at += 1
            yield pd.DataFrame(out, columns=["doc", "item", "number"])

    # the marked mentions of a document come first and are held while its own pass by
    sorted_ = rows.select("doc", "side", "n", "key").repartition(shuffle_width(mentions.sparkSession), "doc").sortWithinPartitions("doc", "side", "n")
    return sorted_.mapInPandas(walk, f"doc {kind['doc']}, item {kind['item']}, number {kind['item']}")


def read_sentences(spark: SparkSession, path: str, per_line: bool = True) -> DataFrame:
    """line_no, pos, sentence: one sentence a line, or with per_line=False the sentences of each line; blank lines have none."""
    from moraine.operators.kb_etl import sentences

    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    found = F.array(F.trim("value")) if per_line else sentences("value")
    return lines.select("line_no", F.posexplode(found).alias("pos", "sentence"))


def read_mention_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """mention, entity, p from lines "mention TAB total TAB id,p,entity TAB ..."."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("mention"), F.explode(F.slice(parts, F.lit(3), F.greatest(F.lit(0), F.size(parts) - 2))).alias("c"))
    cells = F.split("c", ",", 3)
    return rows.filter(F.size(cells) == 3).select("mention", F.get(cells, F.lit(2)).alias("entity"), F.get(cells, F.lit(1)).try_cast("double").alias("p"))


def read_training_lines(spark: SparkSession, path: str, first: int | None = None, sample: int | None = None, seed: int = 1234) -> DataFrame:
    """JSON training lines with target = 1 where neg is 0; the first n lines, or a seeded sample of n."""
    from moraine.operators.ranking import hash_uniform

    df = read_jsonl(spark, path, "query string, candidate string, neg int")
    df = df.withColumn("target", F.when(F.col("neg") == 0, 1).otherwise(0))
    if sample is not None:
        u = hash_uniform(seed, F.col("query"), F.col("candidate"))
        return df.withColumn("_u", u).orderBy("_u").limit(sample).drop("_u")
    return df if first is None else df.limit(first)


def _folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pa.fs.LocalFileSystem(), os.path.abspath(path))


def read_batches(spark: SparkSession, path: str, schema: str, task_bytes: int = 16 << 20) -> DataFrame:
    """Rows of all files of write_batches under a fixed schema; unreadable lines give nulls.

    Small files are dealt to tasks of about `task_bytes`. Spark's own reader takes a task for each folder
    that it lists, and counts 4 MB for each file that it opens.
    """
    fs, root = _folder(path)
    held = [f for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
    groups: list[list[str]] = []
    size = task_bytes
    for f in sorted(held, key=lambda f: f.path):
        if size >= task_bytes:
            groups.append([])
            size = 0
        groups[-1].append(f.path)
        size += f.size

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for name in (n for names in batch.column(0).to_pylist() for n in names):
                with fs.open_input_stream(name) as f:
                    found += f.read().removesuffix(b"\n").split(b"\n")
                if len(found) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], ["_line"])
                    found = []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], ["_line"])

    names = spark.createDataFrame(spark.sparkContext.parallelize([(g,) for g in groups], max(1, len(groups))), "names array<string>")
    return names.mapInArrow(lines, "_line string").select(F.from_json("_line", schema).alias("_row")).select("_row.*")


def write_batches(df: DataFrame, path: str, by: str = "batch", gzip: bool = False) -> None:
    """JSON lines, plain or gz, one folder per batch; what lies in `path` is replaced.

    The rows of a batch meet in one task, else every task leaves a file in every folder; a batch too large
    for a task is split by size. Batches are small and many, so the files are written through pyarrow:
    Hadoop's local file system without its native library starts a process for each mode that it sets.
    A file gets its name when it is complete and the folder its _SUCCESS when all are, so a repeated task
    leaves no rows twice.
    """
    fs, root = _folder(path)
    if fs.get_file_info(root).type != pa.fs.FileType.NotFound:
        fs.delete_dir(root)
    fs.create_dir(root)
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, held, out, pack = f"part-{task.partitionId():05d}.json{'.gz' if gzip else ''}", None, None, None
        spare = f".{name}-{task.taskAttemptId()}"

        def close() -> None:
            if out is not None:
                out.write(pack.flush() if gzip else b"")
                out.close()
                fs.move(f"{held}/{spare}", f"{held}/{name}")

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bounds = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, e in zip(bounds[:-1], bounds[1:], strict=True):
                if a == e:
                    continue
                folder = f"{root}/{by}={_NO_VALUE if keys[a] is None else _UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', keys[a])}"
                if folder != held:
                    close()
                    fs.create_dir(folder)
                    held, out, pack = folder, fs.open_output_stream(f"{folder}/{spare}", compression=None), zlib.compressobj(3, wbits=31)
                plain = ("\n".join(texts[a:e]) + "\n").encode()
                out.write(pack.compress(plain) if gzip else plain)
        close()
        yield pa.RecordBatch.from_pydict({"done": [1]})

    met = df.withColumn(by, F.col(by).cast("string")).hint("rebalance", F.col(by)).sortWithinPartitions(by)
    lines = met.select(by, F.to_json(F.struct(*[c for c in df.columns if c != by])).alias("_line"))
    lines.mapInArrow(write, "done long").agg(F.sum("done")).collect()
    fs.open_output_stream(f"{root}/_SUCCESS").close()


def write_mentions_by_dataset(mentions: DataFrame, path: str) -> None:
    """JSON lines, one folder per dataset_name, of mentions with their candidates and sentence contexts.

    mentions: dataset_name, mention, gold, gold_pos, candidates, previous, left, right, next (parts of
    the sentence before and after the mention, and the sentences around it). Nulls count as ''.
    """
    c = lambda name: F.coalesce(name, F.lit(""))
    pair = lambda a, b: F.array(F.trim(a), F.trim(b))
    mentions.select(
        "dataset_name", "candidates", "gold_pos", "gold", F.col("mention").alias("text"),
        pair(F.concat_ws(" ", c("previous"), c("left")), F.concat_ws(" ", c("right"), c("next"))).alias("tagged_query_context_sent_prev_curr_next"),
        pair(c("left"), c("right")).alias("tagged_query_context_sent_curr"),
    ).write.mode("overwrite").partitionBy("dataset_name").json(path)


def append_run_results(runs: DataFrame, path: str) -> None:
    """Append a line per run (query, keys, dump_id, recalls: map of name to recall), the best overall recall first.

    A line names the recalls in order and the run. A run is a setting tried, so the lines are few and
    go into one file; files are read in name order.
    """
    named = F.transform(F.array_sort(F.map_entries("recalls")), lambda e: F.format_string("%s - %.2f", e["key"], e["value"]))
    line = F.concat(F.array_join(named, " --- "), F.format_string(" === Q: `%s` === K: `%s` === ID: `%s`", "query", "keys", "dump_id"))
    ordered = runs.withColumn("value", line).withColumn("_o", F.try_element_at("recalls", F.lit("overall")))
    ordered.coalesce(1).sortWithinPartitions(F.col("_o").desc_nulls_last(), "value").select("value").write.mode("append").text(path)


def write_encodings(entities: DataFrame, path: str) -> None:
    """Parquet rows {encoding, label, wikipedia_id, title} of encoded entities (id, wikipedia_id, title, vector)."""
    from moraine.functions.vectors import to_base64

    vector = F.col("vector") if dict(entities.dtypes)["vector"] == "binary" else None
    if vector is None:
        raise ValueError("vector must be binary, as of clean_vectors")
    entities.select(to_base64(vector).alias("encoding"), F.col("id").alias("label"), "wikipedia_id", "title").write.mode("overwrite").parquet(path)


def write_scores(ranked: DataFrame, gold: DataFrame, path: str, kind: str = "bi") -> None:
    """Parquet rows {query, kind, labels, scores, nns}: the gold, and scores and ids of the ranked candidates of each query.

    ranked: query, rank, score, wikipedia_id. gold: query, gold. A query without candidates has empty arrays.
    """
    lists = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "wikipedia_id"))).alias("l"))
    empty = lambda t: F.array().cast(f"array<{t}>")
    out = gold.join(lists, "query", "left").select(
        "query", F.lit(kind).alias("kind"), F.col("gold").alias("labels"),
        F.coalesce(F.transform("l", lambda s: s["score"]), empty("double")).alias("scores"), F.coalesce(F.transform("l", lambda s: s["wikipedia_id"]), empty("int")).alias("nns"),
    )
    out.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a report has a row per batch
