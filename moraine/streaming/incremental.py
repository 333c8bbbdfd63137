"""Incremental linking: batches that retrieve, decide, cluster and grow the knowledge base.

State lies in Parquet under one folder, a subfolder per table and step: vectors, entities, added,
clusters, reports. A step reads the steps before it and overwrites its own, so it may be repeated
after a failure with the same result; that makes it safe under foreachBatch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moraine.functions.text import multiset_jaccard, word_levenshtein
from moraine.functions.vectors import from_base64
from moraine.operators import blocks, clustering, kb, metrics, nil, retrieval
from moraine.session import cut

RECALLS = (1, 2, 3, 5, 10, 30, 100)
#: columns of a report after batch, size and dropped; counts are double, as absent figures are null
REPORT = (
    *(f"linking_recall@{k}" for k in RECALLS),
    *(f"nil_prediction_{m}cm{n}_{c}" for m in ("", "mitigated_") for n in ("", "_normalized") for c in ("tn", "fp", "fn", "tp")),
    *(f"{side}-{m}-{k}" for m in ("", "mitigated") for side in ("NIL", "not-NIL") for k in ("precision", "recall", "f1-score", "support")),
    "nil_clustering_bcubed_precision", "nil_clustering_bcubed_recall",
    *(f"eval_clustering_{k}" for k in ("muc_precision", "muc_recall", "muc_f1", "b3_precision", "b3_recall", "b3_f1", "ceaf_precision", "ceaf_recall", "ceaf_f1", "pred_clusters_len", "evalcluster_mean")),
    "overall_to_link_correct", "should_be_nil_correct", "should_be_nil_total", "should_be_nil_correct_normalized",
    "should_be_linked_to_prev_added_correct", "should_be_linked_to_prev_added_total", "should_be_linked_to_prev_added_correct_normalized",
    "overall_correct", "overall_accuracy",
)
TABLES = {
    "vectors": "id long, indexer int, vector binary",
    "entities": kb.ENTITY_SCHEMA,
    "added": "gold long",
    "clusters": "id int, indexer int, mode long, modes array<long>",
    "reports": "batch long, size long, dropped long, " + ", ".join(f"`{c}` double" for c in REPORT),
}


@dataclass(frozen=True)
class Settings:
    """What the command line of an evaluation sets."""

    state: str
    dim: int
    top_k: int = 10
    nil_weights: tuple[tuple[str, float], ...] = (("best", 1.0), ("secondiff", 0.0))
    nil_intercept: float = 0.0
    nil_threshold: float = nil.THRESHOLD
    clusterer: str = "greedy"  # or three_step, feature
    cluster_threshold: float | None = None  # of the clusterer, its own default if None
    grow: bool = True
    correct_steps: bool = False  # judge each component on right answers of the ones before it
    swapped_ceaf: bool = False  # precision and recall of CEAF exchanged, as in the published figures


def _path(settings: Settings, table: str, step: int) -> str:
    return f"{settings.state}/{table}/step={step}"


def _read(spark: SparkSession, settings: Settings, table: str, before: int) -> DataFrame:
    df = spark.read.schema(TABLES[table] + ", step int").parquet(f"{settings.state}/{table}")
    return df.filter(F.col("step") < before).drop("step")  # a partition filter: later steps are not read


def start(spark: SparkSession, settings: Settings, vectors: DataFrame, entities: DataFrame, reset: bool = True) -> None:
    """Write step -1: the index, the entities and empty tables; with `reset` without rows of the read-write index."""
    keep = kb.reset if reset else (lambda df: df)
    firsts = {"vectors": keep(vectors), "entities": keep(entities)}
    for table, schema in TABLES.items():
        firsts.get(table, spark.createDataFrame([], schema)).write.mode("overwrite").parquet(_path(settings, table, -1))


def _positions(vectors: DataFrame, entities: DataFrame) -> DataFrame:
    return vectors.select("id", "indexer").unionByName(entities.select(F.col("id").cast("long").alias("id"), "indexer"))


def retrieve(mentions: DataFrame, vectors: DataFrame, entities: DataFrame, dim: int, top_k: int) -> DataFrame:
    """Ranked candidates of mentions (query, vector) over all indexes, with what the entity table holds of them."""
    found = blocks.exact_top_k(mentions.select("query", "vector"), vectors.select(F.col("indexer").alias("space"), "id", "vector"), dim, top_k)
    raw = found.select("query", "id", F.col("space").alias("indexer"), F.col("score").alias("raw_score"), "query_norm", "entry_norm")
    return retrieval.merge_lists(retrieval.join_entities(raw, entities))


def training_frame(mentions: DataFrame, vectors: DataFrame, entities: DataFrame, dim: int, top_k: int = 100) -> DataFrame:
    """Features for training a NIL model, a row per mention (query, mention, gold, nil, vector).

    top_id, top_title: of the best candidate. scores, nns: score and wikipedia_id of the candidates
    with a positive wikipedia_id, best first. labels: 1 if the mention is not NIL and its best
    candidate is the gold. max, second, secondiff, min, mean, median, stdev over scores (null where
    there are too few), levenshtein and jaccard of mention and top_title. A mention without candidates
    has nulls and label 0.
    """
    # entities are looked up for the index, not for each candidate: a vector carries its wikipedia_id, below 0 if there is none
    gone, unknown = -2, -1
    held = entities.groupBy("id", "indexer").agg(F.min(F.struct("wikipedia_id", "title", "type_")).alias("e")).select(F.col("id").alias("_id"), F.col("indexer").alias("_indexer"), "e")
    tag = F.when(F.col("e").isNull(), gone).otherwise(F.coalesce(F.when(F.col("e.wikipedia_id") >= 0, F.col("e.wikipedia_id")), F.lit(unknown))).cast("long")
    index = vectors.join(held, (F.col("id") == F.col("_id")) & (F.col("indexer") == F.col("_indexer")), "left").select(F.col("indexer").alias("space"), "id", tag.alias("tag"), "vector")
    one = F.transform("found", lambda c: F.struct(F.when(c["tag"] == gone, -retrieval.DUMMY_SCORE).otherwise(c["less"]).alias("less"), F.col("space").alias("indexer"), c["id"].alias("id"), c["tag"].alias("tag")))
    lists = blocks.top_lists(mentions.select("query", "vector"), index, dim, top_k).select("query", one.alias("found"))
    lists = lists.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("candidates"))
    known = F.filter("candidates", lambda c: c["tag"] > 0)
    first = F.get("candidates", F.lit(0))
    lists = lists.select(
        "query", first.alias("c"), F.transform(known, lambda c: F.lit(0.0) - c["less"]).alias("scores"), F.transform(known, lambda c: c["tag"].cast("int")).alias("nns")
    )
    rows = mentions.select("query", "mention", "gold", "nil").join(lists, "query", "left")
    rows = rows.join(held, (F.col("c.id") == F.col("_id")) & (F.col("c.indexer") == F.col("_indexer")), "left")
    rows = rows.select(
        "query", "mention", "gold", "nil", F.when(F.col("c.tag") == gone, 0).otherwise(F.col("e.wikipedia_id")).cast("int").alias("top_id"),
        F.when(F.col("c.tag") == gone, F.lit("")).otherwise(F.col("e.title")).alias("top_title"),
        F.coalesce("scores", F.array().cast("array<double>")).alias("scores"), F.coalesce("nns", F.array().cast("array<int>")).alias("nns"),
    )
    many = F.size("scores") > 1
    stats = nil.array_statistics("scores")
    return rows.select(
        "*", F.coalesce(~F.col("nil") & (F.col("gold") == F.col("top_id")), F.lit(False)).cast("int").alias("labels"),
        F.array_max("scores").alias("max"), F.when(many, F.get("scores", F.lit(1))).alias("second"), stats["secondiff"].alias("secondiff"),
        F.array_min("scores").alias("min"), stats["mean"].alias("mean"), stats["median"].alias("median"), stats["stdev"].alias("stdev"),
        word_levenshtein("mention", "top_title").alias("levenshtein"), multiset_jaccard("mention", "top_title").alias("jaccard"),
    )


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _nil_figures(judged: DataFrame) -> DataFrame:
    """One row: confusion matrices and reports of either class, for the truth and the mitigated truth."""
    out = None
    for mark, truth in (("", "should_be_nil"), ("mitigated", "mitigated")):
        m = nil.binary_measures(judged, truth, "is_nil")
        pre = f"nil_prediction_{mark}{'_' if mark else ''}cm"
        f, t = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
        cells = {"tn": f, "fp": f, "fn": t, "tp": t}
        m = m.select(
            *[F.col(c).cast("double").alias(f"{pre}_{c}") for c in cells], *[_share(F.col(c), n).alias(f"{pre}_normalized_{c}") for c, n in cells.items()],
            *[F.col(f"{k}_{i}").cast("double").alias(f"{side}-{mark}-{'f1-score' if k == 'f1' else k}") for i, side in ((1, "NIL"), (0, "not-NIL")) for k in ("precision", "recall", "f1", "support")],
        )
        out = m if out is None else out.crossJoin(F.broadcast(m))  # one row each
    return out


def _overall_figures(judged: DataFrame, empty: bool) -> DataFrame:
    """One row of end-to-end counts; `empty` leaves all null, as they mean nothing on corrected steps."""
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    modes = F.coalesce("top_modes", F.array().cast("array<long>"))
    again = F.col("nil") & ~F.col("should_be_nil")
    right = ~F.col("is_nil") & F.col("top_added") & (F.size(modes) <= 2) & F.array_contains(modes, F.col("gold"))
    sums = judged.agg(
        F.count("*").alias("_n"), count(~F.col("nil")).alias("_to_link"), count(~F.col("nil") & ~F.col("is_nil") & (F.col("top_id") == F.col("gold"))).alias("_linked"),
        count(F.col("should_be_nil") & F.col("is_nil")).alias("should_be_nil_correct"), count(F.col("should_be_nil")).alias("should_be_nil_total"),
        count(again & right).alias("should_be_linked_to_prev_added_correct"), count(again).alias("should_be_linked_to_prev_added_total"),
    )
    c = F.col
    total = c("_linked") + c("should_be_nil_correct") + c("should_be_linked_to_prev_added_correct")
    out = sums.select(
        _share(c("_linked"), c("_to_link")).alias("overall_to_link_correct"), "should_be_nil_correct", "should_be_nil_total",
        _share(c("should_be_nil_correct"), c("should_be_nil_total")).alias("should_be_nil_correct_normalized"),
        "should_be_linked_to_prev_added_correct", "should_be_linked_to_prev_added_total",
        _share(c("should_be_linked_to_prev_added_correct"), c("should_be_linked_to_prev_added_total")).alias("should_be_linked_to_prev_added_correct_normalized"),
        total.alias("overall_correct"), _share(total, c("_n")).alias("overall_accuracy"),
    )
    return out.select(*[F.lit(None).cast("double").alias(x) for x in out.columns]) if empty else out


def run_batch(mentions: DataFrame, step: int, settings: Settings) -> DataFrame:
    """One batch of mentions (query long, mention string, gold long, nil boolean, vector [, context_left,
    context_right]): its report row, with the columns batch, size, dropped and REPORT.

    Retrieval over both indexes, entity join, recall, NIL decision, clustering of the mentions
    predicted NIL by the clusterer of the settings, all measures, and, if the settings say so, one new
    entity per cluster with the vector of its medoid. A mention
    should be NIL if it is NIL and its gold was not added by an earlier batch; mitigated, also if its
    best candidate is wrong. With correct_steps known mentions whose gold is not found, or found last,
    are dropped, the clusterer and the growth get the mentions that should be NIL, and new entities are
    the gold groups. A null nil counts as false; clusters are judged over rows with a gold. Measures of
    an empty side are 0, those of clusterings without a row null.
    """
    spark = mentions.sparkSession
    text = lambda c: F.coalesce(c, F.lit("")) if c in mentions.columns else F.lit("")
    mentions = cut(mentions.select(
        "query", "mention", "gold", F.coalesce("nil", F.lit(False)).alias("nil"), "vector", F.concat_ws(" ", text("context_left"), text("context_right")).alias("context")
    ))
    vectors, entities = _read(spark, settings, "vectors", step), cut(_read(spark, settings, "entities", step))
    added, clusters = _read(spark, settings, "added", step), _read(spark, settings, "clusters", step)
    ranked = cut(retrieve(mentions, vectors, entities, settings.dim, settings.top_k))
    ranks = retrieval.rank_of_gold(ranked, mentions.select("query", "gold"))

    top = ranked.groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("id", "indexer", "wikipedia_id", "score"))).alias("c"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.count("*").alias("n_candidates"),
    )
    rows = mentions.join(top, "query", "left").join(ranks.select("query", "gold_rank"), "query", "left")
    rows = rows.withColumn("best", F.col("c.score")).withColumn("secondiff", F.col("best") - F.coalesce("second", F.lit(0.0)))
    decided = nil.decide(rows.withColumn("nil_score", nil.logistic(dict(settings.nil_weights), settings.nil_intercept)), threshold=settings.nil_threshold)
    seen = added.distinct().withColumn("_seen", F.lit(True))
    modes = clusters.select(F.col("id").alias("_ci"), F.col("indexer").alias("_cx"), "modes")
    judged = (
        decided.join(seen, "gold", "left")
        .join(modes, (F.col("c.id") == F.col("_ci")) & (F.col("c.indexer") == F.col("_cx")), "left")
        .select(
            "query", "mention", "context", "gold", "vector", "nil", "is_nil", "gold_rank", "n_candidates", (F.col("nil") & F.col("_seen").isNull()).alias("should_be_nil"),
            F.col("c.wikipedia_id").cast("long").alias("top_id"), F.coalesce(F.col("c.indexer") == kb.READ_WRITE, F.lit(False)).alias("top_added"), F.col("modes").alias("top_modes"),
        )
        .withColumn("mitigated", F.col("should_be_nil") | F.coalesce(F.col("top_id") != F.col("gold"), F.lit(True)))
    )
    every = cut(judged)
    usable = F.col("nil") | ((F.col("gold_rank") > 0) & (F.col("gold_rank") < F.col("n_candidates")))
    judged = every.filter(usable) if settings.correct_steps else every
    nil_figures = _nil_figures(judged)
    chosen = judged.filter("should_be_nil" if settings.correct_steps else "is_nil")

    unlinked = cut(chosen.select(F.lit(step).cast("long").alias("grp"), F.col("query").alias("item"), "vector", "mention", "context", "gold"))
    labels = clustering.cluster_mentions(unlinked, settings.dim, settings.clusterer, settings.cluster_threshold)
    labelled = cut(unlinked.join(labels, "item"))
    measures = metrics.clustering_report(labelled.select("item", F.col("gold").alias("true_id"), F.col("cluster").alias("pred_id")), settings.swapped_ceaf)
    if settings.grow:
        if settings.correct_steps:
            heads = unlinked.groupBy(F.col("gold").alias("_g")).agg(F.min("item").alias("cluster"))
            labelled = cut(unlinked.join(heads, F.col("gold").eqNullSafe(F.col("_g"))).drop("_g"))
        titles = clustering.mode_titles(labelled, "cluster", "mention")
        new = cut(kb.grow(entities, titles, kb.next_position(_positions(vectors, entities))))
        centres = clustering.medoid_vectors(labelled, "cluster", "item", labelled.select("item", "vector"), settings.dim)
        golds = clustering.gold_modes(labelled, "cluster", "gold").select("cluster", "mode", "modes")
        new.drop("cluster").write.mode("overwrite").parquet(_path(settings, "entities", step))
        new.join(centres, "cluster").select(F.col("id").cast("long").alias("id"), "indexer", "vector").write.mode("overwrite").parquet(_path(settings, "vectors", step))
        new.select("cluster", "id", "indexer").join(golds, "cluster", "left").drop("cluster").write.mode("overwrite").parquet(_path(settings, "clusters", step))
        chosen.select("gold").distinct().write.mode("overwrite").parquet(_path(settings, "added", step))

    recall = every.filter("not nil").agg(*[F.avg(F.col("gold_rank").between(1, k).cast("double")).alias(f"linking_recall@{k}") for k in RECALLS])
    sizes = every.agg(F.lit(step).cast("long").alias("batch"), F.count("*").alias("size"), F.coalesce(F.sum((~usable).cast("long")), F.lit(0)).alias("_lost"))
    sizes = sizes.select("batch", "size", (F.col("_lost") if settings.correct_steps else F.lit(0)).cast("long").alias("dropped"))
    measures = measures.select(
        F.col("b3_precision").alias("nil_clustering_bcubed_precision"), F.col("b3_recall").alias("nil_clustering_bcubed_recall"),
        *[F.col(c.removeprefix("eval_clustering_")).cast("double").alias(c) for c in REPORT if c.startswith("eval_clustering_")],
    )
    report = sizes
    for part in (recall, nil_figures, measures, _overall_figures(judged, settings.correct_steps)):
        report = report.crossJoin(F.broadcast(part))  # one row each
    report = report.select("batch", "size", "dropped", *[F.col(f"`{c}`") for c in REPORT])
    report.write.mode("overwrite").parquet(_path(settings, "reports", step))
    return spark.read.parquet(_path(settings, "reports", step))


def run_all(mentions: DataFrame, settings: Settings, batches: list[int]) -> DataFrame:
    """The batches in order; returns the report of each."""
    for step in batches:
        run_batch(mentions.filter(F.col("batch") == step).drop("batch"), step, settings)
    return _read(mentions.sparkSession, settings, "reports", max(batches, default=-1) + 1)


def run_one_pass(mentions: DataFrame, settings: Settings) -> DataFrame:
    """All batches as one: the report of step 0."""
    return run_batch(mentions.drop("batch"), 0, settings)


def overall_report(reports: DataFrame) -> DataFrame:
    """The reports, batch as text, and a row incremental_overall: means, sums of size and overall_correct, accuracy of the sums."""
    numbers = [F.avg(f"`{c}`").alias(c) for c in REPORT if c not in ("overall_correct", "overall_accuracy")]
    total = reports.agg(F.sum("size").alias("size"), F.avg("dropped").alias("dropped"), F.sum("overall_correct").alias("overall_correct"), *numbers)
    total = total.withColumn("overall_accuracy", F.try_divide(F.col("overall_correct"), F.col("size"))).withColumn("batch", F.lit("incremental_overall"))
    each = reports.withColumn("batch", F.col("batch").cast("string")).withColumn("dropped", F.col("dropped").cast("double"))
    return each.unionByName(total)


def stream_batches(mentions: DataFrame, settings: Settings, checkpoint: str) -> StreamingQuery:
    """The same over a stream of files: each micro-batch is a step, numbered by Spark, and safe to repeat."""
    return (
        mentions.writeStream.foreachBatch(lambda df, step: run_batch(df, int(step), settings) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def search_request(requests: DataFrame, vectors: DataFrame, entities: DataFrame, dim: int, top_k: int = 10) -> DataFrame:
    """Search over encoded queries: query, encoding (base64) -> query and its candidates, best first."""
    asked = requests.select("query", from_base64(F.col("encoding")).alias("vector"))
    ranked = retrieval.candidate_arrays(retrieve(asked, vectors, entities, dim, top_k))
    return requests.select("query").distinct().join(ranked, "query", "left")


def add_request(spark: SparkSession, settings: Settings, rows: DataFrame, step: int) -> DataFrame:
    """Add entities (item, title, encoding as base64) to the read-write index in item order: item, id, indexer.

    Rows whose encoding cannot be read get an id and no vector, so they are never found.
    """
    vectors, entities = _read(spark, settings, "vectors", step), _read(spark, settings, "entities", step)
    asked = rows.select(F.col("item").alias("cluster"), "title", F.lit(1).alias("n_elements"), from_base64(F.col("encoding")).alias("vector"))
    new = cut(kb.grow(entities, asked.drop("vector"), kb.next_position(_positions(vectors, entities))))
    new.drop("cluster").write.mode("overwrite").parquet(_path(settings, "entities", step))
    placed = new.join(asked.select("cluster", "vector"), "cluster").filter(F.octet_length("vector") == settings.dim * 4)
    placed.select(F.col("id").cast("long").alias("id"), "indexer", "vector").write.mode("overwrite").parquet(_path(settings, "vectors", step))
    return new.select(F.col("cluster").alias("item"), "id", "indexer")


def reset_request(spark: SparkSession, settings: Settings, step: int) -> None:
    """Empty the read-write index: the steps from 0 up to `step` lose their entities, vectors, clusters and added golds."""
    for table in ("entities", "vectors", "clusters", "added"):
        for k in range(step + 1):
            spark.createDataFrame([], TABLES[table]).write.mode("overwrite").parquet(_path(settings, table, k))


def nil_request(records: DataFrame, weights: dict[str, float], intercept: float, threshold: float = nil.THRESHOLD, **quirks: bool) -> DataFrame:
    """NIL prediction over feature records: the records with their features filled, nil_score and is_nil.

    records as of nil.nil_features; weights name its feature columns. A missing feature gives no score, and so NIL.
    """
    filled = nil.nil_features(records, **quirks)
    return nil.decide(filled.withColumn("nil_score", nil.logistic(weights, intercept)), threshold=threshold)


def cluster_request(items: DataFrame, dim: int, kind: str = "greedy", threshold: float | None = None) -> DataFrame:
    """Clusters of requests, in the response form: cluster, title, n_elements, mentions, mentions_id, center.

    items: grp, item, mention, context, embeddings, encodings (base64; embeddings count, where they are
    null or empty the encodings). Items without a readable vector stay, but have no say in the center.
    """
    text = F.when(F.length("embeddings") > 0, F.col("embeddings")).otherwise(F.col("encodings"))
    held = cut(items.filter("item is not null").select("grp", "item", "mention", "context", from_base64(text).alias("vector")))
    labels = clustering.cluster_mentions(held, dim, kind, threshold)
    return clustering.package_clusters(cut(held.join(labels, "item")), "cluster", "item", "mention", held.select("item", "vector"), dim)
