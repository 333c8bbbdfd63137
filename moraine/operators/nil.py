"""NIL features, prediction, training and its measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.text import multiset_jaccard, word_levenshtein
from moraine.operators.ranking import grouped_median, hash_uniform, running_weight

THRESHOLD = 0.5


def score_statistics(rows: DataFrame, query: str, score: str) -> DataFrame:
    """Per query: n, max, second, secondiff, min, mean, median, stdev (sample) of its non-null scores.

    second and secondiff need two scores, stdev too; else null. second is the next in descending
    order, so equal to max on a tie. The two largest come from an aggregate, not a sort.
    """
    s = F.col(score)
    counted = rows.filter(s.isNotNull()).groupBy(query, s.alias("_s")).agg(F.count("*").alias("_c"))
    ranked = Window.partitionBy(query).orderBy(F.col("_s").desc())
    top = counted.withColumn("_r", F.row_number().over(ranked)).filter("_r <= 2")
    second = top.groupBy(query).agg(
        F.max("_s").alias("max"), F.max(F.when((F.col("_r") == 1) & (F.col("_c") > 1), F.col("_s")).when(F.col("_r") == 2, F.col("_s"))).alias("second")
    )
    main = rows.filter(s.isNotNull()).groupBy(query).agg(
        F.count("*").alias("n"), F.min(s).alias("min"), F.avg(s).alias("mean"),
        F.when(F.count("*") > 1, F.stddev_samp(s)).alias("stdev"),
    )
    middle = grouped_median(rows, [query], score)
    return main.join(second, query).join(middle, query).withColumn("secondiff", F.col("max") - F.col("second"))


def array_statistics(scores: str | Column) -> dict[str, Column]:
    """The same of an array in position order: secondiff is the first less the second element."""
    s = F.col(scores) if isinstance(scores, str) else scores
    n = F.size(s)
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
    ordered = F.array_sort(s)
    half = (n / 2).cast("int")
    median = F.when(n % 2 == 1, F.element_at(ordered, half + 1)).otherwise((F.element_at(ordered, F.greatest(half, F.lit(1))) + F.element_at(ordered, half + 1)) / 2)
    spread = F.sqrt(F.aggregate(F.transform(s, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / (n - 1))
    return {
        "mean": F.when(n > 0, mean), "median": F.when(n > 0, median), "stdev": F.when(n > 1, spread),
        "secondiff": F.when(n > 1, F.get(s, F.lit(0)) - F.get(s, F.lit(1))),
    }


def nil_features(records: DataFrame, keep_dummies: bool = False, zero_is_missing: bool = False) -> DataFrame:
    """Fill the feature columns of records with max_bi, max_cross, mention, title, jaccard, levenshtein, topcandidates.

    jaccard and levenshtein are computed where absent, unless both texts are null. mean, median,
    stdev and secondiff come from the scores of topcandidates (array of structs with score and,
    optionally, dummy). keep_dummies lets dummies of -1000 into the statistics, zero_is_missing
    treats a score of 0.0 as absent: both are how the published services behave, neither is meant.
    """
    texts = F.col("mention").isNotNull() | F.col("title").isNotNull()
    scores = F.col("topcandidates")
    if not keep_dummies:
        scores = F.filter(scores, lambda c: c["score"] > -1000.0)
    numbers = array_statistics(F.transform(scores, lambda c: c["score"]))
    out = records.withColumn("jaccard", F.coalesce("jaccard", F.when(texts, multiset_jaccard("mention", "title"))))
    out = out.withColumn("levenshtein", F.coalesce("levenshtein", F.when(texts, word_levenshtein("mention", "title"))))
    if zero_is_missing:
        for c in ("max_bi", "max_cross"):
            out = out.withColumn(c, F.when(F.col(c) != 0.0, F.col(c)))
    return out.withColumns(numbers)


def client_features(queries: DataFrame, cross: bool = False) -> DataFrame:
    """is_nil, max_bi, max_cross, title, topcandidates from mention and candidates (array, best first).

    Without a candidate is_nil is true and the features are null; else it is null, to be predicted.
    """
    empty = F.coalesce(F.size("candidates"), F.lit(-1)) <= 0
    first = F.get("candidates", F.lit(0))
    bi = first["bi_score"] if cross else first["score"]
    return queries.select(
        "*", F.when(empty, F.lit(True)).alias("is_nil"), F.when(~empty, bi).alias("max_bi"),
        F.when(~empty, first["score"] if cross else F.lit(None).cast("double")).alias("max_cross"), F.when(~empty, first["title"]).alias("title"),
        F.when(~empty, F.col("candidates")).alias("topcandidates"),
    )


def logistic(weights: dict[str, float], intercept: float) -> Column:
    """P(not NIL) of a fitted model as an expression; null if a feature is null."""
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + F.lit(w) * F.col(name)
    return 1 / (1 + F.exp(-z))


def decide(df: DataFrame, score: str = "nil_score", threshold: float = THRESHOLD) -> DataFrame:
    """is_nil: the score lies strictly below the threshold; a null score (no candidates) counts as 0."""
    return df.withColumn("is_nil", F.coalesce(F.col(score), F.lit(0.0)) < threshold)


def undersample(df: DataFrame, label: str, key: str, seed: int = 1234) -> DataFrame:
    """All rows of label 0 and as many of label 1, chosen by least hash of the key (all, if there are fewer)."""
    zeros = df.filter(F.col(label) == 0).count()
    ones = df.filter(F.col(label) == 1).withColumn("_u", hash_uniform(seed, F.col(key))).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    placed = running_weight(ones, ["_all"], [F.col("_u"), F.col(key)], "_one", "_before").filter(F.col("_before") < zeros)
    return df.filter(F.col(label) == 0).unionByName(placed.drop("_u", "_all", "_one", "_before"))


def fit_nil_model(train: DataFrame, features: Sequence[str], label: str, undersampled: bool = False, key: str | None = None) -> PipelineModel:
    """Standardised logistic regression with an L2 penalty of 1 / (2 n), on rows with every feature present."""
    rows = train.dropna(subset=[*features, label])
    if undersampled:
        rows = undersample(rows, label, key or features[0])
    n = rows.count()
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
            LogisticRegression(featuresCol="_std", labelCol=label, elasticNetParam=0.0, standardization=False, regParam=1.0 / max(1, n), maxIter=200, probabilityCol="_p"),
        ]
    ).fit(rows)


# fixed values: the tasks of the published ablation; a name lists its features, "under" balances the classes first
ABLATION_TASKS = """
nilp_bi_max nilp_under_bi_max nilp_under_bi_max_secondiff nilp_bi_max_secondiff
nilp_under_bi_max_secondiff_levenshtein_jaccard nilp_bi_max_secondiff_levenshtein_jaccard
nilp_under_bi_max_levenshtein nilp_under_bi_max_jaccard nilp_under_bi_max_stdev10 nilp_under_bi_max_stats10
nilp_under_bi_max_levenshtein_jaccard nilp_bi_max_levenshtein_jaccard nilp_under_bi_max_stdev_levenshtein
nilp_under_bi_max_stdev_jaccard nilp_under_bi_max_stdev_levenshtein_jaccard nilp_under_bi_max_stats10_levenshtein
nilp_under_bi_max_stats10_jaccard nilp_under_bi_max_stats10_levenshtein_jaccard nilp_bi_max_stats10_levenshtein_jaccard
"""
FEATURES_OF = {"max": ["max"], "stdev10": ["stdev"], "stats10": ["mean", "median", "stdev"]}


def task_features(name: str) -> tuple[bool, list[str]]:
    """Whether a task balances the classes, and its features, from its name."""
    parts = name.removeprefix("nilp_").split("_")
    return "under" in parts, [f for p in parts if p not in ("under", "bi") for f in FEATURES_OF.get(p, [p])]


def ablation_table(train: DataFrame, test: DataFrame, tasks: Sequence[str] = tuple(ABLATION_TASKS.split()), key: str = "query") -> DataFrame:
    """A row per task: name, the rows of train and test with all its features, and the measures of ablation_measures.

    train, test: key, labels, the features, and baseline and correct (0/1: the best candidate is the
    gold; of test). Each task fits one model on its rows; the loop is over tasks, not over data.
    """
    out, size = None, test.count()
    for name in tasks:
        under, features = task_features(name)
        model = fit_nil_model(train, features, "labels", under, key)
        scored = predict_nil(model, test, features, "_p1").filter(F.col("_p1").isNotNull())
        row = ablation_measures(scored, "_p1", "labels", "baseline", "correct", size)
        row = row.withColumn("name", F.lit(name)).withColumn("train_rows", F.lit(train.dropna(subset=[*features, "labels"]).count()))
        out = row if out is None else out.unionByName(row)
    return out


def predict_nil(model: PipelineModel, df: DataFrame, features: Sequence[str], score: str = "nil_score") -> DataFrame:
    """P(not NIL) for rows with every feature, null for others; all rows stay."""
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    scored = model.transform(df.filter(whole)).withColumn(score, vector_to_array("_p")[1]).select(*df.columns, score)
    return scored.unionByName(df.filter(~whole).withColumn(score, F.lit(None).cast("double")))


def binary_measures(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: tn, fp, fn, tp, precision, recall, f1 and support of either class, accuracy, macro and weighted means.

    truth and guess are boolean; rows where either is null do not count. An undefined ratio is 0.
    """
    t, g = F.col(truth), F.col(guess)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    base = df.filter(t.isNotNull() & g.isNotNull()).agg(
        count(~t & ~g).alias("tn"), count(~t & g).alias("fp"), count(t & ~g).alias("fn"), count(t & g).alias("tp")
    )
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = base.withColumns(
        {
            "precision_1": safe(tp, tp + fp), "recall_1": safe(tp, tp + fn), "support_1": tp + fn,
            "precision_0": safe(tn, tn + fn), "recall_0": safe(tn, tn + fp), "support_0": tn + fp,
            "accuracy": safe(tp + tn, tn + fp + fn + tp),
        }
    )
    for k in ("1", "0"):
        p, r = F.col(f"precision_{k}"), F.col(f"recall_{k}")
        out = out.withColumn(f"f1_{k}", safe(2 * p * r, p + r))
    for m in ("precision", "recall", "f1"):
        a, b = F.col(f"{m}_1"), F.col(f"{m}_0")
        out = out.withColumn(f"macro_{m}", (a + b) / 2).withColumn(f"weighted_{m}", safe(a * F.col("support_1") + b * F.col("support_0"), F.col("support_1") + F.col("support_0")))
    return out


def normalized_confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Shares of each true class: tn, fp (of false), fn, tp (of true); 0 for a class that does not occur."""
    m = binary_measures(df, truth, guess)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    f, t = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return m.select(safe(F.col("tn"), f).alias("tn"), safe(F.col("fp"), f).alias("fp"), safe(F.col("fn"), t).alias("fn"), safe(F.col("tp"), t).alias("tp"))


def ablation_measures(df: DataFrame, probability: str, label: str, baseline: str, correct: str, original_size: int) -> DataFrame:
    """One row: measures of a NIL task, in per cent to one decimal.

    baseline and correct are 0/1 columns: linked right without, and the entity right with, a NIL
    model. acc, f1_0, f1_1, macro_f1 of the half-even rounded prediction; acc_adjusted over the
    original size; acc_correcting: right predictions that also name the right entity or NIL; oracle_*
    the same over rows with p <= 0.25 or p >= 0.75; to_validator: the share of the other rows.
    """
    p, y = F.col(probability), F.col(label)
    guess = F.bround(p).cast("int")
    sure = (p <= 0.25) | (p >= 0.75)
    right = (guess == y).cast("int")
    named = F.when(guess == 1, F.col(correct)).otherwise((y == 0).cast("int"))

    def f1(k: int, where: Column) -> Column:
        n = lambda c: F.sum((c & where).cast("int"))
        tp, fp, fn = n((guess == k) & (y == k)), n((guess == k) & (y != k)), n((guess != k) & (y == k))
        return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)

    every = F.lit(True)
    cent = lambda c: F.round(c * 100, 1)
    return df.filter(p.isNotNull() & y.isNotNull()).agg(
        F.count("*").alias("size"), cent(F.avg(F.col(baseline))).alias("baseline"), cent(F.avg(right)).alias("acc"),
        cent(F.sum(right) / original_size).alias("acc_adjusted"), cent(F.avg(named)).alias("acc_correcting"),
        cent(f1(0, every)).alias("f1_0"), cent(f1(1, every)).alias("f1_1"), cent((f1(0, every) + f1(1, every)) / 2).alias("macro_f1"),
        cent(F.avg(F.when(sure, right))).alias("oracle_acc"), cent((f1(0, sure) + f1(1, sure)) / 2).alias("oracle_macro_f1"),
        cent(1 - F.avg(sure.cast("int"))).alias("to_validator"),
    )


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, descending, from counts per score."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )
    counts = counts.withColumn("_all", F.lit(0))
    up = running_weight(running_weight(counts, ["_all"], [F.col("threshold").desc()], "pos", "tp0"), ["_all"], [F.col("threshold").desc()], "neg", "fp0")
    total = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return up.crossJoin(F.broadcast(total)).select(  # one row
        "threshold", F.when(F.col("n") > 0, (F.col("fp0") + F.col("neg")) / F.col("n")).alias("fpr"), F.when(F.col("p") > 0, (F.col("tp0") + F.col("pos")) / F.col("p")).alias("tpr")
    )


def density_points(df: DataFrame, score: str, label: str, low: float, high: float, points: int, bandwidth: float) -> DataFrame:
    """label, at, density: a Gaussian kernel density of the score of each label on an even grid.

    Scores are counted per value to twelve digits first, so the grid meets distinct values only; rows
    with a null score or label do not count.
    """
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), F.round(score, 12).alias("_s")).agg(F.count("*").alias("_w"))
    step = (high - low) / max(1, points - 1)
    grid = counts.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.lit(low) + F.col("_g") * step)
    z = (F.col("at") - F.col("_s")) / bandwidth
    sums = grid.groupBy("label", "at").agg((F.sum(F.col("_w") * F.exp(-0.5 * z * z)) / F.sum("_w") / (bandwidth * (2 * math.pi) ** 0.5)).alias("density"))
    return sums
