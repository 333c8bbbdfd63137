"""Session settings, lineage cuts and table access shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster, the submitter's settings are used instead."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in spark.checkpoint.dir. Where that is unset, a local master gets a private
    folder of its one machine, and a cluster is an error, as executors would not share such a folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="moraine-checkpoint-"))


def scratch(spark: SparkSession) -> str:
    """A new folder name inside the shared checkpoint folder, for tables written and read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"


def release(*frames: DataFrame | None) -> None:
    """Delete the files of results of cut() that nothing will read any more, so that rounds do not pile up on disk."""
    for df in frames:
        path = getattr(df, "_moraine_files", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the reliable checkpoint folder, so that a lost executor costs no recomputation.

    The result forgets its size estimate as well as its lineage: estimates of joins multiply, and over
    the rounds of an iterative operator they would grow to numbers that the planner cannot handle. The
    joins over it start as shuffles, and adaptive execution turns those of small sides into broadcasts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    spark = df.sparkSession
    plain = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    out = DataFrame(plain, spark)
    files = done._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    out._moraine_files = files.get() if files.isDefined() else None
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, read with the wanted columns only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
