from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from moraine import session
from moraine.operators.ranking import running_max


def test_cut_results_can_be_released(spark):
    df = session.cut(spark.range(10))
    path = df._moraine_files.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 10
    session.release(df, None, spark.range(1))
    assert not os.path.isdir(path)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Sc:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isEmpty = lambda self: True
        getConf = lambda self: {}

    class Session:
        sparkContext = Sc()
        conf = {}

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_running_max_over_range_partitions(spark):
    rows = [(g, i, i if i % 3 == 0 else None) for g in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(4)
    got = {(r["g"], r["i"]): r["before"] for r in running_max(df, ["g"], [F.col("i")], "v").collect()}
    assert got == {(g, i): ((i - 1) // 3 * 3 if i else None) for g, i, _ in rows}
    assert running_max(df.limit(0), ["g"], [F.col("i")], "v").count() == 0
