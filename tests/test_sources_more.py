from __future__ import annotations

from moraine.operators import kb_etl as K
from moraine.operators import legacy as L
from moraine.sources import files as S


def test_conll_sentences_and_alignment(spark, tmp_path):
    rows = ["-DOCSTART- (d1 x)", "The\tO", "New\tB\tNew York\tt\tNY\t1", "York\tI\tNew York\tt\tNY\t1", ".", "", "Rome\tB\tRome\tt\tRM\t2", "", "-DOCSTART- (d2 x)", "U.S.\tB\tU.S.\tt\tUS\t3"]
    (tmp_path / "c.txt").write_text("\n".join(rows))
    tokens, marked = S.read_conll_sentences(spark, str(tmp_path / "c.txt"))
    assert [(r["sent"], r["pos"], r["token"]) for r in tokens.filter("doc = 'd1'").orderBy("sent", "pos").collect()] == [(0, 0, "The"), (0, 1, "New"), (0, 2, "York"), (0, 3, "."), (1, 0, "Rome")]
    got = {(r["doc"], r["number"]): (r["sent"], r["start"], r["end"], r["text"], r["entity"]) for r in marked.collect()}
    assert got == {("d1", 1): (0, 1, 3, "New York", "NY"), ("d1", 2): (1, 0, 1, "Rome", "RM"), ("d2", 1): (0, 0, 1, "U.S.", "US")}
    ours = spark.createDataFrame([("d1", 1, "ROME"), ("d1", 2, "New York"), ("d2", 1, "US"), ("d3", 1, "x")], "doc string, item long, mention string")
    assert {tuple(r) for r in S.align_mentions(ours, marked).collect()} == {("d1", 1, 2), ("d2", 1, 1)}


def test_anchors_by_xml_and_by_pattern(spark):
    rows = [(1, 'a <a href="x%20y">T </a> <b>q</b> <a href="z">U v</a>'), (2, "bad <a class=k href='q'>x</a> <br> <a href=w>y\nz</a>"), (3, None), (4, "plain & text"), (5, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = sorted((r["k"], r["pos"], r["href"], r["text"], r["from_xml"]) for r in K.page_anchors(df, "k", "t").collect())
    assert got[:2] == [(1, 0, "x y", "T", True), (1, 1, "z", "U v", True)]
    assert [g for g in got if g[0] == 2] == [(2, 0, "w", "y\nz", False)] or [g[2] for g in got if g[0] == 2] == ["q", "w"]


def test_windows_stay_inside_the_text(spark):
    from pyspark.sql import functions as F

    def clamp(at, n, window):
        half = round(window / 2)
        a, b, last = at - half, at + half, n - 1
        if a < 0:
            a, b = 0, min(b - a, last)
        if b > last:
            a, b = max(0, a - b + last), last
        return a, b

    cases = [(i, n, w) for n in (1, 5, 20) for i in range(n) for w in (4, 7, 64)]
    df = spark.createDataFrame(cases, "i int, n int, w int")
    for w in (4, 7, 64):
        got = df.filter(f"w = {w}").select("i", "n", K.window_bounds(F.col("i"), F.col("n"), w).alias("b")).collect()
        assert all((r["b"]["first"], r["b"]["last"]) == clamp(r["i"], r["n"], w) for r in got)


def test_coreference_equals_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    names = ["ann", "ann lee", "mary ann lee", "lee", "o'lee", "bob", "bob lee"]
    rows = [(d, 100 * d + i, rng.choice(names)) for d in (1, 2) for i in range(9)]
    m = spark.createDataFrame(rows, "doc long, item long, mention string")
    c = spark.createDataFrame([(i, n, 1.0) for _, i, n in rows], "item long, entity string, p double")
    persons = ["ann lee", "mary ann lee", "bob lee"]
    want = {}
    for d, i, n in rows:
        longer = [x for e, _, x in rows if e == d and x in persons and len(x) > len(n) and f" {n.replace(chr(39), ' ')} " in f" {x} "]
        for key, part in itertools.groupby(sorted(longer)):
            want[i, key] = len(list(part)) / len(longer)
        if not longer:
            want[i, n] = 1.0
    got = {(r["item"], r["entity"]): r["p"] for r in L.coreference(m, c, spark.createDataFrame([(p,) for p in persons], "entity string")).collect()}
    assert got == want
