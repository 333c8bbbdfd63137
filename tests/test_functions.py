from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import encoders, text
from moraine.functions.vectors import augment, clean_vectors, dot, from_base64, norm, norm_score, to_base64


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def words_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_similarities(spark):
    rng = random.Random(5)
    pairs = [("new york city", "New York"), ("", ""), (None, "x"), (" a\tb ", "a b")]
    pairs += [(" ".join(rng.choices("abcd", k=rng.randrange(7))), " ".join(rng.choices("abcd", k=rng.randrange(7)))) for _ in range(60)]
    long = [f"w{i}" for i in range(150)]
    pairs.append((" ".join(long), " ".join(long[3:] + ["zz"])))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", text.word_levenshtein("a", "b").alias("l"), text.multiset_jaccard("a", "b").alias("j")).collect():
        x, y = (r["a"] or "").lower().split(), (r["b"] or "").lower().split()
        assert r["l"] == pytest.approx(1 - words_distance(x, y) / max(len(x), len(y)) if x or y else 1.0)
        both = set(x) | set(y)
        hi = sum(max(x.count(w), y.count(w)) for w in both)
        assert r["j"] == pytest.approx(sum(min(x.count(w), y.count(w)) for w in both) / hi if hi else 1.0)


def test_mention_keys(spark):
    key = {m: one(spark, text.mention_key(F.lit(m)))[0] for m in ("US", "us", "Us", "Milan", "MILAN", "Milano", "Roma", "roma", "amor", "abc", "ABC")}
    assert len({key[m] for m in ("US", "us", "Us")}) == 3 and key["Milan"] == key["MILAN"] != key["Milano"]
    assert key["Roma"] == key["roma"] != key["amor"] and key["abc"] != key["ABC"]
    assert one(spark, text.mention_key(F.lit(None).cast("string")))[0] is None


def test_window_quotas(spark):
    arr = lambda n, p: F.array(*[F.lit(f"{p}{i}") for i in range(n)]) if n else F.array().cast("array<string>")
    got = one(spark, text.mention_window(arr(2, "l"), arr(4, "m"), arr(9, "r"), 16))[0]
    assert got == ["[CLS]", "l0", "l1", "m0", "m1", "m2", "m3", *[f"r{i}" for i in range(8)], "[SEP]"]
    assert one(spark, text.mention_window(arr(9, "l"), arr(2, "m"), arr(1, "r"), 8))[0] == ["[CLS]", "l6", "l7", "l8", "m0", "m1", "r0", "[SEP]"]
    assert one(spark, text.mention_window(arr(3, "l"), arr(4, "m"), arr(3, "r"), 6))[0][:6] == ["[CLS]", "m0", "m1", "m2", "m3", "[SEP]"]
    assert one(spark, text.mention_window(arr(0, "l"), arr(1, "m"), arr(0, "r"), 6))[0] == ["[CLS]", "m0", "[SEP]", "", "", ""]


def test_pair_functions(spark):
    arr = lambda n: F.array(*[F.lit(i) for i in range(n)])
    for a, b, room in ((5, 3, 6), (3, 5, 6), (4, 4, 5), (2, 2, 9), (9, 1, 2)):
        x, y = a, b
        while x + y > room:
            if x > y:
                x -= 1
            else:
                y -= 1
        assert tuple(one(spark, text.truncated_lengths(arr(a), arr(b), room))[0]) == (x, y)
    s = one(spark, text.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(1), F.lit(1), F.lit(0))))[0]
    assert sum(s) == pytest.approx(1) and s[2] < 1e-9 and s[1] > s[0]
    assert one(spark, text.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))))[0] == 1
    assert one(spark, text.search_escape(F.lit('A OR B: "x"')))[0] == 'A or B\\: \\"x\\"'
    assert one(spark, text.search_escape(F.lit("OR a \\+ b OR-2 AND AND")))[0] == "or a \\+ b OR\\-2 and and"
    assert one(spark, text.last_words(F.lit("a b  c"), 2), text.first_words(F.lit("EMPTYCTXT"), 3)) == ("b c", "")
    assert one(spark, text.quoted_aliases(F.array(F.lit("Ab c"), F.lit("🙂"))))[0] == '"Ab c"'
    assert one(spark, text.set_jaccard_distance(F.lit("a b"), F.lit("b c")))[0] == pytest.approx(2 / 3)
    assert one(spark, text.page_url(F.lit(5)), text.page_url(F.lit(-1))) == ("https://en.wikipedia.org/wiki?curid=5", "")


def test_vectors(spark):
    raw = np.array([1.5, -2.25], "<f4").tobytes()
    df = spark.createDataFrame([("AADAPwAAEMA=",), ("AADA\nPwAAEMA=",), ("",), (None,), ("!!",), ("AADAPw==",)], "t string")
    got = [r[0] for r in df.select(from_base64(F.col("t"))).collect()]
    assert bytes(got[0]) == bytes(got[1]) == raw and got[2:5] == [None] * 3 and len(got[5]) == 4
    assert spark.createDataFrame([(bytearray(raw),)], "b binary").select(to_base64(F.col("b"))).first()[0] == "AADAPwAAEMA="
    rows = [(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [0.0, -0.0]), (4, None), (5, [1.0]), (6, [1.0, None]), (7, [-0.0, 3.0])]
    kept = {r["i"]: np.frombuffer(r["v"], "<f4").tolist() for r in clean_vectors(spark.createDataFrame(rows, "i int, v array<float>"), "v", 2).collect()}
    assert kept == {1: [1.0, 2.0], 7: [0.0, 3.0]}
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, dot(a, b), norm(a), norm_score(dot(a, b), norm(a), norm(b)))[:3] == (3.0, 5.0, pytest.approx(0.12))
    assert one(spark, augment(b, 5.0))[0] == [1.0, 0.0, 2.0]


def test_encoder_hooks(spark):
    df = spark.createDataFrame([(1, "Alpha beta"), (2, None), (3, "Alpha beta")], "query long, t string")
    got = {r["query"]: r["vector"] for r in encoders.encode_mentions(df, lambda: encoders.hashing_encoder(16), "t").collect()}
    assert got[1] == got[3] and len(got[2]) == 16 and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-5)
    spans = encoders.annotate(spark.createDataFrame([(1, "We met Anna Berg in Rome."), (2, None)], "k int, t string"), "k", "t").collect()
    assert [r["mention"] for r in spans] == ["anna berg", "rome"]
    c = spark.createDataFrame([(1, 1, "ab", "x"), (1, 2, "ab", "xyz"), (1, 3, "ab", "y")], "query long, rank int, context string, title string")
    out = encoders.rerank(c, lambda: (lambda a, b: np.array([len(t) for t in b])), "context", "title").collect()
    assert {r["rank"]: r["cross_rank"] for r in out} == {2: 1, 1: 2, 3: 3}
