from __future__ import annotations

import os
import random

import numpy as np
import pytest

from moraine.llm.mixing import fill, mix_sources, permute, shard_counts, split_counts
from moraine.llm.tokens import DEFAULT_FOLDER, VOCABULARY, Encoder, encode_texts, load_merges, token_counts

FILE = os.path.join(DEFAULT_FOLDER, VOCABULARY)
needs_file = pytest.mark.skipif(not os.path.isfile(FILE), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def texts_of(n):
    rng = random.Random(8)
    odd = [chr(c) for c in [*range(0x250), 0x1C, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x4E2D, 0x1F600, 0x301, 0x660]]
    some = ["".join(rng.choice(odd if rng.random() < 0.5 else "aab \n'stre12") for _ in range(rng.randrange(50))) for _ in range(n)]
    return [*some, "a" * 4000, "ab" * 2000, "<|endoftext|> x", " " * 2000 + "x", "", None, "don't we'll I'd", "1234567" * 30]


@needs_file
def test_ids_equal_the_library(reference):
    texts = texts_of(2000)
    flat, at = Encoder(load_merges(FILE)).encode(texts)
    for i, want in enumerate(reference(texts)):
        assert flat[at[i] : at[i + 1]].tolist() == want


@needs_file
def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr("moraine.llm.tokens.MEMORY_WORDS", 5)
    e = Encoder(load_merges(FILE))
    a = [e.encode([f"word{i} and more {i}"])[0].tolist() for i in range(30)]
    assert a == [e.encode([f"word{i} and more {i}"])[0].tolist() for i in range(30)] and len(e.index) < 30


@needs_file
def test_whole_table(spark, reference):
    texts = texts_of(50)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, *texts[:5]])], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_texts(df, "doc_id", "text").collect()}
    assert got == dict(enumerate(reference([*texts, *texts[:5]])))
    counts = {r["doc_id"]: r["tokens"] for r in token_counts(df, "text", ["doc_id"]).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_permutation():
    for size in (1, 2, 3, 17, 256, 1000):
        for key in (1, 99):
            got = permute(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(got) == list(range(size))
    assert permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)).tolist() != permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2)).tolist()


def test_shard_counts_respect_caps():
    aims = fill(np.array([0.5, 0.5, 0.1]), np.array([10**9, 300, 0]), 10_000)
    assert aims.tolist() == [9700, 300, 0]
    counts = shard_counts(aims, np.array([10**9, 300, 0]), 8, 1)
    assert counts.sum() == 10_000 and counts.shape == (8, 3) and 250 < counts[:, 1].sum() <= 300 and (counts[:, 1] > 10).all()
    assert fill(np.array([0.7, 0.3]), np.array([10, 10]), 100).tolist() == [10, 10] and fill(np.array([0.0]), np.array([5]), 9).tolist() == [0]
    assert fill(np.array([0.7, 0.2, 0.1]), np.array([700, 100, 0]), 1000, "shrink") == pytest.approx([350, 100, 0])
    dealt = split_counts(np.array([1000, 0, 37]), 10, np.random.default_rng(3))
    assert dealt.sum(0).tolist() == [1000, 0, 37] and set(dealt.sum(1)) <= {103, 104}


@pytest.mark.parametrize("lack", ["spread", "shrink"])
def test_shares_follow_the_aims(spark, lack):
    docs = [(i, "abcd"[i % 4], 400) for i in range(4000)]
    want = {"a": (0.4, 1), "b": (0.3, 2), "c": (0.2, 1), "d": (0.1, 1)}
    pieces, report = mix(spark, docs, [(k, w, m) for k, (w, m) in want.items()], block_tokens=100, slots_per_shard=500, lack=lack)
    assert not report["a"]["reached"] and report["b"]["reached"]
    noise = 4 * (0.25 / (sum(r["used"] for r in report.values()) / 100)) ** 0.5
    for k, (w, _) in want.items():
        assert abs(report[k]["actual_share"] - report[k]["aimed_share"]) < noise
        assert report[k]["aimed_share"] == pytest.approx(w) if lack == "shrink" else report["b"]["aimed_share"] > 0.3
        assert report[k]["met"] == (lack == "shrink" or k != "a")
    per = {}
    for p in pieces:
        per.setdefault(p["shard"], set()).add((p["source"], p["place"]))
    assert sum(len(x) for x in per.values()) == (16_000 if lack == "spread" else 10_000) and max(len(x) for x in per.values()) <= 501


def mix(spark, docs, weights, **kw):
    m, r = mix_sources(spark.createDataFrame(docs, "doc_id long, source string, tokens long"), spark.createDataFrame(weights, "source string, target_share double, max_repeats int"), **kw)
    return m.collect(), {x["source"]: x for x in r.collect()}


def test_mix_shares_and_repeats(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["big", "big", "big", "small", None, "other"]), rng.choice([0, 1, 50, 700, None])) for i in range(900)]
    docs += docs[:30] + [(5000, "big", 40_000), (5001, "small", -3), (None, "big", 10)]
    size = {}
    for i, s, t in docs:
        if i is not None:
            size[i] = (s, max(0, t or 0))
    pieces, report = mix(spark, docs, [("big", 0.7, 1), ("small", 0.25, 2), ("gone", 0.05, 4), (None, 0.1, 1)], block_tokens=64, slots_per_shard=100)
    total = sum(t for s, t in size.values() if s in ("big", "small"))
    for name, share, most in (("big", 0.7, 1), ("small", 0.25, 2), ("gone", 0.05, 4)):
        own = sum(t for s, t in size.values() if s == name)
        assert (report[name]["tokens"], report[name]["capacity"]) == (own, own * most)
        assert report[name]["reached"] == (own * most >= share * total) and report[name]["used"] <= own * most
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    uses = {}
    for p in pieces:
        assert size[p["doc_id"]][0] == p["source"] and 0 <= p["first_token"] and p["first_token"] + p["n_tokens"] <= size[p["doc_id"]][1]
        for t in range(p["first_token"], p["first_token"] + p["n_tokens"]):
            uses[(p["doc_id"], t)] = uses.get((p["doc_id"], t), 0) + 1
    assert max(n for (d, _), n in uses.items() if size[d][0] == "big") == 1 and max(uses.values()) <= 2
    assert len({(p["source"], p["pass"], p["block"]) for p in pieces}) == len({(p["source"], p["place"]) for p in pieces})


def test_mix_of_nothing(spark):
    pieces, report = mix(spark, [], [("a", 1.0, 2)])
    assert pieces == [] and report["a"]["tokens"] == 0 and report["a"]["reached"]
    pieces, report = mix(spark, [(1, "a", 5)], [])
    assert pieces == [] and report == {}
