from __future__ import annotations

import numpy as np

from moraine.functions.encoders import hashing_encoder
from moraine.operators import kb
from moraine.operators import legacy as L
from moraine.streaming.linking import link_text


def test_text_to_links(spark):
    names = ["anna berg", "rome", "oslo"]
    vectors = spark.createDataFrame([(i, 10, [float(x) for x in v]) for i, v in enumerate(hashing_encoder(32)(names))], "id long, indexer int, vector array<float>")
    entities = spark.createDataFrame([(i, 10, 50 + i, None, None, n, None, None) for i, n in enumerate(names)], kb.ENTITY_SCHEMA)
    texts = spark.createDataFrame([(1, "We met Anna Berg in Rome with Xqwz."), (2, None)], "key long, text string")
    kw = dict(weights=(("best", 10.0),), intercept=-8.0)
    got = {r["mention"]: r for r in link_text(texts, vectors, entities, lambda: hashing_encoder(32), 32, **kw).collect()}
    assert set(got) == {"anna berg", "rome", "xqwz"}
    assert got["anna berg"]["candidates"][0]["wikipedia_id"] == 50 and not got["rome"]["is_nil"] and got["xqwz"]["is_nil"]
    back = link_text(texts, vectors, entities, lambda: hashing_encoder(32), 32, cross=lambda: (lambda a, b: np.array([t == "oslo" for t in b])), **kw)
    assert all(r["candidates"][0]["title"] == "oslo" for r in back.collect())


def test_enrichment_and_labels(spark):
    s = spark.createDataFrame([("d", 0, "A b."), ("d", 1, "C d.")], "doc string, pos int, text string")
    m = spark.createDataFrame([("d", 1, "X OR Y", "EMPTYCTXT", "w1 w2", 7), ("d", 0, "z", None, "", None)], "doc string, pos int, mention string, context_left string, context_right string, gold long")
    r = L.enrich_mentions(m, s).collect()
    assert len(r) == 1 and (r[0]["query_mention"], r[0]["left_25"], r[0]["right_10"], r[0]["previous"], r[0]["next"]) == ("X or Y", "", "w1 w2", "A b.", "")
    local = spark.createDataFrame([(7, 3), (7, 2)], "wikipedia_id long, local_id int")
    rows = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "q int, gold long")
    assert [(x["q"], x["label_id"]) for x in L.map_labels(rows, local).collect()] == [(1, 2)]
    assert {x["q"]: x["label_id"] for x in L.map_labels(rows, local, True).collect()} == {1: 2, 2: -1, 3: -1}
    c = spark.createDataFrame([(1, 5, [4, 5]), (2, 9, [4])], "q int, label_id int, nns array<int>")
    assert [(x["q"], x["label"]) for x in L.gold_among_candidates(c).collect()] == [(1, 1)]
    assert {x["q"]: x["label"] for x in L.gold_among_candidates(c, True).collect()} == {1: 1, 2: 0}
    ms = spark.createDataFrame([("d", 0, 5, "b"), ("d", 0, 1, "a")], "doc string, pos int, start int, mention string")
    assert {x["pos"]: x["mentions"] for x in L.mention_sentences(ms, s).collect()} == {0: ["a", "b"], 1: []}


def test_word_context_vectors(spark):
    w = spark.createDataFrame([("d", i, c) for i, c in enumerate("abcde")], "doc string, at int, word string")
    v = spark.createDataFrame([(c, [float(i), 1.0]) for i, c in enumerate("abcd")], "word string, vector array<double>")
    m = spark.createDataFrame([(1, "d", 3), (2, "none", 0)], "item long, doc string, at int")
    got = [tuple(r) for r in L.word_context_vectors(m, w, v, window=1, head=2).collect()]
    assert [(i, [round(x, 9) for x in vec]) for i, vec in got] == [(1, [round(0.6 * 2.5 + 0.4 * 0.5, 9), 1.0])]


def test_each_mention_text_is_encoded_once(spark, tmp_path):
    def make():
        plain = hashing_encoder(32)

        def encode(texts):
            with open(tmp_path / "seen", "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return plain(texts)

        return encode

    texts = spark.createDataFrame([(i, "We saw New York and Old Rome.") for i in range(20)], "key long, text string")
    entities = spark.createDataFrame([(i, 10, i + 1, t, "x") for i, t in enumerate(("New York", "Old Rome", "Oslo"))], "id int, indexer int, wikipedia_id int, title string, type_ string")
    vectors = spark.createDataFrame([(i, 10, [float(x) for x in hashing_encoder(32)([t])[0]]) for i, t in enumerate(("New York", "Old Rome", "Oslo"))], "id long, indexer int, vector array<float>")
    got = link_text(texts, vectors, entities, make, 32, 2, tagger=lambda t: [(7, 15), (20, 28)]).collect()
    assert len({r["query"] for r in got}) == len(got) == 40
    assert all(r["candidates"][0]["title"].lower() == r["mention"] and len(r["candidates"]) == 2 for r in got)
    # a plan may run the encoder again, but never over each occurrence
    assert (tmp_path / "seen").read_text().count("new york") < 20
