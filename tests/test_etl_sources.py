from __future__ import annotations

import bz2
import gzip
import json
import sqlite3

from pyspark.sql import functions as F

from moraine.operators import kb_etl as K
from moraine.operators import legacy as L
from moraine.sources import files, sqlite


def test_documents_and_links(spark, tmp_path):
    body = "Rome\n\nRome is old. It has <a href=\"Tiber%20River\">the Tiber</a> and <a href=Milan>Milan</a>.\nSection::::History\nMore text here."
    (tmp_path / "wiki").write_text(f'<doc id="5" url="https://x?curid=5" title="Rome">\n{body}\n</doc>\n<doc id="6" url="u" title="Empty">\n</doc>\n')
    docs = {r["page_id"]: r for r in files.read_doc_dump(spark, str(tmp_path / "wiki")).collect()}
    assert docs[5]["title"] == "Rome" and docs[5]["text"] == body and docs[6]["text"] == ""
    df = spark.createDataFrame([(5, "Rome", body), (6, "Empty", ""), (7, None, None)], "page_id long, title string, text string")
    links = [tuple(r)[0:2] + (r["href"], r["text"]) for r in K.anchors(df, "page_id", "text").collect()]
    assert links == [(5, 0, "Tiber River", "the Tiber"), (5, 1, "Milan", "Milan")]
    got = {r["page_id"]: r for r in df.select("page_id", K.intro_sentences("text", "title").alias("s"), K.token_count("text").alias("n"), F.size(K.intro_lines("text")).alias("i")).collect()}
    assert got[5]["s"][0] == "Rome is old." and len(got[5]["s"]) == 2 and got[5]["n"] == len(" ".join(x for x in body.split("\n") if x).split(" ")) and got[5]["i"] == 3
    assert got[6]["s"] == [] and got[7]["n"] == 0
    wide = K.sentence_columns(df.select("page_id", K.intro_sentences("text", "title").alias("s")), "s", 3).filter("page_id = 5").first()
    assert wide["sent_desc_1"] == "Rome is old." and wide["sent_desc_3"] is None
    w = K.wiki_links(spark.createDataFrame([(1, "a [[B c|d]] e [[F]]")], "k int, t string"), "k", "t")
    assert [(r["pos"], r["target"], r["text"]) for r in w.collect()] == [(0, "B c", "d"), (1, "F", "F")]
    keep = K.indexable(spark.createDataFrame([("A", "one two three"), ("B (disambiguation)", "x y z"), ("C", "C may refer to: x")], "title string, text string"), 2)
    assert [r["title"] for r in keep.collect()] == ["A"]


def test_counts_and_mappings(spark):
    links = spark.createDataFrame([("New_York",), ("new york",), ("Rome",), ("rome",), ("?",)], "target string")
    titles = spark.createDataFrame([(1, "New York"), (2, "Rome"), (3, "Oslo")], "id long, title string")
    assert {r["id"]: r["n_links"] for r in K.incoming_links(links, titles).collect()} == {1: 1, 2: 2, 3: 0}
    pages = spark.createDataFrame([(1, "a", 10), (2, "zz", 20), (3, None, None)], "page long, title string, wikipedia_id long")
    mapping = spark.createDataFrame([("a", 99, "Q1"), ("b", 20, "Q2"), (None, None, "Q9")], "title string, wikipedia_id long, wikidata_id string")
    assert {r["page"]: r["wikidata_id"] for r in K.link_by_title_then_id(pages, mapping).collect()} == {1: "Q1", 2: "Q2", 3: None}


def test_json_dump(spark, tmp_path):
    item = {"id": "Q1", "sitelinks": {"enwiki": {"title": "A"}, "enwikiquote": {"title": "AQ"}}, "aliases": {"en": [{"value": "x"}]}, "labels": {"en": {"value": "l"}}, "descriptions": {}}
    other = {"id": "Q2", "sitelinks": {"dewiki": {"title": "B"}}}
    with bz2.open(tmp_path / "dump.bz2", "wt") as f:
        f.write("[\n" + json.dumps(item) + ",\n" + json.dumps(other) + "\n]\n")
    got = K.wikidata_items(files.read_json_dump(spark, str(tmp_path / "dump.bz2"))).collect()
    assert [(r["id"], r["title"], r["aliases"], r["wikidata_label"], r["description"], r["enwikiquote_title"]) for r in got] == [("Q1", "A", ["x"], "l", None, "AQ")]


def test_files_in_order(spark, tmp_path):
    with gzip.open(tmp_path / "c.gz", "wt") as f:
        f.writelines(json.dumps({"idx": f"curid={i}", "title": f"t{i}", "text": "x"}) + "\n" for i in range(50))
    got = files.read_catalogue(spark, str(tmp_path / "c.gz")).orderBy("line_no").collect()
    assert [r["title"] for r in got] == [f"t{i}" for i in range(50)] and [r["line_no"] for r in got] == list(range(50))
    (tmp_path / "m.json").write_text(json.dumps({"ex_id": 3, "word": "w", "wikiId": 9}) + "\nnot json\n")
    m = files.rename_mentions(files.read_jsonl(spark, str(tmp_path / "m.json"), files.MENTION_SCHEMA)).filter("query_id is not null").first()
    assert (m["query_id"], m["mention"], m["Wikipedia_ID"]) == (3, "w", 9)
    files.write_batches(spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "a int, batch int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "batch=1")).count() == 2
    files.write_report(spark.createDataFrame([(1, 0.5)], "batch int, r double"), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).first()["r"] == "0.5"


def test_token_files_and_dictionary(spark, tmp_path):
    lines = ["-DOCSTART- (1)", "EU\tB\tEU\tEuropean_Union", "rejects", "New\tB\tNew York\tNYC", "York\tI\tNew York\tNYC", "", "-DOCSTART- (2)", "Rome\tB\tRome\tRome"]
    (tmp_path / "conll").write_text("\n".join(lines) + "\n")
    got = [tuple(r) for r in files.read_conll(spark, str(tmp_path / "conll")).orderBy("doc", "start").collect()]
    assert got == [(0, 0, "EU", "European_Union"), (0, 2, "New York", "NYC"), (1, 0, "Rome", "Rome")]
    (tmp_path / "pem").write_text("Rome\t10\t1,0.9,Rome_city\t2,0.1,Rome, Georgia\nempty\t0\n")
    d = files.read_mention_dictionary(spark, str(tmp_path / "pem"))
    assert {tuple(r) for r in d.collect()} == {("Rome", "Rome_city", 0.9), ("Rome", "Rome, Georgia", 0.1)}
    m = spark.createDataFrame([(1, "Rome"), (2, "rome"), (3, "ROME"), (4, "x")], "item long, mention string")
    assert {(r["item"], r["entity"]) for r in L.dictionary_lookup(m, d).collect()} == {(i, e) for i in (1, 2, 3) for e in ("Rome_city", "Rome, Georgia")}
    (tmp_path / "train").write_text("\n".join(json.dumps({"query": f"q{i}", "candidate": "c", "neg": i % 2}) for i in range(20)))
    t = files.read_training_lines(spark, str(tmp_path / "train"), sample=7)
    assert t.count() == 7 and {(r["neg"], r["target"]) for r in files.read_training_lines(spark, str(tmp_path / "train")).collect()} == {(0, 1), (1, 0)}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "map.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE mapping (wikipedia_id INTEGER, wikipedia_title TEXT, wikidata_id TEXT)")
        db.executemany("INSERT INTO mapping VALUES (?, ?, ?)", [(i, f"t{i}", None if i % 9 == 0 else f"Q{i}") for i in range(100)])
        db.execute("CREATE TABLE bare (a INTEGER)")
    df = sqlite.read_sqlite(spark, path, "mapping", "wikipedia_title string, wikidata_id string", 4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100 and df.filter("wikidata_id is null").count() == 12
    assert sqlite.read_sqlite(spark, path, "bare", "a int").count() == 0


def test_lexical_and_coreference(spark):
    e = spark.createDataFrame([(1, "red house", "old", 0), (2, "house", "red", 90), (3, None, None, None)], "id long, title string, descr string, links long")
    got = {(r["query"], r["rank"]): r["id"] for r in L.lexical_candidates(spark.createDataFrame([(7, "Red HOUSE house"), (8, "zzz"), (9, None)], "query long, text string"), e, 2).collect()}
    assert set(got) == {(7, 1), (7, 2)} and set(got.values()) == {1, 2}
    m = spark.createDataFrame([("d", 1, "John Smith"), ("d", 2, "Smith"), ("d", 3, "Smithson"), ("e", 4, "Smith")], "doc string, item long, mention string")
    c = spark.createDataFrame([(1, "JS", 0.8), (1, "X", 0.2), (2, "Town", 1.0), (3, "S", 1.0), (4, "Town", 1.0)], "item long, entity string, p double")
    out = {(r["item"], r["entity"]): r["p"] for r in L.coreference(m, c, spark.createDataFrame([("JS",)], "entity string")).collect()}
    assert out == {(1, "JS"): 0.8, (1, "X"): 0.2, (2, "JS"): 0.8, (2, "X"): 0.2, (3, "S"): 1.0, (4, "Town"): 1.0}


def test_oracle_chain_and_sentences(spark):
    df = spark.createDataFrame([(1, 2, [("a",), ("b",), ("c",)]), (2, -1, [("a",)]), (3, 3, [("a",), ("b",), ("c",)])], "q int, gold_rank int, candidates array<struct<t string>>")
    got = L.correct_candidates(df).collect()
    assert [(r["q"], [x["t"] for x in r["candidates"]]) for r in got] == [(1, ["b", "c", "c"])]
    s = spark.createDataFrame([("d", i, f"s{i}") for i in range(3)], "doc string, pos int, text string")
    assert {r["pos"]: (r["previous"], r["next"]) for r in L.sentence_neighbours(s).collect()} == {0: ("", "s1"), 1: ("s0", "s2"), 2: ("s1", "")}
    assert {r["pos"]: r["previous"] for r in L.sentence_neighbours(s, quirk=True).collect()} == {0: "", 1: "", 2: "s1"}
    seen, unseen = L.seen_split(spark.createDataFrame([(1, 5), (2, None)], "i int, e int"), "e", spark.createDataFrame([(5,)], "e int"))
    assert seen.count() == unseen.count() == 1


def test_batches_leave_one_file_each_and_come_back_whole(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"l{i}\n\u2028é", None if i % 5 == 0 else ["a/b", "c=d", "7", "e"][i % 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, t string, batch string").repartition(8)
    out = str(tmp_path / "out")
    for path, gzip in ((out, False), (f"file://{out}", True)):
        files.write_batches(df, path, gzip=gzip)
        folders = sorted((tmp_path / "out").glob("batch=*"))
        assert [len(list(f.iterdir())) for f in folders] == [1] * 5  # before, one of every task
        assert {(r["a"], r["t"]) for r in files.read_batches(spark, path, "a int, t string", 512).collect()} == {r[:2] for r in rows}
        assert {(r["a"], r["batch"]) for r in spark.read.schema("a int, batch string").json(out).collect()} == {(a, b) for a, _, b in rows}
    files.write_batches(df.limit(0), out)
    assert files.read_batches(spark, out, "a int, t string").count() == 0
