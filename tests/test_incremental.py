from __future__ import annotations

import base64

import numpy as np

from moraine.operators import kb
from moraine.streaming import incremental as I


def scene(spark):
    rng = np.random.default_rng(1)
    known, fresh = 10 * np.eye(8)[:6], 10 * np.eye(8)[6:]
    unit = lambda v: [float(x) for x in v]
    vectors = spark.createDataFrame([(i, kb.READ_ONLY, bytearray(np.float32(v).tobytes())) for i, v in enumerate(known)] + [(0, kb.READ_WRITE, bytearray(np.float32(known[0]).tobytes()))], I.TABLES["vectors"])
    entities = spark.createDataFrame([(i, kb.READ_ONLY, 100 + i, None, None, f"e{i}", None, None) for i in range(6)], kb.ENTITY_SCHEMA)
    rows = []
    for b in range(3):
        for j in range(6):
            rows.append((b * 100 + j, f"e{j}", 100 + j, False, b, unit(known[j] + 0.05 * rng.standard_normal(8))))
        for j in range(4):
            rows.append((b * 100 + 50 + j, f"N{j % 2}", 900 + j % 2, True, b, unit(fresh[j % 2] + 0.05 * rng.standard_normal(8))))
    mentions = spark.createDataFrame(rows, "query long, mention string, gold long, nil boolean, batch int, vector array<float>")
    settings = dict(dim=8, top_k=3, nil_weights=(("best", 1.0),), nil_intercept=-80.0, cluster_threshold=80.0)
    return vectors, entities, mentions, settings


def test_batches_grow_the_kb_and_repeat(spark, tmp_path):
    vectors, entities, mentions, s = scene(spark)
    settings = I.Settings(state=str(tmp_path / "state"), **s)
    I.start(spark, settings, vectors, entities)
    reports = {r["batch"]: r for r in I.run_all(mentions, settings, [0, 1, 2]).collect()}
    assert all(r["linking_recall@1"] == 1.0 and r["size"] == 10 for r in reports.values())
    assert reports[0]["NIL--support"] == 4 and reports[0]["eval_clustering_pred_clusters_len"] == 2 and reports[0]["overall_accuracy"] == 1.0
    assert reports[0]["eval_clustering_ceaf_f1"] == reports[0]["nil_clustering_bcubed_recall"] == 1.0
    assert reports[1]["should_be_nil_total"] == 0 and reports[1]["overall_accuracy"] == 1.0  # now linked to the added entities
    assert reports[1]["should_be_linked_to_prev_added_correct"] == reports[1]["should_be_linked_to_prev_added_total"] == 4
    again = I.run_batch(mentions.filter("batch = 1").drop("batch"), 1, settings).first()
    assert again["overall_correct"] == reports[1]["overall_correct"]
    added = I._read(spark, settings, "entities", 99).filter("indexer = 20").orderBy("id").collect()
    assert [(r["id"], r["title"], r["wikipedia_id"]) for r in added] == [(0, "N0", -1), (1, "N1", -1)]
    total = I.overall_report(I._read(spark, settings, "reports", 99)).filter("batch = 'incremental_overall'").first()
    assert total["size"] == 30 and total["overall_accuracy"] == 1.0


def test_one_cluster_a_batch_takes_the_next_id(spark, tmp_path):
    vectors, entities, mentions, s = scene(spark)
    settings = I.Settings(state=str(tmp_path / "state"), **s)
    I.start(spark, settings, vectors, entities)
    for step, gold in enumerate((900, 901)):
        I.run_batch(mentions.filter(f"batch = 0 and gold = {gold}").drop("batch"), step, settings)
    added = I._read(spark, settings, "entities", 99).filter("indexer = 20").orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in added] == [(0, "N0"), (1, "N1")]
    held = {r["id"]: np.frombuffer(r["vector"], "<f4") for r in I._read(spark, settings, "vectors", 99).filter("indexer = 20").collect()}
    assert set(held) == {0, 1}
    own = [np.float32(r["vector"]) for r in mentions.filter("batch = 0 and gold = 900").collect()]
    assert any((held[0] == v).all() for v in own)  # the medoid is one of the mentions
    new = spark.createDataFrame([(1, "x", base64.b64encode(np.float32(range(8)).tobytes()).decode()), (2, "y", "bad")], "item long, title string, encoding string")
    assert [tuple(r) for r in I.add_request(spark, settings, new, 2).orderBy("item").collect()] == [(1, 2, 20), (2, 3, 20)]
    I.reset_request(spark, settings, 2)
    assert I._read(spark, settings, "entities", 99).filter("indexer = 20").isEmpty()


def test_correct_steps_and_modes(spark, tmp_path):
    vectors, entities, mentions, s = scene(spark)
    lost = spark.createDataFrame([(77, "e0", 555, False, 0, [10.0] + [0.0] * 7)], mentions.schema)
    settings = I.Settings(state=str(tmp_path / "state"), **s, correct_steps=True, clusterer="three_step")
    I.start(spark, settings, vectors, entities)
    r = I.run_one_pass(mentions.filter("batch < 2").unionByName(lost), settings).first()
    assert r["size"] == 21 and r["dropped"] == 1 and r["overall_accuracy"] is None and r["NIL--support"] == 8
    added = I._read(spark, settings, "entities", 99).filter("indexer = 20").collect()
    assert sorted(r["title"] for r in added) == ["N0", "N1"]
    frame = I.training_frame(mentions.filter("batch = 0"), vectors.filter("indexer = 10"), entities, 8, 3)
    assert {(r["query"], r["labels"], r["top_title"]) for r in frame.filter("query < 3").collect()} == {(i, 1, f"e{i}") for i in range(3)}
    empty = I.run_batch(mentions.drop("batch").limit(0), 1, settings).first()
    assert empty["size"] == 0 and empty["nil_clustering_bcubed_recall"] is None


def test_stream_equals_loop(spark, tmp_path):
    vectors, entities, mentions, s = scene(spark)
    settings = I.Settings(state=str(tmp_path / "state"), **s)
    I.start(spark, settings, vectors, entities)
    for b in range(2):
        mentions.filter(f"batch = {b}").drop("batch").coalesce(1).write.parquet(str(tmp_path / "in" / str(b)))
    source = spark.readStream.schema(mentions.drop("batch").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    I.stream_batches(source, settings, str(tmp_path / "checkpoint")).awaitTermination()
    got = {r["batch"]: r["overall_accuracy"] for r in I._read(spark, settings, "reports", 99).collect()}
    assert got == {0: 1.0, 1: 1.0}


def test_search_request(spark):
    vectors, entities, _, s = scene(spark)
    q = base64.b64encode(bytes(vectors.filter("id = 2").first()["vector"])).decode()
    requests = spark.createDataFrame([(1, q), (2, "bad"), (3, None)], "query long, encoding string")
    got = {r["query"]: r["candidates"] for r in I.search_request(requests, vectors, entities, 8, 2).collect()}
    assert got[1][0]["title"] == "e2" and len(got[1]) == 3 and got[2] is None and got[3] is None
