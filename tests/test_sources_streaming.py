"""Sources, sinks and streams; streams against their batch twins."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from ctxspark.operators import analytics, cache, cluster, multiturn, schedule
from ctxspark.sources import jsonl, sqlite
from ctxspark.streaming import stateful


def test_tolerant_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts": 1.5, "chars_saved": 8}\n\nnot json\n{"chars_saved": 4}\n')
    rows = jsonl.read_tolerant(spark, str(tmp_path / "a.jsonl"), "ts double, chars_saved bigint").collect()
    assert sorted((r.malformed, r.chars_saved) for r in rows if not r.malformed) == [(False, 4), (False, 8)]
    assert [r.line for r in rows if r.malformed] == ["not json"]


def test_corpus_and_retrieval(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "7", "text": "t", "title": "x"}\n{"_id": "8", "content": "u"}\n')
    assert [tuple(r) for r in jsonl.read_corpus(spark, str(tmp_path / "c.jsonl")).orderBy("doc_id").collect()] == [("7", "x", "t"), ("8", "", "u")]
    (tmp_path / "r.jsonl").write_text('{"qid": "1", "text": "q", "top_k_doc_id": [3, null, 4]}\n{"qid": "2", "question": "p"}\n')
    assert [r.docs for r in jsonl.read_retrieval(spark, str(tmp_path / "r.jsonl")).orderBy("qid").collect()] == [[3, 4], []]


def test_results_sink(spark, tmp_path):
    df = spark.createDataFrame([(0, k, [k, k + 1]) for k in range(4)], "batch long, ctx_id long, docs array<bigint>")
    made = schedule.scheduled(cluster.arranged(df, "batch"), "batch")
    jsonl.write_results(made, str(tmp_path / "lines"))
    lines = [json.loads(x) for f in (tmp_path / "lines").glob("*.json") for x in f.read_text().splitlines()]
    assert sum(len(g["items"]) for g in lines) == 4
    jsonl.write_results(made, str(tmp_path / "whole"), "json")
    assert len([x for f in (tmp_path / "whole").glob("*.json") for x in f.read_text().splitlines()]) == 1
    with pytest.raises(ValueError):
        jsonl.write_results(made, str(tmp_path / "no"), "csv")


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sessions (id TEXT PRIMARY KEY, source TEXT, started_at REAL, input_tokens INTEGER, archived INTEGER)")
        db.executemany("INSERT INTO sessions VALUES (?, ?, ?, ?, ?)", [(f"s{k}", "cli", float(k), k, k % 2) for k in range(50)])
    rows = sqlite.read_sqlite(spark, path, "sessions", sqlite.SESSIONS)
    assert rows.count() == 50 and rows.where("message_count IS NULL").count() == 50
    assert rows.where("archived = 0").agg(F.sum("input_tokens")).first()[0] == sum(range(0, 50, 2))
    assert sqlite.read_sqlite(spark, path, "sessions").columns == ["id", "source", "started_at", "input_tokens", "archived"]


def stream_of(spark, df, tmp_path, parts=1):
    path = str(tmp_path / "in")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def test_ttl_stream_is_the_batch_simulation(spark, tmp_path):
    rows = [(u, f"2024-01-01 {h:02d}:{m:02d}:00", k) for k, (u, h, m) in enumerate([(1, 0, 0), (1, 0, 30), (1, 2, 0), (2, 1, 0), (2, 1, 59), (2, 3, 0), (3, 5, 0)])]
    df = spark.createDataFrame(rows, "user_id long, t string, event_id long").withColumn("ts", F.col("t").cast("timestamp"))
    run(stateful.ttl_cache(stream_of(spark, df, tmp_path), "user_id", "ts", 3600), "ttl_out", "update")
    got = {r.key: (r.hits, r.misses, r.evictions) for r in spark.table("ttl_out").collect()}
    want = {str(r.user_id): (r.hits, r.misses, r.evictions) for r in cache.ttl_simulation(df, "user_id", "ts", 3600, "event_id").collect()}
    assert got == want


def test_session_stream(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 2, ["a", "b"]), ("s", 2, 4, ["b", "c"]), ("s", 3, 1, ["a"]), ("t", 1, 1, ["b"])], "s string, turn long, n long, docs array<string>")
    run(stateful.session_documents(stream_of(spark, df, tmp_path), "s", "turn", "n", "docs"), "session_out", "append")
    got = {(r.session, r.turn): (r.was_reset, r.new_docs, r.repeated_docs) for r in spark.table("session_out").collect()}
    assert got == {("s", 1): (False, ["a", "b"], []), ("s", 2): (False, ["c"], ["b"]), ("s", 3): (True, ["a"], []), ("t", 1): (False, ["b"], [])}


def test_telemetry_stream_is_the_batch_roll_up(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text("".join(json.dumps({"ts": 1700000000 + 600 * k, "chars_saved": 40 + k}) + "\n" for k in range(30)))
    batch = analytics.hourly_savings(jsonl.read_telemetry(spark, str(tmp_path / "t"))).collect()
    run(stateful.telemetry_hours(jsonl.read_telemetry(spark, str(tmp_path / "t"), stream=True)), "tel_out", "complete")
    assert sorted(map(tuple, spark.table("tel_out").collect())) == sorted(map(tuple, batch))


def test_eviction_batches(spark, tmp_path):
    log = str(tmp_path / "log")
    index = spark.createDataFrame([(f"r{k}",) for k in range(6)], "request_id string")
    apply = stateful.evictions_logged(log)
    for number, gone in [(0, ["r1", "r4"]), (0, ["r1", "r4"]), (1, ["r4", "r5", "r9"]), (2, [])]:  # a batch may come twice
        apply(spark.createDataFrame([(r,) for r in gone], "request_id string"), number)
    assert sorted(r.request_id for r in stateful.live_requests(index, log).collect()) == ["r0", "r2", "r3"]


def test_evictions_in_all_spellings(spark, tmp_path):
    log = str(tmp_path / "log")
    apply = stateful.evictions_logged(log)
    apply(spark.createDataFrame([("cmpl-req-a",), ("chatcmpl-req-a-0-9f",), ("HEALTH_CHECK_1",), ("",), (None,)], "request_id string"), 0)
    apply(spark.createDataFrame([("batch-req-x",), ("req-c",)], "request_id string"), 1)
    index = spark.createDataFrame([("req-a", 1), ("req-a", 2), ("req-b", 3), ("req-c", 4)], "request_id string, leaf long")
    assert [r.leaf for r in stateful.live_requests(index, log).collect()] == [3]
    assert sorted(map(tuple, stateful.eviction_effects(index, log).collect())) == [("req-a", 2), ("req-c", 1), ("req-x", 0)]
    talk = spark.createDataFrame([("req-0", None), ("req-c", "req-0"), ("req-d", "req-c"), ("req-b", None)], "request_id string, parent_id string")
    left, counts = stateful.live_conversations(talk, log)
    assert sorted(r.request_id for r in left.collect()) == ["req-b", "req-d"]
    assert sorted(map(tuple, counts.collect())) == [("req-a", 0), ("req-c", 2), ("req-x", 0)]


def test_ancestors_with_branches_and_cycles(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "missing"), ("x", "y"), ("y", "x")], "request_id string, parent_id string")
    got = {}
    for r in multiturn.ancestors(df).collect():
        got.setdefault(r.request_id, {})[r.ancestor] = r.back
    assert got == {"b": {"a": 1}, "c": {"b": 1, "a": 2}, "d": {"b": 1, "a": 2}, "x": {"y": 1}, "y": {"x": 1}}
