"""Sketches, resets, reports, rebuilt results, and functions that no query calls."""

import json

import pytest
from pyspark.sql import functions as F

from ctxspark.engine import ContextEngine, Settings
from ctxspark.operators import analytics, extract, index, multiturn, prompts, retrieve
from ctxspark.sources import jsonl


def lines_of(folder):
    return [json.loads(x) for f in sorted(folder.glob("*.json")) for x in f.read_text().splitlines()]


def test_sketches_of_a_stream_and_of_batches(spark, tmp_path):
    """Ranks within 1 %, for batches merged and for a stream over the same files."""
    rows = [(k % 3, k % 7, float((k * 7919) % 30_011) if k % 11 else None) for k in range(30_000)]
    df = spark.createDataFrame(rows, "kind int, day int, v double")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    parts = [analytics.latency_sketches(df.where(f"day % 2 = {k}"), "v", "kind", "day") for k in (0, 1)]
    merged = analytics.sketched_latency(parts[0].unionByName(parts[1]), "kind").collect()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = analytics.latency_sketches(stream, "v", "kind").writeStream.outputMode("complete").format("memory").queryName("sketched").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = analytics.sketched_latency(spark.table("sketched"), "kind").collect()
    for found in (merged, streamed):
        assert len(found) == 3
        for r in found:
            own = sorted(v for kind, _, v in rows if kind == r.kind and v is not None)
            assert (r["count"], r["max"]) == (len(own), own[-1]) and r["mean"] == pytest.approx(sum(own) / len(own), abs=1e-5)
            for at, q in ((r.p50, 0.5), (r.p99, 0.99)):
                assert abs(sum(v <= at for v in own) / len(own) - q) <= 0.01


def test_rows_since_a_reset(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (2, 2, "c"), (2, 9, "d"), (3, 4, "e"), (None, 1, "f"), (None, 8, "g")], "u int, t int, x string")

    def left(resets):
        return sorted(r.x for r in multiturn.since_reset(rows, spark.createDataFrame(resets, "u int, t int"), "u", "t").collect())

    assert left([]) == list("abcdefg")
    assert left([(1, 1), (2, 9)]) == ["b", "e", "f", "g"]
    assert left([(1, 0), (None, 4)]) == ["b", "d", "g"]


def test_token_deltas(spark):
    nodes = spark.createDataFrame([(1, 5, 10, 4), (2, 5, 10, -3), (3, 5, 10, -20), (4, 5, 10, 0)], "node_id int, extra long, total long, delta long")
    assert sorted(map(tuple, index.tokens_updated(nodes).collect())) == [(1, 9, 14), (2, 2, 7), (3, 0, 0), (4, 5, 10)]


def test_reports_are_written(spark, tmp_path):
    report = analytics.full_report({"sizes": spark.createDataFrame([(1, 2.5), (2, 3.5)], "n int, mean double"), "none": spark.createDataFrame([(0,)], "n int")})
    analytics.write_report(report, str(tmp_path / "r"))
    assert sorted((x["section"], x["rank"]) for x in lines_of(tmp_path / "r" / "entries")) == [("none", 1), ("sizes", 1), ("sizes", 2)]
    text = "".join(f.read_text() for f in sorted((tmp_path / "r" / "text").glob("part-*")))
    assert "## sizes" in text and '- `{"mean":2.5,"n":1}`' in text
    with pytest.raises(Exception, match="exists"):
        analytics.write_report(report, str(tmp_path / "r"))


def test_json_results_are_rebuilt(spark):
    obj = {"total": 3, "results": [{"url": "a", "x": [1, {"y": None}]}, {"path": "b"}, {"url": "a", "x": 2.5}, {"other": 1}], "query": "q é"}
    df = spark.createDataFrame([(json.dumps(obj), ["a", "b", "a", "a", "zz"]), ("no json", ["a"])], "t string, d array<string>")
    got = [r.out for r in df.select(extract.to_json_results(F.col("t"), F.col("d")).alias("out")).collect()]
    assert json.loads(got[0]) == {**obj, "results": [obj["results"][k] for k in (0, 1, 2)]} and got[1] is None


def test_single_documents(spark):
    long = "A document without any structure. " * 20
    df = spark.createDataFrame([(1, f"  {long}\n"), (2, "short"), (3, f"<documents><document>{long}</document><document>b</document></documents>"), (4, None)], "k int, t string")
    got = {r.k: r.d for r in df.select("k", extract.single_document(F.col("t")).alias("d")).collect()}
    assert got == {1: long.strip(), 2: None, 3: None, 4: None}


def test_bench_prompts(spark):
    df = spark.createDataFrame([(["abc", "d" * 12, "e"], "why?"), ([], "q")], "t array<string>, q string")
    got = [r.p for r in df.select(prompts.bench_prompt(F.col("t"), F.col("q"), 2, 10).alias("p")).collect()]
    assert got == ["[1] abc\n\n[2] " + "d" * 10 + "...\n\nQuestion: why?", "\n\nQuestion: q"]


def test_results_under_any_name(spark):
    a = spark.createDataFrame([(7, None, "t"), (None, "x", "u")], "chunk_id long, _id string, text string")
    assert sorted(map(tuple, retrieve.normalized_results(a).collect())) == [("7", "t"), ("x", "u")]
    b = spark.createDataFrame([("1", "c")], "doc_id string, content string")
    assert list(map(tuple, retrieve.normalized_results(b).collect())) == [("1", "c")]


def test_telemetry_is_appended(spark, tmp_path):
    out, events = str(tmp_path / "out"), spark.createDataFrame([(1.5, "turn", 40, "secret")], "ts double, type string, chars_saved long, content string")
    assert jsonl.append_telemetry(events, out) is None
    jsonl.append_telemetry(events.withColumn("ts", F.lit(2.5)), out)
    assert sorted(x["ts"] for x in lines_of(tmp_path / "out")) == [1.5, 2.5] and all("content" not in x for x in lines_of(tmp_path / "out"))
    assert sorted(r.chars_saved for r in jsonl.read_telemetry(spark, out).collect()) == [40, 40]
    stream = jsonl.read_telemetry(spark, out, stream=True)
    with pytest.raises(ValueError):
        jsonl.append_telemetry(stream, str(tmp_path / "again"))
    jsonl.append_telemetry(stream, str(tmp_path / "again"), str(tmp_path / "ck")).awaitTermination(120)
    assert len(lines_of(tmp_path / "again")) == 2


def test_records_are_reordered(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"qid": q, "text": f"t{q}", "top_k_doc_id": [1]}) + "\n" for q in "abc"))
    order = spark.createDataFrame([("c", 0), ("a", 1), ("c", 2), ("zz", 3)], "index string, position int")
    jsonl.reorder_jsonl(spark, str(tmp_path / "in.jsonl"), order, str(tmp_path / "out"))
    assert [x["qid"] for x in lines_of(tmp_path / "out")] == ["c", "a"]


def test_logs_and_retrieval_through_the_engine(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    assert sorted(r.value for r in jsonl.read_log(spark, str(tmp_path / "a.log")).collect()) == ["one", "two"]
    corpus = spark.createDataFrame([(k, f"apple w{k} w{k % 3}") for k in range(12)] + [(20, "pear")], "doc_id long, text string")
    asked = spark.createDataFrame([(k, f"apple w{k % 3}", k % 2) for k in range(6)] + [(9, "nothing", 0)], "item_id long, text string, half int")
    whole = ContextEngine(Settings(top_k=4)).retrieve_and_reorder(corpus, asked)
    small = ContextEngine(Settings(top_k=4, max_batch=2)).retrieve_and_reorder(corpus, asked)
    rows = lambda df: sorted((r.batch, r.exec_pos, r.ctx_id, tuple(r.reordered)) for r in df.collect())
    assert len(rows(whole)) == 6 and rows(whole) == rows(small) and all(len(r[3]) == 4 for r in rows(whole))
    assert {r.half for r in ContextEngine(Settings(top_k=4)).retrieve_and_reorder(corpus, asked, "half").collect()} == {0, 1}
