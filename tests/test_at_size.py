"""Steps whose work once grew faster than their input, or depended on the order of rows."""

import re

import pyarrow as pa
import pytest
from plans import collected
from pyspark.sql import functions as F

from ctxspark.operators import blockdedup, cells, chunking, distance, live, postings, retrieve
from ctxspark.operators.retrieve import bm25, flattened_tree, vector_topk
from ctxspark.plans import analytics_queries, dedup_queries, index_queries


def test_owners_meet_one_node_of_equal_documents(spark):
    i = F.col("id")
    nodes = spark.range(300).select((i % 2).alias("batch"), i.alias("node_id"), F.array((i % 3)).alias("docs"))
    asked = spark.range(300).select((i % 2).alias("batch"), i.alias("request_id"), F.array(i % 4, i).alias("docs"))
    rows, most = collected(spark, live.leaf_owners(nodes, asked))
    own = {(n % 2, n % 3): n for n in range(300)}
    assert {(r.request_id, r.batch, r.node_id) for r in rows} == {(k, k % 2, own.get((k % 2, k % 4))) for k in range(300)}
    assert most <= 600


def tenths(spark, folder):
    """Ten events of 0.1 a user: 0.99... in the order of their ids, 1.0 as two sums of five."""
    e = spark.range(100).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 10).alias("ts"), (F.col("id") % 10).alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.1).alias("value"), F.lit('{"k": 4}').alias("props")
    )
    for k in range(2):
        e.where(F.floor("event_id") / 50 >= k).where(F.floor("event_id") / 50 < k + 1).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return str(folder)


def test_report_adds_up_in_order(spark, tmp_path):
    r = analytics_queries.daily_report(spark, tenths(spark, tmp_path)).first()
    assert (r.sessions, r.messages, r.input_tokens) == (9, 90, 0)


def test_sources_add_up_in_order(spark, tmp_path):
    r = analytics_queries.source_totals(spark, tenths(spark, tmp_path)).collect()
    assert [(x.source, x.sessions, x.input_tokens) for x in r] == [("view", 9, 0)]


def test_evicted_tokens_add_up_in_order(spark, tmp_path):
    assert index_queries.lru_tokens_to_evict(spark, tenths(spark, tmp_path)).count() == 0  # no token is held, so none is to be freed


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_message_is_found_without_texts(spark):
    made = dedup_queries.block_dedup_system(spark, "/root/testdata/sf0.001")
    assert plan_of(made).count("Window [") == 1  # the first copies of blocks


def test_texts_are_cut_and_hashed_once(spark):
    rows = spark.createDataFrame([(1, 1, "a\n" * 300), (1, 2, "b")], "payload int, msg int, text string")
    made = blockdedup.deduped_blocks(rows, "payload", "msg", "text", min_chars=0)
    assert plan_of(made).count("posexplode") == 1
    assert str(chunking.block_ends(F.split("text", "\n"))).count("md5") == 1


def test_small_trees_are_handed_on_together(spark, monkeypatch):
    rows = spark.range(5000).coalesce(1).select("id", F.concat(F.lit('{"node_id": '), F.col("id").cast("string"), F.lit(', "nodes": [{}]}')).alias("tree"))
    found = flattened_tree(rows, "id").select("id", "path", "place", "node_id").collect()
    assert sorted(map(tuple, found)) == sorted(r for k in range(5000) for r in ((k, [0], 0, str(k)), (k, [0, 0], 1, None)))
    got = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: got.append(f))
    flattened_tree(rows, "id")
    trees = pa.RecordBatch.from_pydict({"id": list(range(5000)), "tree": ['{"nodes": [{}]}'] * 5000})
    assert len(list(got[0](iter([trees])))) == 1


@pytest.mark.parametrize("travels", [0, 2, 64])
def test_pairs_are_whole_where_they_meet(spark, monkeypatch, travels):
    lists = [[1, 2, 3], [3, 2], [2, 9, 1, 3], [7], [7, None], [None], [1], [9, 7]]
    rows = spark.createDataFrame(list(enumerate(lists)), "ctx_id int, docs array<int>")
    monkeypatch.setattr(distance, "TRAVELS", travels)
    made = {tuple(r) for r in distance.pairs(rows).collect()}
    want = set()
    for i, a in enumerate(lists):
        for j, b in enumerate(lists[i + 1 :], i + 1):
            both = [d for d in a if d is not None and d in b]
            if both:
                moved = sum(abs(a.index(d) - b.index(d)) for d in both)
                want.add((i, j, len(both), round(1 - len(both) / max(len(a), len(b)) + 0.001 * moved / len(both), 6)))
    assert made == want


def test_pairs_are_not_shuffled(spark):
    rows = spark.range(200).select(F.col("id").alias("ctx_id"), F.array(F.lit(1), F.col("id") + 2).alias("docs"))
    made = distance.pairs(rows)
    assert made.count() == 200 * 199 // 2
    physical = made._jdf.queryExecution().sparkPlan().toString()
    assert physical.index("Join") < physical.index("HashAggregate")  # the branch of short lists has no grouping


def test_nearest_vectors_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 40)
    odd = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], []]
    rows = [(k, [float(k % 5), float(k % 3)]) for k in range(200)] + list(enumerate(odd, 200))
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 50 IN (0, 3)")
    rows, most = collected(spark, vector_topk(v.where("vec_id < 200"), q.where("vec_id < 200"), 7))
    points = {k: (k % 5, k % 3) for k in range(200)}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(points[a], points[b], strict=True))
    want = {(a, b, r, float(d)) for a in (0, 3, 50, 53, 100, 103, 150, 153) for r, (d, b) in enumerate(sorted((far(a, b), b) for b in points if b != a)[:7], 1)}
    assert {tuple(r) for r in rows} == want and most < 200
    # unusable ones keep their places: no distance comes first, one that is no number last
    first = vector_topk(v, q, 4).where("query_id = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in first] == [(200, None), (201, None), (204, None), (205, None)]
    assert vector_topk(v, q, 1000).where("query_id = 0 AND vec_id IN (202, 203)").orderBy("rank").select("vec_id", "rank").collect() == [(203, 204), (202, 205)]


def test_scores_add_up_where_terms_meet(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "PAIRS_A_TASK", 100, raising=False)
    docs = spark.createDataFrame([(k, f"a b{k % 7} b{k % 3} a") for k in range(200)] + [(None, "a a"), (3, "b1 b1")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a b1 a"), (1, "b6"), (1, "a"), (2, None)], "item_id long, text string")
    many, few = (bm25(d, q, 4, id_col=a, query_col=b) for d, q, a, b in ((docs, asked, "doc_id", "item_id"), (asked, docs, "item_id", "doc_id")))
    for made in (many, few):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
    # texts of one id are one if they are of one length
    assert {r.query_id for r in many.collect()} == {0, 1}
    # the rows of an id add up, those of no id are one
    assert {r.query_id for r in few.collect() if r.query_id is None or r.query_id < 4} == {None, 0, 1, 2, 3}


def test_postings_of_a_document_lie_in_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "PART", 20)
    docs = spark.createDataFrame([(k, f"a b{k % 7} b{k % 3}") for k in range(200)] + [(None, "a a"), (None, "a b1")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a b1"), (1, "b6")], "item_id long, text string")
    index = postings.PostingsIndex(spark, str(tmp_path / "index"), folders=2, block=8)
    index.add(docs)
    own = index._blocks().select("part", F.explode("entries.id").alias("id"))
    assert own.groupBy("id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0 < own.select("part").distinct().count() - 1
    found = index.search(asked, 300)[0]
    assert sorted(map(str, found.collect())) == sorted(map(str, bm25(docs, asked, 300).collect()))


def test_new_leaves_are_counted_in_ranges(spark):
    root = [(0, 100, None, [], [], 0, None, False), (0, 1, 100, [0], [5], 1, "r", True)]
    nodes = spark.createDataFrame(root, "batch long, node_id long, parent_id long, path array<int>, docs array<long>, tokens long, request_id string, is_leaf boolean")
    new = spark.range(20000).select(F.lit(0).cast("long").alias("batch"), F.when(F.col("id") > 0, F.col("id") * 3).alias("ctx_id"), F.array(F.lit(0)).alias("path"), F.array("id").alias("docs"), F.lit(1).alias("tokens"))
    made = live.inserted(nodes, new)
    windows = re.findall(r"Window \[row_number\(\)[^\n]*", plan_of(made))
    assert windows and all("range" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows)
    rows = sorted(map(tuple, made.select(F.coalesce("ctx_id", F.lit(0)), "node_id", "path").collect()))
    assert rows == [(3 * k, 101 + k, [1 + k]) for k in range(20000)]
