"""Chunking, block dedup, extraction, metrics and text functions against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ctxspark.functions import text as tx
from ctxspark.operators import analytics, blockdedup, cache, chunking, evalqa, extract, retrieve


def plain_blocks(text):
    lines = text.split("\n")
    if len(lines) <= 3:
        return [text]
    out, cur = [], []
    for line in lines:
        cur.append(line)
        bare = re.sub(r"^\s*\d+\|", "", line).strip()
        edge = int.from_bytes(hashlib.md5(bare.encode()).digest()[:4], "little") % 13 == 0
        if (edge and len(cur) >= 3) or len(cur) >= 40:
            out.append(cur)
            cur = []
    if cur:
        if out and len(cur) < 3:
            out[-1] += cur
        else:
            out.append(cur)
    return ["\n".join(b) for b in out]


def texts():
    r = random.Random(8)
    made = ["\n".join(f"{r.choice(('', '  3|'))}line {r.randint(0, 40)}" for _ in range(n)) for n in (1, 3, 4, 5, 41, 42, 43, 80, 200)]
    return [*made, "", "\n", "a\n\n\n\nb"]


def test_chunking_is_the_sequential_walk(spark):
    own = texts()
    df = spark.createDataFrame(list(enumerate(own)), "k long, t string")
    got = {}
    for r in chunking.blocks(df, "t", "k").orderBy("k", "block_idx").collect():
        got.setdefault(r.k, []).append(r.block)
    assert [got[k] for k in range(len(own))] == [plain_blocks(t) for t in own]


def test_block_dedup_is_the_sequential_walk(spark):
    r = random.Random(2)
    para = ["\n".join(f"{w} {r.random()} some words to make this line long" for w in range(6)) for _ in range(8)]
    messages = ["\n".join(r.sample(para, 4)) for _ in range(7)]
    df = spark.createDataFrame([(0, k, m, f"tool{k % 3}") for k, m in enumerate(messages)], "p long, m long, t string, l string")
    got = {x.m: x for x in blockdedup.deduped(blockdedup.deduped_blocks(df, "p", "m", "t", "l"), "p", "m").collect()}
    seen = {}
    for k, text in enumerate(messages):
        blocks, out, n = plain_blocks(text), [], 0
        for b in blocks:
            h = "\n".join(re.sub(r"^\s*\d+\|", "", x) for x in b.strip().split("\n"))
            if len(b.strip()) < 40:
                out.append(b)
                continue
            if h in seen and seen[h] != k and len(blocks) >= 2:
                ref = f'[... "{b.strip().split(chr(10))[0][:80]}" — identical to earlier tool{seen[h] % 3} result, see above ...]'
                if len(ref) < len(b):
                    out.append(ref)
                    n += 1
                    continue
            seen.setdefault(h, k)
            out.append(b)
        assert got[k].text == "\n".join(out) and got[k].blocks_deduped == n
    assert sum(x.blocks_deduped for x in got.values()) > 0


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_extraction(spark):
    assert one(spark, extract.xml(F.col("t")), t="<documents>\n<doc>a</doc>\n<doc x='1'> b\nc </doc></documents>") == ["a", "b\nc"]
    assert one(spark, extract.xml(F.col("t")), t="<doc>only</doc>") is None
    assert one(spark, extract.numbered(F.col("t")), t="See [1] one [2] two\nmore") == ["one", "two\nmore"]
    assert one(spark, extract.numbered(F.col("t")), t="[1] one") is None
    assert one(spark, extract.separated(F.col("t")), t="a\n---\nb\n---\nc") == ["a", "b", "c"]
    assert one(spark, extract.markdown(F.col("t")), t="x\n# A\na\n## B\nb\n### c") == ["# A\na", "## B\nb\n### c"]
    assert [r.id for r in one(spark, extract.json_results(F.col("t")), t='{"results": [{"url": "u", "path": "p"}, {"path": " q "}, {"a": 1}]}')] == ["u", "q", '{"a":1}']
    assert one(spark, extract.auto(F.col("t")), t="[1] a [2] b").mode == "numbered"
    assert one(spark, extract.auto(F.col("t")), t="nothing here") is None
    docs = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    for write, read in ((extract.to_xml, extract.xml), (extract.to_numbered, extract.numbered), (extract.to_separated, extract.separated)):
        assert one(spark, read(write(docs))) == ["a", "b", "c"]


def test_answer_metrics(spark):
    s = one(spark, evalqa.answer_scores(F.col("p"), F.col("g")), p="The cat, a cat!", g="cat dog")
    assert (s.em, round(s.prec, 3), s.recall, s.f1) == (0.0, 0.5, 0.5, 0.5)
    assert one(spark, evalqa.answer_scores(F.col("p"), F.col("g")), p="yes", g="yes it is").f1 == 0
    assert one(spark, evalqa.best_scores(F.col("p"), F.array(F.lit("x"), F.lit("An apple"))), p="apple").em == 1
    s = one(spark, evalqa.set_scores(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))))
    assert (s.em, s.prec, s.recall, s.f1) == (0, 0.5, 0.5, 0.5)


def test_request_ids(spark):
    f = lambda t: one(spark, tx.normalize_request_id(F.col("t")), t=t)
    assert f("chatcmpl-req-ab-0-1f") == "req-ab" and f("cmpl-req-7") == "req-7" and f("other-1") == "other-1"


def test_usage_metrics(spark):
    m = one(spark, cache.usage_metrics(F.col("t"), "openai"), t='{"prompt_tokens": 100, "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": 60}}')
    assert tuple(m) == (40, 60, 100, 7)
    assert tuple(one(spark, cache.usage_metrics(F.col("t"), "openai"), t='{"prompt_tokens": 100}')) == (0, 0, 100, 0)
    assert tuple(one(spark, cache.usage_metrics(F.col("t"), "anthropic"), t='{"cache_read_input_tokens": 3}')) == (0, 3, 0, 0)


def test_reports_show_no_texts(spark):
    import pytest

    with pytest.raises(ValueError):
        analytics.assert_private(spark.range(1).select(F.struct(F.lit("x").alias("content")).alias("s")))


def test_telemetry_readers_differ_on_missing_times(spark):
    rows = spark.createDataFrame([(None, 40, None), (100.0, 80, 9), (1.0, 4, 1), (100.0, -5, None), (100.0, None, None)], "ts double, chars_saved long, tokens_saved long")
    a = analytics.telemetry_totals(rows, 0, 101.0, 0.01).first()
    b = analytics.telemetry_totals(rows, 0, 101.0, 0.01, keep_missing_ts=False, reject_negative=True).first()
    assert (a.events, a.chars_saved, a.malformed) == (3, 115, 1) and (b.events, b.chars_saved, b.tokens_saved, b.malformed) == (1, 80, 9, 2)


def test_page_trees(spark):
    tree = '{"node_id": "1", "title": "a", "nodes": [{"node_id": "2", "title": "b", "nodes": [{"node_id": "3"}]}, {"node_id": "4"}]}'
    df = spark.createDataFrame([("d", tree)], "doc_name string, tree string")
    got = retrieve.flattened_tree(df).orderBy("path").collect()
    assert [r.node_id for r in got] == ["1", "2", "3", "4"]


def test_deep_page_trees(spark):
    tree = '{"node_id": "33"}'
    for k in range(32, -1, -1):
        tree = f'{{"node_id": "{k}", "nodes": [{tree}]}}'
    got = retrieve.flattened_tree(spark.createDataFrame([("d", tree)], "doc_name string, tree string")).select("node_id").collect()
    assert sorted(int(r.node_id) for r in got) == list(range(34))


def test_odd_page_trees(spark):
    rows = [(1, None), (2, "no json"), (3, '{"node_id": 7, "title": {"a": [1]}, "nodes": {"x": 1}}'), (4, '{"nodes": [3, {"text": "é"}]}'), (None, "{}")]
    got = retrieve.flattened_tree(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()
    assert sorted((r.k or 0, r.place, tuple(r.path), r.node_id, r.title, r.text) for r in got) == [
        (0, 0, (0,), None, None, None), (1, 0, (0,), None, None, None), (2, 0, (0,), None, None, None), (3, 0, (0,), "7", '{"a":[1]}', None),
        (4, 0, (0,), None, None, None), (4, 1, (0, 0), None, None, None), (4, 2, (0, 1), None, None, "é")]
    assert retrieve.flattened_tree(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0


def test_wide_page_tree(spark):
    """More nodes than a task hands on at once."""
    tree = '{"nodes": [' + ",".join(f'{{"node_id": {k}}}' for k in range(25_000)) + "]}"
    got = retrieve.flattened_tree(spark.createDataFrame([("d", tree)], "doc_name string, tree string"))
    assert got.count() == 25_001 and got.where("place <> coalesce(node_id, -1) + 1").count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None), (4, "a")], "k long, t string")
    got = [(r.k, r.start, r.text.split()[0]) for r in retrieve.chunks(df, "k", "t", 10, 4).orderBy("k", "start").collect()]
    assert got == [(1, s, str(s)) for s in (0, 6, 12, 18, 24)] + [(4, 0, "a")]
