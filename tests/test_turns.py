"""Whole turns of agents' sessions, against a plain walk over them."""

import json

from pyspark.sql import functions as F

from ctxspark.operators import payloads, turns

from plans import exchanged

SCHEMA = "s string, t long, body string"


def call(k):
    return {"role": "assistant", "content": None, "tool_calls": [{"id": f"c{k}", "function": {"name": "read"}}]}


def result(k, text):
    return {"role": "tool", "tool_call_id": f"c{k}", "content": text}


def listed(*docs):
    return "<documents>\n" + "\n".join(f"<document>{d}</document>" for d in docs) + "\n</documents>"


def session():
    one, two = "the same file " * 10, "another file " * 10
    messages = [{"role": "system", "content": "help"}, {"role": "user", "content": "go"}]
    for k, text in enumerate([listed("a", "b", "b"), one, listed("b", "c", "c", "d"), one, two, listed("a", "d"), one + "\n"]):
        messages += [call(k), result(k, text)]
    return messages


def walked(messages):
    """What the texts become, one message after the other."""
    seen, files, lists, out, saved = set(), {}, 0, [], []
    for m in messages:
        text = new = m["content"]
        if m["role"] == "tool" and text.startswith("<documents>"):
            docs = [d.split("</document>")[0] for d in text.split("<document>")[1:]]
            fresh = [d for k, d in enumerate(docs) if d not in seen and d not in docs[:k]]
            if lists and len(fresh) < len(docs):
                new = listed(*(fresh or [turns.ALL_SEEN.replace("{n}", str(len(docs) - len(fresh)))]))
            lists += 1
            seen |= set(docs)
        elif m["role"] == "tool":
            origin = files.setdefault(text.strip(), m["tool_call_id"])
            if origin != m["tool_call_id"]:
                new = turns.SAME.replace("{call}", origin)
        out.append({**m, "content": new})
        saved.append(len(text or "") - len(new or ""))
    return out, saved


def body(messages):
    return json.dumps({"model": "m", "messages": messages}, ensure_ascii=False)


def same(a, b):
    drop = lambda ms: [{k: v for k, v in m.items() if v is not None} for m in ms]
    return drop(json.loads(a)["messages"]) == drop(b)


def test_turns_of_a_session(spark):
    whole = session()
    sizes = [2, 4, 8, 8, 12, len(whole)]
    other = [{"role": "user", "content": "new"}, *whole[2:8]]
    rows = [("x", k, body(whole[:n])) for k, n in enumerate(sizes)] + [("x", 6, body(other)), (None, 1, body(whole)), ("y", 1, None), ("y", 2, "no json"), ("y", 3, body(whole[:4])), ("z", 1, body([]))]
    got = {(r.s, r.t): r for r in turns.optimized(spark.createDataFrame(rows, SCHEMA), "s", "t", "body").collect()}
    assert len(got) == len(rows)
    out, saved = walked(whole)
    total, before = 0, 0
    for k, n in enumerate(sizes):
        r = got["x", k]
        total += sum(saved[before:n])
        assert (r.n, r.replayed, r.chars_saved, r.cumulative_chars_saved) == (n, before, sum(saved[before:n]), total) and same(r.body, out[:n])
        before = n
    fresh, less = walked(other)
    r = got["x", 6]  # it does not begin with the turn before
    assert (r.replayed, r.chars_saved, r.cumulative_chars_saved) == (0, sum(less), total + sum(less)) and same(r.body, fresh)
    assert got[None, 1].chars_saved == total and got[None, 1].docs_deduped == sum(got["x", k].docs_deduped for k in range(6)) == 2 + 1 + 2 + 1
    assert [(got["y", k].n, got["y", k].replayed, got["y", k].body) for k in (1, 2)] == [(0, 0, None), (0, 0, "no json")]
    assert got["y", 3].replayed == 0 and got["z", 1].n == 0 and json.loads(got["z", 1].body)["messages"] == []


def test_blocks_of_turns_are_those_of_the_last_request(spark):
    text = "\n".join(f"line {k} of a file that is long enough to be cut into blocks" for k in range(60))
    messages = [{"role": "user", "content": "go"}, call(0), result(0, text), call(1), result(1, "first\n" + text), call(2), result(2, text + "\nlast")]
    rows = spark.createDataFrame([("s", k, body(messages[:n])) for k, n in enumerate((3, 5, 7))], SCHEMA)
    got = {r.t: r for r in turns.optimized(rows, "s", "t", "body").collect()}
    want = payloads.deduped_bodies(rows.withColumn("p", F.col("t")), "p", "body").collect()
    for r in want:
        assert same(got[r.t].body, json.loads(r.body)["messages"])
    assert got[0].blocks_deduped == 0 < got[1].blocks_deduped and got[2].block_chars_saved > 0
    assert got[2].cumulative_chars_saved == got[1].block_chars_saved + got[2].block_chars_saved


def test_repeated_rows_are_one_turn(spark):
    whole = session()
    rows = [("s", 1, body(whole[:6])), ("s", 2, body(whole)), ("s", 2, body(whole)), ("s", 1, body(whole[:6]))]
    got = turns.optimized(spark.createDataFrame(rows, SCHEMA), "s", "t", "body").collect()
    saved = walked(whole)[1]
    assert sorted((r.t, r.replayed, r.chars_saved, r.cumulative_chars_saved) for r in got) == [(1, 0, sum(saved[:6]), sum(saved[:6]))] * 2 + [(2, 6, sum(saved[6:]), sum(saved))] * 2


def test_bodies_and_texts_are_dealt_once(spark, monkeypatch):
    """Behind the tables that they are dealt to, neither bodies nor texts are shuffled."""
    read = []

    def effects(segments, min_chars):
        read.append(inner(segments, min_chars))
        return read[-1]

    inner = turns.effects
    monkeypatch.setattr(turns, "effects", effects)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = session()
        made = turns.optimized(spark.createDataFrame([("s", k, body(whole[:n])) for k, n in enumerate((4, 8, len(whole)))], SCHEMA), "s", "t", "body")
        assert exchanged(made, "body") == 0
        segments = spark.createDataFrame([], "payload string, msg int, part int, kind string, call_id string, name string, text string")
        assert exchanged(read[0], "text") == 0 < exchanged(inner(segments, 200), "text")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_turns(spark):
    assert turns.optimized(spark.createDataFrame([], SCHEMA), "s", "t", "body").count() == 0
