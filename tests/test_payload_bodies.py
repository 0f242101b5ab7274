"""New texts in the bodies of requests: everything else stays."""

import json

import pytest

from ctxspark.operators import payloads

from plans import exchanged

CHAT = {"model": "m", "n": 2, "temperature": 0.5, "messages": [
    {"role": "system", "content": "old system"}, {"role": "user", "content": [{"type": "text", "text": "one"}, {"type": "image_url", "image_url": {"url": "u", "w": [1, 2]}}, {"type": "text", "text": "two", "cache_control": {"type": "ephemeral"}}]},
    {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "type": "function", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "c", "content": "old result"}, {"role": "user", "content": json.dumps([{"type": "text", "text": "inside"}])}]}
MESSAGES = {"max_tokens": 5, "system": [{"type": "text", "text": "s0"}, {"type": "text", "text": "s1"}], "messages": [
    {"role": "user", "content": "plain"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "t", "name": "f", "input": {"q": 1}}]},
    {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "r"}, {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "r1"}, {"type": "image", "source": {}}]}, {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"type": "text", "text": "and"}]}]}
ITEMS = {"input": [{"type": "message", "role": "user", "content": [{"type": "input_image", "image_url": "u"}, {"type": "text", "text": "ask"}]}, {"type": "function_call", "call_id": "c", "name": "f", "arguments": "{}"}, {"type": "function_call_output", "call_id": "c", "output": "old"}], "stream": True}


def changed(spark, body, style, texts):
    bodies = spark.createDataFrame([(7, json.dumps(body), "x"), (8, "not json", "y"), (9, None, "z"), (10, json.dumps(body), "w")], "payload long, body string, note string")
    new = spark.createDataFrame([(p, m, k, t) for p in (7, 8, 9) for m, k, t in texts], "payload long, msg int, part int, text string")
    got = {r.payload: r for r in payloads.written_back(bodies, new, "payload", "body", style).collect()}
    assert [got[k].note for k in (7, 8, 9, 10)] == ["x", "y", "z", "w"] and got[8].body == "not json" and got[9].body is None
    assert got[10].body == json.dumps(body)
    return json.loads(got[7].body)


def test_chat_bodies(spark):
    got = changed(spark, CHAT, "openai_chat", [(0, 0, "new \"system\"\n"), (1, 1, "TWO"), (3, 0, "é"), (4, 0, "deep")])
    want = json.loads(json.dumps(CHAT))
    want["messages"][0]["content"] = "new \"system\"\n"
    want["messages"][1]["content"][2]["text"] = "TWO"
    want["messages"][3]["content"] = "é"
    inner = json.loads(got["messages"][4].pop("content"))
    assert inner == [{"type": "text", "text": "deep"}]
    want["messages"][4].pop("content")
    assert got == want


def test_messages_bodies(spark):
    got = changed(spark, MESSAGES, "anthropic_messages", [(-1, 1, "S"), (0, 0, "P"), (2, 0, "R"), (2, 1, "R1"), (2, 2, "no"), (2, 3, "AND")])
    want = json.loads(json.dumps(MESSAGES))
    want["system"][1]["text"] = "S"
    want["messages"][0]["content"] = "P"
    parts = want["messages"][2]["content"]
    parts[0]["content"], parts[1]["content"][0]["text"], parts[3]["text"] = "R", "R1", "AND"
    assert got == want


def test_responses_bodies(spark):
    got = changed(spark, ITEMS, "openai_responses", [(0, 0, "ASK"), (2, 0, "NEW")])
    want = json.loads(json.dumps(ITEMS))
    want["input"][0]["content"][1]["text"], want["input"][2]["output"] = "ASK", "NEW"
    assert got == want


@pytest.mark.parametrize(("style", "body"), [("openai_chat", CHAT), ("anthropic_messages", MESSAGES), ("openai_responses", ITEMS)])
def test_own_texts_change_nothing(spark, style, body):
    bodies = spark.createDataFrame([(1, json.dumps(body))], "payload long, body string")
    own = payloads.segments(bodies, "payload", "body", style)
    got = json.loads(payloads.written_back(bodies, own, "payload", "body", style).first().body)
    for b in (got, body):
        for m in b.get("messages", []):
            if isinstance(m.get("content"), str) and m["content"].startswith("["):
                m["content"] = json.loads(m["content"])
    assert got == body
    with pytest.raises(ValueError):
        payloads.written_back(bodies, own, "payload", "body", "other")


@pytest.mark.parametrize("style", ["openai_chat", "openai_responses"])
def test_only_bodies_meet_references(spark, style):
    """Texts of segments are not shuffled to be named, cut and put back."""
    text = "\n".join(f"line {k} of a file that is long enough to be cut into blocks" for k in range(60))
    calls = [("c1", "read", text), ("c2", "read", json.dumps({"path": "p", "content": "first\n" + text})), ("c3", "list", text + "\nlast")]
    if style == "openai_chat":
        pairs = [[{"role": "assistant", "content": None, "tool_calls": [{"id": i, "function": {"name": n}}]}, {"role": "tool", "tool_call_id": i, "content": t}] for i, n, t in calls]
        body = {"messages": [m for p in pairs for m in p]}
    else:
        pairs = [[{"type": "function_call", "call_id": i, "name": n}, {"type": "function_call_output", "call_id": i, "output": t}] for i, n, t in calls]
        body = {"input": [m for p in pairs for m in p]}
    bodies = spark.createDataFrame([(1, json.dumps(body)), (None, json.dumps(body)), (2, "no json")], "payload long, body string")
    segments = payloads.segments(bodies, "payload", "body", style)
    assert exchanged(segments, "text") == 0 and sorted({r.name for r in segments.collect()}) == ["list", "read"]
    made = payloads.deduped_bodies(bodies, "payload", "body", style)
    assert exchanged(made, "content") == exchanged(made, "text") == exchanged(made, "block") == 0
    got = {r.payload: r.body for r in made.collect()}
    assert got[None] == json.dumps(body) and got[2] == "no json"
    want = {r.msg: r.text for r in payloads.deduped(segments).where("payload = 1").collect()}
    assert {r.msg: r.text for r in payloads.segments(made.where("payload = 1"), "payload", "body", style).collect()} == want
    assert want[3] != calls[1][2] and json.loads(want[3])["path"] == "p" and "identical to earlier read result" in want[5]
