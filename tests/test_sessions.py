"""Sessions and expiring entries as streams, against plain models and their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from ctxspark.operators import cache, multiturn
from ctxspark.streaming import sessions


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    sessions.with_state_store(spark)
    yield spark
    spark.conf.set(key, before)


def streamed(spark, batches, schema, path):
    """A stream that takes one file a micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/b={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def ended(stream, path, clock=False):
    """Runs a stream over all its files; where state waits for the ``clock``, in one batch, as further ones would never end."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state")
    q = writer.trigger(**({"once": True} if clock else {"availableNow": True})).start(f"{path}/out")
    try:
        assert q.awaitTermination(60)
        assert q.exception() is None
    finally:
        q.stop()
    return f"{path}/out"


def first_in_first_out(rows, cap):
    """Scope by scope: a dictionary of at most ``cap`` sessions, the first one that came in goes."""
    states, out = {}, {}
    for scope, session, _, turn, n, docs in rows:
        live = states.setdefault(scope, {})
        if session not in live and len(live) >= cap:
            live.pop(next(iter(live)))
        state = live.setdefault(session, {"seen": set(), "n": 0})
        reset = n < state["n"]
        if reset:
            state["seen"] = set()
        names = list(dict.fromkeys(docs))
        out[session, turn] = reset, [d for d in names if d not in state["seen"]], [d for d in names if d in state["seen"]]
        state["seen"].update(names)
        state["n"] = n
    return out


TURNS = "scope string, session string, at bigint, turn bigint, n bigint, docs array<string>"


@pytest.mark.parametrize(("cap", "idle"), [(2, None), (64, "24 hours")])
def test_sessions_with_a_cap(store, tmp_path, cap, idle):
    rng = random.Random(5)
    turns, rows = {}, []
    for at in range(60):
        scope = rng.choice("xy")
        session = f"{scope}{rng.randrange(5)}"
        turns[session] = turns.get(session, 0) + 1
        rows.append((scope, session, at, turns[session], rng.randrange(1, 6), [rng.choice("abcdef") for _ in range(rng.randrange(4))]))
    batches = [rows[:25], rows[25:26], rows[26:]]
    taken = sessions.admitted(streamed(store, batches, TURNS, str(tmp_path / "t")), "scope", "session", "at", "turn", "n", "docs", cap)
    path = ended(taken, str(tmp_path / "a"))
    admissions = store.read.parquet(path)
    again = store.readStream.schema(admissions.schema).parquet(path)
    got = store.read.parquet(ended(sessions.session_documents(again, idle), str(tmp_path / "s"), clock=bool(idle))).collect()
    want = first_in_first_out(rows, cap)
    assert {(r.session, r.turn): (r.was_reset, r.new_docs, r.repeated_docs) for r in got} == want and len(got) == len(rows)
    if cap == 64:  # no session goes: the batch twin
        twin = multiturn.session_turns(store.createDataFrame(rows, TURNS), "session", "turn", "n", "docs").collect()
        assert {(r.session, r.turn): (r.was_reset, r.new_docs, r.repeated_docs) for r in twin} == want


def test_sessions_of_nulls_and_nothing(store):
    rows = [("s", 1, None, None), ("s", 2, 3, ["a", None, "a"]), (None, 1, 1, ["a"]), ("s", 3, None, ["a"]), ("t", 1, 2, [])]
    got = multiturn.session_turns(store.createDataFrame(rows, "s string, t long, n long, d array<string>"), "s", "t", "n", "d").collect()
    assert {(r.s, r.t): (r.was_reset, r.new_docs, r.repeated_docs) for r in got} == {
        ("s", 1): (False, [], []), ("s", 2): (False, ["a"], []), ("s", 3): (True, ["a"], []), (None, 1): (False, ["a"], []), ("t", 1): (False, [], [])}
    assert multiturn.session_turns(store.createDataFrame([], "s string, t long, n long, d array<string>"), "s", "t", "n", "d").count() == 0


def test_evictions_of_a_stream_are_those_of_the_batch(store, tmp_path):
    rng = random.Random(9)
    rows = sorted((60.0 * rng.randrange(6000), f"k{rng.randrange(6)}") for _ in range(120))
    rows.append((60.0 * 20_000, "end"))  # moves the watermark beyond all ends but its own
    schema = "s double, key string"
    stream = streamed(store, [rows[:40], rows[40:80], rows[80:]], schema, str(tmp_path / "t")).withColumn("ts", F.timestamp_seconds("s"))
    path = ended(sessions.ttl_evictions(stream, "key", "ts", 3600, "5 days"), str(tmp_path / "a"))
    got = store.read.parquet(path).select("key", F.unix_seconds("last_access"), F.unix_seconds("evicted_at")).collect()
    batch = store.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    want = cache.eviction_times(batch, "key", "ts", 3600, F.timestamp_seconds(F.lit(60 * 20_000 - 5 * 86_400))).select("key", F.unix_seconds("last_access"), F.unix_seconds("evicted_at")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 40
