"""Streams on declared state: sessions with a cap and resets, entries that expire.

State lies in maps, lists and values of its own kind, so a turn writes what it adds and not what the session
already holds; needs the RocksDB state store (``with_state_store``).  Each operator sorts the rows that one key
has in one micro-batch; what a micro-batch holds is the source's setting.  Batch twins: ``multiturn.session_turns``
and ``cache.eviction_times``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import SESSION_OUT

#: Sessions that one scope (a server) keeps; the one that came first goes.
MAX_SESSIONS = 64
ADMITTED_OUT = "scope string, session string, turn bigint, n_messages bigint, docs array<string>, admission bigint"
EVICTED_OUT = "key string, last_access timestamp, evicted_at timestamp"


def with_state_store(spark: SparkSession) -> None:
    """Lets the session's streams use maps, lists and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class Admissions(StatefulProcessor):
    """Numbers a scope's sessions as they come in; beyond the cap the one that came first is forgotten, whenever it was last seen."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getListState("live", "session string, admission bigint")
        self.next = handle.getValueState("next", "admission bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        live = dict(self.live.get())  # at most ``cap``, in the order of their coming
        number = self.next.get()[0] if self.next.exists() else 0
        before = number
        frame = _in_order(rows, "at", "session", "turn")
        given = []
        for session in frame["session"]:
            if session not in live:
                if len(live) >= self.cap:
                    del live[next(iter(live))]
                live[session] = number
                number += 1
            given.append(live[session])
        if number != before:
            self.live.put(list(live.items()))
            self.next.update((number,))
        yield frame.assign(admission=given)[["scope", "session", "turn", "n_messages", "docs", "admission"]]

    def close(self) -> None:
        pass


class SeenDocuments(StatefulProcessor):
    """A session's documents, forgotten by a reset, by a new admission, and by the state's time-to-live."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "doc string", "turn bigint", self.idle_ms)
        self.last = handle.getValueState("last", "admission bigint, n_messages bigint", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        admission, last = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for row in _in_order(rows, "admission", "turn").itertuples():
            anew = admission is not None and row.admission != admission
            was_reset = not anew and row.n_messages < last
            if anew or was_reset:
                self.seen.clear()
            new, repeated = [], []
            for doc in dict.fromkeys(row.docs):
                if self.seen.containsKey((doc,)):
                    repeated.append(doc)
                else:
                    new.append(doc)
                    self.seen.updateValue((doc,), (row.turn,))
            out.append((row.session, row.turn, row.n_messages, was_reset, new, repeated))
            admission, last = row.admission, row.n_messages
        self.last.update((int(admission), int(last)))
        yield pd.DataFrame(out, columns=["session", "turn", "n_messages", "was_reset", "new_docs", "repeated_docs"]).astype({"session": object})

    def close(self) -> None:
        pass


def admitted(turns: DataFrame, scope: str, session: str, at: str, turn: str, n_messages: str, docs: str, cap: int = MAX_SESSIONS) -> DataFrame:
    """The turns with ``admission``: the number under which their scope last took their session in.

    Rows of a micro-batch are taken by time, session and turn.  Null names are a scope and a session of their own,
    null documents are none, a null number of messages counts as none.
    """
    own = turns.select(
        F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("scope"),
        F.coalesce(F.col(session).cast("string"), F.lit("")).alias("session"),
        F.col(at).alias("at"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(n_messages).cast("long"), F.lit(0)).alias("n_messages"),
        F.coalesce(F.array_compact(F.col(docs).cast("array<string>")), F.array().cast("array<string>")).alias("docs"),
    )
    return own.groupBy("scope").transformWithStateInPandas(Admissions(cap), ADMITTED_OUT, "append", "none")


def session_documents(admissions: DataFrame, idle: str | None = "24 hours") -> DataFrame:
    """Each turn's documents that its session has not had; fewer messages than before start the session anew.

    ``admissions``: rows of ``admitted``, read as a stream; a scope and session's documents are a state of their own,
    however many sessions its scope has.  A document is forgotten ``idle`` after it was first seen; that needs a stream
    that goes on by itself, as a run with ``availableNow`` would wait for the clock.  With None nothing is forgotten by time.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return admissions.groupBy("scope", "session").transformWithStateInPandas(SeenDocuments(idle_ms), SESSION_OUT, "append", "processingTime" if idle else "none")


class Expiries(StatefulProcessor):
    """The last access of a key, and a timer at its end."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")

    def _rows(self, key, ended: list) -> pd.DataFrame:
        last = pd.Series(ended, dtype="datetime64[us]")
        return pd.DataFrame({"key": pd.Series([key[0]] * len(ended), dtype=object), "last_access": last, "evicted_at": last + pd.Timedelta(milliseconds=self.ttl_ms)})

    def _ends(self, at: pd.Timestamp) -> int:
        return -(-(at.value // 1000 + self.ttl_ms * 1000) // 1000)  # milliseconds, rounded up

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(self._ends(last))
        ended = []
        for at in sorted(t for f in rows for t in f["at"]):
            if last is not None and (at - last) >= pd.Timedelta(milliseconds=self.ttl_ms):
                ended.append(last)
            last = at if last is None else max(last, at)
        self.last.update((last.to_pydatetime(),))
        self.handle.registerTimer(self._ends(last))
        if ended:
            yield self._rows(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = pd.Timestamp(self.last.get()[0])
        self.last.clear()
        yield self._rows(key, [last])

    def close(self) -> None:
        pass


def ttl_evictions(accesses: DataFrame, key: str, ts: str, ttl_seconds: int, watermark: str = "1 hour") -> DataFrame:
    """(key, last_access, evicted_at): a row each time that a key has not been read for the time-to-live.

    It comes as soon as the watermark has passed the end, and its state goes with it; accesses without time are left out.
    """
    own = accesses.where(F.col(ts).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", watermark)
    return own.groupBy("key").transformWithStateInPandas(Expiries(ttl_seconds * 1000), EVICTED_OUT, "append", "eventTime")
