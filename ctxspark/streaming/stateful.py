"""Stateful streams: time-to-live caches, session state, running telemetry.  Each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import HEALTH_CHECK, normalize_request_id
from ..operators import multiturn
from ..operators.analytics import hourly_savings

TTL_OUT = "key string, hits bigint, misses bigint, evictions bigint, last_access double"
SESSION_OUT = "session string, turn bigint, n_messages bigint, was_reset boolean, new_docs array<string>, repeated_docs array<string>"


def ttl_cache(accesses: DataFrame, key: str, ts: str, ttl_seconds: float, watermark: str = "1 hour") -> DataFrame:
    """Running counters of each key: an access hits if the last one is less than the time-to-live ago.

    State lives as long as the watermark has not passed the last access by the time-to-live and a day.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits, misses, evictions, last = state.get if state.exists else (0, 0, 0, -1.0)
        times = sorted(t for f in frames for t in f["at"])
        for t in times:
            if last >= 0 and t - last < ttl_seconds:
                hits += 1
            else:
                misses += 1
                evictions += last >= 0
            last = max(last, t)
        state.update((hits, misses, evictions, last))
        state.setTimeoutTimestamp(int((last + ttl_seconds + 86_400) * 1000))
        yield pd.DataFrame([(keys[0], hits, misses, evictions, last)], columns=["key", "hits", "misses", "evictions", "last_access"])

    own = accesses.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("event_time")).withColumn("at", F.unix_micros("event_time") / 1e6).withWatermark("event_time", watermark)
    return own.groupBy("key").applyInPandasWithState(step, TTL_OUT, "hits bigint, misses bigint, evictions bigint, last double", "update", GroupStateTimeout.EventTimeTimeout)


def session_documents(turns: DataFrame, session: str, turn: str, n_messages: str, docs: str, idle: str = "24 hours") -> DataFrame:
    """Each turn's documents that its session has not had; fewer messages than before start the session anew.

    State: the documents' names seen and the last number of messages; it goes after ``idle`` without turns.
    """
    hours = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0)
        rows = []
        for f in [pd.concat(list(frames)).sort_values("turn", kind="stable")]:
            for t, n, d in zip(f["turn"], f["n_messages"], f["docs"], strict=True):
                was_reset = bool(n < last)
                if was_reset:
                    seen = set()
                names = list(dict.fromkeys(map(str, d)))
                rows.append((keys[0], int(t), int(n), was_reset, [x for x in names if x not in seen], [x for x in names if x in seen]))
                seen.update(names)
                last = int(n)
        state.update((sorted(seen), last))
        state.setTimeoutDuration(hours)
        yield pd.DataFrame(rows, columns=["session", "turn", "n_messages", "was_reset", "new_docs", "repeated_docs"])

    own = turns.select(F.col(session).cast("string").alias("session"), F.col(turn).cast("long").alias("turn"), F.col(n_messages).cast("long").alias("n_messages"), F.col(docs).cast("array<string>").alias("docs"))
    return own.groupBy("session").applyInPandasWithState(step, SESSION_OUT, "seen array<string>, last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def telemetry_hours(telemetry: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Savings by hour of a telemetry stream."""
    return hourly_savings(telemetry, "at", watermark)


def evictions_logged(log_path: str):
    """For foreachBatch: writes the evicted requests of each batch to a log, under the batch's number.

    Ids are brought to their common spelling first; empty ones and those of health checks are no requests.  A batch
    that is run again writes its own part again, so the log stays the same; the index itself is not rewritten.
    """

    def apply(evicted: DataFrame, batch_id: int) -> None:
        own = evicted.select(normalize_request_id(F.col("request_id")).alias("request_id"))
        own.where((F.length("request_id") > 0) & ~F.col("request_id").startswith(HEALTH_CHECK)).distinct().write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    return apply


def _logged(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema("request_id string, batch bigint").parquet(log_path).select("request_id").distinct()


def live_requests(indexed: DataFrame, log_path: str) -> DataFrame:
    """The rows of an index whose requests the log has not evicted; written as the next index, they compact the log."""
    return indexed.join(_logged(indexed.sparkSession, log_path), "request_id", "left_anti")


def eviction_effects(indexed: DataFrame, log_path: str) -> DataFrame:
    """(request_id, removed): the log's requests, and how many rows of the index go with each; 0 says that it was not there."""
    rows = indexed.groupBy("request_id").agg(F.count("*").alias("removed"))
    return _logged(indexed.sparkSession, log_path).join(rows, "request_id", "left").select("request_id", F.coalesce("removed", F.lit(0)).alias("removed"))


def live_conversations(requests: DataFrame, log_path: str) -> tuple[DataFrame, DataFrame]:
    """The (request_id, parent_id) rows that are left when the chains of all evicted requests go, and (request_id, removed) of each."""
    return multiturn.cleared(requests, _logged(requests.sparkSession, log_path))
