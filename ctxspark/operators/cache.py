"""Cache models: usage counters, breakpoints, time-to-live, slots, block ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Seconds that cached prefixes live, by provider and kind.
TTL_SECONDS = {("anthropic", "short"): 300, ("anthropic", "long"): 3600, ("minimax", "short"): 300, ("openai", "short"): 3600, ("openai", "long"): 86400}
MAX_BREAKPOINTS, MIN_CACHED_CHARS = 3, 1024


def usage_metrics(usage: Column, provider: str) -> Column:
    """struct(cache_creation_tokens, cache_read_tokens, input_tokens, output_tokens) out of a response's usage JSON."""
    n = lambda path: F.coalesce(F.get_json_object(usage, f"$.{path}").try_cast("long"), F.lit(0).cast("long"))
    if provider == "openai":
        read = n("prompt_tokens_details.cached_tokens")
        made = F.when(read > 0, F.greatest(F.lit(0).cast("long"), n("prompt_tokens") - read)).otherwise(F.lit(0).cast("long"))
        return F.struct(made.alias("cache_creation_tokens"), read.alias("cache_read_tokens"), n("prompt_tokens").alias("input_tokens"), n("completion_tokens").alias("output_tokens"))
    if provider not in ("anthropic", "minimax"):
        raise ValueError(f"unknown provider {provider!r}")
    return F.struct(n("cache_creation_input_tokens").alias("cache_creation_tokens"), n("cache_read_input_tokens").alias("cache_read_tokens"), n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"))


def breakpoints(results: DataFrame, payload: str, order: str, text: str) -> DataFrame:
    """Adds ``cached``: the first few tool results of a payload, if they are long; short ones use up their turn."""
    k = F.row_number().over(Window.partitionBy(payload).orderBy(order))
    return results.withColumn("cached", (k <= MAX_BREAKPOINTS) & (F.length(text) >= MIN_CACHED_CHARS))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ttl_simulation(accesses: DataFrame, key: str, ts: str, ttl_seconds: int, tie: str) -> DataFrame:
    """(key, hits, misses, evictions, last_access): an access hits if the one before is less than the time-to-live ago.

    A miss after an earlier access means that the entry was evicted in between.
    """
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    own = accesses.withColumn("idle", _micros(F.col(ts)) - _micros(before))
    hit = F.coalesce(F.col("idle") < ttl_seconds * 1_000_000, F.lit(False))
    return own.groupBy(key).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(F.col("idle").isNotNull() & ~hit).alias("evictions"), F.max(ts).alias("last_access"))


def ttl_stats(state: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """One row: entries alive at ``now``, expired ones, and the hit rate in percent."""
    alive = _micros(now) - _micros(F.col("last_access")) < ttl_seconds * 1_000_000
    return state.agg(F.count_if(alive).alias("active"), F.count_if(~alive).alias("expired"), F.round(F.sum("hits") / (F.sum("hits") + F.sum("misses")) * 100, 2).alias("hit_rate_pct"))


def slot_evictions(samples: DataFrame, slot: str, order: str, n_past: str) -> DataFrame:
    """Samples at which a slot is empty that was not empty before."""
    before = F.lag(n_past).over(Window.partitionBy(slot).orderBy(order))
    return samples.withColumn("before", before).where((F.col(n_past) == 0) & (F.col("before") > 0)).drop("before")


def fully_evicted(owners: DataFrame, evicted: DataFrame) -> DataFrame:
    """(request_id, n_blocks): requests all of whose blocks are evicted.  ``owners``: (request_id, block); ``evicted``: (block)."""
    gone = evicted.select("block").distinct().withColumn("gone", F.lit(1))
    g = owners.distinct().join(gone, "block", "left").groupBy("request_id").agg(F.count("*").alias("n_blocks"), F.count("gone").alias("n_gone"))
    return g.where("n_blocks = n_gone").select("request_id", "n_blocks")


def after_responses(responses: DataFrame, request: str = "request_id", ts: str = "ts", tie: str = "tie") -> DataFrame:
    """(request_id, tokens, last_access, touches): the entries that responses leave.

    ``responses``: (request_id, ts, tie, cache_creation_tokens, cache_read_tokens).  A response that wrote to
    the cache makes an entry or sets its tokens anew; one that only read refreshes an entry that is there.
    Rows without a request say nothing.
    """
    own = responses.where(F.length(F.col(request).cast("string")) > 0)
    upto = Window.partitionBy(request).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    wrote = F.col("cache_creation_tokens") > 0
    own = own.withColumn("known", F.max(wrote.cast("int")).over(upto) == 1)
    live = own.where(F.col("known") & (wrote | (F.col("cache_read_tokens") > 0)))
    at = F.struct(ts, tie)
    last = F.max_by(F.when(wrote, F.col("cache_creation_tokens")), F.when(wrote, at))
    return live.groupBy(F.col(request).alias("request_id")).agg(last.alias("tokens"), F.max(ts).alias("last_access"), F.count_if(~wrote).alias("touches"))


def expired(entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The entries whose time is over at ``now``, with ``idle_seconds``."""
    idle = (_micros(now) - _micros(F.col("last_access"))) / 1_000_000
    return entries.withColumn("idle_seconds", F.round(idle, 3)).where(idle >= ttl_seconds)


def evicted(entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The entries that stay."""
    return entries.where(_micros(now) - _micros(F.col("last_access")) < ttl_seconds * 1_000_000)


def eviction_times(accesses: DataFrame, key: str, ts: str, ttl_seconds: int, now: Column) -> DataFrame:
    """(key, last_access, evicted_at): a row each time that a key was not read for the time-to-live, up to ``now``.

    A key's next access at the very end comes too late.  Accesses without time are left out; a null key is a key.
    """
    own = accesses.where(F.col(ts).isNotNull()).select(F.col(key), F.col(ts).cast("timestamp").alias("last_access"))
    following = F.lead("last_access").over(Window.partitionBy(key).orderBy("last_access"))
    end = F.timestamp_micros(_micros(F.col("last_access")) + ttl_seconds * 1_000_000)
    ends = own.withColumns({"evicted_at": end, "following": following})
    return ends.where((F.col("evicted_at") <= F.coalesce("following", now)) & (F.col("evicted_at") <= now)).drop("following")


def ttl_defaults(spark) -> DataFrame:
    """(provider, kind, seconds)."""
    return spark.createDataFrame([(p, k, s) for (p, k), s in sorted(TTL_SECONDS.items())], "provider string, kind string, seconds int")
