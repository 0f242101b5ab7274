"""Redundancy and savings analytics over sessions, messages, prompts and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.text import blocks_of, est_tokens, salted_hash

# Fixed values.
MIN_BLOCK_CHARS, MIN_REPEAT, LARGE_CHARS, TOP_N, MIN_ARTIFACT_CHARS = 40, 3, 8000, 20, 400


def in_window(ts: Column, now: float | None, hours: float | None) -> Column:
    """Rows of the last hours before ``now`` (epoch seconds); all rows without a window."""
    return F.lit(True) if now is None or hours is None else ts >= F.lit(now - hours * 3600)


def added_in_order(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Adds ``place`` and ``so_far``, the sum of a key's values up to the row, in the order given.

    A sum of doubles depends on their order, and a whole number made of it by a full one; a shuffle keeps none.
    A key's last ``so_far`` is its sum as one walk over the rows in order gives it, however they are partitioned.
    """
    own = Window.partitionBy(key).orderBy(*order, value)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"place": F.row_number().over(own), "so_far": F.sum(value).over(upto)})


def tool_messages(messages: DataFrame, now: float | None = None, hours: float | None = None) -> DataFrame:
    """Messages of tools with content, active where the table says so."""
    own = messages.where(((F.col("role") == "tool") | F.col("tool_name").isNotNull()) & F.col("content").isNotNull() & in_window(F.col("timestamp"), now, hours))
    return own.where("active = 1") if "active" in messages.columns else own


def llm_bound_content(sessions: DataFrame, messages: DataFrame, now: float | None = None, hours: float | None = None) -> DataFrame:
    """(block_type, content): system prompts and messages of sessions that are not archived."""
    open_ = sessions.where((F.col("archived") == 0) & in_window(F.col("started_at"), now, hours))
    prompts = open_.where(F.length("system_prompt") > 0).select(rules.system_prompt_type(F.col("system_prompt")).alias("block_type"), F.col("system_prompt").alias("content"))
    own = messages.where(F.length("content") > 0).join(open_.select(F.col("id").alias("session_id")), "session_id")
    return prompts.unionByName(own.select(rules.message_type(F.col("role"), F.col("tool_name")).alias("block_type"), "content"))


def _top(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def duplicate_outputs(messages: DataFrame, salt: str, top_n: int | None = TOP_N) -> DataFrame:
    """Equal tool outputs; the tool is null if several tools gave them."""
    g = messages.where(F.length("content") > 0).groupBy(salted_hash(F.col("content"), salt).alias("content_hash")).agg(
        F.count("*").alias("occurrences"), F.max(F.length("content")).alias("char_length"),
        F.when((F.count_distinct("tool_name") == 1) & (F.count("tool_name") == F.count("*")), F.max("tool_name")).alias("tool_name"),
    )
    g = g.where("occurrences >= 2").withColumn("est_tokens", est_tokens(F.col("char_length")))
    g = g.withColumn("est_wasted_tokens", F.col("est_tokens") * (F.col("occurrences") - 1))
    return _top(g, top_n, F.desc("est_wasted_tokens"), F.col("content_hash"))


def repeated_blocks(messages: DataFrame, salt: str, min_chars: int = MIN_BLOCK_CHARS, min_repeat: int = MIN_REPEAT, top_n: int | None = TOP_N) -> DataFrame:
    """Lines that several messages have; a message counts once."""
    b = messages.select(F.explode(blocks_of(F.col("content"), min_chars)).alias("block"))
    g = b.groupBy(salted_hash(F.col("block"), salt).alias("block_hash")).agg(F.count("*").alias("occurrences"), F.max(F.length("block")).alias("char_length"))
    g = g.where(F.col("occurrences") >= min_repeat).withColumn("est_tokens", est_tokens(F.col("char_length")))
    g = g.withColumn("est_wasted_tokens", F.col("est_tokens") * (F.col("occurrences") - 1))
    return _top(g, top_n, F.desc("est_wasted_tokens"), F.col("block_hash"))


def tool_sizes(messages: DataFrame, large_chars: int = LARGE_CHARS, top_n: int | None = TOP_N) -> DataFrame:
    n = F.length("content")
    g = messages.groupBy(F.coalesce(F.nullif("tool_name", F.lit("")), F.lit("(unknown)")).alias("tool_name")).agg(
        F.count("*").alias("output_count"), F.sum(n).alias("total_chars"), F.max(n).cast("long").alias("max_chars"), F.count_if(n >= large_chars).alias("large_output_count"),
    )
    g = g.withColumn("avg_chars", F.floor(F.col("total_chars") / F.col("output_count")).cast("long")).withColumn("total_est_tokens", est_tokens(F.col("total_chars")))
    return _top(g, top_n, F.desc("total_chars"), F.col("tool_name"))


def _typed_blocks(contents: DataFrame, salt: str, min_chars: int) -> DataFrame:
    b = contents.select("block_type", F.explode(blocks_of(F.col("content"), min_chars)).alias("block"))
    return b.groupBy(salted_hash(F.col("block"), salt).alias("block_hash"), "block_type").agg(F.count("*").alias("occ"), F.max(F.length("block")).alias("char_length"))


def block_type_stats(contents: DataFrame, salt: str, min_chars: int = MIN_BLOCK_CHARS, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """Redundancy inside each block type; types without blocks are kept."""
    items = contents.groupBy("block_type").agg(F.count("*").alias("item_count"))
    repeated = F.col("occ") >= min_repeat
    per = _typed_blocks(contents, salt, min_chars).groupBy("block_type").agg(
        F.sum("occ").alias("block_count"), F.count("*").alias("unique_block_count"), F.count_if(repeated).alias("repeated_block_count"),
        F.sum(F.when(repeated, est_tokens(F.col("char_length")) * (F.col("occ") - 1)).otherwise(0)).alias("est_redundant_tokens"),
    )
    return items.join(per, "block_type", "left").na.fill(0, ["block_count", "unique_block_count", "repeated_block_count", "est_redundant_tokens"])


def cross_type_blocks(contents: DataFrame, salt: str, min_chars: int = MIN_BLOCK_CHARS, top_n: int | None = TOP_N) -> DataFrame:
    """Lines that come from two block types or more."""
    g = _typed_blocks(contents, salt, min_chars).groupBy("block_hash").agg(F.sort_array(F.collect_list(F.struct("block_type", "occ"))).alias("types"), F.sum("occ").alias("occurrences"), F.max("char_length").alias("char_length"))
    g = g.where(F.size("types") >= 2).withColumn("est_tokens", est_tokens(F.col("char_length")))
    g = g.withColumn("est_wasted_tokens", F.col("est_tokens") * (F.col("occurrences") - 1)).withColumn("type_occurrences", F.array_join(F.transform("types", lambda t: F.concat_ws(":", t["block_type"], t["occ"].cast("string"))), ","))
    return _top(g.drop("types"), top_n, F.desc("est_wasted_tokens"), F.col("block_hash"))


def routed_blocks(contents: DataFrame, salt: str, large_chars: int = LARGE_CHARS, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """One row a distinct content: its most kept origin, its label and reason, and its tokens."""
    priority = F.coalesce(*(F.when(F.col("block_type") == t, F.lit(p)) for t, p in rules.KEEP_PRIORITY.items()), F.lit(0))
    own = contents.where(F.length("content") > 0).withColumn("rank", F.struct((-priority).alias("p"), F.col("block_type").alias("t")))
    g = own.groupBy(salted_hash(F.col("content"), salt).alias("block_hash")).agg(F.min("rank").alias("rank"), F.count("*").alias("occurrences"), F.first("content").alias("content"))
    g = g.withColumn("block_type", F.col("rank.t"))
    decision = F.split(rules.router_decision(F.col("block_type"), F.col("content"), F.col("occurrences"), large_chars, min_repeat), r"\|")
    g = g.withColumn("decision", decision).withColumn("char_length", F.length("content")).withColumn("est_tokens", est_tokens(F.col("char_length")))
    g = g.select("block_hash", "block_type", F.get("decision", F.lit(0)).alias("route_label"), F.get("decision", F.lit(1)).alias("reason_code"), "occurrences", "char_length", "est_tokens", (F.col("est_tokens") * F.col("occurrences")).alias("total_est_tokens"))
    return g.withColumn("est_candidate_tokens", F.when(F.col("route_label").isin(*rules.ROUTABLE), F.col("total_est_tokens")).otherwise(0))


def routing_rollup(routed: DataFrame) -> DataFrame:
    """Counters by label, and by block type, label and reason, in one pass; ``level`` tells the two apart."""
    sets = routed.groupingSets([[F.col("route_label")], [F.col("block_type"), F.col("route_label"), F.col("reason_code")]], "block_type", "route_label", "reason_code")
    return sets.agg(
        F.when(F.grouping("block_type") == 1, "label").otherwise("reason").alias("level"), F.count("*").alias("block_count"), F.sum("occurrences").alias("occurrence_count"),
        F.sum("total_est_tokens").alias("total_est_tokens"), F.sum("est_candidate_tokens").alias("est_candidate_tokens"),
    )


def artifact_bodies(contents: DataFrame, salt: str, min_chars: int = MIN_ARTIFACT_CHARS) -> DataFrame:
    """One row a distinct body of workers and tools: kind, sources and duplicate tokens."""
    own = contents.where(F.col("block_type").isin(*rules.PARENT_SOURCES) & (F.length("content") >= min_chars))
    by_source = own.groupBy(salted_hash(F.col("content"), salt).alias("content_hash"), "block_type").agg(F.count("*").alias("n"), F.first("content").alias("content"))
    g = by_source.groupBy("content_hash").agg(F.sum("n").alias("occurrences"), F.min(F.struct((-F.col("n")).alias("k"), F.col("block_type").alias("t"))).alias("main"), F.first("content").alias("content"), F.sort_array(F.collect_list(F.struct("block_type", "n"))).alias("sources"))
    g = g.withColumn("est_tokens", est_tokens(F.length("content")))
    return g.select(
        "content_hash", rules.artifact_kind(F.col("content")).alias("artifact_kind"), F.col("main.t").alias("canonical_source_type"), "occurrences", F.length("content").alias("char_length"), "est_tokens",
        (F.col("est_tokens") * (F.col("occurrences") - 1)).alias("est_duplicate_tokens"), F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["block_type"], s["n"].cast("string"))), ",").alias("source_type_counts"),
    )


def artifact_kinds(bodies: DataFrame) -> DataFrame:
    return bodies.groupBy("artifact_kind").agg(F.count("*").alias("group_count"), F.sum("occurrences").alias("occurrence_count"), F.count_if(F.col("occurrences") >= 2).alias("duplicate_group_count"), F.sum("est_tokens").alias("est_tokens"), F.sum("est_duplicate_tokens").alias("est_duplicate_tokens"))


def artifact_duplicates(bodies: DataFrame, top_n: int | None = TOP_N) -> DataFrame:
    return _top(bodies.where("occurrences >= 2"), top_n, F.desc("est_duplicate_tokens"), F.desc("occurrences"), F.desc("content_hash"))


def heavy_sessions(sessions: DataFrame, salt: str, top_n: int | None = TOP_N) -> DataFrame:
    own = sessions.where("archived = 0").select(salted_hash(F.col("id").cast("string"), salt).alias("session_hash"), "source", "input_tokens", "tool_call_count", "message_count")
    return _top(own, top_n, F.desc("input_tokens"), F.desc("tool_call_count"), F.col("session_hash"))


def telemetry_totals(events: DataFrame, input_tokens: Column | int = 0, now: float | None = None, hours: float | None = None, keep_missing_ts: bool = True, reject_negative: bool = False) -> DataFrame:
    """Counters of saved characters and tokens; rows without readable counts are malformed.

    The readers of the reference differ in two points, which are flags here: whether rows without a
    time are counted inside a window, and whether negative counts are.
    """
    window = in_window(F.col("ts"), now, hours)
    inside = F.coalesce(window, F.lit(keep_missing_ts)) if now is not None and hours is not None else F.lit(True)
    bad = F.col("chars_saved").isNull() | (F.coalesce(F.col("chars_saved") < 0, F.lit(False)) if reject_negative else F.lit(False))
    good = inside & ~bad
    tokens = F.coalesce("tokens_saved", est_tokens(F.col("chars_saved")))
    t = events.agg(F.count_if(good).alias("events"), F.coalesce(F.sum(F.when(good, F.col("chars_saved"))), F.lit(0)).alias("chars_saved"), F.coalesce(F.sum(F.when(good, tokens)), F.lit(0)).alias("tokens_saved"), F.count_if(inside & bad).alias("malformed"))
    t = t.withColumn("avg_tokens", F.when(F.col("events") > 0, F.round(F.col("tokens_saved") / F.col("events"), 1)).otherwise(F.lit(0.0)))
    given = input_tokens if isinstance(input_tokens, Column) else F.lit(input_tokens)
    return t.withColumn("reduction_pct", F.when(F.col("tokens_saved") + given > 0, F.round(F.col("tokens_saved") / (F.col("tokens_saved") + given) * 100, 2)).otherwise(F.lit(0.0)))


def log_savings(lines: DataFrame, text: str = "value") -> DataFrame:
    """(events, chars_saved, tokens_saved) of log lines that report savings."""
    pattern = r"saved ([\d,]+) chars \(~([\d,]+) tokens\)"
    own = lines.where(F.col(text).rlike(pattern))
    number = lambda k: F.translate(F.regexp_extract(text, pattern, k), ",", "").cast("long")
    return own.agg(F.count("*").alias("events"), F.coalesce(F.sum(number(1)), F.lit(0)).alias("chars_saved"), F.coalesce(F.sum(number(2)), F.lit(0)).alias("tokens_saved"))


def source_totals(sessions: DataFrame, top_n: int | None = 10) -> DataFrame:
    g = sessions.where("archived = 0").groupBy("source").agg(F.count("*").alias("sessions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return _top(g, top_n, F.desc("input_tokens"), F.col("source"))


def daily_report(sessions: DataFrame, telemetry: DataFrame) -> DataFrame:
    """One row: session totals and what telemetry says was saved."""
    s = sessions.where("archived = 0").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    t = telemetry_totals(telemetry).select("events", "chars_saved", "tokens_saved", "malformed")
    both = s.join(t)  # one row each
    return both.withColumn("reduction_pct", F.when(F.col("tokens_saved") + F.col("input_tokens") > 0, F.round(F.col("tokens_saved") / (F.col("tokens_saved") + F.col("input_tokens")) * 100, 2)).otherwise(F.lit(0.0)))


def hourly_savings(telemetry: DataFrame, ts: str = "at", watermark: str | None = None) -> DataFrame:
    """Savings of each hour; with a watermark the same plan runs on a stream."""
    own = telemetry if watermark is None else telemetry.withWatermark(ts, watermark)
    g = own.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("events"), F.sum("chars_saved").alias("chars_saved"), F.sum(F.coalesce("tokens_saved", est_tokens(F.col("chars_saved")))).alias("tokens_saved"))
    return g.select(F.col("w.start").alias("hour"), "events", "chars_saved", "tokens_saved")


#: Size of latency sketches: ranks are within 1 % of the true ones, however many sketches are merged.
SKETCH = 800


def latency_sketches(requests: DataFrame, value: str, *by: str) -> DataFrame:
    """(*by, count, total, max, sketch): a mergeable sketch of each group's values, for batches and streams alike.

    Values that are null are not counted.  Nothing is shuffled but a sketch a group and task.
    """
    v = F.col(value).cast("double")
    return requests.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("count"), F.sum(v).alias("total"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias("sketch"))


def sketched_latency(sketches: DataFrame, *by: str) -> DataFrame:
    """(*by, count, mean, p50, p99, max) of sketches of any finer groups; the percentiles are those of ``SKETCH``."""
    both = sketches.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("total").alias("total"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return both.select(*by, "count", F.round(F.col("total") / F.col("count"), 6).alias("mean"), at(0.5).alias("p50"), at(0.99).alias("p99"), "max")


def latency_stats(requests: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, and the upper median and percentiles as order statistics of whole groups.

    Ranks are taken where counts by value say they lie, so a group of any size is summed up first.
    """
    from pyspark.sql.window import Window

    counts = requests.groupBy(*by, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(*by))})
    at = lambda share: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * share), F.col("n") - 1), F.col(value)))
    return ranked.groupBy(*by).agg(F.max("n").alias("count"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 6).alias("mean"), at(0.5).alias("p50"), at(0.99).alias("p99"), F.max(value).alias("max"))


FORBIDDEN = frozenset(("content", "text", "system_prompt", "session_id", "raw", "prompt"))


def assert_private(report: DataFrame) -> DataFrame:
    """The report, if no field anywhere in it has a name that could hold texts or ids."""
    def names(kind):
        for f in getattr(kind, "fields", ()):
            yield f.name
            yield from names(f.dataType)
        for inner in ("elementType", "valueType"):
            if hasattr(kind, inner):
                yield from names(getattr(kind, inner))

    if bad := FORBIDDEN.intersection(names(report.schema)):
        raise ValueError(f"fields not to be reported: {sorted(bad)}")
    return report


def run_stats(requests: DataFrame) -> DataFrame:
    """One row: counts of requests, and of the successful ones output tokens, decode throughput and the mean time to the first token.

    ``requests``: (success, output_len, ttft, latency).
    """
    good = lambda c: F.sum(F.when(F.col("success"), c))
    t = requests.agg(
        F.count("*").alias("total_requests"), F.count_if("success").alias("successful_requests"), F.count_if(~F.col("success")).alias("failed_requests"),
        good(F.col("output_len")).cast("long").alias("total_output_tokens"), good(F.col("ttft")).alias("t"), good(F.col("latency") - F.col("ttft")).alias("d"),
    )
    n = F.col("successful_requests")
    return t.select(
        "total_requests", "successful_requests", "failed_requests", "total_output_tokens",
        F.when(n > 0, F.round(F.col("total_output_tokens") / n, 6)).alias("average_output_length"),
        F.when(F.col("d") > 0, F.round(F.col("total_output_tokens") / F.col("d"), 6)).alias("decode_throughput"),
        F.when(F.col("t") > 0, F.round(F.col("t") / n, 6)).alias("average_ttft"),
    )


def ttft_history(samples: DataFrame, by: str, order: list[str], value: str, last: int) -> DataFrame:
    """(by, count, mean_all, mean_last, latest): each history's mean, that of its last samples, and the last one."""
    from pyspark.sql.window import Window

    back = F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(c) for c in order)))
    g = samples.withColumn("back", back).groupBy(by)
    recent = F.when(F.col("back") <= last, F.col(value))
    return g.agg(F.count("*").alias("count"), F.round(F.avg(value), 6).alias("mean_all"), F.round(F.avg(recent), 6).alias("mean_last"), F.max(F.when(F.col("back") == 1, F.col(value))).alias("latest"))


def full_report(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, rank, entry): reports of any columns as one, each row as JSON; rows of a section by their JSON.

    Raises if a section has a field that could hold texts or ids.
    """
    from pyspark.sql.window import Window

    out = None
    for name, rows in sections.items():
        own = assert_private(rows).select(F.lit(name).alias("section"), F.to_json(F.struct(*sorted(rows.columns))).alias("entry"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy("entry")))


def markdown(report: DataFrame) -> DataFrame:
    """(section, text): a report's sections as lists."""
    items = F.array_sort(F.collect_list(F.struct("rank", "entry")))
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- `"), x["entry"], F.lit("`"))), "\n")
    return report.groupBy("section").agg(lines.alias("lines")).select("section", F.concat(F.lit("## "), "section", F.lit("\n\n"), "lines", F.lit("\n")).alias("text"))


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report as two folders: ``entries``, JSON lines of (section, rank, entry), and ``text``, its sections as lists."""
    report.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/entries")
    markdown(report).orderBy("section").select("text").write.mode(mode).text(f"{path}/text")
