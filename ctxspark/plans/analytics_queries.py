"""Queries of the analytics operators.

Sessions are users of ``events``, messages are ``conversations`` and documents as tool outputs.
"""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import analytics as an
from .tables import table

SALT = "pepper"
NOW, HOURS = 1706659200.0, 240.0  # the end of the events


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 150).alias("session_id"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_name"), (F.lit(NOW) - F.col("turn") * 86400).alias("timestamp"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 150).alias("session_id"), F.lit("tool").alias("role"), F.col("text").alias("content"), F.col("source").alias("tool_name"), (F.lit(NOW) - F.col("doc_id") % 30 * 86400).cast("double").alias("timestamp"))
    return talk.unionByName(docs)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = an.added_in_order(table(spark, sf_dir, "events"), "user_id", "value", "event_id")
    own = e.groupBy(F.col("user_id").alias("id")).agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("source"), F.unix_timestamp(F.min("ts")).cast("double").alias("started_at"), F.count("*").alias("message_count"), F.count_if(F.col("event_type") == "click").alias("tool_call_count"),
        F.floor(F.max_by("so_far", "place")).cast("long").alias("input_tokens"), F.floor(F.max("value")).cast("long").alias("output_tokens"), F.min_by("props", F.struct("ts", "event_id")).alias("props"),
    )
    return own.withColumn("archived", (F.col("id") % 10 == 0).cast("int")).withColumn("system_prompt", F.when(F.col("id") % 3 == 0, F.concat(F.lit("---\nname: skill "), "source", F.lit("\nWhen to use: "), "props")).when(F.col("id") % 3 == 1, F.concat(F.lit("You must answer. "), "props"))).drop("props")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("event_id") % 11 != 0, F.unix_timestamp("ts").cast("double")).alias("ts"), F.col("ts").alias("at"),
        F.when(F.col("event_id") % 13 != 0, F.floor(F.col("value") - 5).cast("long")).alias("chars_saved"), F.get_json_object("props", "$.k").try_cast("long").alias("tokens_saved"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.llm_bound_content(sessions(spark, sf_dir), messages(spark, sf_dir))


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool messages of the window, by tool."""
    return an.tool_messages(messages(spark, sf_dir), NOW, HOURS).groupBy("tool_name").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def llm_bound_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that sessions send, by block type."""
    return contents(spark, sf_dir).groupBy("block_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def dup_tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most wasteful equal tool outputs."""
    return an.duplicate_outputs(an.tool_messages(messages(spark, sf_dir)), SALT)


def dup_tool_outputs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of them."""
    return an.duplicate_outputs(an.tool_messages(messages(spark, sf_dir)), SALT, None)


def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several tool outputs have."""
    return an.repeated_blocks(an.tool_messages(messages(spark, sf_dir)), SALT)


def repeated_blocks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of them."""
    return an.repeated_blocks(an.tool_messages(messages(spark, sf_dir)), SALT, top_n=None)


def tool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output sizes of each tool."""
    return an.tool_sizes(an.tool_messages(messages(spark, sf_dir)))


def block_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundancy by block type."""
    return an.block_type_stats(contents(spark, sf_dir), SALT)


def cross_type_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several block types."""
    return an.cross_type_blocks(contents(spark, sf_dir), SALT)


def routing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router counters by label."""
    return an.routing_rollup(an.routed_blocks(contents(spark, sf_dir), SALT)).where("level = 'label'").drop("level", "block_type", "reason_code")


def routing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router counters by block type, label and reason."""
    return an.routing_rollup(an.routed_blocks(contents(spark, sf_dir), SALT)).where("level = 'reason'").drop("level")


def routing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest blocks that a router might route away."""
    found = an.routed_blocks(contents(spark, sf_dir), SALT).where("est_candidate_tokens > 0")
    return found.orderBy(F.desc("est_candidate_tokens"), F.desc("occurrences"), F.desc("block_hash")).limit(an.TOP_N)


def artifact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of workers and tools by kind."""
    return an.artifact_kinds(an.artifact_bodies(contents(spark, sf_dir), SALT))


def artifact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most repeated of them."""
    return an.artifact_duplicates(an.artifact_bodies(contents(spark, sf_dir), SALT))


def heavy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the most tokens."""
    return an.assert_private(an.heavy_sessions(sessions(spark, sf_dir), SALT))


def telemetry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings; rows without a time count, negative ones too."""
    total = sessions(spark, sf_dir).where("archived = 0").agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("given"))
    return an.telemetry_totals(telemetry(spark, sf_dir), 0, NOW, HOURS).drop("reduction_pct").join(total).withColumn("coverage_pct", F.round(F.col("tokens_saved") / (F.col("tokens_saved") + F.col("given")) * 100, 2)).drop("given")


def savings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings; rows without a time do not count inside a window, nor negative ones."""
    return an.telemetry_totals(telemetry(spark, sf_dir), 0, NOW, HOURS, keep_missing_ts=False, reject_negative=True).drop("reduction_pct")


def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session totals and savings."""
    return an.daily_report(sessions(spark, sf_dir), telemetry(spark, sf_dir))


def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest sources."""
    return an.source_totals(sessions(spark, sf_dir))


def telemetry_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings by hour."""
    return an.hourly_savings(telemetry(spark, sf_dir))


def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from sketches of each day, merged; whether their percentiles' ranks are within 1 % of the true ones."""
    events = table(spark, sf_dir, "events")
    found = an.sketched_latency(an.latency_sketches(events, "value", "event_type", F.to_date("ts").alias("day")), "event_type")
    ranked = events.join(F.broadcast(found), "event_type")  # a row a type of event
    share = lambda at, op: F.count_if(op(F.col("value"), F.col(at))) / F.count("value")
    within = lambda at, q: (share(at, operator.lt) <= q + 0.01) & (share(at, operator.le) >= q - 0.01)
    return ranked.groupBy("event_type").agg(F.first("count").alias("count"), F.first("mean").alias("mean"), F.first("max").alias("max"), within("p50", 0.5).alias("p50_within"), within("p99", 0.99).alias("p99_within"))


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of event values by type."""
    return an.latency_stats(table(spark, sf_dir, "events"), "value", "event_type")


def log_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings out of log lines."""
    e = table(spark, sf_dir, "events")
    lines = e.select(F.concat(F.lit("INFO run "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(": saved "), F.format_number(F.floor("value") * 1000, 0), F.lit(" chars (~"), F.floor("value").cast("string"), F.lit(" tokens)"))).otherwise(": nothing")).alias("value"))
    return an.log_savings(lines)


QUERIES = [
    tool_messages, llm_bound_content, dup_tool_outputs, dup_tool_outputs_all, repeated_blocks, repeated_blocks_all, tool_sizes, block_type_stats, cross_type_blocks, routing_labels, routing_reasons, routing_candidates,
    artifact_kinds, artifact_dups, heavy_sessions, telemetry_coverage, savings_summary, daily_report, source_totals, telemetry_hourly, latency_stats, latency_sketches, log_savings,
]


def _any(text: str, cues) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(c)})" for c in cues) + ")"


def _quoted(text: str) -> str:
    parts = text.replace("'", "''").split("\n")
    parts = [" || chr(9) || ".join(f"'{x}'" for x in p.split("\t")) for p in parts]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _kind_sql() -> str:
    cases = []
    for name, rule in rules.ARTIFACT_RULES:
        tests = [f"contains(lower(content), {_quoted(c)})" for c in rule.get("low", ())] + [f"contains(content, {_quoted(c)})" for c in rule.get("text", ())]
        tests += [f"starts_with(regexp_replace(content, '^\\s+', ''), {_quoted(c)})" for c in rule.get("start", ())]
        tests += [f"(contains(lower(content), {_quoted(a)}) AND contains(lower(content), {_quoted(b)}))" for a, b in rule.get("low_pairs", ())]
        tests += [f"(contains(content, {_quoted(a)}) AND contains(content, {_quoted(b)}))" for a, b in rule.get("text_pairs", ())]
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE 'unknown_large_block' END"


_S = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BLOCKS = "list_distinct(list_filter(list_transform(string_split_regex(content, '\\r\\n|\\n|\\r'), lambda l: " + _S.format("l") + "), lambda b: length(b) >= 40))"
_HASH = f"substr(sha256('{SALT}:' || {{0}}), 1, 16)"
_BASE = f"""WITH msg AS (SELECT conv_id % 150 AS session_id, role, text AS content, NULL::VARCHAR AS tool_name, {NOW} - turn * 86400 AS ts FROM conversations
  UNION ALL SELECT doc_id % 150, 'tool', text, source, {NOW} - doc_id % 30 * 86400 FROM documents),
tools AS (SELECT * FROM msg WHERE (role = 'tool' OR tool_name IS NOT NULL) AND content IS NOT NULL),
ses AS (SELECT user_id AS id, arg_min(event_type, (ts, event_id)) AS source, epoch(min(ts))::DOUBLE AS started_at, count(*) AS message_count, count(*) FILTER (event_type = 'click') AS tool_call_count, floor(sum(value))::BIGINT AS input_tokens, floor(max(value))::BIGINT AS output_tokens, arg_min(props, (ts, event_id)) AS props, (user_id % 10 = 0)::INT AS archived FROM events GROUP BY user_id),
open AS (SELECT *, CASE WHEN id % 3 = 0 THEN '---' || chr(10) || 'name: skill ' || source || chr(10) || 'When to use: ' || props WHEN id % 3 = 1 THEN 'You must answer. ' || props END AS prompt FROM ses WHERE archived = 0),
con AS (SELECT CASE WHEN (starts_with(lower(prompt), '---') AND contains(substr(lower(prompt), 1, 300), 'name:')) OR {_any('lower(prompt)', rules.SKILL_CUES)} THEN 'skill_prompt' ELSE 'system_prompt' END AS block_type, prompt AS content FROM open WHERE length(prompt) > 0
  UNION ALL SELECT CASE WHEN role = 'tool' OR tool_name IS NOT NULL THEN 'tool_result' WHEN role = 'user' THEN 'user_prompt' WHEN role = 'assistant' THEN 'assistant_context' WHEN role = 'system' THEN 'system_prompt' ELSE 'unknown' END, content FROM msg JOIN open ON open.id = session_id WHERE length(content) > 0),
tel AS (SELECT CASE WHEN event_id % 11 <> 0 THEN epoch(ts)::DOUBLE END AS ts, ts AS seen_at, CASE WHEN event_id % 13 <> 0 THEN floor(value - 5)::BIGINT END AS chars_saved, try_cast(props->>'$.k' AS BIGINT) AS tokens_saved FROM events)"""
_DUPS = f"""{_BASE}, g AS (SELECT {_HASH.format('content')} AS content_hash, count(*) AS occurrences, max(length(content)) AS char_length, CASE WHEN count(DISTINCT tool_name) = 1 AND count(tool_name) = count(*) THEN max(tool_name) END AS tool_name FROM tools WHERE length(content) > 0 GROUP BY 1 HAVING count(*) >= 2)
SELECT *, char_length // 4 AS est_tokens, char_length // 4 * (occurrences - 1) AS est_wasted_tokens FROM g"""
_REPEATED = f"""{_BASE}, b AS (SELECT unnest({_BLOCKS}) AS block FROM tools), g AS (SELECT {_HASH.format('block')} AS block_hash, count(*) AS occurrences, max(length(block)) AS char_length FROM b GROUP BY 1 HAVING count(*) >= 3)
SELECT *, char_length // 4 AS est_tokens, char_length // 4 * (occurrences - 1) AS est_wasted_tokens FROM g"""
_TYPED = f"{_BASE}, b AS (SELECT block_type, unnest({_BLOCKS}) AS block FROM con), t AS (SELECT {_HASH.format('block')} AS block_hash, block_type, count(*) AS occ, max(length(block)) AS char_length FROM b GROUP BY 1, 2)"
_PRIORITY = "CASE block_type " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in rules.KEEP_PRIORITY.items()) + " ELSE 0 END"
_HINT, _LOW = _any("lower(content)", rules.TASK_CUES), "length(content) >= 8000"
_TOOL = "block_type IN ('tool_result', 'assistant_context', 'unknown')"
_ROUTED = f"""{_BASE}, k AS (SELECT {_HASH.format('content')} AS block_hash, arg_min(block_type, (-({_PRIORITY}), block_type)) AS block_type, count(*) AS occurrences, any_value(content) AS content FROM con WHERE length(content) > 0 GROUP BY 1),
d AS (SELECT *, CASE WHEN block_type = 'user_prompt' THEN ['policy_must_keep', 'user_prompt_never_drop'] WHEN block_type IN ('system_prompt', 'skill_prompt') THEN ['policy_must_keep', 'system_or_skill_constraint_never_drop']
  WHEN {_any('lower(content)', rules.SAFETY_CUES)} THEN ['policy_must_keep', 'safety_or_acceptance_constraint'] WHEN {_HINT} AND NOT {_LOW} THEN ['direct_task_hint', 'actionable_task_signal'] WHEN {_TOOL} AND {_HINT} THEN ['summarizable_candidate', 'large_actionable_tool_block']
  WHEN {_TOOL} AND {_LOW} AND occurrences >= 3 THEN ['likely_drop_candidate', 'large_repeated_tool_block'] WHEN {_TOOL} AND occurrences >= 3 THEN ['likely_drop_candidate', 'repeated_tool_block'] WHEN {_TOOL} AND {_LOW} THEN ['summarizable_candidate', 'large_single_tool_block'] ELSE ['likely_relevant', 'default_keep'] END AS r FROM k),
routed AS (SELECT block_hash, block_type, r[1] AS route_label, r[2] AS reason_code, occurrences, length(content) AS char_length, length(content) // 4 AS est_tokens, length(content) // 4 * occurrences AS total_est_tokens, CASE WHEN r[1] IN ('summarizable_candidate', 'likely_drop_candidate') THEN length(content) // 4 * occurrences ELSE 0 END AS est_candidate_tokens FROM d)"""
_ROLL = "count(*) AS block_count, sum(occurrences)::BIGINT AS occurrence_count, sum(total_est_tokens)::BIGINT AS total_est_tokens, sum(est_candidate_tokens)::BIGINT AS est_candidate_tokens"
_BODIES = f"""{_BASE}, s AS (SELECT {_HASH.format('content')} AS content_hash, block_type, count(*) AS n, any_value(content) AS content FROM con WHERE block_type IN ('assistant_context', 'tool_result') AND length(content) >= 400 GROUP BY 1, 2),
g AS (SELECT content_hash, sum(n)::BIGINT AS occurrences, arg_min(block_type, (-n, block_type)) AS canonical_source_type, any_value(content) AS content, string_agg(block_type || ':' || n, ',' ORDER BY block_type) AS source_type_counts FROM s GROUP BY 1),
bodies AS (SELECT content_hash, {_kind_sql()} AS artifact_kind, canonical_source_type, occurrences, length(content) AS char_length, length(content) // 4 AS est_tokens, length(content) // 4 * (occurrences - 1) AS est_duplicate_tokens, source_type_counts FROM g)"""


def _telemetry_sql(inside: str, bad: str) -> str:
    good = f"({inside}) AND NOT ({bad})"
    return f"""{_BASE}, t AS (SELECT count(*) FILTER ({good}) AS events, coalesce(sum(chars_saved) FILTER ({good}), 0)::BIGINT AS chars_saved, coalesce(sum(coalesce(tokens_saved, floor(chars_saved / 4)::BIGINT)) FILTER ({good}), 0)::BIGINT AS tokens_saved, count(*) FILTER (({inside}) AND ({bad})) AS malformed FROM tel),
u AS (SELECT *, round(tokens_saved / events, 1) AS avg_tokens FROM t)"""


_CUT = NOW - HOURS * 3600
ORACLES = {
    "tool_messages": f"{_BASE} SELECT tool_name, count(*) AS n, sum(length(content))::BIGINT AS chars FROM tools WHERE ts >= {_CUT} GROUP BY 1",
    "llm_bound_content": f"{_BASE} SELECT block_type, count(*) AS n, sum(length(content))::BIGINT AS chars FROM con GROUP BY 1",
    "dup_tool_outputs": f"{_DUPS} ORDER BY est_wasted_tokens DESC, content_hash LIMIT 20",
    "dup_tool_outputs_all": _DUPS,
    "repeated_blocks": f"{_REPEATED} ORDER BY est_wasted_tokens DESC, block_hash LIMIT 20",
    "repeated_blocks_all": _REPEATED,
    "tool_sizes": f"{_BASE} SELECT coalesce(nullif(tool_name, ''), '(unknown)') AS tool_name, count(*) AS output_count, sum(length(content))::BIGINT AS total_chars, max(length(content)) AS max_chars, count(*) FILTER (length(content) >= 8000) AS large_output_count, sum(length(content))::BIGINT // count(*) AS avg_chars, sum(length(content))::BIGINT // 4 AS total_est_tokens FROM tools GROUP BY 1 ORDER BY total_chars DESC, 1 LIMIT 20",
    "block_type_stats": f"""{_TYPED}, i AS (SELECT block_type, count(*) AS item_count FROM con GROUP BY 1), p AS (SELECT block_type, sum(occ)::BIGINT AS block_count, count(*) AS unique_block_count, count(*) FILTER (occ >= 3) AS repeated_block_count, coalesce(sum(char_length // 4 * (occ - 1)) FILTER (occ >= 3), 0)::BIGINT AS est_redundant_tokens FROM t GROUP BY 1)
SELECT block_type, item_count, coalesce(block_count, 0) AS block_count, coalesce(unique_block_count, 0) AS unique_block_count, coalesce(repeated_block_count, 0) AS repeated_block_count, coalesce(est_redundant_tokens, 0) AS est_redundant_tokens FROM i LEFT JOIN p USING (block_type)""",
    "cross_type_blocks": f"""{_TYPED}, g AS (SELECT block_hash, string_agg(block_type || ':' || occ, ',' ORDER BY block_type) AS type_occurrences, sum(occ)::BIGINT AS occurrences, max(char_length) AS char_length FROM t GROUP BY 1 HAVING count(*) >= 2)
SELECT *, char_length // 4 AS est_tokens, char_length // 4 * (occurrences - 1) AS est_wasted_tokens FROM g ORDER BY est_wasted_tokens DESC, block_hash LIMIT 20""",
    "routing_labels": f"{_ROUTED} SELECT route_label, {_ROLL} FROM routed GROUP BY 1",
    "routing_reasons": f"{_ROUTED} SELECT block_type, route_label, reason_code, {_ROLL} FROM routed GROUP BY 1, 2, 3",
    "routing_candidates": f"{_ROUTED} SELECT * FROM routed WHERE est_candidate_tokens > 0 ORDER BY est_candidate_tokens DESC, occurrences DESC, block_hash DESC LIMIT 20",
    "artifact_kinds": f"{_BODIES} SELECT artifact_kind, count(*) AS group_count, sum(occurrences)::BIGINT AS occurrence_count, count(*) FILTER (occurrences >= 2) AS duplicate_group_count, sum(est_tokens)::BIGINT AS est_tokens, sum(est_duplicate_tokens)::BIGINT AS est_duplicate_tokens FROM bodies GROUP BY 1",
    "artifact_dups": f"{_BODIES} SELECT * FROM bodies WHERE occurrences >= 2 ORDER BY est_duplicate_tokens DESC, occurrences DESC, content_hash DESC LIMIT 20",
    "heavy_sessions": f"{_BASE} SELECT {_HASH.format('id')} AS session_hash, source, input_tokens, tool_call_count, message_count FROM open ORDER BY input_tokens DESC, tool_call_count DESC, 1 LIMIT 20",
    "telemetry_coverage": _telemetry_sql(f"coalesce(ts >= {_CUT}, TRUE)", "chars_saved IS NULL") + " SELECT u.*, round(tokens_saved / (tokens_saved + (SELECT sum(input_tokens) FROM open)) * 100, 2) AS coverage_pct FROM u",
    "savings_summary": _telemetry_sql(f"coalesce(ts >= {_CUT}, FALSE)", "chars_saved IS NULL OR chars_saved < 0") + " SELECT * FROM u",
    "daily_report": _telemetry_sql("TRUE", "chars_saved IS NULL") + ", s AS (SELECT count(*) AS sessions, sum(message_count)::BIGINT AS messages, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM open) SELECT s.*, events, chars_saved, tokens_saved, malformed, round(tokens_saved / (tokens_saved + input_tokens) * 100, 2) AS reduction_pct FROM s, u",
    "source_totals": f"{_BASE} SELECT source, count(*) AS sessions, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM open GROUP BY 1 ORDER BY input_tokens DESC, 1 LIMIT 10",
    "telemetry_hourly": f"{_BASE} SELECT date_trunc('hour', seen_at) AS hour, count(*) AS events, sum(chars_saved)::BIGINT AS chars_saved, sum(coalesce(tokens_saved, floor(chars_saved / 4)::BIGINT))::BIGINT AS tokens_saved FROM tel GROUP BY 1",
    "latency_sketches": "SELECT event_type, count(value) AS count, round(sum(value) / count(value), 6) AS mean, max(value) AS max, true AS p50_within, true AS p99_within FROM events GROUP BY 1",
    "latency_stats": "WITH r AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, sum(value) AS s FROM events GROUP BY 1) SELECT event_type, n AS count, round(s / n, 6) AS mean, v[n // 2 + 1] AS p50, v[least(floor(n * 0.99)::BIGINT, n - 1) + 1] AS p99, v[n] AS max FROM r",
    "log_savings": "WITH l AS (SELECT floor(value)::BIGINT AS v FROM events WHERE event_id % 3 = 0) SELECT count(*) AS events, sum(v * 1000)::BIGINT AS chars_saved, sum(v)::BIGINT AS tokens_saved FROM l WHERE v >= 0",
}
