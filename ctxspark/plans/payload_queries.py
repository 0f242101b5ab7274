"""Queries over requests of chat interfaces.

The requests are made of the tables: ``conversations`` are chats; twenty ``documents`` are a request whose
results of tool calls they are, every third one inside a JSON object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import blockdedup, payloads, turns
from .dedup_queries import _dedup_sql
from .tables import table

#: Tool results of a request.
RESULTS = 20


def _sorted_list(order: list[str], item: F.Column) -> F.Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))), lambda x: x["item"])


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload, body): conversations as chat completion requests."""
    talk = table(spark, sf_dir, "conversations")
    return talk.groupBy(F.col("conv_id").alias("payload")).agg(F.to_json(F.struct(_sorted_list(["turn"], F.struct("role", F.col("text").alias("content"))).alias("messages"))).alias("body"))


def _anthropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload, body): conversations as messages requests, system texts apart."""
    talk = table(spark, sf_dir, "conversations").withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), "text")))
    system = _sorted_list(["turn"], F.when(F.col("role") == "system", F.get("parts", F.lit(0))))
    messages = _sorted_list(["turn"], F.when(F.col("role") != "system", F.struct("role", F.col("parts").alias("content"))))
    own = talk.groupBy(F.col("conv_id").alias("payload")).agg(F.filter(system, lambda x: x.isNotNull()).alias("system"), F.filter(messages, lambda x: x.isNotNull()).alias("messages"))
    return own.select("payload", F.to_json(F.struct("system", "messages")).alias("body"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload, doc_id, lang, call, content): documents as results of tool calls."""
    docs = table(spark, sf_dir, "documents")
    wrapped = F.to_json(F.struct(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")))
    content = F.when(F.col("doc_id") % 3 == 0, wrapped).otherwise(F.col("text"))
    return docs.select(F.floor(F.col("doc_id") / RESULTS).alias("payload"), "doc_id", "lang", F.concat(F.lit("call_"), F.col("doc_id").cast("string")).alias("call"), content.alias("content"))


def _tool_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.struct(F.col("call").alias("id"), F.struct(F.col("lang").alias("name")).alias("function"))
    text, none = T_STRING, F.lit(None)
    asked = F.struct(F.lit("assistant").alias("role"), none.cast(text).alias("content"), none.cast(text).alias("tool_call_id"), F.array(call).alias("tool_calls"))
    got = F.struct(F.lit("tool").alias("role"), "content", F.col("call").alias("tool_call_id"), none.cast("array<struct<id:string,function:struct<name:string>>>").alias("tool_calls"))
    rows = _results(spark, sf_dir).withColumn("pair", F.array(asked, got))
    return rows.groupBy("payload").agg(F.to_json(F.struct(F.flatten(_sorted_list(["doc_id"], F.col("pair"))).alias("messages"))).alias("body"))


T_STRING = "string"


def _tool_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast(T_STRING)
    asked = F.struct(F.lit("function_call").alias("type"), F.col("call").alias("call_id"), F.col("lang").alias("name"), none.alias("output"))
    got = F.struct(F.lit("function_call_output").alias("type"), F.col("call").alias("call_id"), none.alias("name"), F.col("content").alias("output"))
    rows = _results(spark, sf_dir).withColumn("pair", F.array(asked, got))
    return rows.groupBy("payload").agg(F.to_json(F.struct(F.flatten(_sorted_list(["doc_id"], F.col("pair"))).alias("input"))).alias("body"))


def _shown(segments: DataFrame) -> DataFrame:
    return segments.select("payload", "msg", "part", "kind", "call_id", "name", F.md5("text").alias("text_md5"))


def payload_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of chat completion requests."""
    return _shown(payloads.segments(_chats(spark, sf_dir), "payload", "body"))


def anthropic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of messages requests."""
    return _shown(payloads.segments(_anthropic(spark, sf_dir), "payload", "body", "anthropic_messages"))


def tool_result_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of tool calls with the names of the tools, from both kinds of requests that have them."""
    chat = payloads.segments(_tool_chats(spark, sf_dir), "payload", "body", scope="tool_results")
    responses = payloads.segments(_tool_responses(spark, sf_dir), "payload", "body", "openai_responses", "tool_results")
    return _shown(chat).withColumn("style", F.lit("chat")).unionByName(_shown(responses).withColumn("style", F.lit("responses")))


def system_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system texts of each chat."""
    return payloads.system_content(payloads.segments(_chats(spark, sf_dir), "payload", "body", scope="system"))


def _dedup_rows(made: DataFrame) -> DataFrame:
    return made.select("payload", "msg", "name", "blocks_total", "blocks_deduped", "chars_saved", F.md5("text").alias("text_md5"))


def payload_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results of chats, deduped by block inside their JSON, and put back."""
    return _dedup_rows(payloads.deduped(payloads.segments(_tool_chats(spark, sf_dir), "payload", "body")))


def responses_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of responses requests."""
    return _dedup_rows(payloads.deduped(payloads.segments(_tool_responses(spark, sf_dir), "payload", "body", "openai_responses")))


def rebuilt_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of both kinds with deduped results put back in their bodies: the long results that are read from these."""
    out = None
    for style, bodies in (("openai_chat", _tool_chats(spark, sf_dir)), ("openai_responses", _tool_responses(spark, sf_dir))):
        made = payloads.segments(payloads.deduped_bodies(bodies, "payload", "body", style), "payload", "body", style, "tool_results")
        long_ones = payloads.deduped(payloads.segments(bodies, "payload", "body", style)).select("payload", "msg")
        told = made.select("payload", "msg", "call_id", "name", F.md5("text").alias("text_md5"))  # hashed where they are read: no text is shuffled
        rows = told.join(long_ones, ["payload", "msg"], "left_semi").withColumn("style", F.lit(style))
        out = rows if out is None else out.unionByName(rows)
    return out


def external_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents between markers with random ids, and without the ids."""
    docs = table(spark, sf_dir, "documents")
    mark = lambda end: F.concat(F.lit(f"<<<{end}EXTERNAL_UNTRUSTED_CONTENT id=\""), F.substring(F.md5("text"), 1, 8), F.lit('">>>'))
    return docs.select("doc_id", F.md5(tx.without_random_ids(F.concat(mark(""), F.lit("\n"), "text", F.lit("\n"), mark("END_")))).alias("text_md5"))


def document_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line item stood, when an order's are sorted by supplier and named by part modulo 3."""
    rows = table(spark, sf_dir, "lineitem").withColumn("ctx_id", F.col("l_orderkey"))
    own = Window.partitionBy("ctx_id")
    line = F.row_number().over(own.orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"))
    items = rows.select("ctx_id", line.alias("pos"), (F.col("l_partkey") % 3).alias("doc"), "l_suppkey")
    place = F.row_number().over(own.orderBy("l_suppkey", "pos"))
    return payloads.occurrences(items.drop("l_suppkey"), items.select("ctx_id", "doc", place.alias("pos")), "ctx_id")


def fence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fenced code blocks of their source's conversation."""
    docs = table(spark, sf_dir, "documents").where(~F.col("text").contains("```"))
    told = docs.select("source", "doc_id", F.concat(F.lit("Look:\n```txt\n"), F.trim("text"), F.lit("\n```\nDone.")).alias("text"))
    return blockdedup.deduped_fences(told, "source", "doc_id", "text").select("source", "doc_id", "fences", "replaced", F.md5("text").alias("text_md5"))


def _agent_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload, body): results of tool calls, of which every fourth document is asked for again at the end."""
    once = _results(spark, sf_dir).withColumn("again", F.lit(False))
    twice = once.where("doc_id % 4 = 1").withColumns({"again": F.lit(True), "call": F.concat(F.lit("again_"), F.col("doc_id").cast("string"))})
    calls = F.array(F.struct(F.col("call").alias("id"), F.struct(F.col("lang").alias("name")).alias("function")))
    none = F.lit(None).cast(T_STRING)
    asked = F.struct(F.lit("assistant").alias("role"), none.alias("content"), none.alias("tool_call_id"), calls.alias("tool_calls"))
    got = F.struct(F.lit("tool").alias("role"), "content", F.col("call").alias("tool_call_id"), F.lit(None).cast("array<struct<id:string,function:struct<name:string>>>").alias("tool_calls"))
    rows = once.unionByName(twice).withColumn("pair", F.array(asked, got))
    return rows.groupBy("payload").agg(F.to_json(F.struct(F.flatten(_sorted_list(["again", "doc_id"], F.col("pair"))).alias("messages"))).alias("body"))


def turn_optimizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents' sessions whose second turn goes on from the first half of their tool calls: what each turn brought and saved of documents."""
    whole = _agent_chats(spark, sf_dir)
    messages = F.from_json("body", "messages array<string>")["messages"]
    half = F.concat(F.lit('{"messages":['), F.array_join(F.slice(messages, 1, F.ceil(F.size(messages) / 4).cast("int") * 2), ","), F.lit("]}"))
    rows = whole.select("payload", F.explode(F.array(F.struct(F.lit(1).alias("turn"), half.alias("body")), F.struct(F.lit(2).alias("turn"), "body"))).alias("t")).select("payload", "t.*")
    made = turns.optimized(rows, "payload", "turn", "body")
    texts = F.filter(F.from_json("body", "messages array<struct<role: string, content: string>>")["messages"], lambda m: m["role"] == "tool")
    hints = F.size(F.filter(texts, lambda m: m["content"].startswith("[Duplicate")))
    return made.select("payload", "turn", "n", "replayed", "docs_deduped", "doc_chars_saved", hints.alias("hints"))


QUERIES = [
    turn_optimizer,
    payload_segments, anthropic_segments, tool_result_segments, system_content, payload_block_dedup, responses_block_dedup, rebuilt_bodies, external_markers,
    document_occurrences, fence_dedup,
]

_RESULT = f"""t AS (SELECT doc_id // {RESULTS} AS payload, doc_id, lang, 'call_' || doc_id AS call, CASE WHEN doc_id % 3 = 0 THEN '{{"path":"/d/' || doc_id || '","content":' || to_json(text)::VARCHAR || '}}' ELSE text END AS content,
  row_number() OVER (PARTITION BY doc_id // {RESULTS} ORDER BY doc_id) * 2 - 1 AS msg FROM documents)"""
# a JSON result without a long text is looked at as a whole
_LOOKED_AT = f"""WITH RECURSIVE looked AS (SELECT doc_id, lang, source, doc_id % 3 = 0 AND length(text) >= 200 AS inside, CASE WHEN doc_id % 3 = 0 AND length(text) < 200 THEN content ELSE text END AS text
  FROM (SELECT doc_id, lang, source, text, '{{"path":"/d/' || doc_id || '","content":' || to_json(text)::VARCHAR || '}}' AS content FROM documents)), """
_REBUILT = _LOOKED_AT + _dedup_sql(f"doc_id // {RESULTS}", "lang").replace("WITH RECURSIVE ", "", 1).replace("FROM documents", "FROM looked").replace("JOIN documents", "JOIN looked") + f""",
g AS (SELECT payload, msg AS doc_id, count(*) FILTER (ok) AS blocks_total, count(*) FILTER (replaced) AS blocks_deduped, string_agg(CASE WHEN replaced THEN ref ELSE block END, chr(10) ORDER BY block_idx) AS text FROM d GROUP BY 1, 2),
m AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id // {RESULTS} ORDER BY doc_id) * 2 - 1 AS msg, text AS old,
  CASE WHEN inside THEN '{{"path":"/d/' || doc_id || '","content":' ELSE '' END AS head, CASE WHEN inside THEN '}}' ELSE '' END AS tail FROM looked),
e AS (SELECT payload, msg, lang AS name, blocks_total, blocks_deduped, CASE WHEN head = '' THEN old ELSE head || to_json(old)::VARCHAR || tail END AS before, CASE WHEN head = '' THEN g.text ELSE head || to_json(g.text)::VARCHAR || tail END AS after FROM g JOIN m USING (doc_id))
SELECT payload, msg, name, blocks_total, blocks_deduped, length(before) - length(after) AS chars_saved, md5(after) AS text_md5 FROM e"""

ORACLES = {
    "turn_optimizer": f"""WITH d AS (SELECT floor(doc_id / {RESULTS})::BIGINT AS payload, doc_id, CASE WHEN doc_id % 3 = 0 THEN '{{"path":"/d/' || doc_id || '","content":' || to_json(text)::VARCHAR || '}}' ELSE text END AS content FROM documents),
r AS (SELECT *, false AS again, 'call_' || doc_id AS call FROM d UNION ALL SELECT *, true, 'again_' || doc_id FROM d WHERE doc_id % 4 = 1),
o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY payload) AS m, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS bare FROM r WINDOW w AS (PARTITION BY payload ORDER BY again, doc_id)),
c AS (SELECT *, first_value(call) OVER (PARTITION BY payload, bare ORDER BY k) AS origin, ceil(m / 2)::INT AS h FROM o),
s AS (SELECT payload, m, h, k, length(bare) >= 100 AND origin <> call AS gone, length(content) - length('[Duplicate — identical to previous tool result (' || origin || '). Refer to the earlier result above.]') AS saved FROM c)
SELECT payload, turn, CASE turn WHEN 1 THEN 2 * h ELSE 2 * m END::INT AS n, CASE turn WHEN 1 THEN 0 ELSE 2 * h END::INT AS replayed, count(*) FILTER (gone AND (k <= h) = (turn = 1)) AS docs_deduped,
  coalesce(sum(saved) FILTER (gone AND (k <= h) = (turn = 1)), 0)::BIGINT AS doc_chars_saved, (count(*) FILTER (gone AND (k <= h OR turn = 2)))::INT AS hints FROM s, (VALUES (1), (2)) t(turn) GROUP BY payload, turn, m, h""",
    "payload_segments": "SELECT conv_id AS payload, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg, 0 AS part, role AS kind, NULL::VARCHAR AS call_id, NULL::VARCHAR AS name, md5(text) AS text_md5 FROM conversations QUALIFY text <> ''",
    "anthropic_segments": """SELECT conv_id AS payload, CASE WHEN role = 'system' THEN -1 ELSE row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) - 1 END AS msg,
  CASE WHEN role = 'system' THEN row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) - 1 ELSE 0 END AS part, role AS kind, NULL::VARCHAR AS call_id, NULL::VARCHAR AS name, md5(text) AS text_md5 FROM conversations QUALIFY text <> ''""",
    "tool_result_segments": f"WITH {_RESULT} SELECT payload, msg, 0 AS part, 'tool_result' AS kind, call AS call_id, lang AS name, md5(content) AS text_md5, style FROM t, (VALUES ('chat'), ('responses')) s(style) WHERE content <> ''",
    "system_content": "SELECT conv_id AS payload, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) AS system FROM conversations WHERE role = 'system' AND trim(text) <> '' GROUP BY conv_id",
    "payload_block_dedup": _REBUILT,
    "responses_block_dedup": _REBUILT,
    "rebuilt_bodies": f"SELECT payload, msg, 'call_' || (payload * {RESULTS} + rank - 1) AS call_id, name, text_md5, style FROM (SELECT payload, msg, name, text_md5, (msg + 1) // 2 AS rank FROM ({_REBUILT})), (VALUES ('openai_chat'), ('openai_responses')) s(style)",
    "external_markers": "SELECT doc_id, md5('<<<EXTERNAL_UNTRUSTED_CONTENT>>>' || chr(10) || text || chr(10) || '<<<END_EXTERNAL_UNTRUSTED_CONTENT>>>') AS text_md5 FROM documents",
    "document_occurrences": """WITH n AS (SELECT l_orderkey AS ctx_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS pos, l_partkey % 3 AS doc, l_suppkey FROM lineitem),
i AS (SELECT ctx_id, pos, doc, row_number() OVER (PARTITION BY ctx_id ORDER BY l_suppkey, pos) AS new_pos FROM n),
c AS (SELECT *, row_number() OVER (PARTITION BY ctx_id, doc ORDER BY pos) AS old_copy, row_number() OVER (PARTITION BY ctx_id, doc ORDER BY new_pos) AS new_copy FROM i)
SELECT b.ctx_id, b.new_pos, a.pos FROM c b JOIN c a ON a.ctx_id = b.ctx_id AND a.doc = b.doc AND a.old_copy = b.new_copy""",
    "fence_dedup": """WITH d AS (SELECT source, doc_id, trim(text, ' ') AS body, min(doc_id) OVER (PARTITION BY source, regexp_replace(trim(text, ' '), '^\\s+|\\s+$', '', 'g'), length(trim(text, ' ')) >= 200) AS origin FROM documents WHERE NOT contains(text, '```')),
r AS (SELECT *, '[... "' || substr(string_split(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), chr(10))[1], 1, 80) || '" — identical to earlier result, see above ...]' AS told FROM d),
n AS (SELECT *, CASE WHEN length(body) >= 200 AND origin <> doc_id AND length(told) < length(body) THEN 1 ELSE 0 END AS replaced FROM r)
SELECT source, doc_id, 1 AS fences, replaced, md5('Look:' || chr(10) || '```txt' || chr(10) || CASE WHEN replaced = 1 THEN told ELSE body END || chr(10) || '```' || chr(10) || 'Done.') AS text_md5 FROM n""",
}
