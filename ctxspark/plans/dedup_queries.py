"""Queries of chunking, block dedup and multi-turn dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import joined
from ..operators import blockdedup, chains, chunking, multiturn
from .tables import customer_contexts, table, turns_sql


def cdc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every document."""
    b = chunking.blocks(table(spark, sf_dir, "documents"), "text", "doc_id")
    return b.select("doc_id", "block_idx", "n_blocks", F.length("block").alias("n_chars"), chunking.block_hash(F.col("block")).alias("block_hash"))


def _payload_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("payload"), F.col("doc_id").alias("msg"), "text", F.col("lang").alias("label"))
    return blockdedup.deduped_blocks(docs, "payload", "msg", "text", "label")


def block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tool results of their source's payload, deduped by block."""
    made = blockdedup.deduped(_payload_blocks(spark, sf_dir), "payload", "msg")
    return made.select("payload", "msg", "blocks_total", "blocks_deduped", "chars_saved", F.md5("text").alias("text_md5"))


def block_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each payload."""
    return blockdedup.stats(_payload_blocks(spark, sf_dir), "payload").drop("system_blocks_matched")


def block_dedup_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each payload's first document as its system prompt: it gives origins and stays."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("payload"), F.col("doc_id").alias("msg"), "text", F.col("source").alias("label"))
    first = docs.groupBy("payload").agg(F.min("msg").alias("first"))  # one row a language: whole texts are not brought together for it
    docs = docs.join(first.withColumnRenamed("payload", "p"), F.col("payload").eqNullSafe(F.col("p")), "left").withColumn("is_system", F.col("msg") == F.col("first")).drop("p", "first")
    return blockdedup.stats(blockdedup.deduped_blocks(docs, "payload", "msg", "text", "label", "is_system"), "payload")


def doc_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language as one request, with references that name no tool."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("payload"), F.col("doc_id").alias("msg"), "text")
    b = blockdedup.deduped_blocks(docs, "payload", "msg", "text").where("n_blocks >= 2")
    made = blockdedup.deduped(b, "payload", "msg")
    return made.select("msg", "blocks_total", "blocks_deduped", "chars_saved", F.md5("text").alias("text_md5"))


def conversation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's suppliers that the customer has not had before, and hints for the others."""
    seen = multiturn.first_seen(customer_contexts(spark, sf_dir), "customer", "turn")
    made = multiturn.split_documents(seen, "customer", "turn")
    return made.select("ctx_id", joined(F.col("new_docs")).alias("new_docs"), joined(F.col("overlapping_docs")).alias("overlapping_docs"), F.array_join("hints", "|").alias("hints"))


def conversation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's ancestors, oldest first, by parent pointers."""
    turns = customer_contexts(spark, sf_dir).select(F.col("ctx_id").alias("request_id"), F.col("parent").alias("parent_id"))
    found = multiturn.ancestors(turns)
    chain = found.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("b"), "ancestor"))).alias("x"))
    out = turns.join(chain, "request_id", "left")
    ids = F.concat(F.coalesce(F.transform("x", lambda x: x["ancestor"]), F.array().cast("array<bigint>")), F.array("request_id"))
    return out.select("request_id", F.size(ids).cast("long").alias("turn"), joined(ids).alias("chain"))


def previous_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's earlier documents and the first request of its chain that had them."""
    turns = customer_contexts(spark, sf_dir)
    numbers = chains.numbered(turns.select(F.col("ctx_id").alias("request_id"), F.col("parent").alias("parent_id")))
    return chains.previous_documents(numbers, turns.select(F.col("ctx_id").alias("request_id"), F.explode("docs").alias("doc")))


def multi_turn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints that name the turn and the request a document came from."""
    seen = multiturn.first_seen(customer_contexts(spark, sf_dir), "customer", "turn")
    made = multiturn.split_documents(seen, "customer", "turn", template="See doc {doc_id} in turn {turn_number} ({source_request}).")
    return made.select("ctx_id", F.size("new_docs").cast("long").alias("n_new"), F.size("overlapping_docs").cast("long").alias("n_overlapping"), F.array_join("hints", "|").alias("hints"), (F.col("turn") == 1).alias("is_new_conversation"))


def _turn_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.col("s_name").alias("text"))
    seen = multiturn.first_seen(customer_contexts(spark, sf_dir), "customer", "turn")
    return multiturn.context_text(seen, corpus, "customer", "turn")


def multi_turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context texts: supplier names when new, hints when known."""
    return _turn_contexts(spark, sf_dir).select("ctx_id", F.md5("context").alias("context_md5"), "num_retrieved", "num_novel", "num_deduplicated")


def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each customer."""
    return multiturn.conversation_stats(_turn_contexts(spark, sf_dir), "customer")


def conversation_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all customers."""
    return multiturn.all_conversation_stats(multiturn.conversation_stats(_turn_contexts(spark, sf_dir), "customer"))


def history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval queries of every message with the four before it."""
    return multiturn.history_query(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.md5("query").alias("query_md5"), F.length("query").alias("n_chars"))


def session_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all conversations."""
    return multiturn.session_fingerprint(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def tool_docs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text their source has not had before."""
    return multiturn.first_copies(table(spark, sf_dir, "documents"), "source", "doc_id").select("source", "doc_id", "text_hash")


def single_doc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replaced by a hint where their language had the same text before."""
    made = multiturn.repeats_replaced(table(spark, sf_dir, "documents"), "lang", "doc_id")
    return made.select("doc_id", "origin", F.md5("result").alias("result_md5"))


def half_prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each first half of a text."""
    docs = table(spark, sf_dir, "documents").withColumn("half", F.md5(F.expr("left(text, length(text) div 2)")))
    return docs.withColumn("k", F.row_number().over(Window.partitionBy("half").orderBy("doc_id"))).where("k = 1").select("doc_id", "half")


def prefix_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation that the one before it began with, too (the cached turn)."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    cached = talk.select((F.col("conv_id") + 1).alias("conv_id"), "turn", F.col("role").alias("text"))
    return multiturn.replayed_prefix(cached, talk.select("conv_id", "turn", F.col("role").alias("text")), "conv_id", "turn")


def events_since_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events after their last error, which resets; events of no user would reset all."""
    events = table(spark, sf_dir, "events")
    left = multiturn.since_reset(events, events.where("event_type = 'error'").select("user_id", "ts"), "user_id", "ts")
    return left.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("value"))


QUERIES = [
    events_since_reset,
    cdc_blocks, block_dedup, block_dedup_stats, block_dedup_system, doc_block_dedup, conversation_dedup, conversation_chain, previous_docs, multi_turn_dedup, multi_turn_context,
    conversation_stats, conversation_stats_all, history_query, session_fingerprint, tool_docs_dedup, single_doc_dedup, half_prefix_dedup, prefix_replay,
]

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BARE = r"regexp_replace({0}, '^\s*\d+\|', '')"


def _blocks_sql(where: str = "true") -> str:
    h = f"md5({_STRIP.format(_BARE.format('line'))})"
    little = f"('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))::BIGINT"
    bare_block = f"array_to_string(list_transform(string_split({_STRIP.format('block')}, chr(10)), lambda l: {_BARE.format('l')}), chr(10))"
    return f"""RECURSIVE src AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE {where}),
ln AS (SELECT doc_id, len(ls) AS n, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM src),
fl AS (SELECT doc_id, n, k, line, {little} % 13 = 0 AS edge FROM ln),
walk AS (SELECT doc_id, n, k, line, 0 AS blk, 1 AS held, edge FROM fl WHERE k = 1
  UNION ALL SELECT f.doc_id, f.n, f.k, f.line, w.blk + CASE WHEN w.n > 3 AND ((w.edge AND w.held >= 3) OR w.held >= 40) THEN 1 ELSE 0 END,
    CASE WHEN w.n > 3 AND ((w.edge AND w.held >= 3) OR w.held >= 40) THEN 1 ELSE w.held + 1 END, f.edge FROM walk w JOIN fl f ON f.doc_id = w.doc_id AND f.k = w.k + 1),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, blk) AS len, max(blk) OVER (PARTITION BY doc_id) AS last FROM walk),
named AS (SELECT doc_id, k, line, CASE WHEN blk = last AND blk > 0 AND len < 3 THEN blk - 1 ELSE blk END AS block_idx FROM sized),
raw AS (SELECT doc_id, block_idx, string_agg(line, chr(10) ORDER BY k) AS block FROM named GROUP BY 1, 2),
blocks AS (SELECT doc_id, block_idx, block, count(*) OVER (PARTITION BY doc_id) AS n_blocks, substr(sha256({bare_block}), 1, 20) AS block_hash FROM raw)"""


def _dedup_sql(payload: str, label: str | None, system: bool = False) -> str:
    earlier = "'earlier result'" if label is None else f"'earlier ' || {'CASE WHEN o.sys THEN ' + chr(39) + 'system prompt' + chr(39) + ' ELSE o.lab END' if system else 'o.lab'} || ' result'"
    where = "length(text) >= 200" if not system else "length(text) >= 200 OR doc_id IN (SELECT min(doc_id) FROM documents GROUP BY lang)"
    return f"""WITH {_blocks_sql(where)},
b AS (SELECT {payload} AS payload, doc_id AS msg, {label or "''"} AS lab, {'doc_id IN (SELECT min(doc_id) FROM documents GROUP BY lang)' if system else 'FALSE'} AS sys, block_idx, n_blocks, block, block_hash, length({_STRIP.format('block')}) >= 40 AS ok FROM blocks JOIN documents USING (doc_id)),
o AS (SELECT payload, block_hash, arg_min(msg, (msg, block_idx)) AS msg, arg_min(lab, (msg, block_idx)) AS lab, arg_min(sys, (msg, block_idx)) AS sys FROM b WHERE ok GROUP BY 1, 2),
r AS (SELECT b.payload, b.msg, b.block_idx, b.n_blocks, b.block, ok, ok AND o.msg <> b.msg AND n_blocks >= 2 AND NOT b.sys AS hit, o.sys AS osys,
  '[... "' || substr(string_split({_STRIP.format('block')}, chr(10))[1], 1, 80) || '" — identical to ' || {earlier} || ', see above ...]' AS ref
  FROM b LEFT JOIN o ON b.ok AND o.payload = b.payload AND o.block_hash = b.block_hash),
d AS (SELECT *, coalesce(hit AND length(ref) < length(block), FALSE) AS replaced FROM r)"""


_TOTALS = "count(*) FILTER (ok) AS blocks_total, count(*) FILTER (replaced) AS blocks_deduped, coalesce(sum(length(block) - length(ref)) FILTER (replaced), 0)::BIGINT AS chars_saved"
_TEXT = "md5(string_agg(CASE WHEN replaced THEN ref ELSE block END, chr(10) ORDER BY block_idx)) AS text_md5"
_SEEN = f"""WITH {turns_sql()}, e AS (SELECT t.ctx_id, customer, turn, doc, pos FROM turns t JOIN places USING (ctx_id)),
s AS (SELECT *, first(turn) OVER w AS first_turn, first(ctx_id) OVER w AS first_ctx FROM e WINDOW w AS (PARTITION BY customer, doc ORDER BY turn, ctx_id))"""
_CONTEXTS = f"""{_SEEN}, c AS (SELECT ctx_id, customer, string_agg(CASE WHEN first_ctx <> ctx_id THEN 'Please refer to [Doc_' || doc || '] in the previous conversation.' ELSE '[Doc_' || doc || ']: ' || s_name END || chr(10) || chr(10), '' ORDER BY pos) AS context,
  count(*) AS num_retrieved, count(*) FILTER (first_ctx = ctx_id) AS num_novel, count(*) FILTER (first_ctx <> ctx_id) AS num_deduplicated FROM s LEFT JOIN supplier ON s_suppkey = doc GROUP BY 1, 2),
st AS (SELECT customer, count(*) AS turns, sum(num_retrieved)::BIGINT AS total_retrieved, sum(num_novel)::BIGINT AS total_novel, sum(num_deduplicated)::BIGINT AS total_deduplicated, round(sum(num_deduplicated) / sum(num_retrieved), 6) AS deduplication_rate FROM c GROUP BY 1)"""

ORACLES = {
    "events_since_reset": "WITH r AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS value FROM events LEFT JOIN r USING (user_id) WHERE last IS NULL OR ts > last GROUP BY 1",
    "cdc_blocks": f"WITH {_blocks_sql()} SELECT doc_id, block_idx, n_blocks, length(block) AS n_chars, block_hash FROM blocks",
    "block_dedup": f"{_dedup_sql('source', 'lang')} SELECT payload, msg, {_TOTALS}, {_TEXT} FROM d GROUP BY 1, 2",
    "block_dedup_stats": f"{_dedup_sql('source', 'lang')} SELECT payload, {_TOTALS} FROM d GROUP BY 1",
    "block_dedup_system": f"{_dedup_sql('lang', 'source', True)} SELECT payload, {_TOTALS}, count(*) FILTER (hit AND osys) AS system_blocks_matched FROM d GROUP BY 1",
    "doc_block_dedup": f"{_dedup_sql('lang', None)} SELECT msg, {_TOTALS}, {_TEXT} FROM d WHERE n_blocks >= 2 GROUP BY payload, msg",
    "conversation_dedup": f"""{_SEEN} SELECT ctx_id, coalesce(string_agg(doc, ',' ORDER BY pos) FILTER (first_ctx = ctx_id), '') AS new_docs, coalesce(string_agg(doc, ',' ORDER BY pos) FILTER (first_ctx <> ctx_id), '') AS overlapping_docs,
coalesce(string_agg('Please refer to [Doc ' || doc || '] from the previous conversation.', '|' ORDER BY pos) FILTER (first_ctx <> ctx_id), '') AS hints FROM s GROUP BY ctx_id""",
    "conversation_chain": f"WITH {turns_sql()} SELECT ctx_id AS request_id, turn, string_agg(ctx_id, ',') OVER (PARTITION BY customer ORDER BY turn) AS chain FROM turns",
    "previous_docs": f"""{_SEEN}, f AS (SELECT DISTINCT customer, doc, first_turn, first_ctx FROM s) SELECT t.ctx_id AS request_id, doc, first_ctx AS source_request FROM turns t JOIN f ON f.customer = t.customer AND f.first_turn < t.turn""",
    "multi_turn_dedup": f"""{_SEEN} SELECT ctx_id, count(*) FILTER (first_ctx = ctx_id) AS n_new, count(*) FILTER (first_ctx <> ctx_id) AS n_overlapping,
coalesce(string_agg('See doc ' || doc || ' in turn ' || first_turn || ' (' || first_ctx || ').', '|' ORDER BY pos) FILTER (first_ctx <> ctx_id), '') AS hints, any_value(turn) = 1 AS is_new_conversation FROM s GROUP BY ctx_id""",
    "multi_turn_context": f"{_CONTEXTS} SELECT ctx_id, md5(context) AS context_md5, num_retrieved, num_novel, num_deduplicated FROM c",
    "conversation_stats": f"{_CONTEXTS} SELECT * FROM st",
    "conversation_stats_all": f"{_CONTEXTS} SELECT count(*) AS conversations, sum(turns)::BIGINT AS total_turns, round(avg(turns), 6) AS avg_turns, sum(total_retrieved)::BIGINT AS total_retrieved, sum(total_deduplicated)::BIGINT AS total_deduplicated, round(sum(total_deduplicated) / sum(total_retrieved), 6) AS deduplication_rate FROM st",
    "history_query": """WITH q AS (SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) || chr(10), '') || text AS query FROM conversations)
SELECT conv_id, turn, md5(query) AS query_md5, length(query) AS n_chars FROM q""",
    "session_fingerprint": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT conv_id, substr(sha256(coalesce(arg_min(substr(text, 1, 500), place) FILTER (role = 'system'), '') || chr(0) || coalesce(arg_min(text, place) FILTER (role = 'user'), '')), 1, 16) AS fingerprint FROM p WHERE place <= 5 GROUP BY conv_id""",
    "tool_docs_dedup": "SELECT source, doc_id, substr(sha256(trim(text)), 1, 16) AS text_hash FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(trim(text)) ORDER BY doc_id) = 1",
    "single_doc_dedup": f"""WITH f AS (SELECT doc_id, text, first(doc_id) OVER (PARTITION BY lang, sha256({_STRIP.format('text')}) ORDER BY doc_id) AS o FROM documents)
SELECT doc_id, CASE WHEN o <> doc_id THEN o END AS origin, md5(CASE WHEN o <> doc_id THEN '[Document identical to the result of call ' || o || ', see above.]' ELSE text END) AS result_md5 FROM f""",
    "half_prefix_dedup": "SELECT doc_id, md5(left(text, length(text) // 2)) AS half FROM documents QUALIFY row_number() OVER (PARTITION BY left(text, length(text) // 2) ORDER BY doc_id) = 1",
    "prefix_replay": """WITH j AS (SELECT b.conv_id, b.turn, coalesce((a.role = b.role)::INT, 0) AS same FROM conversations b LEFT JOIN conversations a ON a.conv_id + 1 = b.conv_id AND a.turn = b.turn),
m AS (SELECT conv_id, min(same) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM j) SELECT conv_id, sum(run)::BIGINT AS n_replayed FROM m GROUP BY conv_id""",
}
