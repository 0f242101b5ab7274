"""Queries of cache state, run statistics, memories, evidence, composed turns and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics, cache, evalqa, extract, multiturn, prompts, retrieve
from ..operators import contexts as cx
from ..sources import jsonl
from .analytics_queries import HOURS, NOW, telemetry
from .tables import customer_contexts, table, turns_sql

TTL = 36_000


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    made = F.when(F.col("event_type") == "signup", F.floor("value") + 1).otherwise(0).cast("long")
    read = F.when(F.col("event_type").isin("view", "click"), F.floor("value")).otherwise(0).cast("long")
    return e.select(F.concat(F.lit("req-"), F.col("user_id").cast("string")).alias("request_id"), "ts", F.col("event_id").alias("tie"), made.alias("cache_creation_tokens"), read.alias("cache_read_tokens"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.after_responses(_responses(spark, sf_dir))


def ttl_after_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache entries that the events leave: sign-ups write, views and clicks read."""
    return _entries(spark, sf_dir).select("request_id", "tokens", F.unix_micros(F.col("last_access").cast("timestamp")).alias("last_access_us"), "touches")


def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries whose time is over at the end of January."""
    return cache.expired(_entries(spark, sf_dir), F.timestamp_seconds(F.lit(NOW)), TTL).select("request_id", "tokens", "idle_seconds")


def ttl_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that stay, and their tokens."""
    return cache.evicted(_entries(spark, sf_dir), F.timestamp_seconds(F.lit(NOW)), TTL).agg(F.count("*").alias("entries"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def ttl_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long providers keep prefixes."""
    return cache.ttl_defaults(spark)


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: errors failed."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return analytics.run_stats(e.select((F.col("event_type") != "error").alias("success"), k.alias("output_len"), (k / 64).alias("ttft"), (k / 64 + F.col("event_id") % 8).alias("latency")))


def ttft_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's history of times."""
    e = table(spark, sf_dir, "events").withColumn("ms", F.get_json_object("props", "$.k").cast("double"))
    return analytics.ttft_history(e, "user_id", ["ts", "event_id"], "ms", last=10)


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session sources, saved tokens by event type and cache entries as one report."""
    e = table(spark, sf_dir, "events")
    by_type = e.groupBy("event_type").agg(F.count("*").alias("events"), F.floor(F.sum("value")).cast("long").alias("tokens"))
    langs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    entries = _entries(spark, sf_dir).agg(F.count("*").alias("entries"), F.sum("tokens").alias("tokens"))
    return analytics.full_report({"types": by_type, "languages": langs, "cache": entries})


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report as lists."""
    return analytics.markdown(full_report(spark, sf_dir))


def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as memories of their label: every hundredth asks for the nearest of its own, beyond a threshold."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("user"), (F.col("vec_id") % 2).alias("agent"))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector", "user", F.when(F.col("vec_id") % 200 == 0, F.col("agent")).alias("agent"))
    return retrieve.memory_search(v.withColumnRenamed("vec_id", "memory_id"), asked, 10, ("user", "agent"), threshold=0.1)


def memory_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that orders hold, under the numbers of their first appearance."""
    from .tables import order_contexts

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("memory_id"), F.col("p_name").alias("text"))
    return retrieve.memory_corpus(parts, cx.interned(order_contexts(spark, sf_dir)))


def chunk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks: the first returned order of the same supplier and part modulo 50."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), "l_returnflag", F.col("l_suppkey").alias("doc_name"), (F.col("l_partkey") % 50).alias("node_id"))
    items = rows.where("l_returnflag = 'R'").select("doc_name", "node_id", F.col("chunk").alias("item_id"))
    return retrieve.chunk_items(rows, items).groupBy("doc_name", "node_id", "item_id").agg(F.count("*").alias("n"))


def tree_fields_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page trees of one document each, without their texts."""
    d = table(spark, sf_dir, "documents")
    leaf = F.struct(F.col("lang").alias("title"), "text")
    tree = F.to_json(F.struct(F.col("doc_id").alias("node_id"), "text", F.array(leaf, F.struct(F.col("source").alias("title"), F.lit(None).cast("string").alias("text"))).alias("nodes")))
    return d.select("doc_id", retrieve.tree_without(tree).alias("tree"))


def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of nations: customers name segment and nation; golds are the nation's segments with two spellings."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    own = c.join(n, F.col("c_nationkey") == F.col("k"))
    said = own.groupBy("n_name").agg(F.collect_list(F.array(F.concat(F.col("c_mktsegment"), F.lit("!")), F.lower("n_name"))).alias("p"))
    golds = n.select("n_name", F.array(*(F.array(F.array(F.lit(s), "n_name"), F.array(F.lit(f"{s} s"), F.lit("x"))) for s in ("building", "Machinery", "household  ", "toys"))).alias("g"))
    s = evalqa.evidence_scores(F.col("p"), F.col("g"))
    return said.join(golds, "n_name").select("n_name", s.alias("s")).select("n_name", *(F.round(f"s.{m}", 6).alias(m) for m in ("em", "f1", "prec", "recall")))


def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as titles, and as evidence."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", evalqa.normalize_title(F.col("p_name")).alias("title"), F.array_join(evalqa.normalize_evidence(F.array("p_name", F.concat(F.lit(" The, "), F.col("p_brand")))), "|").alias("evidence"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_contexts(spark, sf_dir).select(F.col("ctx_id").alias("request_id"), F.col("parent").alias("parent_id"))


def requests_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are left when urgent ones are removed."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("request_id"))
    return multiturn.without_requests(_turns(spark, sf_dir), urgent)


def conversations_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the customers' orders when the chains up to their fourth ones go."""
    fourth = customer_contexts(spark, sf_dir).where("turn = 4").select(F.col("ctx_id").alias("request_id"))
    return multiturn.cleared(_turns(spark, sf_dir), fourth)[0]


def conversation_clear_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests each clearing removes."""
    fourth = customer_contexts(spark, sf_dir).where("turn = 4").select(F.col("ctx_id").alias("request_id"))
    return multiturn.cleared(_turns(spark, sf_dir), fourth.unionByName(fourth.selectExpr("-request_id AS request_id")))[1]


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns of the conversations: history, retrieval of benchmark items, hints for what was had before."""
    talk = table(spark, sf_dir, "conversations").withColumn("ctx_id", F.col("conv_id") * 1000 + F.col("turn"))
    items = table(spark, sf_dir, "benchmark")

    def search(queries: DataFrame, k: int) -> DataFrame:
        return retrieve.bm25(items, queries, k, id_col="item_id", query_col="qid")

    corpus = items.select(F.col("item_id").alias("doc"), "text")
    made = multiturn.conversation_turns(talk, corpus, search, "conv_id", "turn", 3)
    return made.select("conv_id", "turn", F.md5("context").alias("context_md5"), "num_retrieved", "num_novel", "num_deduplicated")


def answers_without_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts with a block of reasoning before them, or inside."""
    t = table(spark, sf_dir, "conversations")
    first, inside = F.concat(F.lit("<think>\nhm\n</think>\n"), "text"), F.concat(F.col("role"), F.lit(" <think>x</think>"))
    return t.select("conv_id", "turn", F.md5(tx.without_thinking(first)).alias("a_md5"), tx.without_thinking(inside).alias("b"))


def salt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The salt's name, beside counts of sessions."""
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("sessions")).withColumn("salt", tx.salt_fingerprint("pepper"))


def telemetry_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last hours, by whether they say when they were."""
    own = telemetry(spark, sf_dir).where(analytics.in_window(F.col("ts"), NOW, HOURS))
    return own.agg(F.count("*").alias("events"), F.sum("tokens_saved").alias("tokens_saved"))


def permuted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the order of their price, unknown keys left out."""
    o = table(spark, sf_dir, "orders")
    order = o.select(F.col("o_orderkey").alias("index"), F.struct("o_totalprice", "o_orderkey").alias("position"))
    order = order.unionByName(order.select((-F.col("index") - 1).alias("index"), "position"))
    return jsonl.permuted(o.select(F.col("o_orderkey").alias("index"), "o_custkey"), order).select("index", "o_custkey", F.col("position.o_totalprice").alias("price"))


def normalized_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as questions; only every third row has a number of its own."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("q"), F.col("p_partkey").cast("string"))).alias("qid"), F.col("p_name").alias("question"))
    return retrieve.normalized_queries(rows)


def extract_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that an order's text names, found by whichever way fits."""
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.transform(F.array("s_name", F.concat("s_name", F.lit(" two"))), lambda x: x).alias("docs"))
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, extract.to_xml(F.col("docs"))).when(k == 1, extract.to_numbered(F.col("docs"))).otherwise(F.get("docs", F.lit(0)))
    found = d.select("s_suppkey", extract.auto(text).alias("x"))
    return found.select("s_suppkey", "x.mode", F.array_join("x.documents", "|").alias("documents"))


def ttl_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When users' entries went in January: no event for the time-to-live."""
    gone = cache.eviction_times(table(spark, sf_dir, "events"), "user_id", "ts", TTL, F.timestamp_seconds(F.lit(NOW)))
    return gone.select("user_id", *(F.unix_micros(c).alias(f"{c}_us") for c in ("last_access", "evicted_at")))


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions that an order of fewer suppliers than the one before starts anew."""
    turns = customer_contexts(spark, sf_dir).withColumn("n", F.size("docs"))
    made = multiturn.session_turns(turns, "customer", "turn", "n", "docs")
    return made.select("customer", "turn", "n_messages", "was_reset", *(F.array_join(F.transform(c, lambda d: d.cast("string")), ",").alias(c) for c in ("new_docs", "repeated_docs")))


def flattened_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as page trees: a node for each return flag, and below it one for each line."""
    lines = table(spark, sf_dir, "lineitem")
    leaf = F.struct(F.col("l_linenumber").alias("node_id"), F.col("l_linestatus").alias("title"), F.col("l_partkey").alias("text"))
    leaves = lines.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(leaf)).alias("nodes"))
    flags = F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("title"), "nodes")))
    trees = leaves.groupBy("l_orderkey").agg(F.to_json(F.struct(F.col("l_orderkey").alias("node_id"), flags.alias("nodes"))).alias("tree"))
    made = retrieve.flattened_tree(trees, "l_orderkey")
    return made.select("l_orderkey", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "place", "node_id", "title", "text")


QUERIES = [
    ttl_evictions, session_turns, flattened_tree,
    ttl_after_responses, ttl_expired, ttl_alive, ttl_defaults, run_stats, ttft_history, full_report, report_markdown, memory_search, memory_corpus, chunk_items,
    tree_fields_dropped, evidence_scores, normalized_titles, requests_removed, conversations_cleared, conversation_clear_counts, conversation_turns,
    answers_without_thinking, salt_fingerprint, telemetry_window, permuted_orders, normalized_queries, extract_auto,
]

_ENTRIES = """r AS (SELECT 'req-' || user_id AS request_id, ts, event_id, event_type = 'signup' AS wrote, event_type IN ('view', 'click') AND floor(value) > 0 AS was_read, (floor(value) + 1)::BIGINT AS n FROM events),
k AS (SELECT *, max(wrote::INT) OVER (PARTITION BY request_id ORDER BY ts, event_id) = 1 AS known FROM r),
entries AS (SELECT request_id, arg_max(n, (ts, event_id)) FILTER (wrote) AS tokens, max(ts) AS last_access, count(*) FILTER (NOT wrote) AS touches FROM k WHERE known AND (wrote OR was_read) GROUP BY 1)"""
_IDLE = f"{NOW} - epoch_us(last_access) / 1000000"
_REPORT = f"""WITH {_ENTRIES}, rows AS (SELECT 'types' AS section, to_json({{'event_type': event_type, 'events': count(*), 'tokens': floor(sum(value))::BIGINT}})::VARCHAR AS entry FROM events GROUP BY event_type
UNION ALL SELECT 'languages', to_json({{'chars': sum(n_chars)::BIGINT, 'documents': count(*), 'lang': lang}})::VARCHAR FROM documents GROUP BY lang
UNION ALL SELECT 'cache', to_json({{'entries': count(*), 'tokens': sum(tokens)::BIGINT}})::VARCHAR FROM entries), report AS (SELECT section, entry, row_number() OVER (PARTITION BY section ORDER BY entry) AS rank FROM rows)"""
# BM25 over benchmark items, asked with four messages of history; then first appearances as in multi-turn dedup
_TURNS = """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)')) AS term FROM benchmark),
dl AS (SELECT item_id, count(term) AS dl FROM w GROUP BY 1), n AS (SELECT (SELECT count(*) FROM benchmark) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM benchmark) AS avgdl),
tf AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT conv_id, turn, role, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) || chr(10), '') || text AS query FROM conversations),
a AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(query), '([\\p{L}\\p{N}_]+)')) AS term FROM q WHERE role = 'user'), c AS (SELECT conv_id, turn, term, count(*) AS qtf FROM a GROUP BY 1, 2, 3),
s AS (SELECT conv_id, turn, item_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM c JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (item_id), n GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 3),
f AS (SELECT *, turn = min(turn) OVER (PARTITION BY conv_id, item_id) AS is_new FROM r)
SELECT conv_id, turn, md5(string_agg(CASE WHEN is_new THEN '[Doc_' || item_id || ']: ' || text ELSE 'Please refer to [Doc_' || item_id || '] in the previous conversation.' END || chr(10) || chr(10), '' ORDER BY rank)) AS context_md5,
  count(*) AS num_retrieved, count(*) FILTER (is_new) AS num_novel, count(*) FILTER (NOT is_new) AS num_deduplicated FROM f JOIN benchmark USING (item_id) GROUP BY 1, 2"""
_BARE = "trim(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"

ORACLES = {
    "ttl_evictions": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events)
SELECT user_id, t AS last_access_us, t + {TTL}000000::BIGINT AS evicted_at_us FROM e WHERE t + {TTL}000000::BIGINT <= coalesce(following, {NOW}::BIGINT * 1000000) AND t + {TTL}000000::BIGINT <= {NOW}::BIGINT * 1000000""",
    "session_turns": f"""WITH {turns_sql()}, b AS (SELECT *, len(docs) AS n, coalesce(len(docs) < lag(len(docs)) OVER (PARTITION BY customer ORDER BY turn), false) AS was_reset FROM turns),
e AS (SELECT *, sum(was_reset::INT) OVER (PARTITION BY customer ORDER BY turn) AS epoch FROM b), x AS (SELECT customer, turn, epoch, unnest(docs) AS doc, generate_subscripts(docs, 1) AS pos FROM e),
s AS (SELECT *, turn = min(turn) OVER (PARTITION BY customer, epoch, doc) AS fresh FROM x)
SELECT customer, turn, n::BIGINT AS n_messages, was_reset, coalesce(string_agg(doc::VARCHAR, ',' ORDER BY pos) FILTER (fresh), '') AS new_docs,
  coalesce(string_agg(doc::VARCHAR, ',' ORDER BY pos) FILTER (NOT fresh), '') AS repeated_docs FROM e JOIN s USING (customer, turn) GROUP BY ALL""",
    "flattened_tree": """WITH l AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_linestatus, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS f,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_linestatus, l_partkey) - 1 AS k FROM lineitem),
n AS (SELECT l_orderkey, '0' AS path, -1 AS f, -1 AS k, l_orderkey::VARCHAR AS node_id, NULL AS title, NULL AS text FROM l GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, '0.' || f, f, -1, NULL, l_returnflag, NULL FROM l GROUP BY l_orderkey, f, l_returnflag
UNION ALL SELECT l_orderkey, '0.' || f || '.' || k, f, k, l_linenumber::VARCHAR, l_linestatus, l_partkey::VARCHAR FROM l)
SELECT l_orderkey, path, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, k) - 1 AS place, node_id, title, text FROM n""",
    "ttl_after_responses": f"WITH {_ENTRIES} SELECT request_id, tokens, epoch_us(last_access) AS last_access_us, touches FROM entries",
    "ttl_expired": f"WITH {_ENTRIES} SELECT request_id, tokens, round({_IDLE}, 3) AS idle_seconds FROM entries WHERE {_IDLE} >= {TTL}",
    "ttl_alive": f"WITH {_ENTRIES} SELECT count(*) AS entries, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM entries WHERE {_IDLE} < {TTL}",
    "ttl_defaults": "SELECT * FROM (VALUES ('anthropic', 'short', 300), ('anthropic', 'long', 3600), ('minimax', 'short', 300), ('openai', 'short', 3600), ('openai', 'long', 86400)) t(provider, kind, seconds)",
    "run_stats": """WITH e AS (SELECT event_type <> 'error' AS ok, (props->>'$.k')::BIGINT AS k, event_id % 8 AS d FROM events)
SELECT count(*) AS total_requests, count(*) FILTER (ok) AS successful_requests, count(*) FILTER (NOT ok) AS failed_requests, sum(k) FILTER (ok)::BIGINT AS total_output_tokens,
  round(avg(k) FILTER (ok), 6) AS average_output_length, round(sum(k) FILTER (ok) / sum(d) FILTER (ok), 6) AS decode_throughput, round(avg(k / 64) FILTER (ok), 6) AS average_ttft FROM e""",
    "ttft_history": """WITH e AS (SELECT user_id, (props->>'$.k')::DOUBLE AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, count(*) AS count, round(avg(ms), 6) AS mean_all, round(avg(ms) FILTER (back <= 10), 6) AS mean_last, max(ms) FILTER (back = 1) AS latest FROM e GROUP BY user_id""",
    "full_report": f"{_REPORT} SELECT * FROM report",
    "report_markdown": f"{_REPORT} SELECT section, '## ' || section || chr(10) || chr(10) || string_agg('- `' || entry || '`', chr(10) ORDER BY rank) || chr(10) AS text FROM report GROUP BY section",
    "memory_search": """WITH q AS (SELECT vec_id, embedding, label, CASE WHEN vec_id % 200 = 0 THEN vec_id % 2 END AS agent FROM embeddings WHERE vec_id % 100 = 0),
m AS (SELECT q.vec_id AS query_id, v.vec_id AS memory_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings v ON v.label = q.label AND (q.agent IS NULL OR v.vec_id % 2 = q.agent))
SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM m WHERE score >= 0.1 QUALIFY rank <= 10""",
    "memory_corpus": """WITH f AS (SELECT l_partkey AS doc, min((l_orderkey, pos)) AS first FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) - 1 AS pos FROM lineitem GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT doc, row_number() OVER (ORDER BY first) - 1 AS k FROM f) SELECT k::VARCHAR AS doc_id, p_name AS text FROM n JOIN part ON p_partkey = doc""",
    "chunk_items": """WITH f AS (SELECT l_suppkey AS doc_name, l_partkey % 50 AS node_id, min(l_orderkey) AS item_id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l_suppkey AS doc_name, l_partkey % 50 AS node_id, item_id, count(*) AS n FROM lineitem LEFT JOIN f ON f.doc_name = l_suppkey AND f.node_id = l_partkey % 50 GROUP BY 1, 2, 3""",
    "tree_fields_dropped": """SELECT doc_id, '{"node_id":' || doc_id || ',"nodes":[{"title":"' || lang || '"},{"title":"' || source || '"}]}' AS tree FROM documents""",
    "evidence_scores": """WITH s AS (SELECT n_name, lower(c_mktsegment) AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
h AS (SELECT n_name, count(*) AS n, count(*) FILTER (seg IN ('building', 'machinery', 'household', 'toys')) AS hits FROM s GROUP BY 1)
SELECT n_name, CASE WHEN hits = n AND hits = 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS em, round(CASE WHEN hits = 0 THEN 0 ELSE 2.0 * hits / (n + 4) END, 6)::DOUBLE AS f1, round(hits / n, 6) AS prec, round(hits / 4, 6) AS recall FROM h""",
    "normalized_titles": f"SELECT p_partkey, lower(p_name) AS title, {_BARE.format('p_name')} || '|the ' || {_BARE.format('p_brand')} AS evidence FROM part",
    "requests_removed": f"WITH {turns_sql()} SELECT ctx_id AS request_id, parent AS parent_id FROM turns JOIN orders ON o_orderkey = ctx_id WHERE o_orderpriority <> '1-URGENT'",
    "conversations_cleared": f"WITH {turns_sql()}, n AS (SELECT customer, max(turn) AS n FROM turns GROUP BY 1) SELECT ctx_id AS request_id, parent AS parent_id FROM turns JOIN n USING (customer) WHERE n < 4 OR turn > 4",
    "conversation_clear_counts": f"WITH {turns_sql()} SELECT ctx_id AS request_id, 4 AS removed FROM turns WHERE turn = 4 UNION ALL SELECT -ctx_id, 0 FROM turns WHERE turn = 4",
    "conversation_turns": _TURNS,
    "answers_without_thinking": "SELECT conv_id, turn, md5(regexp_replace(text, '^\\s+', '')) AS a_md5, role || ' <think>x</think>' AS b FROM conversations",
    "salt_fingerprint": "SELECT count(DISTINCT user_id) AS sessions, substr(sha256('fingerprint:pepper'), 1, 12) AS salt FROM events",
    "telemetry_window": f"SELECT count(*) AS events, sum((props->>'$.k')::BIGINT)::BIGINT AS tokens_saved FROM events WHERE event_id % 11 <> 0 AND floor(epoch_us(ts) / 1000000) >= {NOW} - {HOURS} * 3600",
    "permuted_orders": "SELECT o_orderkey AS index, o_custkey, o_totalprice AS price FROM orders",
    "normalized_queries": """WITH k AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS k FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 3 <> 0))
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'q' || p_partkey ELSE k::VARCHAR END AS qid, part.p_name AS text FROM part LEFT JOIN k ON k.p_name = part.p_name""",
    "extract_auto": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'xml' WHEN 1 THEN 'numbered' END AS mode, CASE WHEN s_suppkey % 3 < 2 THEN s_name || '|' || s_name || ' two' END AS documents FROM supplier""",
}
