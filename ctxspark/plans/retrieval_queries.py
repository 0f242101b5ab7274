"""Queries of retrieval, prompts, metrics, extraction and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import cache, cells, evalqa, extract, postings, prompts, retrieve
from ..operators import contexts as cx
from ..operators.shared import Scratch
from .tables import ctx_sql, customer_contexts, order_contexts, table, turns_sql


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return retrieve.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index of blocks, built in two steps, searched by block maxima."""
    docs = table(spark, sf_dir, "documents")
    index = postings.PostingsIndex(spark, Scratch(spark, "index").path())
    for part in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0 OR doc_id IS NULL")):
        index.add(part)
    return index.search(table(spark, sf_dir, "benchmark"), 20)[0]


def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    v = table(spark, sf_dir, "embeddings")
    return retrieve.vector_topk(v, v.where("vec_id % 100 = 0"), 10)


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index of cells: the nearest ones first, then all that their bounds leave open."""
    v = table(spark, sf_dir, "embeddings")
    index = cells.VectorIndex(spark, Scratch(spark, "vectors").path()).build(v)
    return index.search(v.where("vec_id % 100 = 0"), 10)[0]


def retrieval_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reuse of suppliers over each customer's orders."""
    e = cx.exploded(customer_contexts(spark, sf_dir), "customer").withColumnRenamed("doc", "doc_id")
    return retrieve.overlap_ratio(e, "customer")


def topk_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three parts of every order."""
    return order_contexts(spark, sf_dir).select("ctx_id", tx.joined(F.slice("docs", 1, 3)).alias("docs"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 words every 80 words of all documents."""
    return retrieve.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 100, 20).select("doc_id", "start", F.md5("text").alias("text_md5"))


def combine_by_qid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to documents by id; fields of the right side win, misses go."""
    left = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.struct("quality", "toxic")).alias("x"))
    return left.join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "x.quality", "x.toxic", "lang", "source")


def combine_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def prompt_docs_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sections of all orders; parts of the smallest sizes are missing in the corpus."""
    corpus = table(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("doc"), F.col("p_name").alias("text"))
    return prompts.docs_section(order_contexts(spark, sf_dir), corpus)


def system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System prompts of all orders: sorted parts, ranked as ordered."""
    c = order_contexts(spark, sf_dir)
    return c.select("ctx_id", F.md5(prompts.system_prompt(F.array_sort("docs"), F.col("docs"))).alias("prompt_md5"), prompts.importance_ranking(F.array_sort("docs"), F.col("docs")).alias("ranking"))


def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the documents of an order."""
    c = order_contexts(spark, sf_dir, "l_suppkey")
    corpus = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.col("s_name").alias("text"))
    both = prompts.docs_section(c, corpus).join(c, "ctx_id")
    return both.select("ctx_id", F.md5(prompts.rag_prompt(F.col("docs_section"), F.concat(F.lit("What is order "), "ctx_id", F.lit("?")), F.col("docs"))).alias("prompt_md5"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item texts as gold answers; predictions are their first words with noise."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("text").alias("gold"), F.when(F.col("item_id") % 7 == 0, "Yes").when(F.col("item_id") % 5 == 0, F.concat(F.lit("The "), F.upper("text"), F.lit("!"))).otherwise(F.concat(F.lit("an "), F.substring("text", 1, 60))).alias("prediction"))


def qa_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer metrics of every item."""
    s = _answers(spark, sf_dir).select("item_id", evalqa.answer_scores(F.col("prediction"), F.col("gold")).alias("s"))
    return s.select("item_id", "s.em", F.round("s.f1", 6).alias("f1"), F.round("s.prec", 6).alias("prec"), F.round("s.recall", 6).alias("recall"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("customer").orderBy("turn")
    return customer_contexts(spark, sf_dir).withColumn("gold", F.lag("docs").over(own)).where("gold IS NOT NULL")


def sp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supporting-fact metrics: an order's suppliers as prediction of the order's before."""
    s = _neighbours(spark, sf_dir).select("ctx_id", evalqa.set_scores(F.col("docs"), F.col("gold")).alias("s"))
    return s.select("ctx_id", "s.em", F.round("s.f1", 6).alias("f1"), F.round("s.prec", 6).alias("prec"), F.round("s.recall", 6).alias("recall"))


def joint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint means of suppliers and of suppliers modulo 10."""
    tens = lambda c: F.transform(c, lambda d: d % 10)
    s = _neighbours(spark, sf_dir).select(evalqa.joint_scores(evalqa.set_scores(F.col("docs"), F.col("gold")), evalqa.set_scores(tens("docs"), tens("gold"))).alias("s"))
    return evalqa.means(s, "s")


def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names as gold answers, their customers' segments as aliases."""
    golds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("answer_id"), F.array("n_name").alias("golds"))
    aliases = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("answer_id"), F.col("c_mktsegment").alias("alias"))
    return evalqa.with_aliases(golds, aliases).select("answer_id", F.array_join("golds", "|").alias("golds"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines marked up in each of the ways."""
    d = table(spark, sf_dir, "documents")
    ls = F.filter(F.split("text", "\n"), lambda x: tx.stripped(x) != "")
    return d.select("doc_id", ls.alias("ls"))


def extract_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as XML and read back; every third without a wrapper."""
    m = _marked(spark, sf_dir)
    bare = F.array_join(F.transform("ls", lambda d: F.concat(F.lit('<doc id="1">'), d, F.lit("</doc>"))), " ")
    text = F.when(F.col("doc_id") % 3 == 0, bare).otherwise(F.concat(F.lit("Read this. "), extract.to_xml(F.col("ls"))))
    return m.select("doc_id", extract.xml(text).alias("docs")).select("doc_id", F.size("docs").cast("long").alias("n"), F.md5(F.array_join("docs", "|")).alias("docs_md5"))


def extract_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written with numbers and read back."""
    m = _marked(spark, sf_dir).select("doc_id", extract.numbered(extract.to_numbered(F.col("ls"))).alias("docs"))
    return m.select("doc_id", F.size("docs").cast("long").alias("n"), F.md5(F.array_join("docs", "|")).alias("docs_md5"))


def extract_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written with separators and read back."""
    m = _marked(spark, sf_dir)
    text = F.when(F.col("doc_id") % 2 == 0, extract.to_separated(F.col("ls"))).otherwise(extract.to_separated(F.col("ls"), "==="))
    return m.select("doc_id", extract.separated(text).alias("docs")).select("doc_id", F.size("docs").cast("long").alias("n"), F.md5(F.array_join("docs", "|")).alias("docs_md5"))


def extract_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written under headers and read back."""
    m = _marked(spark, sf_dir)
    text = F.concat(F.lit("intro\n"), extract.to_markdown(F.transform("ls", lambda d, k: F.concat(F.lit("## Part "), k.cast("string"), F.lit("\n"), d))))
    return m.select("doc_id", extract.markdown(text).alias("docs")).select("doc_id", F.size("docs").cast("long").alias("n"))


def extract_json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON search results."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    row = lambda x: F.concat(F.lit('{"url": "'), F.when(x["l_linenumber"] % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("u"), x["l_partkey"].cast("string"))), F.lit('", "path": "p'), x["l_suppkey"].cast("string"), F.lit('"}'))
    text = F.concat(F.lit('{"results": ['), F.array_join(F.transform("x", row), ", "), F.lit("]}"))
    found = items.select("l_orderkey", extract.json_results(text).alias("r"))
    return found.select("l_orderkey", F.size("r").cast("long").alias("n"), F.array_join(F.transform("r", lambda r: r["id"]), ",").alias("ids"))


def normalize_request_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request ids of all events in their engines' spellings."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit("cmpl-req-"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("chatcmpl-req-"), k.cast("string"), F.lit("-0-"), F.lower(F.hex(k)))).when(k % 4 == 2, F.concat(F.lit("batch-x"), k.cast("string"))).otherwise(F.concat(F.lit("HEALTH_CHECK_"), k.cast("string")))
    return e.select("event_id", tx.normalize_request_id(raw).alias("request_id"), tx.is_tracked(tx.normalize_request_id(raw)).alias("tracked"))


def cache_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters out of usage records made of events."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    openai = F.concat(F.lit('{"prompt_tokens": '), F.floor("value").cast("string"), F.lit(', "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": '), k, F.lit("}}"))
    other = F.concat(F.lit('{"cache_creation_input_tokens": '), k, F.lit(', "cache_read_input_tokens": 3, "input_tokens": '), F.floor("value").cast("string"), F.lit("}"))
    both = e.select("event_id", cache.usage_metrics(openai, "openai").alias("o"), cache.usage_metrics(other, "anthropic").alias("a"))
    return both.select("event_id", *(F.col(f"{s}.{m}").alias(f"{n}_{m}") for s, n in (("o", "openai"), ("a", "anthropic")) for m in ("cache_creation_tokens", "cache_read_tokens", "input_tokens", "output_tokens")))


def cache_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that get a cache mark as tool results of their source."""
    return cache.breakpoints(table(spark, sf_dir, "documents"), "source", "doc_id", "text").select("doc_id", "cached")


def ttl_cache_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits of every user at one hour to live."""
    return cache.ttl_simulation(table(spark, sf_dir, "events"), "user_id", "ts", 3600, "event_id").drop("last_access")


def ttl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users alive at the end of the events."""
    state = cache.ttl_simulation(table(spark, sf_dir, "events"), "user_id", "ts", 3600, "event_id")
    return cache.ttl_stats(state, F.lit("2024-01-30 00:00:00").cast("timestamp"), 86400)


def slot_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as slots, purchases as emptied ones."""
    e = table(spark, sf_dir, "events").withColumn("n_past", F.when(F.col("event_type") == "purchase", 0).otherwise(F.floor("value").cast("long")))
    return cache.slot_evictions(e, "user_id", "event_id", "n_past").select("user_id", "event_id")


def fully_evicted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose suppliers are all of the first regions' nations."""
    owners = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("block"))
    return cache.fully_evicted(owners, table(spark, sf_dir, "supplier").where("s_nationkey < 15").select(F.col("s_suppkey").alias("block")))


def doc_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-line previews, texts without reasoning, and salted names of all documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.doc_preview(F.col("text")).alias("preview"), tx.salted_hash(F.col("text"), "s").alias("name"), F.md5(tx.without_thinking(F.concat(F.lit("<think>a\nb</think> "), "text"))).alias("told_md5"))


QUERIES = [
    bm25_topk, bm25_index_topk, vector_topk_l2, vector_index_topk, retrieval_overlap_ratio, topk_truncate, chunk_documents, combine_by_qid, combine_misses, prompt_docs_section, system_prompt, rag_prompt, qa_f1, sp_metrics, joint_metrics, alias_expansion,
    extract_xml, extract_numbered, extract_separator, extract_markdown, extract_json_results, normalize_request_id, cache_metrics, cache_breakpoints, ttl_cache_sim, ttl_stats, slot_evictions, fully_evicted_requests, doc_previews,
]


def _lit(text: str) -> str:
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in text.replace("'", "''").split("\n")) + ")"


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NORM = r'''trim(regexp_replace(regexp_replace(translate(lower({0}), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))'''
_LINES = f"list_filter(string_split(text, chr(10)), lambda x: {_STRIP.format('x')} <> '')"
_SHOWN = f"list_transform({_LINES}, lambda x: {_STRIP.format('x')})"
_TWO = f"WITH {turns_sql()}, two AS (SELECT ctx_id, docs AS p, lag(docs) OVER (PARTITION BY customer ORDER BY turn) AS g FROM turns)"


def _sets(p: str, g: str) -> str:
    tp = f"len(list_intersect({p}, {g}))"
    return f"{tp} AS tp, len(list_distinct({p})) AS np, len(list_distinct({g})) AS ng"


_F1 = "CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0 END"
ORACLES = {
    "bm25_topk": f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT item_id AS query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 20""",
    "vector_topk_l2": """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, rank, distance FROM r WHERE rank <= 10""",
    "retrieval_overlap_ratio": f"WITH {turns_sql()} SELECT customer, count(*) AS n_retrieved, count(DISTINCT doc) AS n_unique, round(1 - count(DISTINCT doc) / count(*), 6) AS reuse_ratio FROM turns JOIN places USING (ctx_id) GROUP BY 1",
    "topk_truncate": f"WITH {ctx_sql()} SELECT ctx_id, array_to_string(docs[1:3], ',') AS docs FROM ctx",
    "chunk_documents": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, start, md5(array_to_string(w[start + 1 : start + 100], ' ')) AS text_md5 FROM s""",
    "combine_by_qid": "WITH l AS (SELECT doc_id, max((quality, toxic)) AS x FROM labels GROUP BY 1) SELECT doc_id, x[1] AS quality, x[2] AS toxic, lang, source FROM l JOIN documents USING (doc_id)",
    "combine_misses": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "prompt_docs_section": f"WITH {ctx_sql()} SELECT ctx_id, coalesce(string_agg('[Doc_' || doc || '] ' || p_name, chr(10) || chr(10) ORDER BY pos) FILTER (p_name IS NOT NULL), '') AS docs_section, count(*) FILTER (p_name IS NULL) AS n_missing FROM places LEFT JOIN (SELECT * FROM part WHERE p_size > 2) ON p_partkey = doc GROUP BY 1",
    "system_prompt": f"""WITH {ctx_sql()}, r AS (SELECT ctx_id, docs, list_sort(docs) AS s FROM ctx), k AS (SELECT ctx_id, s, array_to_string(list_transform(docs, lambda d: list_position(s, d)), ' > ') AS ranking FROM r)
SELECT ctx_id, md5({_lit(prompts.SYSTEM_HEAD)} || array_to_string(list_transform(s, lambda d, i: '[' || i || '] ' || d), chr(10)) || {_lit(prompts.SYSTEM_RANKING)} || ranking || {_lit(prompts.SYSTEM_END)}) AS prompt_md5, ranking FROM k""",
    "rag_prompt": f"""WITH {ctx_sql('l_suppkey')} SELECT ctx_id, md5({_lit(prompts.RAG_HEAD)} || string_agg('[Doc_' || doc || '] ' || s_name, chr(10) || chr(10) ORDER BY pos) || {_lit(prompts.RAG_QUESTION)} || 'What is order ' || ctx_id || '?' || {_lit(prompts.RAG_RANKING)} || string_agg('[Doc_' || doc || ']', ' > ' ORDER BY pos) || {_lit(prompts.RAG_RANKING_END)}) AS prompt_md5 FROM places JOIN supplier ON s_suppkey = doc GROUP BY ctx_id""",
    "qa_f1": f"""WITH a AS (SELECT item_id, text AS gold, CASE WHEN item_id % 7 = 0 THEN 'Yes' WHEN item_id % 5 = 0 THEN 'The ' || upper(text) || '!' ELSE 'an ' || substr(text, 1, 60) END AS prediction FROM benchmark),
n AS (SELECT item_id, {_NORM.format('prediction')} AS p, {_NORM.format('gold')} AS g FROM a),
t AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS pt, list_filter(string_split(g, ' '), lambda x: x <> '') AS gt FROM n),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda w: least(len(list_filter(pt, lambda x: x = w)), len(list_filter(gt, lambda x: x = w))))), 0)::DOUBLE AS same FROM t),
z AS (SELECT *, ((p IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer')) AND p <> g) OR same = 0 AS none FROM c)
SELECT item_id, (p = g)::INT::DOUBLE AS em, CASE WHEN none THEN 0 ELSE round(2 * (same / len(pt)) * (same / len(gt)) / (same / len(pt) + same / len(gt)), 6) END AS f1, CASE WHEN none THEN 0 ELSE round(same / len(pt), 6) END AS prec, CASE WHEN none THEN 0 ELSE round(same / len(gt), 6) END AS recall FROM z""",
    "sp_metrics": f"{_TWO}, s AS (SELECT ctx_id, {_sets('p', 'g')} FROM two WHERE g IS NOT NULL), r AS (SELECT ctx_id, (tp = np AND tp = ng)::INT::DOUBLE AS em, tp / np AS prec, tp / ng AS recall FROM s) SELECT ctx_id, em, round({_F1}, 6) AS f1, round(prec, 6) AS prec, round(recall, 6) AS recall FROM r",
    "joint_metrics": f"""{_TWO}, m AS (SELECT p, g, list_transform(p, lambda d: d % 10) AS p2, list_transform(g, lambda d: d % 10) AS g2 FROM two WHERE g IS NOT NULL),
s AS (SELECT len(list_intersect(p, g)) AS tp, len(list_distinct(p)) AS np, len(list_distinct(g)) AS ng, len(list_intersect(p2, g2)) AS tp2, len(list_distinct(p2)) AS np2, len(list_distinct(g2)) AS ng2 FROM m),
r AS (SELECT (tp = np AND tp = ng)::INT * (tp2 = np2 AND tp2 = ng2)::INT AS em, tp / np * (tp2 / np2) AS prec, tp / ng * (tp2 / ng2) AS recall FROM s)
SELECT round(avg(em) * 100, 2) AS em, round(avg({_F1}) * 100, 2) AS f1, round(avg(prec) * 100, 2) AS prec, round(avg(recall) * 100, 2) AS recall FROM r""",
    "alias_expansion": "WITH a AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS a FROM customer GROUP BY 1) SELECT n_nationkey AS answer_id, array_to_string(list_concat([n_name], list_filter(coalesce(a, []), lambda x: x <> n_name)), '|') AS golds FROM nation LEFT JOIN a ON k = n_nationkey",
    "extract_xml": f"WITH l AS (SELECT doc_id, {_SHOWN} AS s FROM documents), r AS (SELECT doc_id, CASE WHEN len(s) >= 1 AND (doc_id % 3 <> 0 OR len(s) >= 2) THEN s END AS d FROM l) SELECT doc_id, len(d)::BIGINT AS n, md5(array_to_string(d, '|')) AS docs_md5 FROM r",
    "extract_numbered": f"WITH l AS (SELECT doc_id, {_SHOWN} AS s FROM documents), r AS (SELECT doc_id, CASE WHEN len(s) >= 2 THEN s END AS d FROM l) SELECT doc_id, len(d)::BIGINT AS n, md5(array_to_string(d, '|')) AS docs_md5 FROM r",
    "extract_separator": f"WITH l AS (SELECT doc_id, {_SHOWN} AS s FROM documents), r AS (SELECT doc_id, CASE WHEN len(s) >= 3 THEN s END AS d FROM l) SELECT doc_id, len(d)::BIGINT AS n, md5(array_to_string(d, '|')) AS docs_md5 FROM r",
    "extract_markdown": f"WITH l AS (SELECT doc_id, len({_SHOWN}) AS n FROM documents) SELECT doc_id, CASE WHEN n >= 2 THEN n END AS n FROM l",
    "extract_json_results": "SELECT l_orderkey, CASE WHEN count(*) >= 2 THEN count(*) END AS n, CASE WHEN count(*) >= 2 THEN string_agg(CASE WHEN l_linenumber % 2 = 0 THEN 'p' || l_suppkey ELSE 'u' || l_partkey END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) END AS ids FROM lineitem GROUP BY 1",
    "normalize_request_id": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'req-' || event_id WHEN 1 THEN 'req-' || event_id WHEN 2 THEN 'x' || event_id ELSE 'HEALTH_CHECK_' || event_id END AS request_id, event_id % 4 < 2 AS tracked FROM events""",
    "cache_metrics": """WITH e AS (SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k, floor(value)::BIGINT AS v FROM events)
SELECT event_id, CASE WHEN k > 0 THEN greatest(0, v - k) ELSE 0 END AS openai_cache_creation_tokens, coalesce(k, 0) AS openai_cache_read_tokens, CASE WHEN k IS NULL THEN 0 ELSE v END AS openai_input_tokens, CASE WHEN k IS NULL THEN 0 ELSE 5 END AS openai_output_tokens,
coalesce(k, 0) AS anthropic_cache_creation_tokens, CASE WHEN k IS NULL THEN 0 ELSE 3 END AS anthropic_cache_read_tokens, CASE WHEN k IS NULL THEN 0 ELSE v END AS anthropic_input_tokens, 0 AS anthropic_output_tokens FROM e""",
    "cache_breakpoints": "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3 AND length(text) >= 1024 AS cached FROM documents",
    "ttl_cache_sim": "WITH l AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS idle FROM events) SELECT user_id, count(*) FILTER (idle < 3600000000) AS hits, count(*) FILTER (idle IS NULL OR idle >= 3600000000) AS misses, count(*) FILTER (idle >= 3600000000) AS evictions FROM l GROUP BY 1",
    "ttl_stats": """WITH l AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS idle FROM events),
s AS (SELECT user_id, count(*) FILTER (idle < 3600000000) AS hits, count(*) AS n, max(ts) AS last FROM l GROUP BY 1)
SELECT count(*) FILTER (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last) < 86400000000) AS active, count(*) FILTER (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last) >= 86400000000) AS expired, round(sum(hits) / sum(n) * 100, 2) AS hit_rate_pct FROM s""",
    "slot_evictions": "WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE floor(value)::BIGINT END AS p FROM events) SELECT user_id, event_id FROM e QUALIFY p = 0 AND lag(p) OVER (PARTITION BY user_id ORDER BY event_id) > 0",
    "fully_evicted_requests": "WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT l_orderkey AS request_id, count(*) AS n_blocks FROM o LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 15) ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(*) = count(s_suppkey)",
    "doc_previews": f"WITH l AS (SELECT doc_id, text, {_STRIP.format('replace(text, chr(10), chr(32))')} AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 60 THEN substr(x, 1, 60) || '...' ELSE x END AS preview, substr(sha256('s:' || text), 1, 16) AS name, md5(text) AS told_md5 FROM l",
}
ORACLES["bm25_index_topk"] = ORACLES["bm25_topk"]
ORACLES["vector_index_topk"] = ORACLES["vector_topk_l2"]
