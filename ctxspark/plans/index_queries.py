"""Queries of distances, clustering, ordering and scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import joined, sha_hex
from ..operators import analytics, cluster, distance, schedule
from ..operators import contexts as cx
from ..operators import index as ix
from ..operators.shared import Scratch
from .tables import ctx_sql, customer_contexts, order_contexts, table, turns_sql


def context_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all orders that share a part."""
    return distance.pairs(order_contexts(spark, sf_dir))


def context_distance_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of orders and brands: a brand's parts are its documents."""
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ctx_id")).agg(F.sort_array(F.collect_list("p_partkey")).alias("docs"))
    return distance.cross(order_contexts(spark, sf_dir), brands)


def context_distance_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each order to the customer's order before it."""
    own = Window.partitionBy("customer").orderBy("turn")
    turns = customer_contexts(spark, sf_dir).withColumn("before", F.lag("docs").over(own)).where(F.col("before").isNotNull())
    return turns.select("ctx_id", F.round(distance.between(F.col("before"), F.col("docs")), 6).alias("distance"))


def intern_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense document numbers by first appearance."""
    return cx.interned(order_contexts(spark, sf_dir))


def leaf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one set of suppliers."""
    return cx.leaves(order_contexts(spark, sf_dir, "l_suppkey")).select(joined(F.col("content")).alias("content"), "frequency", "first_ctx")


def schedule_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders clustered, reordered and scheduled."""
    made = schedule.scheduled(cluster.arranged(customer_contexts(spark, sf_dir).withColumnRenamed("customer", "batch"), "batch"), "batch")
    return made.select("batch", "exec_pos", "ctx_id", "group_id", "group_size", joined(F.col("reordered")).alias("docs"), joined(F.col("docs")).alias("original_docs"), joined(F.col("path"), ".").alias("path"))


def context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trees of all customers' orders."""
    nodes = cluster.tree_nodes(customer_contexts(spark, sf_dir).withColumnRenamed("customer", "batch"), "batch")
    return nodes.select("batch", "node_id", "parent_id", "child_no", joined(F.col("path"), ".").alias("path"), joined(F.col("docs")).alias("docs"), joined(F.col("content")).alias("content"), "frequency", F.round("merge_distance", 6).alias("merge_distance"), "is_leaf")


def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node counts of each tree."""
    return ix.node_stats(cluster.tree_nodes(customer_contexts(spark, sf_dir).withColumnRenamed("customer", "batch"), "batch"), "batch")


def _written_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' orders, made once for those that are indexed and those that are asked for."""
    return Scratch(spark, "turns").written(customer_contexts(spark, sf_dir).withColumnRenamed("customer", "batch"))


def live_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders from the sixth turn on, searched in the tree of the first five."""
    turns = _written_turns(spark, sf_dir)
    found = ix.searched(turns.where("turn <= 5"), turns.where("turn > 5"), "batch")
    return found.select("batch", "ctx_id", joined(F.col("search_path"), ".").alias("search_path"), "node_id", "overlap", "has_prefix")


def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, built in: matched orders follow their node's documents, the others get a tree of their own."""
    turns = _written_turns(spark, sf_dir)
    made = ix.built_incrementally(turns.where("turn <= 5"), turns.where("turn > 5"), "batch")
    return made.select("batch", "ctx_id", "exec_pos", "group_id", joined(F.col("reordered")).alias("docs"), joined(F.col("path"), ".").alias("path"), "matched")


def _synthetic_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = customer_contexts(spark, sf_dir)
    return turns.select(F.col("customer").alias("batch"), "ctx_id", "turn", F.transform(F.filter("docs", lambda d: d % 7 != 0), lambda d: (d % 3).cast("int")).alias("path"))


def schedule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduling of given paths: each order's suppliers modulo 3."""
    return schedule.scheduled(_synthetic_paths(spark, sf_dir), "batch").select("batch", "ctx_id", "group_id", "group_size", "exec_pos")


def schedule_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warm order of the same paths."""
    paths = _synthetic_paths(spark, sf_dir).withColumn("matched", F.col("turn") % 2)
    return schedule.scheduled_incremental(paths, "batch", matched="matched").select("batch", "ctx_id", "group_id", "exec_pos")


def group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the groups of those paths."""
    return schedule.group_scores(_synthetic_paths(spark, sf_dir), "batch")


def reorder_with_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders reordered so that they begin as the customer's order before."""
    own = Window.partitionBy("customer").orderBy("turn")
    turns = customer_contexts(spark, sf_dir).withColumn("before", F.lag("docs").over(own))
    docs = F.when(F.col("before").isNull(), F.col("docs")).otherwise(cx.reordered_with_prefix(F.col("docs"), F.col("before")))
    return turns.select("ctx_id", joined(docs).alias("docs"))


def adjacent_prefix_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that each order shares with the customer's order before, from the first on."""
    own = Window.partitionBy("customer").orderBy("turn")
    turns = customer_contexts(spark, sf_dir).withColumn("before", F.lag("docs").over(own))
    return turns.select("ctx_id", F.when(F.col("before").isNull(), 0).otherwise(cx.common_prefix_length(F.col("before"), F.col("docs"))).cast("long").alias("prefix_len"))


def prefix_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shared prefix of neighbours before and after scheduling: what clustering gains."""
    made = schedule.scheduled(cluster.arranged(customer_contexts(spark, sf_dir).withColumnRenamed("customer", "batch"), "batch"), "batch")

    def mean(docs: str, order: str):
        before = F.lag(docs).over(Window.partitionBy("batch").orderBy(order))
        return F.when(before.isNull(), 0).otherwise(cx.common_prefix_length(before, F.col(docs)))

    both = made.select(mean("docs", "ctx_id").alias("a"), mean("reordered", "exec_pos").alias("b"))
    return both.agg(F.count("*").alias("n_contexts"), F.round(F.avg("a"), 6).alias("mean_prefix_before"), F.round(F.avg("b"), 6).alias("mean_prefix_after"))


def group_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix that all orders of one first supplier and one order priority share."""
    first = order_contexts(spark, sf_dir, "l_suppkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ctx_id"), "o_orderpriority"), "ctx_id")
    own = first.withColumn("grp", F.concat_ws("/", F.get("docs", F.lit(0)), F.col("o_orderpriority"))).select("ctx_id", "docs", "grp")
    return cx.group_prefix(own, "grp").select("grp", "n_contexts", joined(F.col("prefix")).alias("prefix"))


def hash_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless order of an order's suppliers by the hash of their names."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), sha_hex(F.trim("s_name"), 16).alias("h"))
    e = cx.exploded(order_contexts(spark, sf_dir, "l_suppkey")).join(names, "doc")
    return e.groupBy("ctx_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("h", "pos", "doc"))), lambda x: x["doc"])).alias("docs"))


def lru_tokens_to_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users evicted, least recently seen first, until a quarter of all tokens is free."""
    events = analytics.added_in_order(table(spark, sf_dir, "events"), "user_id", "value", "event_id")
    use = events.groupBy(F.col("user_id").alias("node_id")).agg(F.max(F.struct("ts", "event_id")).alias("last"), F.floor(F.max_by("so_far", "place")).cast("long").alias("tokens"))
    return ix.lru_evictions(use.select("node_id", F.col("last.ts").alias("last_access"), F.col("last.event_id").alias("tie"), "tokens"), share=0.25)


def evict_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees after short contexts are evicted: leaves of at most three documents go, and parents left without children."""
    nodes = cluster.tree_nodes(customer_contexts(spark, sf_dir).withColumnRenamed("customer", "batch"), "batch")
    short = F.col("is_leaf") & (F.size("docs") <= 3)
    nodes = Scratch(spark, "nodes").written(nodes.select("batch", "node_id", "path", "is_leaf", short.alias("short")))  # trees are built once
    gone = nodes.where("short").select("batch", "node_id")
    return ix.pruned(nodes, gone, "batch").select("batch", "node_id", "removed")


def update_node_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arithmetic: an order's lines add tokens, returned lines take from the extra ones first."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node_id")).agg(
        F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(0)).cast("long").alias("extra"),
        F.sum("l_quantity").cast("long").alias("total"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("long").alias("removed"),
    )
    return ix.tokens_after_removal(items)


def update_node_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines that add or, if returned, remove: one delta an order."""
    sign = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node_id")).agg(
        F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(0)).cast("long").alias("extra"),
        F.sum("l_quantity").cast("long").alias("total"),
        F.sum(F.when(F.col("l_linenumber") > 1, sign).otherwise(0)).cast("long").alias("delta"),
    )
    return ix.tokens_updated(items)


QUERIES = [update_node_deltas, context_distance_pairs, context_distance_cross, context_distance_turns, intern_documents, leaf_dedup, schedule_contexts, context_tree, tree_stats, live_search, incremental_build, schedule_groups, schedule_incremental, group_scores, reorder_with_prefix, adjacent_prefix_len, prefix_sharing, group_prefix, hash_reorder, lru_tokens_to_evict, evict_requests, update_node_tokens]

_PREFIX_LEN = "(SELECT coalesce(min(k) - 1, least(len(a), len(b))) FROM (SELECT unnest(range(1, least(len(a), len(b)) + 1)) AS k) WHERE a[k] <> b[k])"
_PATHS = f"""WITH {turns_sql()},
paths AS (SELECT customer AS batch, ctx_id, turn, list_transform(list_filter(docs, lambda d: d % 7 <> 0), lambda d: d % 3) AS path FROM turns),
grouped AS (SELECT *, CASE WHEN len(path) > 0 THEN path[1] ELSE -1 END AS group_id FROM paths)"""

ORACLES = {
    "context_distance_pairs": f"""WITH {ctx_sql()}, e AS (SELECT p.*, c.n FROM places p JOIN ctx c USING (ctx_id))
SELECT a.ctx_id AS ctx_i, b.ctx_id AS ctx_j, count(*) AS n_common, round(1 - count(*) / greatest(any_value(a.n), any_value(b.n))::DOUBLE + 0.001 * sum(abs(a.pos - b.pos)) / count(*), 6) AS distance
FROM e a JOIN e b ON a.doc = b.doc AND a.ctx_id < b.ctx_id GROUP BY 1, 2""",
    "context_distance_cross": f"""WITH {ctx_sql()}, e AS (SELECT p.*, c.n FROM places p JOIN ctx c USING (ctx_id)),
t AS (SELECT p_brand AS target_id, p_partkey AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS m FROM part)
SELECT ctx_id, target_id, count(*) AS n_common, round(1 - count(*) / greatest(any_value(n), any_value(m))::DOUBLE + 0.001 * sum(abs(e.pos - t.pos)) / count(*), 6) AS distance FROM e JOIN t USING (doc) GROUP BY 1, 2""",
    "context_distance_turns": f"""WITH {turns_sql()}, two AS (SELECT ctx_id, docs AS b, lag(docs) OVER (PARTITION BY customer ORDER BY turn) AS a FROM turns),
m AS (SELECT *, list_filter(a, lambda x: list_contains(b, x)) AS c FROM two WHERE a IS NOT NULL)
SELECT ctx_id, CASE WHEN len(c) = 0 THEN 1.0 ELSE round(1 - len(c) / greatest(len(a), len(b))::DOUBLE + 0.001 * list_sum(list_transform(c, lambda x: abs(list_position(a, x) - list_position(b, x)))) / len(c), 6) END AS distance FROM m""",
    "intern_documents": f"""WITH {ctx_sql()} SELECT doc, row_number() OVER (ORDER BY first) - 1 AS doc_number FROM (SELECT doc, min((ctx_id, pos)) AS first FROM places GROUP BY doc)""",
    "leaf_dedup": f"""WITH {ctx_sql('l_suppkey')} SELECT array_to_string(list_sort(docs), ',') AS content, count(*) AS frequency, min(ctx_id) AS first_ctx FROM ctx GROUP BY list_sort(docs)""",
    "schedule_groups": f"""{_PATHS}, sized AS (SELECT *, count(*) OVER (PARTITION BY batch, group_id) AS group_size, first(ctx_id) OVER (PARTITION BY batch, group_id ORDER BY len(path) DESC, path, ctx_id) AS first_ctx FROM grouped)
SELECT batch, ctx_id, group_id, group_size, row_number() OVER (PARTITION BY batch ORDER BY group_size DESC, first_ctx, len(path) DESC, path, ctx_id) - 1 AS exec_pos FROM sized""",
    "schedule_incremental": f"""{_PATHS} SELECT batch, ctx_id, group_id, row_number() OVER (PARTITION BY batch ORDER BY group_id, len(path) DESC, turn % 2 DESC, ctx_id) - 1 AS exec_pos FROM grouped""",
    "group_scores": f"""{_PATHS} SELECT batch, group_id, count(*) AS score FROM grouped GROUP BY 1, 2""",
    "reorder_with_prefix": f"""WITH {turns_sql()}, two AS (SELECT ctx_id, docs AS b, lag(docs) OVER (PARTITION BY customer ORDER BY turn) AS a FROM turns)
SELECT ctx_id, array_to_string(CASE WHEN a IS NULL THEN b ELSE list_concat(list_filter(a, lambda x: list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))) END, ',') AS docs FROM two""",
    "adjacent_prefix_len": f"""WITH {turns_sql()}, two AS (SELECT ctx_id, docs AS b, lag(docs) OVER (PARTITION BY customer ORDER BY turn) AS a FROM turns),
k AS (SELECT ctx_id, a, b, unnest(range(1, 1 + greatest(1, least(len(a), len(b))))) AS k FROM two WHERE a IS NOT NULL)
SELECT t.ctx_id, coalesce(min(least(len(k.a), len(k.b))), 0)::BIGINT - CASE WHEN min(CASE WHEN k.a[k] <> k.b[k] THEN k END) IS NULL THEN 0 ELSE min(least(len(k.a), len(k.b))) - min(CASE WHEN k.a[k] <> k.b[k] THEN k END) + 1 END AS prefix_len
FROM two t LEFT JOIN k USING (ctx_id) GROUP BY t.ctx_id""",
    "group_prefix": f"""WITH {ctx_sql('l_suppkey')}, g AS (SELECT c.ctx_id, docs, docs[1] || '/' || o_orderpriority AS grp FROM ctx c JOIN orders ON o_orderkey = ctx_id),
m AS (SELECT grp, count(*) AS n FROM g GROUP BY grp),
p AS (SELECT grp, pos, count(*) AS here, min(doc) AS low, max(doc) AS high FROM g JOIN places USING (ctx_id) GROUP BY grp, pos),
r AS (SELECT p.grp, pos, low, min(CASE WHEN here = n AND low = high THEN 1 ELSE 0 END) OVER (PARTITION BY p.grp ORDER BY pos) AS same FROM p JOIN m USING (grp))
SELECT m.grp, any_value(n) AS n_contexts, coalesce(string_agg(low, ',' ORDER BY pos) FILTER (same = 1), '') AS prefix FROM m LEFT JOIN r USING (grp) GROUP BY m.grp""",
    "hash_reorder": f"""WITH {ctx_sql('l_suppkey')} SELECT ctx_id, string_agg(doc, ',' ORDER BY substr(sha256(trim(s_name)), 1, 16), pos) AS docs FROM places JOIN supplier ON s_suppkey = doc GROUP BY ctx_id""",
    "lru_tokens_to_evict": """WITH use AS (SELECT user_id AS node_id, max((ts, event_id)) AS last, floor(sum(value))::BIGINT AS tokens FROM events GROUP BY user_id),
run AS (SELECT node_id, tokens, sum(tokens) OVER (ORDER BY last) - tokens AS before, sum(tokens) OVER () AS total FROM use)
SELECT node_id, tokens, before::BIGINT AS freed_before FROM run WHERE before < 0.25 * total""",
    "update_node_deltas": """WITH i AS (SELECT l_orderkey AS node_id, sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END)::BIGINT AS extra, sum(l_quantity)::BIGINT AS total,
  sum(CASE WHEN l_linenumber = 1 THEN 0 WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::BIGINT AS delta FROM lineitem GROUP BY 1)
SELECT node_id, CASE WHEN delta > 0 THEN extra + delta ELSE greatest(0, extra + delta) END AS extra, CASE WHEN delta > 0 THEN total + delta ELSE greatest(0, total + delta) END AS total FROM i""",
    "update_node_tokens": """WITH i AS (SELECT l_orderkey AS node_id, sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END)::BIGINT AS extra, sum(l_quantity)::BIGINT AS total, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS removed FROM lineitem GROUP BY 1)
SELECT node_id, greatest(0, extra - removed) AS extra, greatest(0, total - removed) AS total FROM i""",
}
