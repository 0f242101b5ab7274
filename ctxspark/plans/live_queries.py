"""Queries of the live index: a region's tree has its nations below the root and their customers as leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import joined
from ..operators import live
from .tables import order_contexts, table

MAX_TOKENS = 10_000_000


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    key, place = F.col("n_nationkey").cast("long"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    inner = nation.select(F.col("n_regionkey").cast("long").alias("batch"), key.alias("node_id"), F.lit(100).cast("long").alias("parent_id"), F.array(place.cast("int")).alias("path"), F.array(key % 7).alias("docs"))
    inner = inner.withColumns({"tokens": F.lit(50).cast("long"), "request_id": F.lit(None).cast("string"), "is_leaf": F.lit(False)})
    root = inner.select("batch", F.lit(100).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.array().cast("array<int>").alias("path"), F.array().cast("array<bigint>").alias("docs")).distinct()
    root = root.withColumns({"tokens": F.lit(0).cast("long"), "request_id": F.lit(None).cast("string"), "is_leaf": F.lit(False)})
    own = customer.join(inner.select("batch", F.col("node_id").alias("nation"), F.col("path").alias("up"), F.col("docs").alias("first")), F.col("c_nationkey") == F.col("nation"))
    place = F.row_number().over(Window.partitionBy("nation").orderBy("c_custkey")) - 1
    leaf = own.select(
        "batch", (F.col("c_custkey") + 1000).alias("node_id"), F.col("nation").alias("parent_id"), F.array_append("up", place.cast("int")).alias("path"),
        F.concat("first", F.array(F.col("c_custkey") % 5, F.col("c_custkey") + 10)).alias("docs"), F.floor(F.abs("c_acctbal")).cast("long").alias("tokens"),
        F.concat(F.lit("req-"), F.col("c_custkey").cast("string")).alias("request_id"), F.lit(True).alias("is_leaf"),
    )
    return root.unionByName(inner).unionByName(leaf)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contexts that search the trees."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    path = F.when(k % 7 == 0, F.array((k % 6).cast("int"))).otherwise(F.array((k % 6).cast("int"), (F.col("o_custkey") % 40).cast("int")))
    docs = F.array(k % 7, F.col("o_custkey") % 5, k)
    return o.select((k % 5).alias("batch"), k.alias("ctx_id"), path.alias("path"), docs.alias("docs"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("tokens"))


def live_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that orders' paths lead to."""
    return live.traverse(nodes(spark, sf_dir), asked(spark, sf_dir)).select("batch", "ctx_id", "node_id", "node_is_leaf")


def live_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves that the orders get."""
    made = live.inserted(nodes(spark, sf_dir), asked(spark, sf_dir))
    return made.select("batch", "ctx_id", "node_id", "parent_id", joined(F.col("path"), ".").alias("path"), joined(F.col("docs")).alias("docs"), "tokens", "request_id")


def live_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How orders go in beside the leaves that they match."""
    return live.split_leaves(nodes(spark, sf_dir), asked(spark, sf_dir)).select("batch", "ctx_id", "node_id", "kind", joined(F.col("prefix")).alias("prefix"), "tokens")


def live_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's tree with its own copy merged in."""
    own = nodes(spark, sf_dir)
    return live.merged(own, own).select("batch", "node_id", "parent_id", joined(F.col("path"), ".").alias("path"), "is_leaf")


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to remove: two market segments', every customer's of one nation, and unknown ones."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey % 10 = 3").select(F.concat(F.lit("req-"), F.col("c_custkey").cast("string")).alias("request_id"))
    return c.unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("req-x"), F.col("n_nationkey").cast("string")).alias("request_id")))


def live_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the trees."""
    left = live.without_requests(nodes(spark, sf_dir), _removed(spark, sf_dir))
    return left.select("batch", "node_id", "parent_id", joined(F.col("path"), ".").alias("path"))


def live_removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in numbers."""
    return live.removal_counts(nodes(spark, sf_dir), _removed(spark, sf_dir))


def live_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests with their nodes; orders' customers are tracked, with a node or without."""
    tracked = table(spark, sf_dir, "orders").select(F.concat(F.lit("req-"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 9 == 0, F.lit("-late")).otherwise(F.lit(""))).alias("request_id"))
    return live.request_nodes(nodes(spark, sf_dir), tracked)


def live_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, tokens and utilisation of the trees."""
    return live.index_stats(nodes(spark, sf_dir), MAX_TOKENS)


def radix_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest node that begins each order's documents."""
    requests = asked(spark, sf_dir).select("batch", F.col("ctx_id").alias("request_id"), "docs")
    return live.leaf_owners(nodes(spark, sf_dir).withColumn("docs", F.slice("docs", 1, 2)), requests)


def shared_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's suppliers in the order of their balance; those in debt are not in the schedule."""
    items = order_contexts(spark, sf_dir, "l_suppkey").select(F.col("ctx_id").alias("by"), F.posexplode("docs").alias("local_pos", "item"))
    balance = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("item"), F.struct("s_acctbal", "s_suppkey").alias("global_pos"))
    return live.local_order(items, balance)


QUERIES = [live_traverse, live_insert, live_split, live_merge, live_remove, live_removal_counts, live_requests, live_stats, radix_owners, shared_order]

_NODES = """inn AS (SELECT n_regionkey AS batch, n_nationkey AS node_id, 100 AS parent_id, [row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1] AS path, [n_nationkey % 7] AS docs, 50 AS tokens, NULL::VARCHAR AS request_id, FALSE AS is_leaf FROM nation),
nodes AS (SELECT DISTINCT batch, 100::BIGINT AS node_id, NULL::BIGINT AS parent_id, []::BIGINT[] AS path, []::BIGINT[] AS docs, 0::BIGINT AS tokens, NULL::VARCHAR AS request_id, FALSE AS is_leaf FROM inn
  UNION ALL SELECT * FROM inn
  UNION ALL SELECT batch, c_custkey + 1000, node_id, list_append(path, row_number() OVER (PARTITION BY node_id ORDER BY c_custkey) - 1), list_concat(docs, [c_custkey % 5, c_custkey + 10]), floor(abs(c_acctbal))::BIGINT, 'req-' || c_custkey, TRUE FROM customer JOIN inn ON c_nationkey = node_id)"""
_ASKED = """asked AS (SELECT o_orderkey % 5 AS batch, o_orderkey AS ctx_id, CASE WHEN o_orderkey % 7 = 0 THEN [o_orderkey % 6] ELSE [o_orderkey % 6, o_custkey % 40] END AS path, [o_orderkey % 7, o_custkey % 5, o_orderkey] AS docs, floor(o_totalprice / 100)::BIGINT AS tokens FROM orders)"""
_HIT = f"WITH {_NODES}, {_ASKED}, hit AS (SELECT a.*, n.node_id, n.parent_id, n.is_leaf, n.docs AS nd, n.tokens AS nt FROM asked a LEFT JOIN nodes n ON n.batch = a.batch AND n.path = a.path)"
_GONE = f"""WITH {_NODES}, req AS (SELECT 'req-' || c_custkey AS request_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey % 10 = 3 UNION SELECT 'req-x' || n_nationkey FROM nation),
leaf AS (SELECT node_id, parent_id, request_id, request_id IN (SELECT request_id FROM req) AS named FROM nodes WHERE is_leaf),
gone AS (SELECT node_id FROM leaf WHERE named UNION ALL SELECT parent_id FROM leaf GROUP BY parent_id HAVING bool_and(named))"""

ORACLES = {
    "live_traverse": f"{_HIT} SELECT batch, ctx_id, node_id, is_leaf AS node_is_leaf FROM hit",
    "live_insert": f"""{_HIT}, place AS (SELECT h.*, coalesce(CASE WHEN is_leaf THEN parent_id ELSE node_id END, 100) AS under FROM hit h),
kids AS (SELECT batch, parent_id, count(*) AS n FROM nodes GROUP BY 1, 2), tops AS (SELECT batch, max(node_id) AS top FROM nodes GROUP BY 1)
SELECT a.batch, ctx_id, top + row_number() OVER (PARTITION BY a.batch ORDER BY ctx_id) AS node_id, under AS parent_id,
  array_to_string(list_append(p.path, coalesce(k.n, 0) + row_number() OVER (PARTITION BY a.batch, under ORDER BY ctx_id) - 1), '.') AS path, array_to_string(a.docs, ',') AS docs, a.tokens, 'req-' || substr(sha256(a.batch || ':' || ctx_id), 1, 16) AS request_id
FROM place a JOIN tops t ON t.batch = a.batch JOIN nodes p ON p.batch = a.batch AND p.node_id = under LEFT JOIN kids k ON k.batch = a.batch AND k.parent_id = under""",
    "live_split": f"""{_HIT}, s AS (SELECT *, CASE WHEN docs[1] <> nd[1] THEN 0 WHEN docs[2] <> nd[2] THEN 1 WHEN docs[3] <> nd[3] THEN 2 ELSE 3 END AS k FROM hit WHERE is_leaf)
SELECT batch, ctx_id, node_id, CASE WHEN k IN (1, 2) THEN 'split' ELSE 'sibling' END AS kind, CASE k WHEN 1 THEN nd[1]::VARCHAR WHEN 2 THEN nd[1] || ',' || nd[2] ELSE '' END AS prefix, CASE WHEN k IN (1, 2) THEN floor(50 + (nt - 50) * k / 3)::BIGINT END AS tokens FROM s""",
    "live_merge": f"""WITH {_NODES}, tops AS (SELECT batch, max(node_id) + 1 AS shift, count(*) FILTER (parent_id = 100) AS taken FROM nodes GROUP BY 1)
SELECT batch, node_id, parent_id, array_to_string(path, '.') AS path, is_leaf FROM nodes
UNION ALL SELECT n.batch, node_id + shift, CASE WHEN len(path) = 1 THEN 100 ELSE parent_id + shift END, array_to_string(list_concat([path[1] + taken], path[2:]), '.'), is_leaf FROM nodes n JOIN tops t ON t.batch = n.batch WHERE len(path) > 0""",
    "live_remove": f"{_GONE} SELECT batch, node_id, parent_id, array_to_string(path, '.') AS path FROM nodes WHERE node_id NOT IN (SELECT node_id FROM gone)",
    "live_removal_counts": f"""{_GONE} SELECT (SELECT count(*) FROM leaf WHERE named) AS removed, (SELECT count(*) FROM (SELECT parent_id FROM leaf GROUP BY parent_id HAVING bool_and(named))) AS pruned,
  (SELECT count(*) FROM req WHERE request_id NOT IN (SELECT request_id FROM leaf)) AS not_found, (SELECT count(*) FROM leaf WHERE NOT named) AS remaining""",
    "live_requests": f"""WITH {_NODES}, tracked AS (SELECT DISTINCT 'req-' || o_custkey || CASE WHEN o_custkey % 9 = 0 THEN '-late' ELSE '' END AS request_id FROM orders),
own AS (SELECT request_id, batch, node_id FROM nodes WHERE is_leaf) SELECT coalesce(o.request_id, t.request_id) AS request_id, batch, node_id FROM own o FULL JOIN tracked t ON t.request_id = o.request_id""",
    "live_stats": f"""WITH {_NODES} SELECT batch, count(*) AS total_nodes, count(*) FILTER (is_leaf) AS leaf_nodes, count(request_id) AS requests, coalesce(sum(tokens) FILTER (is_leaf), 0)::BIGINT AS total_tokens,
  round(coalesce(sum(tokens) FILTER (is_leaf), 0) * 100 / {MAX_TOKENS}, 4) AS utilization_pct FROM nodes GROUP BY batch""",
    "radix_owners": f"""WITH {_NODES}, {_ASKED}, held AS (SELECT a.batch, a.ctx_id, n.node_id, len(n.docs[1:2]) AS k FROM asked a JOIN nodes n ON n.batch = a.batch AND len(n.docs) > 0 AND a.docs[1 : len(n.docs[1:2])] = n.docs[1:2])
SELECT a.ctx_id AS request_id, a.batch, arg_max(h.node_id, (h.k, h.node_id)) AS node_id FROM asked a LEFT JOIN held h ON h.ctx_id = a.ctx_id GROUP BY 1, 2""",
    "shared_order": """WITH i AS (SELECT l_orderkey AS "by", l_suppkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_suppkey) AS local_pos FROM lineitem GROUP BY 1, 2)
SELECT "by", item, row_number() OVER (PARTITION BY "by" ORDER BY CASE WHEN s_acctbal >= 0 THEN 0 ELSE 1 END, CASE WHEN s_acctbal >= 0 THEN s_acctbal END, CASE WHEN s_acctbal >= 0 THEN s_suppkey END, local_pos) AS pos FROM i JOIN supplier ON s_suppkey = item""",
}
