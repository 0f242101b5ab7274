"""The live index as a table of nodes that changes by whole batches of requests.

Nodes are rows (batch, node_id, parent_id, path, docs, tokens, request_id, is_leaf): ``path`` holds the
ordinals from the root (empty path) down, leaves carry the request that they were made for.  Changes give
the new rows or the whole new table; all requests of a batch are applied at once, in the order of ctx_id.

Defined results: unknown paths and requests are reported, not raised; a null path is unknown; a request
tracked without a node has node_id null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

NODE = ("batch", "node_id", "parent_id", "path", "docs", "tokens", "request_id", "is_leaf")
#: Requests are counted in ranges of so many ids.
RANGE = 4096


def traverse(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (batch, ctx_id, path, ...) with the node of each path: node_id, node_docs, node_tokens, node_is_leaf, parent_id; null if there is none."""
    own = nodes.select("batch", "path", "node_id", F.col("docs").alias("node_docs"), F.col("tokens").alias("node_tokens"), F.col("is_leaf").alias("node_is_leaf"), "parent_id")
    return asked.join(own, ["batch", "path"], "left")


def _children(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id IS NOT NULL").groupBy("batch", "parent_id").agg((F.max(F.element_at("path", -1)) + 1).alias("taken"))


def inserted(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New leaves for (batch, ctx_id, path, docs, tokens): below an inner node, beside a leaf, below the root for unknown paths.

    Requests get the ordinals behind the children that their parent has.  Whole-number ids are counted in ranges, so
    no task sees all requests of a batch.
    """
    at = traverse(nodes, new.select("batch", "ctx_id", "path", F.col("docs").alias("own_docs"), F.col("tokens").alias("own_tokens")))
    root = nodes.where(F.size("path") == 0).select("batch", F.col("node_id").alias("root_id"))
    top = nodes.groupBy("batch").agg(F.max("node_id").alias("top"))
    beside = F.when(F.col("node_is_leaf"), F.col("parent_id")).otherwise(F.col("node_id"))
    placed = at.join(root, "batch").join(top, "batch").withColumn("under", F.coalesce(beside, F.col("root_id"))).drop("parent_id", "node_id", "path")
    parents = nodes.select("batch", F.col("node_id").alias("under"), F.col("path").alias("under_path"))
    placed = placed.join(parents, ["batch", "under"]).join(_children(nodes).withColumnRenamed("parent_id", "under"), ["batch", "under"], "left")
    whole = isinstance(new.schema["ctx_id"].dataType, IntegralType)
    placed = placed.withColumn("range", F.coalesce(F.floor(F.col("ctx_id") / RANGE), F.lit(-(2**63))) if whole else F.lit(0))
    counts = placed.groupBy("batch", "under", "range").agg(F.count("*").alias("n"))  # rows of ranges from here on
    before = lambda n, *by: F.sum(n).over(Window.partitionBy(*by).orderBy("range")) - F.col(n)
    whole_range = counts.groupBy("batch", "range").agg(F.sum("n").alias("m"))
    shift = counts.select("batch", "under", "range", before("n", "batch", "under").alias("beside")).join(whole_range.select("batch", "range", before("m", "batch").alias("place")), ["batch", "range"])
    inside = lambda *by: F.row_number().over(Window.partitionBy("batch", "range", *by).orderBy("ctx_id")) - 1
    placed = placed.repartition("batch", "range").withColumns({"inside": inside("under"), "at": inside()}).join(shift, ["batch", "under", "range"])
    ordinal, number = F.coalesce("taken", F.lit(0)) + F.col("inside") + F.col("beside"), F.col("top") + F.col("at") + F.col("place") + 1
    return placed.select(
        "batch", "ctx_id", number.alias("node_id"), F.col("under").alias("parent_id"), F.array_append("under_path", ordinal.cast("int")).alias("path"),
        F.col("own_docs").alias("docs"), F.col("own_tokens").alias("tokens"), request_id(F.col("batch"), F.col("ctx_id")).alias("request_id"), F.lit(True).alias("is_leaf"),
    )


def request_id(batch: Column, ctx_id: Column) -> Column:
    """The id of a context's request: the same for the same context."""
    return F.concat(F.lit("req-"), F.substring(F.sha2(F.concat_ws(":", batch.cast("string"), ctx_id.cast("string")), 256), 1, 16))


def split_leaves(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """(batch, ctx_id, node_id, kind, prefix, tokens): how a context that matched a leaf goes in.

    ``split``: leaf and context get a new inner node above them, with the documents that both begin with and
    tokens in proportion; ``sibling``: they begin differently, or hold the same documents.
    """
    at = traverse(nodes, new.select("batch", "ctx_id", "path", F.col("docs").alias("own_docs"))).where("node_is_leaf")
    parents = nodes.select("batch", F.col("node_id").alias("parent_id"), F.col("tokens").alias("parent_tokens"))
    at = at.join(parents, ["batch", "parent_id"], "left")
    n = F.least(F.size("node_docs"), F.size("own_docs"))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: ~F.get("node_docs", k).eqNullSafe(F.get("own_docs", k)))
    shared = F.when(n <= 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)), n))
    at = at.withColumn("prefix", F.slice("node_docs", 1, shared))
    same = (F.size("prefix") == F.size("node_docs")) & (F.size(F.array_except("own_docs", "node_docs")) == 0) & (F.size(F.array_except("node_docs", "own_docs")) == 0)
    is_split = (F.size("prefix") > 0) & ~same
    over = F.coalesce("parent_tokens", F.lit(0))
    tokens = F.floor(over + (F.col("node_tokens") - over) * F.size("prefix") / F.size("node_docs")).cast("long")
    kind = F.when(is_split, F.lit("split")).otherwise(F.lit("sibling"))
    none = F.array().cast(nodes.schema["docs"].dataType)
    return at.select("batch", "ctx_id", "node_id", kind.alias("kind"), F.when(is_split, F.col("prefix")).otherwise(none).alias("prefix"), F.when(is_split, tokens).alias("tokens"))


def merged(nodes: DataFrame, other: DataFrame) -> DataFrame:
    """Each batch's tree with the tree of the same batch in ``other`` hung below its root, behind its children.

    The other tree's numbers are moved beyond the first tree's, its root goes.
    """
    top = nodes.groupBy("batch").agg((F.max("node_id") + 1).alias("shift"))
    root = nodes.where(F.size("path") == 0).select("batch", F.col("node_id").alias("root_id"))
    taken = _children(nodes).join(root, "batch").where("parent_id = root_id").select("batch", F.col("taken"))
    moved = other.where(F.size("path") > 0).join(top, "batch").join(root, "batch").join(taken, "batch", "left")
    first = F.get("path", F.lit(0)) + F.coalesce("taken", F.lit(0))
    path = F.concat(F.array(first.cast("int")), F.slice("path", 2, F.size("path")))
    parent = F.when(F.size("path") == 1, F.col("root_id")).otherwise(F.col("parent_id") + F.col("shift"))
    moved = moved.select("batch", (F.col("node_id") + F.col("shift")).alias("node_id"), parent.alias("parent_id"), path.alias("path"), "docs", "tokens", "request_id", "is_leaf")
    return nodes.select(*NODE).unionByName(moved)


def _gone(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(batch, path, named, gone): which nodes go with the requests, and with the loss of all their children."""
    named = requests.select("request_id").distinct().withColumn("named", F.lit(True))
    leaves = nodes.where("is_leaf").join(named, "request_id", "left").select("batch", "path", F.coalesce("named", F.lit(False)).alias("named"))
    ups = F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))
    above = leaves.where(F.size("path") > 0).select("batch", "named", F.explode(ups).alias("path"))
    return above.groupBy("batch", "path").agg(F.bool_and("named").alias("gone"))


def without_requests(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """The nodes that stay when the leaves of ``requests`` (request_id) go and, with them, parents left childless; roots stay."""
    gone = _gone(nodes, requests).where("gone").select("batch", "path")
    return nodes.join(gone, ["batch", "path"], "left_anti").select(*NODE)


def removal_counts(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(removed, pruned, not_found, remaining): what a removal of requests does, in one row."""
    leaves = nodes.where("is_leaf").select("request_id")
    asked = requests.select("request_id").distinct()
    found = asked.join(leaves.distinct().withColumn("hit", F.lit(1)), "request_id", "left").agg(F.count("hit").alias("removed"), F.count_if(F.col("hit").isNull()).alias("not_found"))
    gone = _gone(nodes, requests).where("gone").join(nodes.select("batch", "path", "is_leaf"), ["batch", "path"]).agg(F.count_if(~F.col("is_leaf")).alias("pruned"))
    left = leaves.join(asked, "request_id", "left_anti").agg(F.count("*").alias("remaining"))
    return found.join(gone).join(left).select("removed", "pruned", "not_found", "remaining")  # one row each


def request_nodes(nodes: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """(request_id, batch, node_id) of all requests; ``tracked`` (request_id) are known without a node."""
    own = nodes.where(F.col("request_id").isNotNull()).select("request_id", "batch", "node_id")
    if tracked is None:
        return own
    return tracked.select("request_id").distinct().join(own, "request_id", "full_outer")


def index_stats(nodes: DataFrame, max_tokens: int) -> DataFrame:
    """(batch, total_nodes, leaf_nodes, requests, total_tokens, utilization_pct): tokens count at the leaves."""
    tokens = F.coalesce(F.sum(F.when(F.col("is_leaf"), F.col("tokens"))), F.lit(0)).cast("long")
    g = nodes.groupBy("batch").agg(F.count("*").alias("total_nodes"), F.count_if("is_leaf").alias("leaf_nodes"), F.count("request_id").alias("requests"), tokens.alias("total_tokens"))
    return g.withColumn("utilization_pct", F.round(F.col("total_tokens") * 100 / max_tokens, 4))


def leaf_owners(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, batch, node_id): the deepest node whose documents begin the request's ``docs`` (batch, request_id, docs).

    A node's documents are found by the hash of every prefix of the request, not by trying the nodes; of
    nodes with the same documents only the last can own a request, so the others don't meet the requests.
    """
    starts = F.transform(F.sequence(F.lit(1), F.size("docs")), lambda k: F.slice("docs", 1, k))
    asked = requests.where(F.size("docs") > 0).select("batch", "request_id", F.posexplode(starts).alias("k", "docs"))
    last = nodes.where(F.size("docs") > 0).groupBy("batch", "docs").agg(F.max("node_id").alias("node_id"))
    held = asked.join(last, ["batch", "docs"])
    found = held.groupBy("batch", "request_id").agg(F.max_by("node_id", F.struct("k", "node_id")).alias("node_id"))
    return requests.select("batch", "request_id").join(found, ["batch", "request_id"], "left").select("request_id", "batch", "node_id")


def local_order(items: DataFrame, order: DataFrame) -> DataFrame:
    """(by, item, pos): each group's items in the order of a shared schedule; items it does not name keep theirs, at the end.

    ``items``: (by, item, local_pos); ``order``: (item, global_pos).
    """
    both = items.join(order, "item", "left")
    place = Window.partitionBy("by").orderBy(F.col("global_pos").asc_nulls_last(), "local_pos")
    return both.select("by", "item", F.row_number().over(place).alias("pos"))
