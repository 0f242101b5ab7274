"""The live index: searching and growing trees, evicting from them, token arithmetic."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import arranged, tree_nodes
from .contexts import ranked, reordered_with_prefix
from .distance import ALPHA
from .shared import Scratch, group_key


def node_stats(nodes: DataFrame, batch: str) -> DataFrame:
    """(batch, total_nodes, leaf_nodes, root_nodes, internal_nodes)."""
    leaf = F.count_if("is_leaf")
    return nodes.groupBy(batch).agg(F.count("*").alias("total_nodes"), leaf.alias("leaf_nodes"), F.count_if(F.col("parent_id").isNull()).alias("root_nodes"), (F.count("*") - leaf).alias("internal_nodes"))


def _keyed(df: DataFrame, batch: str) -> DataFrame:
    return df.withColumn("g", group_key(F.col(batch)))


def _searched(nodes: DataFrame, asked: DataFrame, alpha: float, scratch: Scratch) -> DataFrame:
    """(g, ctx_id, search_path, node_id, overlap, has_prefix) of contexts (g, ctx_id, docs) in the trees of a node table (g, ...).

    All contexts go down a level a round: a context at a node meets, through shared documents, the node's
    children, and the nearest one is where it goes on, stays or ends.  Paths are looked up at the end, no round carries them.
    """
    own = asked.select("g", "ctx_id", F.size("docs").alias("n"), F.posexplode("docs").alias("pos", "doc"))
    children = nodes.where(F.col("parent_id").isNotNull()).select("g", F.col("parent_id").alias("at"), "node_id", "child_no", "is_leaf", F.size("docs").alias("m"), F.get("docs", F.lit(0)).alias("first"), F.posexplode("docs").alias("child_pos", "doc"))
    frontier = asked.select("g", "ctx_id").join(nodes.where(F.col("parent_id").isNull()).select("g", F.col("node_id").alias("at")), "g")
    frontier = scratch.written(frontier.select("g", "ctx_id", "at", F.lit(None).cast("long").alias("overlap")))
    ended: list[DataFrame] = []
    while True:
        met = frontier.select("g", "ctx_id", "at").join(own, ["g", "ctx_id"]).join(children, ["g", "at", "doc"])
        near = met.groupBy("g", "ctx_id", "n", "m", "node_id", "child_no", "is_leaf", "first").agg(F.count("*").alias("common"), F.sum(F.abs(F.col("pos") - F.col("child_pos"))).alias("moved"), F.bool_or(F.col("doc") == F.col("first")).alias("starts"))
        far = 1 - F.col("common") / F.greatest("n", "m") + F.lit(alpha) * F.col("moved") / F.col("common")
        best = near.groupBy("g", "ctx_id").agg(F.min_by(F.struct("node_id", "is_leaf", "starts", "common"), F.struct(far, "child_no")).alias("to"))
        step = scratch.written(frontier.join(best, ["g", "ctx_id"], "left"))
        to = F.col("to")
        here = step.where(to.isNull() & F.col("overlap").isNotNull()).select("g", "ctx_id", F.col("at").alias("node_id"), "overlap", F.lit(True).alias("has_prefix"))
        there = step.where(to.isNotNull() & (to.is_leaf | ~to.starts)).select("g", "ctx_id", to.node_id.alias("node_id"), to.common.alias("overlap"), to.starts.alias("has_prefix"))
        ended += [here, there]
        on = step.where(to.isNotNull() & ~to.is_leaf & to.starts)
        frontier = on.select("g", "ctx_id", to.node_id.alias("at"), to.common.alias("overlap"))
        if not on.limit(1).count():
            break
    found = functools.reduce(DataFrame.unionByName, ended).join(nodes.select("g", "node_id", F.col("path").alias("search_path")), ["g", "node_id"])
    out = asked.select("g", "ctx_id").join(found, ["g", "ctx_id"], "left")
    none = F.array().cast("array<int>")
    return out.select("g", "ctx_id", F.coalesce("search_path", none).alias("search_path"), F.coalesce("node_id", F.lit(-1).cast("long")).alias("node_id"), F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"), F.coalesce("has_prefix", F.lit(False)).alias("has_prefix"))


def _tables(indexed: DataFrame, asked: DataFrame, batch: str, method: str, alpha: float) -> tuple[Scratch, DataFrame, DataFrame]:
    scratch = Scratch(indexed.sparkSession, "search")
    nodes = scratch.written(_keyed(tree_nodes(indexed, batch, method, alpha), batch).drop(batch))
    own = scratch.written(_keyed(asked.select(batch, "ctx_id", F.col("docs").cast("array<bigint>").alias("docs")), batch))
    return scratch, nodes, own


def searched(indexed: DataFrame, asked: DataFrame, batch: str, method: str = "average", alpha: float = ALPHA) -> DataFrame:
    """(batch, ctx_id, search_path, node_id, overlap, has_prefix): each batch's contexts searched in its tree.

    The search goes to the nearest child that shares documents, as long as its first document is asked for;
    no match: ([], -1, 0, False).
    """
    scratch, nodes, own = _tables(indexed, asked, batch, method, alpha)
    found = _searched(nodes, own, alpha, scratch)
    return own.select("g", batch, "ctx_id").join(found, ["g", "ctx_id"]).drop("g")


def built_incrementally(indexed: DataFrame, asked: DataFrame, batch: str, method: str = "average", alpha: float = ALPHA) -> DataFrame:
    """(batch, ctx_id, docs, reordered, path, matched, group_id, exec_pos): new contexts built into each batch's tree.

    Matched contexts begin with the documents of their node that they have, and hang below it, or beside it
    where it is a leaf or its first document isn't theirs; the others are clustered among themselves, and
    their subtrees become further children of the root.
    """
    scratch, nodes, own = _tables(indexed, asked, batch, method, alpha)
    found = scratch.written(own.join(_searched(nodes, own, alpha, scratch), ["g", "ctx_id"]))
    count = nodes.where(F.col("parent_id").isNotNull()).groupBy("g", F.col("parent_id").alias("parent")).agg(F.count("*").alias("children"))
    places = nodes.select("g", F.col("node_id").alias("parent"), F.col("path").alias("parent_path")).join(count, ["g", "parent"], "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    at = nodes.select("g", "node_id", "parent_id", "is_leaf", F.col("docs").alias("node_docs"))
    hit = found.where("node_id >= 0").join(at, ["g", "node_id"])
    hit = hit.withColumn("parent", F.when(F.col("has_prefix") & ~F.col("is_leaf"), F.col("node_id")).otherwise(F.col("parent_id")))
    hit = scratch.written(ranked(hit, ["g", "parent"], "ctx_id", "added"))
    prefix = F.when(F.col("has_prefix"), F.col("node_docs")).otherwise(F.array().cast("array<bigint>"))
    path = F.concat("parent_path", F.array((F.col("children") + F.col("added")).cast("int")))
    matched = hit.join(places, ["g", "parent"]).select(batch, "ctx_id", "docs", reordered_with_prefix(F.col("docs"), prefix).alias("reordered"), path.alias("path"), F.lit(True).alias("matched"))

    rest = scratch.written(arranged(found.where("node_id < 0").select(batch, "ctx_id", "docs"), batch, method, alpha))
    root = places.join(nodes.where(F.col("parent_id").isNull()).select("g", F.col("node_id").alias("parent")), ["g", "parent"])
    base = root.join(hit.groupBy("g", "parent").agg(F.count("*").alias("more")), ["g", "parent"], "left").select("g", (F.col("children") + F.coalesce("more", F.lit(0))).alias("base"))
    first = (F.get("path", F.lit(0)) + F.coalesce("base", F.lit(0))).cast("int")
    moved = F.when(F.size("path") == 0, F.col("path")).otherwise(F.concat(F.array(first), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))))
    others = _keyed(rest, batch).join(base, "g", "left").select(batch, "ctx_id", "docs", "reordered", moved.alias("path"), F.lit(False).alias("matched"))

    rows = matched.unionByName(others).withColumn("group_id", F.coalesce(F.get("path", F.lit(0)), F.lit(-1)))
    order = Window.partitionBy(batch).orderBy("group_id", F.desc(F.size("path")), F.desc("matched"), "ctx_id")
    return rows.withColumn("exec_pos", (F.row_number().over(order) - 1).cast("long"))


def pruned(nodes: DataFrame, gone: DataFrame, batch: str) -> DataFrame:
    """(batch, node_id, removed): named nodes go, and then every parent below the root that has no child left.

    A node goes if it is named, or if it is inside and all its leaves go; that needs the leaves'
    ancestors only, which their paths name.
    """
    own = nodes.select(batch, "node_id", "path", "is_leaf")
    leaves = own.where("is_leaf").join(gone.withColumn("named", F.lit(True)), [batch, "node_id"], "left").select(batch, F.col("path").alias("leaf_path"), F.coalesce("named", F.lit(False)).alias("named"))
    above = leaves.select(batch, "named", F.explode(F.transform(F.sequence(F.lit(0), F.size("leaf_path")), lambda k: F.slice("leaf_path", 1, k))).alias("path"))
    alive = above.groupBy(batch, "path").agg((~F.bool_and("named")).alias("alive"))
    found = own.join(alive, [batch, "path"], "left")
    return found.select(batch, "node_id", (~F.coalesce("alive", F.lit(True)) & (F.size("path") > 0)).alias("removed"))


def lru_evictions(use: DataFrame, share: float) -> DataFrame:
    """(node_id, tokens, freed_before): nodes evicted, least recently used first, until a share of all tokens is free.

    Running sums are taken inside days and shifted by the sums of earlier days.
    """
    use = use.withColumn("day", F.to_date("last_access"))
    days = use.groupBy("day").agg(F.sum("tokens").alias("t"))
    days = days.select("day", (F.sum("t").over(Window.orderBy("day")) - F.col("t")).alias("earlier"), F.sum("t").over(Window.partitionBy()).alias("total"))  # one row a day
    inside = F.sum("tokens").over(Window.partitionBy("day").orderBy("last_access", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    run = use.withColumn("inside", inside).join(days, "day").withColumn("freed_before", F.col("inside") + F.col("earlier"))
    return run.where(F.col("freed_before") < F.lit(share) * F.col("total")).select("node_id", "tokens", "freed_before")


def tokens_after_removal(nodes: DataFrame) -> DataFrame:
    """(node_id, extra, total): removed tokens come off the extra ones first and off the total; neither falls below 0."""
    return nodes.select("node_id", F.greatest(F.lit(0), F.col("extra") - F.col("removed")).alias("extra"), F.greatest(F.lit(0), F.col("total") - F.col("removed")).alias("total"))


def tokens_updated(nodes: DataFrame) -> DataFrame:
    """(node_id, extra, total) after a ``delta``: tokens that are added count as extra ones, removed ones as in ``tokens_after_removal``."""
    added, removed = (F.greatest(F.lit(0), sign * F.col("delta")) for sign in (1, -1))
    grown = nodes.select("node_id", (F.col("extra") + added).alias("extra"), (F.col("total") + added).alias("total"), removed.alias("removed"))
    return tokens_after_removal(grown)
