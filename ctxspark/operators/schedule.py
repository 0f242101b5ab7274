"""Execution orders from search paths: contexts of one subtree run together, deepest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def grouped(paths: DataFrame, batch: str, path: str = "path") -> DataFrame:
    """Adds group_id: the root's child of the path, -1 without a path."""
    return paths.withColumn("group_id", F.coalesce(F.get(path, F.lit(0)), F.lit(-1)))


def scheduled(paths: DataFrame, batch: str, path: str = "path") -> DataFrame:
    """Adds group_id, group_size and exec_pos: larger groups first (then by first context), longer paths first, then by path."""
    own = grouped(paths, batch, path)
    group = Window.partitionBy(batch, "group_id")
    order = group.orderBy(F.size(path).desc(), path, "ctx_id")
    # a group's first context is the first of its own order
    own = own.withColumn("group_size", F.count("*").over(group)).withColumn("first_ctx", F.first("ctx_id").over(order))
    place = Window.partitionBy(batch).orderBy(F.desc("group_size"), "first_ctx", F.size(path).desc(), path, "ctx_id")
    return own.withColumn("exec_pos", F.row_number().over(place) - 1).drop("first_ctx")


def scheduled_incremental(paths: DataFrame, batch: str, path: str = "path", matched: str | None = None) -> DataFrame:
    """Adds group_id and exec_pos of a warm build: groups by number, longer paths first, matched ones before others."""
    own = grouped(paths, batch, path)
    keys = ["group_id", F.size(path).desc(), *([F.desc(matched)] if matched else []), "ctx_id"]
    return own.withColumn("exec_pos", F.row_number().over(Window.partitionBy(batch).orderBy(*keys)) - 1)


def group_scores(paths: DataFrame, batch: str, path: str = "path") -> DataFrame:
    """(batch, group_id, score): group sizes."""
    return grouped(paths, batch, path).groupBy(batch, "group_id").agg(F.count("*").alias("score"))
