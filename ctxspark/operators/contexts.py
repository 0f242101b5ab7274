"""Contexts: ordered lists of document ids, as rows (ctx_id, docs) and exploded (ctx_id, doc, pos, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_rows(rows: DataFrame, ctx: str, doc: str, order: str, *keep: str) -> DataFrame:
    """(ctx_id, docs, *keep): each document once, at its first place.  Rows are shuffled once, by context, to a fixed number of tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.col(ctx).alias("ctx_id"), F.col(doc).alias("doc"), F.col(order).alias("place"), *keep).repartition(parts, "ctx_id")
    once = own.groupBy("ctx_id", "doc", *keep).agg(F.min("place").alias("at"))
    return once.groupBy("ctx_id", *keep).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc"))), lambda x: x["doc"]).alias("docs"))


def exploded(contexts: DataFrame, *keep: str) -> DataFrame:
    """(ctx_id, doc, pos, n, *keep), places from 0."""
    return contexts.select("ctx_id", *keep, F.size("docs").alias("n"), F.posexplode("docs").alias("pos", "doc"))


def interned(contexts: DataFrame, bucket: int = 4096) -> DataFrame:
    """(doc, doc_number): dense numbers from 0 by first appearance (context, place).

    Numbers are given inside ranges of contexts and shifted by the counts of earlier ranges, so no
    task sees all documents.
    """
    first = exploded(contexts).groupBy("doc").agg(F.min(F.struct("ctx_id", "pos")).alias("first")).withColumn("range", F.floor(F.col("first.ctx_id") / bucket))
    counts = first.groupBy("range").agg(F.count("*").alias("n"))
    shift = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("range").orderBy("first")) - 1
    return first.withColumn("inside", inside).join(shift, "range").select("doc", (F.col("inside") + F.col("before")).cast("long").alias("doc_number"))


def ranked(rows: DataFrame, keys: list[str], order: str, name: str, bucket: int = 4096) -> DataFrame:
    """``rows`` with ``name``: the place, from 0, among the rows of their keys by a whole-number column.

    Places are given inside ranges of the column and shifted by the counts of earlier ranges.
    """
    own = rows.withColumn("range_", F.floor(F.col(order) / bucket))
    counts = own.groupBy(*keys, "range_").agg(F.count("*").alias("n_"))
    shift = counts.select(*keys, "range_", (F.sum("n_").over(Window.partitionBy(*keys).orderBy("range_")) - F.col("n_")).alias("before_"))  # one row a range
    inside = F.row_number().over(Window.partitionBy(*keys, "range_").orderBy(order)) - 1
    return own.withColumn("inside_", inside).join(shift, [*keys, "range_"]).withColumn(name, F.col("inside_") + F.col("before_")).drop("range_", "inside_", "before_")


def ordered_intersection(first: Column, second: Column) -> Column:
    """Members of the first list that are in the second, in the first's order."""
    return F.array_intersect(first, second)


def reordered_with_prefix(docs: Column, prefix: Column) -> Column:
    """The prefix's documents that are in the list, then the others in their order."""
    return F.concat(ordered_intersection(prefix, docs), F.array_except(docs, prefix))


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many places from the first on hold the same documents."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: ~F.get(a, k).eqNullSafe(F.get(b, k)))
    return F.when(n <= 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)), n)).cast("int")


def group_prefix(contexts: DataFrame, group: str) -> DataFrame:
    """(group, n_contexts, prefix): the longest prefix that all contexts of a group share."""
    members = contexts.groupBy(group).agg(F.count("*").alias("n_contexts"))
    places = exploded(contexts, group).groupBy(group, "pos").agg(F.count("*").alias("here"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    shared = places.join(members, group).withColumn("same", (F.col("here") == F.col("n_contexts")) & (F.col("low") == F.col("high")))
    upto = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = shared.withColumn("all", F.min(F.col("same").cast("int")).over(upto)).where("all = 1")
    prefix = run.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "low"))), lambda x: x["low"]).alias("prefix"))
    return members.join(prefix, group, "left").select(group, "n_contexts", F.coalesce("prefix", F.array().cast(contexts.schema["docs"].dataType)).alias("prefix"))


def leaves(contexts: DataFrame) -> DataFrame:
    """(content, frequency, first_ctx): contexts of one set of documents are one leaf."""
    return contexts.groupBy(F.array_sort("docs").alias("content")).agg(F.count("*").alias("frequency"), F.min("ctx_id").alias("first_ctx"))
