"""Tables of a folder, and the contexts that the queries read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import contexts as cx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_contexts(spark: SparkSession, sf_dir: str, doc: str = "l_partkey") -> DataFrame:
    """(ctx_id, docs): an order's parts or suppliers by line number."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", doc, "l_linenumber")
    return cx.from_rows(rows, "l_orderkey", doc, "l_linenumber")


def customer_contexts(spark: SparkSession, sf_dir: str, doc: str = "l_suppkey") -> DataFrame:
    """(ctx_id, docs, customer, turn, parent): orders of a customer as turns, by date and key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ctx_id"), F.col("o_custkey").alias("customer"), "o_orderdate")
    own = Window.partitionBy("customer").orderBy("o_orderdate", "ctx_id")
    turns = order_contexts(spark, sf_dir, doc).join(orders, "ctx_id")
    return turns.select("ctx_id", "docs", "customer", F.row_number().over(own).cast("int").alias("turn"), F.lag("ctx_id").over(own).alias("parent"))


#: The same in SQL, as common table expressions.
def ctx_sql(doc: str = "l_partkey") -> str:
    return f"""places AS (SELECT l_orderkey AS ctx_id, {doc} AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), {doc}) - 1 AS pos FROM lineitem GROUP BY l_orderkey, {doc}),
ctx AS (SELECT ctx_id, list(doc ORDER BY pos) AS docs, count(*) AS n FROM places GROUP BY ctx_id)"""


def turns_sql(doc: str = "l_suppkey") -> str:
    return f"""{ctx_sql(doc)},
turns AS (SELECT ctx_id, docs, o_custkey AS customer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, ctx_id) AS turn, lag(ctx_id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, ctx_id) AS parent FROM ctx JOIN orders ON o_orderkey = ctx_id)"""
