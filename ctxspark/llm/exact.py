"""Exact dedup by progressive refinement, in DataFrame functions only.

Level 1 groups all texts by their length, level 2 those that share a length by a hash of their first
characters, level 3 those that share both by a hash of the whole text.  The first scan writes two numbers a
row, lengths and prefix hashes; levels 1 and 2 work on these alone.  What survives a level is marked in
bitmaps of a fixed number of bits, at most ``PREFIX_SLOTS / 8`` bytes, which go to every task: the second scan
hashes whole texts only where both marks are set.  Two keys may share a bit; that costs a hash more, and
level 3 tells the texts apart.  Texts are never shuffled, only hashes; copies are counted where they are
before anything is sent.

Defined results: texts are equal when identical after every run of white space became one space; null
counts as empty, and all empty texts are one group; the smallest id stays, an id of null only where a group
has no other; rows that repeat the id that stays are all marked as kept (``remove_copies`` keeps one of them);
an empty table gives no rows; other columns are carried (``keep``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PREFIX_CHARS = 64
#: Bits of the marks: one bitmap of 32,768 bits is a row of 4 KB, so these are 32 and 1024 rows at most.
LENGTH_SLOTS, PREFIX_SLOTS = 1 << 20, 1 << 25


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(key, F.lit(slots)) + 1


def marks(keys: DataFrame, key: Column, slots: int) -> DataFrame:
    """(bucket, bits): a bitmap that has the bit of every key, of at most slots / 32,768 rows."""
    slot = _slot(key, slots)
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def marked(rows: DataFrame, key: Column, of: DataFrame, slots: int, name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether the key's bit is set."""
    slot = _slot(key, slots)
    own = F.broadcast(of.select(F.col("bucket").alias("bucket_"), F.col("bits").alias("bits_")))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("bits_"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.join(own, F.bitmap_bucket_number(slot) == F.col("bucket_"), "left").withColumn(name, found).drop("bucket_", "bits_")


def _shape(text: Column) -> tuple[Column, Column]:
    return F.length(text).cast("long"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), length_slots: int = LENGTH_SLOTS, prefix_slots: int = PREFIX_SLOTS) -> DataFrame:
    """``id``, k0, k1 ... (the ``keep`` columns), keep_id, group_size, kept and full (hash of the text, null if no other can equal it) of every row."""
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"), *(F.col(c).alias(f"k{n}") for n, c in enumerate(keep)))
    n, p = _shape(F.col("t"))
    shapes = written(texts.select(n.alias("n"), p.alias("p")), "shapes")
    lengths = shapes.groupBy("n").count().where(F.col("count") > 1)
    length_marks = written(marks(lengths, F.col("n"), length_slots), "lengths")
    both = F.xxhash64("n", "p")
    prefixes = marked(shapes, F.col("n"), length_marks, length_slots, "shared").where("shared").groupBy("n", "p").count().where(F.col("count") > 1)
    prefix_marks = written(marks(prefixes, both, prefix_slots), "prefixes")

    rows = texts.withColumns({"n": n, "p": p})
    rows = marked(marked(rows, F.col("n"), length_marks, length_slots, "m1"), both, prefix_marks, prefix_slots, "m2")
    rows = rows.withColumn("full", F.when(F.col("m1") & F.col("m2"), F.sha2("t", 256))).drop("t", "n", "p", "m1", "m2")
    rows = written(rows, "hashed")
    found = rows.where(F.col("full").isNotNull())
    groups = written(found.groupBy("full").agg(F.min("id").alias("least"), F.count("*").alias("size")), "groups")
    own = found.join(groups.withColumnRenamed("full", "full_"), F.col("full") == F.col("full_"), "left").drop("full_")
    alone = rows.where(F.col("full").isNull()).withColumns({"least": F.col("id"), "size": F.lit(1).cast("long")})
    carried = [f"k{n}" for n in range(len(keep))]
    return own.unionByName(alone).select("id", *carried, F.col("least").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("least")).alias("kept"), "full")


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` without copies: of equal texts one row stays."""
    rows = exact_groups(docs, id_col, text_col, keep=tuple(docs.columns)).where("kept")
    alone = F.col("group_size") == 1
    rows = rows.where(alone).unionByName(rows.where(~alone).dropDuplicates(["full"]))
    return rows.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(docs.columns)))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(normalised(F.col("text")), 256).alias("sha"))
    rows = exact_groups(docs, keep=("sha",))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("k0").alias("text_sha256"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM texts JOIN groups USING (t)
"""
