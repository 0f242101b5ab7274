"""Exact block dedup inside payloads: a later copy of a block becomes a reference to the first one.

The reference's sequential walk is one window: in a payload, ordered by walk position, the first block
of a hash is its origin.  A block is replaced if its origin is another message, its text has at least
two blocks, and the reference is shorter; system messages give origins but stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import once, stripped
from . import chunking

SYSTEM = "system prompt"


def _head(block: Column) -> Column:
    return F.substring(F.get(F.split(stripped(block), "\n", -1), F.lit(0)), 1, 80)


def reference(block: Column, label: Column | None) -> Column:
    return _reference(_head(block), label)


def _reference(first: Column, label: Column | None) -> Column:
    earlier = F.lit("earlier result") if label is None else F.concat(F.lit("earlier "), label, F.lit(" result"))
    return F.concat(F.lit('[... "'), first, F.lit('" — identical to '), earlier, F.lit(", see above ...]"))


def deduped_blocks(messages: DataFrame, payload: str, message: str, text: str, label: str | None = None, system: str | None = None, min_chars: int = chunking.MIN_CONTENT_CHARS, min_block_chars: int = chunking.MIN_BLOCK_CHARS, part: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a block: (payload, message, block_idx, n_blocks, chars, ref, block, eligible, replaced, matched_system, result).

    Heads and lengths are taken where a block is cut, so that who leaves ``block`` and ``result`` alone shuffles no texts.
    ``label`` names the tool in references; rows whose ``system`` column is true only give origins;
    ``part`` tells the texts of one message apart and comes behind ``message`` in the result,
    and the columns of ``carry`` behind these.
    """
    keep = [*(c for c in (payload, message, part, label, system) if c), *carry]
    places = [c for c in (message, part) if c]
    long_ones = messages.where(F.length(text) >= min_chars if system is None else (F.length(text) >= min_chars) | F.col(system))
    b = chunking.blocks(long_ones, text, *keep).withColumn("eligible", F.length(stripped(F.col("block"))) >= min_block_chars)
    # blocks too short to count have keys of their own: as one group they would be the largest of all
    alone = F.concat(F.lit("-"), F.xxhash64(*places, "block_idx").cast("string"))
    b = b.withColumn("hash", F.when(F.col("eligible"), chunking.block_hash(F.col("block"))).otherwise(alone))
    # fixed before the shuffle; references are made of heads behind it
    b = b.withColumns({"chars": F.length("block"), "head": F.when(F.col("eligible") & (F.col("n_blocks") >= 2), _head(F.col("block")))})
    here = Window.partitionBy(payload, "hash").orderBy(*places, "block_idx").rowsBetween(Window.unboundedPreceding, 0)
    origin = F.struct(F.col(message).alias("message"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), (F.col(system) if system else F.lit(False)).alias("system"))
    b = b.withColumn("origin", F.first(origin).over(here))
    origin_label = F.when(F.col("origin.system"), F.lit(SYSTEM)).otherwise(F.col("origin.label")) if label else None
    matched = F.col("eligible") & (F.col("origin.message") != F.col(message)) & (F.col("n_blocks") >= 2)
    if system:
        matched = matched & ~F.col(system)
    b = b.withColumn("matched", F.coalesce(matched, F.lit(False)))
    b = b.withColumn("ref", F.when(F.col("matched"), _reference(F.col("head"), origin_label)))
    b = b.withColumns({"matched_system": F.col("matched") & F.col("origin.system"), "replaced": F.col("matched") & F.coalesce(F.length("ref") < F.col("chars"), F.lit(False))})
    b = b.withColumn("result", F.when(F.col("replaced"), F.col("ref")).otherwise(F.col("block")))
    return b.select(payload, *places, *carry, "block_idx", "n_blocks", "chars", "ref", "block", "eligible", "replaced", "matched_system", "result")


def references(blocks: DataFrame, payload: str, *message: str) -> DataFrame:
    """(payload, *message, blocks_total, blocks_deduped, refs): ``refs`` (at, ref) are what replaces blocks, without a text."""
    refs = F.collect_list(F.when(F.col("replaced"), F.struct(F.col("block_idx").alias("at"), "ref")))
    return blocks.groupBy(payload, *message).agg(F.count_if("eligible").alias("blocks_total"), F.count_if("replaced").alias("blocks_deduped"), refs.alias("refs"))


def with_references(text: Column, refs: Column) -> Column:
    """A text, cut into its blocks once more, with the references of ``references`` in their places."""

    def replaced(lines: Column) -> Column:
        blocks = once(chunking.block_ends(lines), lambda ends: chunking.cut(lines, ends))
        told = F.transform(refs, lambda r: r["at"])
        return once(told, lambda ats: F.array_join(F.transform(blocks, lambda b, k: F.coalesce(F.get(refs, (F.array_position(ats, k) - 1).cast("int"))["ref"], b)), "\n"))

    return once(F.split(text, "\n", -1), replaced)


def deduped(blocks: DataFrame, payload: str, *message: str) -> DataFrame:
    """(payload, *message, blocks_total, blocks_deduped, system_blocks_matched, chars_saved, text)."""
    saved = F.sum(F.when(F.col("replaced"), F.length("block") - F.length("result")).otherwise(0))
    return blocks.groupBy(payload, *message).agg(
        F.count_if("eligible").alias("blocks_total"),
        F.count_if("replaced").alias("blocks_deduped"),
        F.count_if("matched_system").alias("system_blocks_matched"),
        saved.cast("long").alias("chars_saved"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "result"))), lambda x: x["result"]), "\n").alias("text"),
    )


def stats(blocks: DataFrame, payload: str) -> DataFrame:
    """(payload, counters): without the texts."""
    saved = F.sum(F.when(F.col("replaced"), F.col("chars") - F.length("ref")).otherwise(0))
    return blocks.groupBy(payload).agg(F.count_if("eligible").alias("blocks_total"), F.count_if("replaced").alias("blocks_deduped"), F.count_if("matched_system").alias("system_blocks_matched"), saved.cast("long").alias("chars_saved"))


#: Fields of a tool's JSON result that may hold its text, in this order.
TEXT_FIELDS = ("content", "output", "result", "text", "stdout")


def unwrapped(content: Column, min_chars: int = chunking.MIN_CONTENT_CHARS) -> Column:
    """(field, text) of a JSON result's first long text field; (null, content) otherwise."""
    parsed = F.from_json(content, ", ".join(f"{f} string" for f in TEXT_FIELDS))
    found = F.coalesce(*(F.when(F.length(parsed[f]) >= min_chars, F.struct(F.lit(f).alias("field"), parsed[f].alias("text"))) for f in TEXT_FIELDS))
    return F.coalesce(found, F.struct(F.lit(None).cast("string").alias("field"), content.alias("text")))


def fence_bodies(text: Column) -> Column:
    """The bodies of a text's fenced code blocks."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)\n```"), F.lit(1))


def deduped_fences(messages: DataFrame, payload: str, message: str, text: str, min_chars: int = chunking.MIN_CONTENT_CHARS) -> DataFrame:
    """(payload, message, fences, replaced, text): bodies of long code blocks that an earlier message had become references.

    A body counts with its outer white space stripped; all copies in a message are replaced alike.
    """
    own = messages.select(payload, message, F.col(text).alias("text"), fence_bodies(F.col(text)).alias("bodies"))
    long_ones = own.select(payload, message, F.explode(F.array_distinct("bodies")).alias("body")).where(F.length("body") >= min_chars)
    first = Window.partitionBy(payload, "hash").orderBy(message).rowsBetween(Window.unboundedPreceding, 0)
    seen = long_ones.withColumn("hash", F.sha2(stripped(F.col("body")), 256)).withColumn("origin", F.first(message).over(first))
    told = reference(F.col("body"), None)
    seen = seen.where((F.col("origin") != F.col(message)) & (F.length(told) < F.length("body"))).withColumn("told", told)
    gone = seen.groupBy(payload, message).agg(F.sort_array(F.collect_list(F.struct(F.length("body").alias("n"), "body", "told")), False).alias("gone"))
    made = own.join(gone, [payload, message], "left")
    # longer bodies first, so that a body inside another one is not cut out of it
    new = F.aggregate(F.coalesce("gone", F.array().cast(gone.schema["gone"].dataType)), F.col("text"), lambda t, g: F.replace(t, g["body"], g["told"]))
    n = F.coalesce(F.size("gone"), F.lit(0))
    return made.select(payload, message, F.size("bodies").alias("fences"), F.when(n > 0, n).otherwise(0).alias("replaced"), new.alias("text"))
