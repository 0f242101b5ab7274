"""Content-defined chunking: texts cut into blocks of lines where a line's hash says so.

A text of at most ``min_lines`` lines is one block.  Otherwise a block ends after a line whose hash is
0 modulo ``modulus`` once it has ``min_lines`` lines, or when it has ``max_lines``; a last block of fewer
than ``min_lines`` lines joins the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped

# Fixed values.
MODULUS, MIN_LINES, MAX_LINES = 13, 3, 40
MIN_BLOCK_CHARS, MIN_CONTENT_CHARS = 40, 200
HASH_DIGITS = 20


def without_number(line: Column) -> Column:
    """A line without the number that a listing puts before it."""
    return F.regexp_replace(line, r"^\s*\d+\|", "")


def _digest(line: Column) -> Column:
    return F.md5(stripped(without_number(line)))


def _number(h: Column) -> Column:
    return F.conv(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("long")


def line_number_hash(line: Column) -> Column:
    """The first four bytes of the stripped line's MD5, little-endian."""
    return _number(_digest(line))


def block_ends(lines: Column, modulus: int = MODULUS, min_lines: int = MIN_LINES, max_lines: int = MAX_LINES) -> Column:
    """The numbers of the lines (from 1) after which a block ends."""
    edges = F.transform(F.transform(lines, _digest), lambda h: _number(h) % modulus == 0)  # in two steps, so that a line is hashed once
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("ends"))

    def step(s: Column, edge: Column) -> Column:
        held, at = s["held"] + 1, s["at"] + 1
        cut = (edge & (held >= min_lines)) | (held >= max_lines)
        return F.struct(at.alias("at"), F.when(cut, 0).otherwise(held).alias("held"), F.when(cut, F.array_append(s["ends"], at)).otherwise(s["ends"]).alias("ends"))

    def finish(s: Column) -> Column:
        none, n = F.size(s["ends"]) == 0, s["at"]
        short = (s["held"] > 0) & (s["held"] < min_lines) & ~none
        with_rest = F.when(s["held"] == 0, s["ends"]).when(short, F.array_append(F.slice(s["ends"], 1, F.greatest(F.size(s["ends"]) - 1, F.lit(0))), n)).otherwise(F.array_append(s["ends"], n))
        return with_rest

    return F.when(F.size(lines) <= min_lines, F.array(F.size(lines))).otherwise(F.aggregate(edges, start, step, finish))


def cut(lines: Column, ends: Column) -> Column:
    """The blocks' texts."""
    return F.transform(ends, lambda e, k: F.array_join(F.slice(lines, F.when(k == 0, 1).otherwise(F.get(ends, k - 1) + 1), e - F.when(k == 0, 0).otherwise(F.get(ends, k - 1))), "\n"))


def block_hash(block: Column) -> Column:
    """Equal for blocks that differ in outer white space and line numbers only."""
    bare = F.array_join(F.transform(F.split(stripped(block), "\n", -1), without_number), "\n")
    return F.substring(F.sha2(bare, 256), 1, HASH_DIGITS)


def blocks(texts: DataFrame, text_col: str, *keep: str, **options: int) -> DataFrame:
    """(*keep, n_blocks, block_idx, block) of every block."""
    own = texts.select(*keep, F.split(text_col, "\n", -1).alias("lines"))
    own = own.withColumn("ends", block_ends(F.col("lines"), **options))
    return own.select(*keep, F.size("ends").alias("n_blocks"), F.posexplode(cut(F.col("lines"), F.col("ends"))).alias("block_idx", "block"))
