"""Scalar text functions as column expressions: all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation that answers are compared without.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is evaluated one time, however often ``made`` names it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space at both ends (ASCII white space, as regular expressions know it)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def est_tokens(chars: Column) -> Column:
    """Whole tokens at four characters each."""
    return F.floor(chars / 4).cast("long")


def sha_hex(text: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def salted_hash(text: Column, salt: str) -> Column:
    """16 hex digits that identify a text without showing it."""
    return sha_hex(F.concat(F.lit(f"{salt}:"), text), 16)


def salt_fingerprint(salt: str) -> Column:
    return sha_hex(F.lit(f"fingerprint:{salt}"), 12)


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """The words of a normalised text; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


#: How the ids of engines' own probes begin.
HEALTH_CHECK = "HEALTH_CHECK"


def normalize_request_id(request_id: Column) -> Column:
    """Without an engine's prefix, and without the suffix that an engine adds to its own ids."""
    bare = F.regexp_replace(request_id, r"^(cmpl-|chatcmpl-|batch-)", "")
    return F.regexp_replace(bare, r"^(req-[^-]+)-\d+-[0-9a-f]+$", "$1")


def is_tracked(request_id: Column) -> Column:
    return (F.length(request_id) > 0) & ~request_id.startswith(HEALTH_CHECK) & request_id.startswith("req-")


def without_random_ids(text: Column) -> Column:
    """Without the random ids of markers around external content, whose quotes may be escaped."""
    marker = r'<<<((?:END_)?)EXTERNAL_UNTRUSTED_CONTENT\s+id=\\?"[0-9a-f]+\\?">>>'
    return F.regexp_replace(text, marker, "<<<$1EXTERNAL_UNTRUSTED_CONTENT>>>")


def doc_preview(text: Column, chars: int = 60) -> Column:
    """The first characters on one line."""
    line = stripped(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > chars, F.concat(F.substring(line, 1, chars), F.lit("..."))).otherwise(line)


def without_thinking(text: Column) -> Column:
    """Without a leading block of reasoning."""
    return F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>\s*", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def blocks_of(text: Column, min_chars: int = 40) -> Column:
    """Distinct stripped lines of at least so many characters."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\r\n|\n|\r", -1), stripped), lambda b: F.length(b) >= min_chars))


def joined(items: Column, by: str = ",") -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), by)
