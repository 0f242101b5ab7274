"""Secret scan with a trigram inverted index, in DataFrame functions only.

A rule is a regular expression.  ``trigram_query`` derives from it which trigrams every match must
contain: an AND of ORs.  The index holds (trigram, text key) postings for the trigrams of all rules;
intersecting postings means counting, per key and rule, the clauses that have a posting.  Texts of
those keys are verified with the rule's expression; rules without mandatory trigrams are matched
against every text.  Keys are hashes of whole texts: a collision adds a text to verify, it loses none.

Spans come from the gaps between leftmost non-overlapping matches (``split``) and the matches
themselves (``regexp_extract_all``), in code points.

Defined results: a null text counts as empty and has no spans; repeated rows are reported each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # matched leftmost, non-overlapping; in the syntax that Java and Python share
    group: int = 0  # the part that min_length counts
    min_length: int = 0
    base: bool = False


# The base kinds, in the order in which spans of one start are listed, and more kinds behind.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
)

#: Clauses kept of a rule's query: those of the fewest trigrams, which are the cheapest and rarest.
CLAUSES = 3
#: Alternatives of exact strings that one expression may stand for before the analysis gives them up.
MOST = 32


# --- trigram queries --------------------------------------------------------------------------


@dataclass
class _Info:
    """What is known of an expression's matches: all of them (or None), their possible starts and ends, and the query."""

    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: frozenset[frozenset[str]]  # AND of ORs


def _clauses(strings: frozenset[str]) -> frozenset[frozenset[str]]:
    """The clause that any of the strings is contained, as trigrams: one clause for each choice that all strings share a place for."""
    if not strings or min(map(len, strings)) < 3:
        return frozenset()
    n = max(len(s) for s in strings) - 2
    # the k-th trigram of each string (the last one where a string is shorter): every match has one of each clause
    return frozenset(frozenset(s[min(k, len(s) - 3) :][:3] for s in strings) for k in range(n))


def _edge(strings, keep: int, end: bool) -> frozenset[str]:
    cut = frozenset((s[-keep:] if end else s[:keep]) if keep else "" for s in strings)
    return cut if len(cut) <= MOST else _edge(cut, keep - 1, end)


def _known(strings: frozenset[str]) -> _Info:
    if len(strings) <= MOST:
        return _Info(strings, strings, strings, frozenset())
    return _Info(None, _edge(strings, 2, False), _edge(strings, 2, True), _clauses(strings))


_ANY = _Info(None, frozenset([""]), frozenset([""]), frozenset())


def _joined(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _known(frozenset(x + y for x in a.exact for y in b.exact))
    query = a.query | b.query
    if a.exact is not None:
        query |= _clauses(a.exact)
    if b.exact is not None:
        query |= _clauses(b.exact)
    if len(a.suffix) * len(b.prefix) <= MOST * MOST:
        seam = frozenset(x[-2:] + y[:2] for x in a.suffix for y in b.prefix)
        if len(seam) <= MOST:
            query |= _clauses(seam)
    prefix = frozenset(x + y for x in a.exact for y in b.prefix) if a.exact is not None and len(a.exact) * len(b.prefix) <= MOST else a.prefix
    suffix = frozenset(x + y for x in a.suffix for y in b.exact) if b.exact is not None and len(b.exact) * len(a.suffix) <= MOST else b.suffix
    return _Info(None, prefix, suffix, query)


def _either(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST:
        return _known(a.exact | b.exact)
    left = a.query | (_clauses(a.exact) if a.exact is not None else frozenset())
    right = b.query | (_clauses(b.exact) if b.exact is not None else frozenset())
    both = frozenset(x | y for x, y in itertools.product(left, right)) if left and right else frozenset()
    return _Info(None, _edge(a.prefix | b.prefix, 3, False), _edge(a.suffix | b.suffix, 3, True), both)


def _of(parsed, fold: bool) -> _Info:
    info = _known(frozenset([""]))
    for op, value in parsed:
        info = _joined(info, _one(op, value, fold))
    return info


def _one(op, value, fold: bool) -> _Info:
    if op is C.LITERAL:
        c = chr(value)
        return _known(frozenset([c.lower() if fold else c]))
    if op is C.IN:
        chars: set[str] = set()
        for kind, v in value:
            if kind is C.LITERAL:
                chars.add(chr(v))
            elif kind is C.RANGE and v[1] - v[0] < 128:
                chars.update(map(chr, range(v[0], v[1] + 1)))
            else:
                return _ANY
        chars = {c.lower() for c in chars} if fold else chars
        return _known(frozenset(chars)) if len(chars) <= MOST else _ANY
    if op is C.SUBPATTERN:
        return _of(value[3], fold)
    if op is C.BRANCH:
        info = _of(value[1][0], fold)
        for branch in value[1][1:]:
            info = _either(info, _of(branch, fold))
        return info
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = value
        body = _of(inner, fold)
        if least == 0:
            if most == 1 and body.exact is not None:
                return _known(body.exact | {""})
            return _ANY
        info = body
        for _ in range(min(least, 4) - 1):
            info = _joined(info, body)
        if least == most and least <= 4:
            return info
        return _Info(None, info.prefix, info.suffix, info.query | (_clauses(info.exact) if info.exact is not None else frozenset()))
    return _ANY


def trigram_query(pattern: str, fold: bool = True) -> list[list[str]]:
    """The AND of ORs of trigrams that every match contains (``fold``: in the lower-cased text); empty: scan fully."""
    info = _of(parser.parse(pattern), fold)
    query = info.query | (_clauses(info.exact) if info.exact is not None else frozenset())
    kept = [c for c in query if not any(d < c for d in query)]
    return sorted(sorted(c) for c in kept)


# --- index ------------------------------------------------------------------------------------


def queries_of(rules: tuple[Rule, ...], clauses: int = CLAUSES) -> dict[str, list[list[str]]]:
    """Each rule's query, of its smallest clauses; fewer clauses let more texts through to be verified, never fewer."""
    return {r.kind: sorted(trigram_query(r.pattern), key=lambda c: (len(c), c))[:clauses] for r in rules}


def postings(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """(trigram, key): the inverted index of the lower-cased texts, for the named trigrams.

    Two texts of one key share their postings; a trigram's list is never gathered in one row or task.
    """
    low = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), F.lower(F.col(text_col)).alias("low"))  # once for all trigrams
    found = F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams)) if trigrams else F.array().cast("array<string>")
    return low.select("key", found.alias("found")).select("key", F.explode(F.array_compact("found")).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(key, kinds): the keys whose postings meet every clause of a kind's query."""
    clause_of: dict[str, list[int]] = {}
    masks: dict[str, int] = {}
    n = 0
    for kind, clauses in queries.items():
        for clause in clauses:
            for t in clause:
                clause_of.setdefault(t, []).append(n)
            masks[kind] = masks.get(kind, 0) | 1 << n
            n += 1
    if n > 63:
        raise ValueError("more than 63 clauses: split the rules")
    bits = {t: sum(1 << k for k in ks) for t, ks in clause_of.items()}
    bit = F.create_map(*itertools.chain.from_iterable((F.lit(t), F.lit(b).cast("long")) for t, b in bits.items())) if bits else F.lit(None).cast("map<string,bigint>")
    met = index.groupBy("key").agg(F.bit_or(bit[F.col("trigram")]).alias("met"))
    kinds = F.array_compact(F.array(*(F.when(F.col("met").bitwiseAND(F.lit(m)) == m, F.lit(k)) for k, m in masks.items()))) if masks else F.array().cast("array<string>")
    return met.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


# --- verification -----------------------------------------------------------------------------

_SPAN = "array<struct<start:bigint,rank:int,span_end:bigint,base:boolean,kind:string>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in a text: matches that are long enough, with their places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), counted.alias("c"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(s, p):
        begin = s["at"] + F.length(p["g"])
        end = begin + F.length(p["m"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("span_end"), F.lit(rule.base).alias("base"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(p["c"]) >= rule.min_length, F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans): array of (start, rank, span_end, base, kind) by start, then by the rules' order."""
    queries = queries_of(rules)
    indexed = {k: q for k, q in queries.items() if q}
    rows = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = candidates(postings(rows, sorted({t for q in indexed.values() for c in q for t in c}), "t"), indexed)
    joined = rows.withColumn("key", F.xxhash64("t")).join(found, "key", "left")
    none = F.array().cast(_SPAN)
    each = [F.when((F.array_contains("kinds", r.kind) if r.kind in indexed else F.lit(True)) & F.col("t").rlike(r.pattern), _spans(F.col("t"), r, n)).otherwise(none) for n, r in enumerate(rules)]
    each = [F.coalesce(e, none) for e in each]
    return joined.select(F.col("k").alias(id_col), F.array_sort(F.concat(*each)).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts and digests of the base kinds, and all spans."""
    found = scan(table(spark, sf_dir, "documents"))
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["span_end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", shown), ",").alias("spans"))


def oracle() -> str:
    """DuckDB SQL: matches and the gaps between them give the places."""
    parts = []
    for n, r in enumerate(RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        counted = f"regexp_extract_all(t, {pattern}, {r.group})"
        parts.append(
            f"""SELECT doc_id, '{r.kind}' AS kind, {n} AS rank, {str(r.base).upper()} AS base, unnest(list_transform(range(1, len(m) + 1), lambda k:
  {{'s': list_sum(list_transform(g[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0), 'n': length(m[k]), 'c': length(c[k])}})) AS p
  FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, {counted} AS c, string_split_regex(t, {pattern}) AS g FROM d)"""
        )
    least = " ".join(f"WHEN {n} THEN {r.min_length}" for n, r in enumerate(RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, kind, rank, base, p.s::BIGINT AS b, kind || ':' || p.s::BIGINT || ':' || (p.s + p.n)::BIGINT AS shown FROM p WHERE p.c >= CASE rank {least} END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
sha256(coalesce(string_agg(shown, ',' ORDER BY b, rank) FILTER (base), '')) AS base_sha256, coalesce(string_agg(shown, ',' ORDER BY b, rank), '') AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""
