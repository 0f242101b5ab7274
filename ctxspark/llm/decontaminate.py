"""Benchmark decontamination with training suffix arrays.

Each shard of documents gets a suffix array over its words; every suffix of every benchmark item is
binary-searched in it.  The neighbours of its place give the longest verbatim match and where it is;
the range of its first ten words gives all places of that window.  Words that no item has end every
match, so only runs of item words long enough for a window enter the array: nothing is lost by that.

The benchmark is searched in blocks of bounded size, so it may be of any size; documents are read
once and never shuffled.

Defined results: a null text has no words; items without words are never found; repeated rows are
reported each for itself; a null item id is listed as "null"; items that share an id count as one;
other columns are ignored (reports) or kept as they are (``remove_contaminated``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, small_batches, table

WINDOW = 10
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 1 << 20
#: Bytes of document text in a shard.
SHARD_BYTES = 4 << 20

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and all beyond ASCII."""
    return raw.translate(_TABLE).split()


@dataclass
class Block:
    """Part of the benchmark: its words as numbers from 1, and all suffixes that begin a window."""

    vocabulary: dict[bytes, int]
    items: list[str]
    words: np.ndarray  # all items' words, 0 after each item
    begins: np.ndarray  # where each suffix begins in words
    item: np.ndarray  # the suffix's item
    width: np.ndarray  # words of its window
    length: np.ndarray  # words of the suffix

    @property
    def shortest(self) -> int:
        return int(self.width.min())

    @property
    def longest(self) -> int:
        return int(self.length.max())


def block_of(rows: list[tuple], window: int = WINDOW) -> Block | None:
    vocabulary: dict[bytes, int] = {}
    items: dict[str, int] = {}
    words: list[int] = []
    begins, item, width, length = [], [], [], []
    for key, raw in rows:
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(raw or b"")]
        if not own:
            continue
        number = items.setdefault("null" if key is None else str(key), len(items))
        k = min(window, len(own))
        for j in range(len(own) - k + 1):
            begins.append(len(words) + j)
            item.append(number)
            width.append(k)
            length.append(len(own) - j)
        words += [*own, 0]
    if not begins:
        return None
    return Block(vocabulary, list(items), np.array(words + [0] * 8, np.int32), *(np.array(x, np.int64) for x in (begins, item, width, length)))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` ordered by at least their first ``depth`` words (prefix doubling)."""
    n = len(text)
    rank, k = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + int(text.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        at = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], at[1:] != at[:-1]]))
        rank, k = fresh, 2 * k
        if rank[order[-1]] == n - 1:
            break
    return order


def _compare(text: np.ndarray, at: np.ndarray, words: np.ndarray, begins: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of a text suffix and a test suffix: the common words (up to limit) and the order (-1, 0, 1)."""
    common, order = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
    live = np.flatnonzero(limit > 0)
    while len(live):
        a, b = text[at[live] + common[live]], words[begins[live] + common[live]]
        same = a == b
        order[live[~same]] = np.where(a[~same] < b[~same], -1, 1)
        live = live[same]
        common[live] += 1
        live = live[common[live] < limit[live]]
    return common, order


def search(text: np.ndarray, order: np.ndarray, words: np.ndarray, begins: np.ndarray, limit: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: the first place not before (or after) their first ``limit`` words."""
    low, high = np.zeros(len(begins), np.int64), np.full(len(begins), len(order), np.int64)
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) >> 1
        _, sign = _compare(text, order[mid], words, begins[live], limit[live])
        right = sign <= 0 if after else sign < 0
        low[live[right]] = mid[right] + 1
        high[live[~right]] = mid[~right]
    return low


@dataclass
class Report:
    n_words: int
    hit: np.ndarray | None = None  # hit words' places, ascending
    items: tuple[str, ...] = ()
    longest: tuple[tuple[str, int, int, int], ...] = ()  # item, place in the item, place in the document, words


def scan(texts: list[bytes], block: Block) -> list[Report]:
    """What of the block's items is in each text of a shard."""
    get = block.vocabulary.get
    reports, parts, doc_of, place_of = [], [], [], []
    need = block.shortest
    for n, raw in enumerate(texts):
        own = words_of(raw)
        reports.append(Report(len(own)))
        if len(own) < need:
            continue
        ids = np.fromiter((get(w, 0) for w in own), np.int32, len(own))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
        for a, b in edges.reshape(-1, 2):
            if b - a >= need:
                parts += [ids[a:b], np.zeros(1, np.int32)]
                doc_of += [np.full(b - a + 1, n)]
                place_of += [np.arange(a, b + 1)]
    if not parts:
        return reports
    text = np.concatenate([*parts, np.zeros(block.longest + 1, np.int32)])
    docs, places = np.concatenate(doc_of), np.concatenate(place_of)
    order = suffix_array(text, block.longest)
    known = np.zeros(len(block.vocabulary) + 1, bool)
    known[text] = True
    tests = np.flatnonzero(known[block.words[block.begins]])
    begins, width, length, item = block.begins[tests], block.width[tests], block.length[tests], block.item[tests]
    low = search(text, order, block.words, begins, width, after=False)
    high = search(text, order, block.words, begins, width, after=True)
    found = np.flatnonzero(high > low)
    if not len(found):
        return reports
    n = high[found] - low[found]
    which = np.repeat(found, n)
    at = order[np.repeat(low[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    marks = np.zeros(len(text) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width[which], -1)
    hit = np.flatnonzero(np.cumsum(marks)[: len(docs)] > 0)
    for d, part in _by(docs[hit], places[hit]):
        reports[d].hit = part
    pairs = np.unique(docs[at] * len(block.items) + item[which])
    for d, part in _by(pairs // len(block.items), pairs % len(block.items)):
        reports[d].items = tuple(block.items[k] for k in part)
    # the longest match of each item in each document: extend every found window to the right
    longest, _ = _compare(text, at, block.words, begins[which], length[which])
    rank = np.lexsort((places[at], -longest, item[which], docs[at]))
    key = docs[at[rank]] * len(block.items) + item[which[rank]]
    rank = rank[np.concatenate([[True], key[1:] != key[:-1]])]
    starts = np.concatenate([[0], np.flatnonzero(block.words[:-8] == 0) + 1])
    for k in rank:
        t = which[k]
        inside = begins[t] - starts[np.searchsorted(starts, begins[t], side="right") - 1]
        report = reports[docs[at[k]]]
        report.longest += ((block.items[item[t]], int(inside), int(places[at[k]]), int(longest[k])),)
    return reports


def _by(keys: np.ndarray, values: np.ndarray):
    """(key, values) of sorted keys."""
    if len(keys):
        cut = np.flatnonzero(np.diff(keys)) + 1
        for part, v in zip(np.split(keys, cut), np.split(values, cut), strict=True):
            yield int(part[0]), v


def merged(a: Report, b: Report) -> Report:
    hit = b.hit if a.hit is None else a.hit if b.hit is None else np.union1d(a.hit, b.hit)
    best: dict[str, tuple] = {}
    for m in (*a.longest, *b.longest):
        if m[0] not in best or m[3] > best[m[0]][3]:
            best[m[0]] = m
    return Report(a.n_words, hit, tuple(dict.fromkeys((*a.items, *b.items))), tuple(best.values()))


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int) -> list:
    """The benchmark as broadcast blocks; a block holds about BLOCK_BYTES, the driver one block at a time."""
    spark = bench.sparkSession
    rows = bench.select(F.col(id_col).alias("k"), F.encode(F.col(text_col), "UTF-8").alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // BLOCK_BYTES))
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        block = block_of([(r["k"], bytes(r["t"]) if r["t"] is not None else None) for r in part.collect()], window)
        if block is not None:
            out.append(spark.sparkContext.broadcast(block))
    return out


def _scan_all(texts: list[bytes], blocks: list) -> list[Report]:
    reports: list[Report] | None = None
    for b in blocks:
        found = scan(texts, b.value)
        reports = found if reports is None else [merged(x, y) for x, y in zip(reports, found, strict=True)]
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)  # one block in memory at a time
    return [Report(len(words_of(t))) for t in texts] if reports is None else reports


_SPAN = "array<struct<start:bigint,end:bigint>>"
_LONGEST = "array<struct<item_id:string,item_start:bigint,doc_start:bigint,n_words:bigint>>"


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, spans, items, longest): hit words, their spans, and each item's longest verbatim match."""
    small_batches(docs.sparkSession)
    blocks = _blocks(bench, item_col, item_text_col, window)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    longest = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())]))

    def made(kind, keys, texts):
        reports, spans = _scan_all(texts, blocks), []
        for r in reports:
            hit = np.zeros(0, np.int64) if r.hit is None else r.hit
            cut = np.flatnonzero(np.diff(hit) > 1) + 1
            spans.append([{"start": int(p[0]), "end": int(p[-1]) + 1} for p in np.split(hit, cut) if len(p)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, kind), pa.array([r.n_words for r in reports], pa.int64()), pa.array([0 if r.hit is None else len(r.hit) for r in reports], pa.int64()), pa.array(spans, span), pa.array([list(r.items) for r in reports], pa.list_(pa.string())),
                pa.array([[dict(zip(("item_id", "item_start", "doc_start", "n_words"), m, strict=True)) for m in r.longest] for r in reports], longest),
            ],
            names=[id_col, "n_words", "n_hit", "spans", "items", "longest"],
        )

    def run(batches):
        keys, texts, size, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, raw in rows_of([batch], "k", "t"):
                keys.append(key)
                texts.append(raw or b"")
                size += len(raw or b"")
                if size >= SHARD_BYTES:
                    yield made(kind, keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield made(kind, keys, texts)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T._parse_datatype_string(_SPAN)), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T._parse_datatype_string(_LONGEST))])
    return docs.select(F.col(id_col).alias("k"), F.encode(F.col(text_col), "UTF-8").alias("t")).mapInArrow(run, schema)


def remove_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no window of any item occurs."""
    small_batches(docs.sparkSession)
    blocks = _blocks(bench, item_col, item_text_col, window)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([r.hit is None for r in _scan_all(texts, blocks)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in each whole document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[j : j + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM i)),
ks AS (SELECT DISTINCT k FROM iw),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks),
hits AS (SELECT doc_id, p, k, item_id FROM (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS win FROM dp) JOIN iw USING (k, win)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
