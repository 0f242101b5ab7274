"""Sequence packing as a cutting-stock problem solved by column generation.

1. Every document is tokenised whole; its ids and the end id are cut at multiples of the capacity,
   so all pieces but a document's last one fill a sequence alone.
2. The pieces' lengths, rounded up to a unit, form a histogram of at most ``capacity / unit`` classes;
   this histogram (never the documents) is what the driver sees.
3. A linear program over patterns (how many pieces of each class share a sequence) is solved by column
   generation: a knapsack dynamic program prices new patterns with the simplex multipliers.
4. Patterns are rounded down; what remains of the histogram is packed first-fit decreasing.
5. Pieces are ranked inside their class by a sharded count, and the rank of a piece names its
   sequence.  Offsets are running sums of true lengths inside a sequence.

Defined results: null and empty texts are the end id alone; repeated rows are packed each for itself;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import rows_of, small_batches, table, written

CAPACITY = 4096
UNIT = 16
EOS = 2
#: Pieces ranked by one task.
SHARD_ROWS = 10_000
#: Encoded words kept by a task; beyond, the store is emptied. A speed setting: results are the same.
WORDS_KEPT = 300_000


# --- tokens -----------------------------------------------------------------------------------


#: Letters that lower-case one by one and are composed already, with ASCII punctuation (no apostrophe) behind.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Whole-text ids from ids of space-separated words.

    The vocabulary's pre-tokenizer drops white space and no token crosses it, so a text's ids are
    those of its words in a row; words repeat, and each is encoded once.  A simple word is letters
    and punctuation behind, which the pre-tokenizer parts and which are in any case looked up in
    lower case; new ones are encoded together and told apart by the ids that end a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.encode_batch = own.encode_batch_fast
        self.ends = np.zeros(own.get_vocab_size(with_added_tokens=True), bool)
        for token, k in own.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def forget(self) -> None:
        """Empties the stores at a task's end, as workers are used again."""
        self.words, self.parts = {"": b""}, {"": b""}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        parts, words = self.parts, self.words
        simple = [(w, m[1].lower(), m[2]) for w in new if (m := _SIMPLE.fullmatch(w))]
        fresh = list(dict.fromkeys(p for _, core, tail in simple for p in (core, tail) if p not in parts))
        if fresh:
            ids = self._ids([" ".join(fresh)])[0]
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(fresh) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for p, end in zip(fresh, (4 * cut).tolist(), strict=True):
                    parts[p] = raw[at:end]
                    at = end
            else:  # a vocabulary without word ends
                parts.update(zip(fresh, (i.tobytes() for i in self._ids(fresh)), strict=True))
        for w, core, tail in simple:
            words[w] = parts[core] + parts[tail]
        rest = [w for w in new if w not in words]
        words.update(zip(rest, (i.tobytes() for i in self._ids(rest)), strict=True))

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        words = text.replace("\n", " ").split(" ")
        known = self.words
        new = set(words).difference(known)
        if new:
            if len(known) > WORDS_KEPT:
                known.clear()
                known[""] = b""
                new = set(words) - {""}
            if len(self.parts) > WORDS_KEPT:
                self.parts = {"": b""}
            self._learn(sorted(new))
        return b"".join(map(known.__getitem__, words))


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens) of every piece."""
    small_batches(docs.sparkSession)
    end = int(eos).to_bytes(4, "little")
    names = (id_col, "start", "length", "ids_crc32", "doc_tokens")

    def run(batches):
        encode = encoder(tokenizer_path)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, text in rows_of([batch], "k", "t"):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, v in zip(out, (key, start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in out[1:])], names=list(names))
        encode.forget()

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in names[1:])])
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


# --- the cutting-stock plan -------------------------------------------------------------------


def best_pattern(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of largest value; values[w] is the value of a piece of w units."""
    best, taken = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    v = np.maximum(values, 0)
    for c in range(1, room + 1):
        got = v[1 : c + 1] + best[c - 1 :: -1]
        k = int(np.argmax(got))
        best[c], taken[c] = got[k], k + 1
    pattern, c = np.zeros(room + 1, np.int64), room
    while c > 0:
        if v[taken[c]] > 0:
            pattern[taken[c]] += 1
        c -= taken[c]
    return float(best[room]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination, a few hundred rows at most.

    Not by LAPACK: its threads stood still in drivers that share their cores with local executors.
    """
    m = len(matrix)
    a = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, pivot]] = a[[pivot, k]]
        a[k] /= a[k, k]
        times = a[:, k].copy()
        times[k] = 0
        a -= times[:, None] * a[k]
    return a[:, m:].copy()


def column_generation(demand: np.ndarray, room: int, gap: float = 2e-4, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of the linear relaxation; demand[w] is the number of pieces of w units."""
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    d, m = demand[sizes].astype(float), len(sizes)
    basis = np.zeros((m, m))
    np.fill_diagonal(basis, room // sizes)
    cost, inverse = np.ones(m), np.diag(1.0 / (room // sizes))
    x = inverse @ d
    for step in range(rounds):
        if step % 100 == 99:
            inverse = inverted(basis)
            x = np.maximum(inverse @ d, 0)
        y = cost @ inverse
        low = int(np.argmin(y))
        if y[low] < -1e-9:  # fewer of that size would be cheaper: a surplus column
            column, price = np.zeros(m), 0.0
            column[low] = -1.0
        else:
            values = np.zeros(room + 1)
            values[sizes] = y
            worth, pattern = best_pattern(values, room)
            total = float(cost @ x)
            if worth <= 1 + 1e-9 or total - (y @ d) / worth <= gap * total:  # Farley's bound
                break
            column, price = pattern[sizes].astype(float), 1.0
        u = inverse @ column
        able = u > 1e-9
        ratio = np.where(able, x / np.where(able, u, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        move = ratio[out]
        x = np.maximum(x - move * u, 0)
        x[out] = move
        row = inverse[out] / u[out]
        inverse = inverse - np.outer(u, row)
        inverse[out] = row
        basis[:, out], cost[out] = column, price
    found = []
    for k in range(m):
        if cost[k] and x[k] > 1e-9:
            pattern = np.zeros(room + 1, np.int64)
            pattern[sizes] = np.round(basis[:, k]).astype(np.int64)
            found.append((pattern, float(x[k])))
    return found


def first_fit(demand: np.ndarray, room: int) -> list[np.ndarray]:
    """First-fit decreasing on a small histogram: one pattern for each sequence."""
    open_, space = [], np.zeros(0, np.int64)
    for w in range(room, 0, -1):
        for _ in range(int(demand[w])):
            fits = np.flatnonzero(space >= w)
            if len(fits):
                k = int(fits[0])
            else:
                k, space = len(open_), np.append(space, room)
                open_.append(np.zeros(room + 1, np.int64))
            open_[k][w] += 1
            space[k] -= w
    return open_


def plan(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns and how often each is used; together they hold every piece."""
    rest, used = demand.astype(np.int64).copy(), []
    full = int(rest[room])
    rest[room] = 0
    if full:
        alone = np.zeros(room + 1, np.int64)
        alone[room] = 1
        used.append((alone, full))
    for pattern, times in column_generation(rest, room):
        n = int(times + 1e-6)
        if n:
            used.append((pattern, n))
            rest -= n * pattern
    seen: dict[bytes, list] = {}
    for pattern in first_fit(np.maximum(rest, 0), room):
        seen.setdefault(pattern.tobytes(), [pattern, 0])[1] += 1
    return used + [(p, n) for p, n in seen.values()]


def slots(used: Iterable[tuple[np.ndarray, int]], demand: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: the first rank of each of its runs, the run's first sequence, pieces a sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    given, base = np.zeros(len(demand), np.int64), 0
    for pattern, n in used:
        for w in np.flatnonzero(pattern):
            out.setdefault(int(w), []).append((int(given[w]), base, int(pattern[w])))
            given[w] += n * pattern[w]
        base += n
    assert (given >= demand).all()
    return {w: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for w, runs in out.items()}


# --- the operator -----------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, unit: int = UNIT, eos: int = EOS) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    if capacity % unit:
        raise ValueError("capacity must be a multiple of unit")
    room = capacity // unit
    made = written(pieces(docs, tokenizer_path, id_col, text_col, capacity, eos).withColumn("class", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    demand = np.zeros(room + 1, np.int64)
    for row in made.groupBy("class").count().collect():  # at most capacity / unit rows
        demand[row["class"]] = row["count"]
    where = slots(plan(demand, room), demand)
    shards = int(max(1, -(-demand.sum() // SHARD_ROWS)))
    made = made.withColumn("shard", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(shards)))
    before = made.groupBy("class", "shard").count().select(F.col("class").alias("c"), F.col("shard").alias("s"), (F.sum("count").over(Window.partitionBy("class").orderBy("shard")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("class", "shard").orderBy("length", id_col, "start", "ids_crc32")) - 1
    ranked = made.withColumn("inside", inside).join(before, (F.col("class") == F.col("c")) & (F.col("shard") == F.col("s")))
    ranked = ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("inside") + F.col("before")).alias("rank"))

    def run(batches):
        for batch in batches:
            classes = batch.column(5).to_numpy(zero_copy_only=False)
            ranks = batch.column(6).to_numpy(zero_copy_only=False)
            sequence = np.zeros(len(ranks), np.int64)
            for w in np.unique(classes):
                at = np.flatnonzero(classes == w)
                first, base, each = where[int(w)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                sequence[at] = base[k] + (ranks[at] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence)], names=[*batch.schema.names[:5], "sequence_id"])

    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType())])
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), id_col, "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.mapInArrow(run, schema).withColumn("offset", F.sum("length").over(order) - F.col("length"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of at most 4096 ids."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
