"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  The corpus' vote patterns are
counted (with n labellers there are at most 3^n), and expectation-maximisation on those counts estimates
each labeller's accuracy and coverage by class and the share of good documents.  The posteriors label a
bounded sample of documents (one row of each picked id), on which a linear scorer over hashed words and word pairs is trained;
it scores every whole text.

No given label is used: the labels table serves only to measure.

Defined results: null and empty texts have no words, are voted bad and get the scorer's constant;
corpora whose votes are all alike get the constant posterior; repeated rows are scored each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batcher, one_of_each, rows_of, small_batches, table

#: Documents that the scorer is trained on, by lowest hash of id.
MAX_TRAIN = 12_000
#: Hashed weights.
BUCKETS = 1 << 16
WORDS_KEPT = 300_000


@dataclass
class Stats:
    """What the labellers look at, counted once for a text."""

    text_words: list[str] = field(repr=False)

    chars: int
    words: int
    distinct: int
    lines: int
    distinct_lines: int
    letters: int
    upper: int
    symbols: int
    digits: int
    ends: int
    mean_word: float


def stats_of(text: str) -> tuple[Stats, Counter]:
    """The statistics and the counts of the words."""
    words = text.split()
    counts = Counter(words)
    rows = text.split("\n")
    raw = text.encode()
    symbols, digits, spaces = (len(raw) - len(raw.translate(None, some)) for some in (_SYMBOLS, b"0123456789", b"\t\n\r "))
    upper = sum(n for w, n in counts.items() if w.isupper())
    ends = sum(r.rstrip().endswith((".", "!", "?", "…", '"')) for r in rows)
    n = len(text)
    return Stats(words, n, len(words), len(counts), len(rows), len(set(rows)), n - symbols - digits - spaces, upper, symbols, digits, ends, (n - spaces) / max(1, len(words))), counts


_SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

Labeller = Callable[[Stats], int]


def _vote(good: bool, bad: bool) -> int:
    return 1 if good else -1 if bad else 0


#: 1: good, -1: bad, 0: no vote.
LABELLERS: dict[str, Labeller] = {
    "length": lambda s: _vote(60 <= s.words <= 20_000, s.words < 15),
    "symbols": lambda s: _vote(s.symbols <= 0.05 * s.chars, s.symbols > 0.085 * s.chars),
    "digits": lambda s: _vote(s.digits <= 0.01 * s.chars, s.digits > 0.06 * s.chars),
    "capitals": lambda s: _vote(s.upper <= 0.05 * s.words, s.upper > 0.3 * s.words),
    "repeats": lambda s: _vote(s.words >= 30 and s.distinct >= 0.35 * s.words, s.words >= 30 and s.distinct < 0.2 * s.words),
    "line_repeats": lambda s: _vote(s.lines > 2 and s.distinct_lines == s.lines, s.distinct_lines < 0.7 * s.lines),
    "sentences": lambda s: _vote(s.ends >= 0.8 * s.lines, s.ends < 0.4 * s.lines),
    "word_length": lambda s: _vote(2.5 <= s.mean_word <= 8, s.mean_word > 11 or s.mean_word < 1.5),
}


def votes(text: str | None, labellers: dict[str, Labeller] = LABELLERS) -> tuple[int, ...]:
    return votes_of(stats_of(text or "")[0], labellers)


def votes_of(s: Stats, labellers: dict[str, Labeller] = LABELLERS) -> tuple[int, ...]:
    return tuple(f(s) for f in labellers.values())


# --- label model ------------------------------------------------------------------------------


@dataclass
class LabelModel:
    prior: float
    #: For each labeller and class (bad, good): the chances of the votes -1, 0, 1.
    table: np.ndarray
    rounds: int = 0

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance of good for each row of votes."""
        ll = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(patterns), 0)
        for k in range(patterns.shape[1]):
            ll += np.log(self.table[k][:, patterns[:, k] + 1].T)
        return 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """The chance that a labeller that votes is right."""
        weight = np.array([1 - self.prior, self.prior])
        right = self.table[:, 0, 0] * weight[0] + self.table[:, 1, 2] * weight[1]
        cast = (self.table[:, :, [0, 2]].sum(2) * weight).sum(1)
        return right / np.maximum(cast, 1e-12)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation from the majority vote."""
    n = patterns.shape[1]
    if not len(patterns):
        return LabelModel(0.5, np.full((n, 2, 3), 1 / 3))
    c = counts.astype(float)
    q = 1 / (1 + np.exp(-patterns.sum(1)))
    model = LabelModel(0.5, np.full((n, 2, 3), 1 / 3))
    for step in range(rounds):
        sides = np.stack([(1 - q) * c, q * c])
        chance = np.empty((n, 2, 3))
        for k in range(n):
            for v in range(3):
                chance[k, :, v] = sides[:, patterns[:, k] == v - 1].sum(1) + smooth
        chance /= chance.sum(2, keepdims=True)
        model = LabelModel(float(np.clip(sides[1].sum() / c.sum(), 1e-3, 1 - 1e-3)), chance, step + 1)
        fresh = model.posterior(patterns)
        if np.abs(fresh - q).max() < 1e-7:
            break
        q = fresh
    return model


# --- hashed scorer ----------------------------------------------------------------------------


class _Hashes(dict):
    """Word -> 63 bits of its hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode()) & 0x7FFFFFFFFFFFFFFF
        return h


_hashes = _Hashes()


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text: its words and its word pairs, each of length 1 together, and its shape."""
    return hashed_of(*stats_of(text or ""))


def hashed_of(s: Stats, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0)
    shape = (("len", min(12, s.words.bit_length())), ("sym", min(20, 100 * s.symbols // max(1, s.chars))), ("dig", min(20, 100 * s.digits // max(1, s.chars))), ("up", min(10, 10 * s.upper // s.words)), ("dis", min(10, 10 * s.distinct // s.words)), ("lin", min(10, 10 * s.distinct_lines // s.lines)), ("end", min(10, 10 * s.ends // s.lines)))
    words = np.fromiter(map(_hashes.__getitem__, s.text_words), np.uint64, s.words)
    parts = [_counted(words % BUCKETS)]
    if s.words > 1:
        pairs = words[:-1] * _PAIR + words[1:]
        parts.append(_counted((pairs * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)))
    own = np.array([_hashes[f"\n{a}{b}"] % BUCKETS for a, b in shape])
    return np.concatenate([*(w for w, _ in parts), own]), np.concatenate([*(v for _, v in parts), np.full(len(shape), 0.7)])


_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _counted(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets and the logarithms of their counts, of length 1 together."""
    where, n = np.unique(buckets.astype(np.uint16), return_counts=True)
    value = np.log1p(n)
    return where.astype(np.int64), value / np.sqrt(value @ value)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 6, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad, in the given order."""
    w, g, bias, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        for (where, value), y in zip(rows, target, strict=True):
            e = 1 / (1 + np.exp(-np.clip(w[where] @ value + bias, -30, 30))) - y
            d = e * value + decay * w[where]
            np.add.at(g, where, d * d)
            np.add.at(w, where, -rate * d / np.sqrt(g[where]))
            gb += e * e
            bias -= rate * e / np.sqrt(gb)
    return w, bias


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray = field(repr=False)
    bias: float = 0.0

    def score(self, text: str | None) -> float:
        return self.of_vector(*hashed(text))

    def of_vector(self, where: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[where] @ value + self.bias, -30, 30))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> QualityModel:
    """Votes of all documents make the label model; ``max_train`` texts make the scorer."""
    small_batches(docs.sparkSession)
    n = len(LABELLERS)

    def count(batches):
        found: Counter = Counter()
        for (text,) in rows_of(batches, "t"):
            found[votes(text)] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int32())), pa.array([found[k] for k in keys], pa.int64())], names=["v", "n"])

    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    counted = own.select("t").mapInArrow(count, "v array<int>, n long").groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").collect()  # at most 3^8 rows
    patterns = np.array([r["v"] for r in counted], np.int64).reshape(len(counted), n)
    labels = estimate(patterns, np.array([r["n"] for r in counted], np.int64))
    picked = own.select("k").where(F.col("k").isNotNull()).distinct().orderBy(F.xxhash64("k"), "k").limit(max_train)

    def vectors(batches):
        out = Batcher(pa.schema([("w", pa.binary()), ("x", pa.binary()), ("v", pa.list_(pa.int32()))]))
        for (text,) in rows_of(batches, "t"):
            s, counts = stats_of(text or "")
            where, value = hashed_of(s, counts)
            if out.add((where.astype("<i4").tobytes(), value.astype("<f4").tobytes(), list(votes_of(s))), 8 * len(where)):
                yield out.flush()
        yield out.flush()

    rows, seen = [], []
    for r in one_of_each(own.join(F.broadcast(picked), "k"), "k").select("t").mapInArrow(vectors, "w binary, x binary, v array<int>").toLocalIterator():
        rows.append((np.frombuffer(r["w"], "<i4").copy(), np.frombuffer(r["x"], "<f4").copy()))
        seen.append(r["v"])
    order = sorted(range(len(rows)), key=lambda k: xxhash.xxh3_64_intdigest(rows[k][0].tobytes()))
    target = labels.posterior(np.array(seen, np.int64).reshape(len(seen), n))
    weights, bias = train([rows[k] for k in order], target[order])
    return QualityModel(labels, weights.astype(np.float32), float(bias))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, votes, weak_label, score) of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches):
        m = shared.value
        for batch in batches:
            v, scores = [], []
            for (text,) in rows_of([batch], "t"):
                s, counts = stats_of(text or "")
                v.append(list(votes_of(s)))
                scores.append(m.of_vector(*hashed_of(s, counts)))
            weak = m.labels.posterior(np.array(v, np.int64).reshape(len(v), len(LABELLERS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.list_(pa.int32())), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], names=[id_col, "votes", "weak_label", "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs)).select("doc_id", "score", "weak_label", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join(F.transform("votes", lambda v: v.cast("string")), ",").alias("votes"))
