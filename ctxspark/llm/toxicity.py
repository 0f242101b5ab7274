"""Toxicity by compression distance.

Two zstandard dictionaries are built, one from ordinary and one from toxic labelled texts.  A window
is one word, spelled as all its prefixes and suffixes, so that a word a dictionary holds is one long
match and words of the same stem share part of it.  A word is a run of letters and digits; of runs of
more than ``LONGEST`` characters (as in texts without spaces) every window of that length is taken that
begins at a multiple of half of it, and the last one.  A window's distance is its compressed length with
the ordinary dictionary less that with the toxic one, over the square root of its length; windows
beyond the calibrated threshold speak for label 1.  A text's score is a logistic function of how many
such windows it has, their share, and the mean of the largest distances.

The dictionaries hold raw content chosen here, words by how many labelled texts have them, until their
size is reached; a word of a single labelled text is in neither.  Dictionaries that zstandard's own trainer picks leave out most of the words that
matter; see README.

The fit uses a bounded sample of the labelled rows (``max_train``, by lowest hash of the id).  Of either
label's rows, in the order of another hash, the first and every fourth after it set the threshold and
the weights, the others make the dictionaries.  All of this is the same at every size.

Defined results: null and empty texts have no window and get the score of a text without any; no
labels at all, or labels of one class only, give every text the share of label 1 (0.5 without labels);
labels that are null are left out, of several labels of one document the highest counts; repeated rows
are scored each for itself; other columns are ignored or kept.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one_of_each, rows_of, small_batches, table, written

#: Labelled rows that the fit may use.
MAX_TRAIN = 16_000
#: Bytes of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 1_000_000, 65_536
#: A toxic word costs this many bytes more with the ordinary dictionary than a known word does.
KNOWN_COST, HARD = 18, 6
#: Words whose distances a task keeps. A speed setting: results are the same.
WORDS_KEPT = 400_000
THRESHOLD = 0.7
FEATURES = 5

#: Characters of a window, at most.
LONGEST = 24
#: Bytes of the shortest word as it is spelled: a dictionary of n bytes holds at most n / SHORTEST words.
SHORTEST = 5

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [part for w in found for part in ([w] if len(w) <= LONGEST else _parts(w))]


def _parts(run: str) -> list[str]:
    last = len(run) - LONGEST
    return [run[k : k + LONGEST] for k in (*range(0, last, LONGEST // 2), last)]


def spelled(word: str) -> bytes:
    return ("\n" + ".".join(word[:k] for k in range(1, len(word) + 1)) + "|" + ".".join(word[k:] for k in range(len(word))) + "\n").encode()


def compressor(content: bytes) -> zstd.ZstdCompressor:
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    own = zstd.ZstdCompressionParameters.from_level(
        6, strategy=zstd.STRATEGY_BTLAZY2, window_log=21, hash_log=17, chain_log=18, search_log=7, min_match=5, target_length=64,
        format=zstd.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    dictionary.precompute_compress(compression_params=own)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=own)


def content(words: list[str], size: int) -> bytes:
    """The first words that fit, the first of them last: near matches are the cheapest."""
    out, used = [], 0
    for w in words:
        s = spelled(w)
        if used + len(s) > size:
            break
        out.append(s)
        used += len(s)
    return b"".join(reversed(out)) or b"\n\n\n\n\n\n\n\n"


@dataclass
class Model:
    """What scoring needs; a few hundred KB."""

    ordinary: bytes
    toxic: bytes
    cut: float
    weights: list[float] = field(default_factory=list)  # of the features, then the constant
    prior: float = 0.5


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.distances: dict[str, float] = {}
        self.by_ordinary, self.by_toxic = compressor(model.ordinary).compress, compressor(model.toxic).compress

    def distance(self, word: str) -> float:
        s = spelled(word)
        return (len(self.by_ordinary(s)) - len(self.by_toxic(s))) / len(s) ** 0.5

    def windows(self, text: str | None) -> np.ndarray:
        words, known = words_of(text or ""), self.distances
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.distance(w)
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def score(self, text: str | None) -> float:
        return self.of_windows(self.windows(text))

    def of_windows(self, d: np.ndarray) -> float:
        m = self.model
        if not m.weights:
            return m.prior
        z = float(features(d, m.cut) @ np.array(m.weights[:-1]) + m.weights[-1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(d: np.ndarray, cut: float) -> np.ndarray:
    if not len(d):
        return np.zeros(FEATURES)
    n = int((d >= cut).sum())
    top = np.sort(d)[-5:]
    share = n / len(d)
    return np.array([np.log1p(n), min(20 * share, 3.0), max(top[-1], 0), max(top[-3:].mean(), 0), np.log1p(n) * min(10 * share, 1.0)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights and constant by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sized(words: DataFrame, by: str, size: int) -> bytes:
    """A dictionary's content from the (w, count) rows of the highest counts; no more rows than can fit are collected."""
    return content([r["w"] for r in words.orderBy(F.desc(by), "w").limit(size // SHORTEST).collect()], size)


def dictionaries(counted: DataFrame, n_toxic: int) -> tuple[bytes, bytes]:
    """Contents for ordinary and toxic text from rows (w, n0, n1): ordinary and toxic texts that have each word."""
    ordinary = _sized(counted.where("n0 > 0 AND n0 + n1 >= 2"), "n0", ORDINARY_BYTES)
    shared = counted.sparkSession.sparkContext.broadcast(ordinary)

    def heavy(batches):
        cost = compressor(shared.value).compress
        for batch in batches:
            words = batch.column(batch.schema.get_field_index("w")).to_pylist()
            yield batch.filter(pa.array([len(cost(spelled(w))) >= KNOWN_COST + HARD for w in words], pa.bool_()))

    often = counted.where(F.col("n1") >= max(4, 0.003 * n_toxic)).select("w", "n1")
    return ordinary, _sized(often.mapInArrow(heavy, "w string, n1 long"), "n1", TOXIC_BYTES)


def _sample(labels: DataFrame, docs: DataFrame, id_col: str, text_col: str, label_col: str, where: F.Column | None, most: int) -> DataFrame:
    """(k, y, part, t) of at most ``most`` labelled ids, each with one of its texts; part 1 sets threshold and weights."""
    own = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull())
    if where is not None:
        own = own.where(where)
    own = own.groupBy("k").agg(F.max("y").cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    place = F.row_number().over(Window.partitionBy(F.col("y") > 0).orderBy(F.xxhash64("k", F.lit("part")), "k"))  # over ids alone
    own = own.select("k", "y", (place % 4 == 1).cast("int").alias("part"))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return one_of_each(texts.join(F.broadcast(own), "k"), "k", "y", "part")  # at most ``most`` ids


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: F.Column | None = None, max_train: int = MAX_TRAIN) -> Model:
    """``where``: which labelled rows may be learnt from, as a condition on column ``k``, the id."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = written(_sample(labels, docs, id_col, text_col, label_col, where, max_train), "labelled")

    def count(batches):
        words: dict[str, list[int]] = {}
        for y, text in rows_of(batches, "y", "t"):
            for w in set(words_of(text or "")):
                words.setdefault(w, [0, 0])[y > 0] += 1
            if len(words) > WORDS_KEPT:
                yield from counts(words)
                words = {}
        yield from counts(words)

    def counts(words):
        keys = list(words)
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([words[w][c] for w in part], pa.int64()) for c in (0, 1))], names=["w", "n0", "n1"])

    sizes = {(r["part"], r["y"]): r["n"] for r in sample.groupBy("part", (F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n1 = sum(n for (_, y), n in sizes.items() if y)
    n = sum(sizes.values())
    model = Model(b"", b"", 1.2, [], n1 / n if n else 0.5)
    if not n1 or n1 == n:
        return model
    first = sample.where("part = 0").select("y", "t").mapInArrow(count, "w string, n0 long, n1 long")
    counted = written(first.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "words")
    model.ordinary, model.toxic = dictionaries(counted, sizes.get((0, True), 0))
    shared = spark.sparkContext.broadcast(model)
    cuts = (0.8, 1.0, 1.2, 1.4, 1.6, 1.8)

    def measured(batches):
        scorer = Scorer(shared.value)
        for y, text in rows_of(batches, "y", "t"):
            d = scorer.windows(text)
            x = np.concatenate([features(d, c) for c in cuts])
            yield pa.RecordBatch.from_arrays([pa.array([int(y)], pa.int32()), pa.array([x.tolist()], pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.where("part = 1").select("y", "t").mapInArrow(measured, "y int, x array<double>").collect()  # at most max_train rows of 30 numbers
    rows = sorted(rows, key=lambda r: (r["y"], r["x"]))
    y, x = np.array([r["y"] > 0 for r in rows], float), np.array([r["x"] for r in rows]).reshape(len(rows), len(cuts), FEATURES)
    best = None
    for k, cut in enumerate(cuts):
        w = logistic(x[:, k], y)
        p = np.clip(1 / (1 + np.exp(-np.clip(x[:, k] @ w[:-1] + w[-1], -30, 30))), 1e-9, 1 - 1e-9)
        loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if best is None or loss < best[0] - 1e-9:
            best = (loss, cut, w)
    model.cut, model.weights = best[1], [float(v) for v in best[2]]
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_windows, n_toxic_windows) of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scorer = Scorer(m)
        for batch in batches:
            scores, n, toxic = [], [], []
            for (text,) in rows_of([batch], "t"):
                d = scorer.windows(text)
                scores.append(scorer.of_windows(d))
                n.append(len(d))
                toxic.append(int((d >= m.cut).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(n, pa.int64()), pa.array(toxic, pa.int64())], names=[id_col, "score", "n_windows", "n_toxic_windows"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_windows", T.LongType()), T.StructField("n_toxic_windows", T.LongType())])
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: F.Column) -> F.Column:
    """The rows that the fit must not learn from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    return fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where=~held_out(F.col("k")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt from labelled rows that are not held out."""
    scored = score(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows", "n_toxic_windows")
