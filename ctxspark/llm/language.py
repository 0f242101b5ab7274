"""Language-model scoring by masked pseudo-likelihood.

A small network predicts every token of a text from three tokens on either side: an embedding for each
token, one hidden layer over the places, and a binary tree over the vocabulary, whose inner nodes each
decide between two sides.  A token's probability is the product of the decisions on its path, so it
sums to one over the tokens and costs as many products as the token's Huffman code has bits.  The sum
of the conditional log-probabilities is the text's pseudo-log-likelihood.

The vocabulary is every word that makes up at least ``SHARE`` of the corpus (and occurs ``MIN_COUNT``
times), counted over all texts.  The other words have one leaf together; behind it each is spelled by
a model of character pairs, counted over all of those words, so that every string has a probability of
its own and all strings' sum is one.  As context they are told apart by ``CLASSES`` hash classes.

Training starts on a small sample (``START_DOCS`` distinct texts), then all texts are dealt by the hash
of their id and text in shards of about ``SHARD`` tokens.  Each shard's texts are learnt once from that
start, in the order of their hashes, and the shards' weights are averaged by their numbers of tokens, in
groups, so that neither the driver nor a task holds more than ``GROUP`` sets of weights.  Neither shards
nor sums depend on how rows are split over tasks: other files or partitions give the same scores, up to
the rounding of 32-bit numbers.

Defined results: null and empty texts have no tokens, a sum of 0 and a mean that is null; repeated rows
are scored each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one_of_each, rows_of, small_batches, table, written

SIDE = 3
#: Words of the vocabulary: at least this share of all tokens, and so many times.
SHARE, MIN_COUNT = 2.0**-17, 3
#: Hash classes that tell the other words apart as context.
CLASSES = 4096
#: Ids of a network without a vocabulary; 0 stands for what is beyond a text's ends.
SIZE = 128
HIDDEN = 16
#: Tokens of a training step, and of a scoring step (their paths stay in a core's cache).
BATCH, SCORED = 2048, 1024
#: Texts that training starts on; sets of weights averaged by one task.
START_DOCS, GROUP = 1_000, 16
#: Tokens that are learnt together, in about 25 MB of text, and the most tasks that shards are dealt to.
SHARD, MOST_TASKS = 4_000_000, 20_000
#: Tokens that a task trains on or scores at once.
BLOCK = 1 << 16
WORDS_KEPT = 300_000
#: Words whose pairs of characters are looked at together; longer words go one by one.
WORDS_TOGETHER, LONG = 10_000, 256


#: Pairs of characters that the spelling of words knows; the others go by their single characters.
PAIRS_KEPT = 50_000
#: Characters, the most frequent ones, whose pairs are kept in a square; the others' are looked up one by one.
SQUARE = 1000
#: Weight of a character's own share against the pairs', and the share of characters never seen.
SMOOTH, UNSEEN, CHARACTERS = 5.0, 1e-4, 0x110000


def _pairs_of(words: Iterable[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The words with one space before, between and behind them, its code points, and where its spaces are; long words are left empty."""
    text = f" {' '.join(w if len(w) <= LONG else '' for w in words)} "
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return text, codes, np.flatnonzero(codes == 32)


class Speller:
    """log P(word) of words outside the vocabulary, by character pairs; a space stands for a word's ends."""

    def __init__(self, pairs: dict[str, int], singles: dict[str, int], frequent: list[str]):
        self.singles, self.total = singles, sum(singles.values())
        before: Counter = Counter(singles)  # a pair's first character: each character and each start
        kept: Counter = Counter()
        for p, n in pairs.items():
            kept[p[0]] += n
        self.before, self.kept, self.pairs, self.logs, self.rest = before, kept, pairs, {}, 0.0
        known = sorted(singles, key=lambda c: (-singles[c], c))[:SQUARE]
        self.numbers = np.zeros(max(map(ord, known), default=0) + 2, np.int64)  # 0: not in the square
        self.numbers[np.array([ord(c) for c in known], np.int64)] = np.arange(1, len(known) + 1)
        self.square = None
        # what it would give to no character and to words of the vocabulary, which have their own leaves, goes to the others
        self.rest = -math.log1p(-min(math.fsum(math.exp(self(w)) for w in {"", *frequent}), 1 - 1e-9))

    def _log(self, pair: str) -> float:
        first, then = pair
        own = UNSEEN / CHARACTERS + (1 - UNSEEN) * (self.singles.get(then, 0) / self.total) if self.total else 1 / CHARACTERS
        all_of = self.before.get(first, 0) + SMOOTH
        p = self.pairs.get(pair, 0) / all_of + (1 - self.kept.get(first, 0) / all_of) * own
        if len(self.logs) < WORDS_KEPT:
            self.logs[pair] = math.log(p)
        return math.log(p)

    def __call__(self, word: str) -> float:
        s, logs = f" {word} ", self.logs
        found = 0.0
        for a, b in zip(s, s[1:], strict=False):
            x = logs.get(a + b)
            found += self._log(a + b) if x is None else x
        return found + self.rest

    def of(self, words: list[str]) -> np.ndarray:
        """The same for many words together."""
        if self.square is None:
            width = int(self.numbers.max()) + 1
            self.square = np.full((width, width), np.nan)
        parts = [self._of(words[at : at + WORDS_TOGETHER]) for at in range(0, len(words), WORDS_TOGETHER)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _of(self, words: list[str]) -> np.ndarray:
        text, codes, ends = _pairs_of(words)
        n = self.numbers.take(np.minimum(codes, len(self.numbers) - 1))
        cell = n[:-1] * len(self.square) + n[1:]
        found = self.square.ravel().take(cell)
        new = np.flatnonzero(np.isnan(found))
        for k in new.tolist():
            x = self.logs.get(text[k : k + 2])
            found[k] = self._log(text[k : k + 2]) if x is None else x
        self.square.ravel()[cell[new]] = found[new]
        self.square[0] = self.square[:, 0] = np.nan
        out = np.add.reduceat(found, ends[:-1]) + self.rest
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self(w)
        return out


class Vocabulary(dict):
    """Word -> number: 1 to K for the K frequent words, hash classes behind.

    The upper 32 bits of a value are the log-probability of a spelled word, as the bits of a float32.
    """

    def __init__(self, frequent: list[str], speller: Speller | None = None):
        super().__init__({w: k + 1 for k, w in enumerate(frequent)})
        self.frequent, self.speller = frequent, speller

    def _others(self, words: list[str]) -> list[int]:
        """The numbers of words outside the vocabulary."""
        n = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words)) % np.uint64(CLASSES)
        n = n.astype(np.int64) + 1 + len(self.frequent)
        if self.speller:
            n |= self.speller.of(words).astype(np.float32).view(np.int32).astype(np.int64) << 32
        return n.tolist()

    def blocks(self, texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
        """The values of the texts' words, in lists of about ``BLOCK`` words; each distinct word of a list is looked up once."""
        for held in blocks(((text or "").lower().split() for text in texts), BLOCK):
            words = list(itertools.chain.from_iterable(held))
            own = dict.fromkeys(words)
            own = dict(zip(own, map(self.get, own), strict=True))
            others = [w for w, n in own.items() if n is None]
            own.update(zip(others, self._others(others), strict=True))
            values = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
            yield np.split(values, np.cumsum([len(t) for t in held])[:-1])

    def id_blocks(self, texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
        for held in self.blocks(texts):
            yield [v & 0xFFFFFFFF for v in held]

    @staticmethod
    def spelled(values: np.ndarray) -> np.ndarray:
        """The log-probabilities of spelling; 0 for words of the vocabulary."""
        return (values >> 32).astype(np.int32).view(np.float32)


@dataclass
class Tree:
    """A Huffman tree over the ids from 1: for each id, where its path begins in ``nodes`` and its length."""

    first: np.ndarray = field(repr=False)
    length: np.ndarray = field(repr=False)
    nodes: np.ndarray = field(repr=False)
    side: np.ndarray = field(repr=False)  # 1 or -1
    lean: np.ndarray = field(repr=False)  # of each node, the log-odds of side 1 by counts

    @classmethod
    def of(cls, counts: list[int], aliases: int = 0) -> Tree:
        """Leaves for the ids 1 to len(counts), at least two; ``aliases`` more ids share the last leaf."""
        n = len(counts)
        heap = [(max(1, c), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side, lean = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.float32), np.zeros(n - 1, np.float32)
        for k in range(n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[x, y]], side[x], side[y], lean[k] = n + k, 1, -1, math.log(a / b)
            heapq.heappush(heap, (a + b, n + k))
        at = here = np.arange(n)
        ids, nodes, sides = [], [], []
        while len(at):
            ids.append(at)
            nodes.append(parent[here] - n)
            sides.append(side[here])
            here = parent[here]
            live = here != 2 * n - 2
            at, here = at[live], here[live]
        ids, nodes, sides = np.concatenate(ids), np.concatenate(nodes), np.concatenate(sides)
        by = np.argsort(ids, kind="stable")
        length = np.bincount(ids, minlength=n)
        first = np.cumsum(length) - length
        spread = np.concatenate([[0], np.arange(n), np.full(aliases, n - 1)])
        length = length[spread]
        length[0] = 0
        return cls(first[spread], length, nodes[by].astype(np.int32), sides[by], lean)

    def paths(self, ids: np.ndarray):
        """For the ids' paths one after the other: where each begins, their lengths, nodes and sides."""
        n = self.length[ids]
        begin = np.cumsum(n) - n
        k = np.repeat(self.first[ids] - begin, n)
        k += np.arange(len(k))
        return begin, n, self.nodes[k], self.side[k]


TREE = Tree.of([1] * (SIZE - 1))


@dataclass
class Weights:
    embed: np.ndarray = field(repr=False)  # id x hidden
    places: np.ndarray = field(repr=False)  # place and hidden x hidden
    hidden: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)  # node x hidden
    bias: np.ndarray = field(repr=False)
    tree: Tree = field(default_factory=lambda: TREE, repr=False)

    @classmethod
    def fresh(cls, seed: int = 7, tree: Tree = TREE) -> Weights:
        r = np.random.default_rng(seed)
        embed, places = r.standard_normal((len(tree.first), HIDDEN)) * 0.3, r.standard_normal((2 * SIDE * HIDDEN, HIDDEN)) * 0.25
        return cls(embed.astype(np.float32), places.astype(np.float32), np.zeros(HIDDEN, np.float32), np.zeros((len(tree.lean), HIDDEN), np.float32), tree.lean.copy(), tree)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.places, self.hidden, self.out, self.bias]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def of(cls, v: np.ndarray, tree: Tree = TREE) -> Weights:
        at, out = 0, []
        for shape in ((len(tree.first), HIDDEN), (2 * SIDE * HIDDEN, HIDDEN), (HIDDEN,), (len(tree.lean), HIDDEN), (len(tree.lean),)):
            size = math.prod(shape)
            out.append(v[at : at + size].astype(np.float32).reshape(shape))
            at += size
        return cls(*out, tree)


_PLACES = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens with SIDE ends between and around them, and where tokens are."""
    gap = np.zeros(SIDE, np.int64)
    parts = [gap]
    for t in texts:
        parts += [t, gap]
    line = np.concatenate(parts)
    return line, np.flatnonzero(line)


def _forward(w: Weights, line: np.ndarray, at: np.ndarray):
    context = line[at[:, None] + _PLACES]
    x = w.embed.take(context.ravel(), 0).reshape(len(at), -1)
    h = np.tanh(x @ w.places + w.hidden)
    begin, n, nodes, side = w.tree.paths(line[at])
    own, u = np.repeat(h, n, 0), w.out.take(nodes, 0)
    z = np.einsum("ij,ij->i", own, u)
    z += w.bias.take(nodes)
    z *= side
    return context, x, h, begin, nodes, side, own, u, z


def log_probabilities(w: Weights, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(token | both sides) of the tokens at the given places; nothing else than tokens is ever there."""
    out = np.empty(len(at), np.float64)
    for k in range(0, len(at), SCORED):
        part = at[k : k + SCORED]
        begin, z = (f := _forward(w, line, part))[3], f[-1]
        small = np.minimum(z, 0)
        small -= np.log1p(np.exp(-np.abs(z)))
        if w.tree.length[line[part]].all():
            out[k : k + len(part)] = np.add.reduceat(small, begin)
        else:
            real = line[part] != 0
            out[k : k + len(part)] = -np.inf
            if real.any():
                out[k : k + len(part)][real] = np.add.reduceat(small, begin[real])
    return out


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the keys by their halves of 16 bits, and where each distinct key begins in it."""
    by = np.argsort(keys.astype(np.uint16), kind="stable")
    if keys.max() >> 16:
        by = by[np.argsort((keys[by] >> 16).astype(np.uint16), kind="stable")]
    own = keys[by]
    return by, np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``first``; as complex numbers two columns are added at once."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


class Trainer:
    """AdaGrad over mini-batches."""

    def __init__(self, w: Weights, rate: float = 0.05):
        self.w, self.rate, self.tokens = w, rate, 0
        self.seen = [np.full(p.shape, 1e-4, np.float32) for p in w.parts()]

    def _step(self, k: int, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        own, seen = self.w.parts()[k], self.seen[k]
        now = g * g
        now += seen if rows is None else seen.take(rows, 0)
        move = np.sqrt(now)
        np.divide(g, move, out=move)
        move *= self.rate
        if rows is None:
            seen[...] = now
            own -= move
        else:
            seen[rows] = now
            own[rows] = own.take(rows, 0) - move

    def learn(self, line: np.ndarray, at: np.ndarray) -> None:
        w = self.w
        for k in range(0, len(at), BATCH):
            part = at[k : k + BATCH]
            n = len(part)
            context, x, h, begin, nodes, side, own, u, z = _forward(w, line, part)
            g = np.float32(-1 / n) * side / (1 + np.exp(np.minimum(z, 60)))
            u *= g[:, None]
            own *= g[:, None]
            dh = _sums(u, begin) * (1 - h * h)
            dx = (dh @ w.places.T).reshape(-1, HIDDEN)
            by, first = _by_key(nodes)
            here = nodes[by[first]]
            d_out, d_bias = _sums(own.take(by, 0), first), np.add.reduceat(g.take(by), first)
            flat = context.ravel()
            by, first = _by_key(flat)
            d_embed = _sums(dx.take(by, 0), first)
            self._step(0, d_embed, flat[by[first]])
            self._step(1, x.T @ dh)
            self._step(2, dh.sum(0))
            self._step(3, d_out, here)
            self._step(4, d_bias, here)
            self.tokens += n


def blocks(texts: Iterable, tokens: int):
    """Lists of texts (lists of words) of about so many tokens."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Model:
    frequent: list[str] = field(repr=False)
    speller: Speller = field(repr=False)
    tree: Tree = field(repr=False)
    weights: np.ndarray = field(repr=False)


def _averaged(parts: DataFrame) -> np.ndarray | None:
    """The mean of the shards' weights by tokens, in rounds of groups, each summed up in the order of ``g``."""

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("g")
        n = np.array(group.column("n").to_pylist(), float)
        v = sum(np.frombuffer(b, "<f4") * k for b, k in zip(group.column("w").to_pylist(), n, strict=True)) / n.sum()
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "w": pa.array([v.astype("<f4").tobytes()], pa.binary())})

    parts = written(parts.where("n > 0"), "weights")
    while parts.count() > GROUP:
        parts = written(parts.groupBy(F.expr(f"g div {GROUP}").alias("up")).applyInArrow(merge, parts.schema), "weights")
    rows = parts.orderBy("g").collect()  # at most GROUP
    total = sum(r["n"] for r in rows)
    return sum(np.frombuffer(r["w"], "<f4").astype(float) * (r["n"] / total) for r in rows) if rows else None


def _start_texts(texts: DataFrame) -> list[str]:
    """The distinct texts of the lowest hashes: the hashes are picked first, so no task is sent other texts."""
    own = texts.where("t IS NOT NULL").withColumn("h", F.xxhash64("t"))
    low = own.select("h").distinct().orderBy("h").limit(START_DOCS).collect()
    return [r["t"] for r in one_of_each(own.where(F.col("h") <= low[-1]["h"]), "h").orderBy("h").toLocalIterator()] if low else []


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Vocabulary and weights from all texts; ids, where there are any, deal copies of a text over the shards."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).alias("t"))

    def count(batches):
        found: Counter = Counter()
        for (text,) in rows_of(batches, "t"):
            found.update((text or "").lower().split())
            if len(found) > WORDS_KEPT:
                yield from _counts(found)
                found = Counter()
        yield from _counts(found)

    counted = written(texts.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(MIN_COUNT, math.ceil(SHARE * total))
    found = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "w").collect()  # at most 1 / SHARE words
    frequent, own = [r["w"] for r in found] or [""], [r["n"] for r in found] or [0]
    speller = _speller(counted.where(F.col("n") < least), frequent)
    tree = Tree.of([*own, total - sum(own)], CLASSES - 1)
    start = Trainer(Weights.fresh(tree=tree))
    vocabulary = Vocabulary(frequent)
    sample = list(vocabulary.id_blocks(_start_texts(texts)))
    for _ in range(2):
        for held in sample:
            start.learn(*joined(held))
    shared = spark.sparkContext.broadcast((frequent, tree, start.w.vector().astype("<f4"), [s.copy() for s in start.seen]))

    def learn(batches):
        words, shape, vector, seen = shared.value
        own = Vocabulary(words)
        for g, rows in itertools.groupby(rows_of(batches, "g", "t"), key=lambda row: row[0]):
            trainer = Trainer(Weights.of(vector, shape))
            trainer.seen = [s.copy() for s in seen]
            for held in own.id_blocks(t for _, t in rows):
                trainer.learn(*joined(held))
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([trainer.tokens], pa.int64()), pa.array([trainer.w.vector().astype("<f4").tobytes()], pa.binary())], names=["g", "n", "w"])

    shards = max(1, -(-total // SHARD))
    key = F.xxhash64(F.col(text_col), *([F.col(id_col)] if id_col in docs.columns else []))
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.pmod(key, F.lit(shards)).alias("g"), key.alias("k"), F.col(text_col).alias("t"))
    dealt = keyed.repartitionById(min(shards, MOST_TASKS), F.pmod("g", F.lit(MOST_TASKS)).cast("int")).sortWithinPartitions("g", "k", "t")
    mean = _averaged(dealt.select("g", "t").mapInArrow(learn, "g long, n long, w binary"))
    return Model(frequent, speller, tree, (start.w.vector() if mean is None else mean).astype("<f4"))


def _speller(counted: DataFrame, frequent: list[str]) -> Speller:
    """Character pairs of the counted words, each word as often as it occurs."""

    def pairs(batches):
        found: Counter = Counter()
        rows = rows_of(batches, "w", "n")
        while held := list(itertools.islice(rows, WORDS_TOGETHER)):
            found.update(_pair_counts(*zip(*held, strict=True)))
            if len(found) > WORDS_KEPT:
                yield from _counts(found)
                found = Counter()
        yield from _counts(found)

    table_of = written(counted.mapInArrow(pairs, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "pairs")
    singles = table_of.groupBy(F.substring("w", 2, 1).alias("c")).agg(F.sum("n").alias("n")).collect()  # at most one row a character
    kept = table_of.orderBy(F.desc("n"), "w").limit(PAIRS_KEPT).collect()
    return Speller({r["w"]: r["n"] for r in kept}, {r["c"]: r["n"] for r in singles}, frequent)


def _pair_counts(words: tuple[str, ...], times: tuple[int, ...]) -> Counter:
    """How often each pair of characters occurs in words that occur so many times; a space stands for a word's ends."""
    text, codes, ends = _pairs_of(words)
    key = codes[:-1].astype(np.int64) << 32 | codes[1:]
    n = np.repeat(np.array(times, np.int64), np.diff(ends))
    by = np.argsort(key, kind="stable")
    own = key[by]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    found = Counter({text[k : k + 2]: c for k, c in zip(by[first].tolist(), np.add.reduceat(n[by], first).tolist(), strict=True)})
    found.pop("  ", None)  # where long words are left out
    for word, c in zip(words, times, strict=True):
        if len(word) > LONG:
            s = f" {word} "
            for a, b in zip(s, s[1:], strict=False):
                found[a + b] += c
    return found


def _counts(found: Counter):
    keys = list(found)
    for at in range(0, len(keys), 20_000):
        part = keys[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[w] for w in part], pa.int64())], names=["w", "n"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood, mean_log_likelihood) of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, "n_tokens", "log_likelihood", "mean_log_likelihood"]

    def run(batches):
        m = shared.value
        words, w = Vocabulary(m.frequent, m.speller), Weights.of(m.weights, m.tree)
        for batch in batches:
            sums, sizes = [], []
            for held in words.blocks(t for (t,) in rows_of([batch], "t")):
                line, at = joined([v & 0xFFFFFFFF for v in held])
                n = np.array([len(t) for t in held])
                total = np.concatenate([[0.0], np.cumsum(log_probabilities(w, line, at) + Vocabulary.spelled(np.concatenate(held)))])
                ends = np.cumsum(n)
                sums += (total[ends] - total[ends - n]).tolist()
                sizes += n.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array([s / n if n else None for s, n in zip(sums, sizes, strict=True)], pa.float64())], names=names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_likelihood", T.DoubleType())])
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihoods of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
