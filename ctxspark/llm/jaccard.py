"""Exact Jaccard join of documents' word shingles by T-occurrence search, and its components.

Two sets of n and m shingles that reach the similarity share at least T = ceil(4/9 (n + m)) of them.
DivideSkip splits a set's inverted lists in short ones, which are merged, and L < T long ones, which are
only probed: whoever reaches T is in T - L of the short ones.  Here all shingles have one order, rare
ones first; a set's first n/5 + l shingles are its short lists (l is n/20, at least 1), at most n/5
of its shingles are not shared, and so the first l shared ones are among them.  The short lists are
merged in buckets of bounded size; the long ones are probed by binary search in a candidate's sorted
set until the overlap is reached or out of reach.  There is no heap: the entries of a list come together
by a sort of their bucket, and those of a pair by a grouping.

Words and shingles are 64-bit hashes, in which every eight bytes are multiplied and shifted before the next
come in.  Lists are made of one family of hashes; what decides, the keys of equal sets and the verification of
pairs, is of another as well: two texts are taken for alike only if both families agree.

Nobody enumerates a group of copies: documents with equal sets are one class; in each list, members are
first held against a few leaders; only pairs of a list that lie in different components then, and that
may reach T by where in the order they meet, are verified as well: no link that would join two
components is lost.

Defined results: null and empty texts have no shingles and link with nothing; texts of fewer words are
one shingle; rows of one id are one document; rows without id link with nothing and have no component;
an empty table gives no rows; other columns are ignored (``components``) or kept (``keep_one``).
Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


from .common import rows_of, small_batches, table, written

WORDS = 5
#: A shingle seen at least this often among distinct sets goes to the end of the order ...
COMMON = 3
#: ... but only so many of them, the most frequent, are told to all tasks (16 bytes each). The order
#: decides how much is compared, never what is found.
COMMON_KEPT = 400_000
#: Shingles counted together by a task; list entries merged together by a task.
COUNTED, MERGED = 3_000_000, 1_000_000
#: Bytes hashed together by numpy, in some arrays of as many or more.
CHUNK = 1 << 19
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# --- sets -------------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def _spread(h: np.ndarray) -> np.ndarray:
    """Every bit of h moves every bit of the result, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: What is left of eight bytes when a word ends after so many of them.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _words(buffer: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words: eight bytes of every word at a time, mixed in one after the other."""
    text = np.concatenate([[False], ~_BLANK[buffer], [False]])
    edge = np.flatnonzero(text[1:] != text[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    low = np.concatenate([_LOWER[buffer], np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(low, 8)
    h = _spread(length.astype(np.uint64) * _MIX[0] + _MIX[seed + 1])
    some = np.flatnonzero(length <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        some = some[length[some] > k]
        if not len(some):
            break
        block = eights[start[some] + k].view("<u8")[:, 0] & _LEFT[np.minimum(length[some] - k, 8)]
        h[some] = _spread(h[some] ^ block)
    for k in np.flatnonzero(length > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(low[start[k] : start[k] + length[k]].tobytes(), seed)
    return start, h


def _pieces(buffer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, piece) of some ``CHUNK`` bytes, cut at white space."""
    at = 0
    while len(buffer) - at > CHUNK:
        end = at + CHUNK
        while end < len(buffer) and not len(blank := np.flatnonzero(_BLANK[buffer[end : end + CHUNK]])):
            end += CHUNK
        end = min(len(buffer), end + int(blank[0])) if end < len(buffer) else len(buffer)
        yield at, buffer[at:end]
        at = end
    yield at, buffer[at:]


def _words_of_any(buffer: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(at + start, h) for at, piece in _pieces(buffer) for start, h in [_words(piece, seed)]]
    return np.concatenate([s for s, _ in found]), np.concatenate([h for _, h in found])


def _sets_of_group(raws: list[bytes], seed: int) -> Iterator[np.ndarray]:
    start, ids = _words_of_any(np.frombuffer(b" ".join(raws), np.uint8), seed)
    ends = np.cumsum([len(r) + 1 for r in raws])
    last = np.searchsorted(start, ends)
    if len(ids) >= WORDS:
        h = ids[: len(ids) - 4] * _MIX[0]
        for k in range(1, WORDS):
            h ^= h >> np.uint64(29)
            h = (h + ids[k : len(ids) - 4 + k]) * _MIX[k]
        h = _mixed(h ^ (h >> np.uint64(32)))
    a = 0
    for b in last.tolist():
        n = b - a
        if n >= WORDS:
            own = np.sort(h[a : b - 4])
            same = own[1:] == own[:-1]
            yield own[np.concatenate([[True], ~same])] if same.any() else own
        elif n:
            one = np.array([n], np.uint64)
            for k in range(n):
                one = (one ^ ids[a + k]) * _MIX[k]
            yield _mixed(one)
        else:
            yield np.zeros(0, np.uint64)
        a = b


def sets_of(raws: Iterable[bytes | None], seed: int = 0) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; many short texts are hashed together.

    The hashes of seed 0 make the lists; those of seed 1 are of another family, for what must be exact.
    """
    group: list[bytes] = []
    size = 0
    for raw in raws:
        raw = raw or b""
        if group and size + len(raw) + 1 > CHUNK:
            yield from _sets_of_group(group, seed)
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield from _sets_of_group(group, seed)


def shingles(raw: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of one text's shingles."""
    return next(sets_of([raw]))


def set_key(*hashes: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, of its hashes under both seeds."""
    d = xxhash.xxh3_128_intdigest(b"".join(h.tobytes() for h in hashes))
    return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)


def least_common(n: int) -> int:
    """In how many short lists of a set of n whoever reaches the similarity is at least."""
    return max(1, n // 20)


def _least(n: str, m: str) -> F.Column:
    """The same for a pair."""
    return F.greatest(F.lit(1), F.floor(F.least(n, m) / 20))


class Order:
    """Rare shingles by hash, then common ones by frequency."""

    def __init__(self, common: np.ndarray, counts: np.ndarray):
        by = np.argsort(common)
        self.common, self.counts = common[by], counts[by]

    def is_common(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.common):
            return np.zeros(len(own), bool), np.zeros(len(own), np.int64)
        at = np.minimum(np.searchsorted(self.common, own), len(self.common) - 1)
        return self.common[at] == own, at

    def prefix(self, own: np.ndarray) -> tuple[np.ndarray, int]:
        """The short lists' shingles, and how many of them are rare."""
        p = len(own) // 5 + least_common(len(own))
        common, at = self.is_common(own)
        rare = own[~common][:p]
        if len(rare) == p or not len(own):
            return rare, len(rare)
        last = own[common]
        last = last[np.lexsort((last, self.counts[at[common]]))]
        return np.concatenate([rare, last[: p - len(rare)]]), len(rare)


def reaches(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * |a & b| >= 80 * |a | b|: the smaller set probes the larger one in blocks until that is decided."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n or 5 * n < 4 * m:
        return False
    need = -(-4 * (n + m) // 9)
    got, step = 0, max(64, n // 8)
    for at in range(0, n, step):
        part = a[at : at + step]
        place = np.minimum(np.searchsorted(b, part), m - 1)
        got += int((b[place] == part).sum())
        if got + n - min(n, at + step) < need:
            return False
    return got >= need


# --- passes -----------------------------------------------------------------------------------


def _raw(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("t"))


def common_shingles(docs: DataFrame, least: int = COMMON, most: int = COMMON_KEPT) -> Order:
    """Shingles that tasks saw more than once and that add up to ``least``; at most ``most`` of them, a bounded list."""

    def count(batches):
        def emit(sets):
            values, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            many = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(n[many])], names=["s", "n"])

        sets: dict[bytes, np.ndarray] = {}
        size = 0
        for own in sets_of(raw for (raw,) in rows_of(batches, "t")):
            if len(own) and (key := xxhash.xxh3_128_digest(own.tobytes())) not in sets:
                sets[key] = own
                size += len(own)
                if size >= COUNTED:
                    yield emit(sets)
                    sets, size = {}, 0
        if sets:
            yield emit(sets)

    seen = docs.select("t").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = seen.where(F.col("n") >= least).orderBy(F.desc("n"), "s").limit(most).toPandas()
    return Order(rows["s"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def _sets(docs: DataFrame, order) -> DataFrame:
    """(id, n, k1, k2, rare, prefix) of every row."""

    def run(batches):
        own_order = order.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            both = (sets_of((raw for (raw,) in rows_of([batch], "t")), seed) for seed in (0, 1))
            for key, own, other in zip(batch.column(0).to_pylist(), *both, strict=True):
                first, rare = own_order.prefix(own)
                k1, k2 = set_key(own, other)
                for column, v in zip(out, (key, len(own), k1, k2, rare, first.tobytes() if len(own) else b""), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["id", "n", "k1", "k2", "rare", "prefix"])

    return docs.mapInArrow(run, "id long, n long, k1 long, k2 long, rare int, prefix binary")


_ENTRY = np.dtype([("s", "<u8"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4")])


_POSITIVE = np.uint64((1 << 63) - 1)


def _lists(classes: DataFrame) -> DataFrame:
    """(list, id, n, pos): entries of the short lists that have more than one member.

    Rare lists are merged in buckets, packed; common ones stay rows, as one may be of any length.
    """
    total = classes.agg(F.sum(F.col("rare")).alias("n")).first()["n"] or 0
    buckets = int(max(1, -(-total // MERGED)))
    spread = np.uint64(buckets)

    def pack(batches):
        for batch in batches:
            parts, where = [], []
            for key, n, rare, raw in rows_of([batch], "id", "n", "rare", "prefix"):
                own = np.frombuffer(raw, np.uint64)[:rare]
                e = np.empty(len(own), _ENTRY)
                e["s"], e["id"], e["n"], e["pos"] = own & _POSITIVE, key, n, np.arange(len(own))
                parts.append(e)
                where.append((own & _POSITIVE) % spread)
            if parts:
                entries, bucket = np.concatenate(parts), np.concatenate(where).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                entries, bucket = entries[by], bucket[by]
                cut = np.flatnonzero(np.diff(bucket)) + 1
                starts = np.concatenate([[0], cut]).astype(np.int64) if len(bucket) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array([x.tobytes() for x in np.split(entries, cut)] if len(bucket) else [], pa.binary())], names=["bucket", "entries"])

    def merge(group: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(group.column("entries").to_pylist()), _ENTRY)
        e = e[np.argsort(e["s"], kind="stable")]
        s = e["s"]
        same = s[1:] == s[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        e = e[many]
        return pa.table({"list": e["s"].astype(np.int64), "id": e["id"].copy(), "n": e["n"].astype(np.int64), "pos": e["pos"].copy()})

    packed = classes.where("rare > 0").select("id", "n", "rare", "prefix").mapInArrow(pack, "bucket long, entries binary")
    rare = packed.groupBy("bucket").applyInArrow(merge, "list long, id long, n long, pos int")

    def unpack(batches):
        for batch in batches:
            ids, ns, ps, ss = [], [], [], []
            for key, n, first, raw in rows_of([batch], "id", "n", "rare", "prefix"):
                own = np.frombuffer(raw, np.uint64)[first:]
                ss.append(own.view(np.int64))
                ids.append(np.full(len(own), key, np.int64))
                ns.append(np.full(len(own), n, np.int64))
                ps.append(np.arange(first, first + len(own), dtype=np.int32))
            if ss:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ss, ids, ns, ps)], names=["list", "id", "n", "pos"])

    # a list's number is its shingle's hash, the sign bit tells common ones from rare ones
    common = classes.where(F.length("prefix") > 8 * F.col("rare")).select("id", "n", "rare", "prefix").mapInArrow(unpack, "list long, id long, n long, pos int")
    common = common.withColumn("list", F.col("list").bitwiseOR(F.lit(-(1 << 63))))
    return rare.unionByName(common)


def _near(n: str, m: str) -> F.Column:
    return (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n))


#: For each round, the orders in which a list's leader is its first member: by how few rare shingles it
#: has before, or by chance, which finds another member of a group in each order.
LEADERS = (("pos", "1"), ("2", "3"))


def _open(lists: DataFrame, found: DataFrame, name: int) -> DataFrame:
    """(list, id, n, pos, c): entries that may still join components.

    Whoever reaches the similarity with a set of n shares all but n/5 of it, and is in at least as many
    of its lists as ``least_common`` says for 4/5 n.  So entries go that stand behind more than n/5
    shingles without a list of several components, then sets with too few entries, and lists that are of
    one component then.  That loses no pair.
    """
    rows = lists.join(found.withColumnRenamed("component", "c") if "component" in found.columns else found, "id", "left").withColumn("c", F.coalesce("c", "id"))
    for _ in range(2):
        mixed = rows.groupBy("list").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("list")
        rows = rows.join(mixed, "list", "left_semi")
        own = Window.partitionBy("id", "n")
        rows = rows.withColumn("k", F.row_number().over(own.orderBy("pos"))).where("pos + 1 - k <= n div 5")
        rows = rows.withColumn("m", F.count("*").over(own)).where("m >= greatest(1, ((4 * n + 4) div 5) div 20)").drop("k", "m")
    return written(rows, f"open{name}")


#: Lists of more entries are long: their pairs are tested inside the join.
LONG = 64


def _crossed(open_: DataFrame) -> DataFrame:
    """(a, b): pairs of a list, of different components, that may reach T.

    All shared shingles up to the last list where a pair meets are counted; behind it, no more are
    shared than the shorter rest has.
    Pairs of short lists are counted after the join.  In a long list an entry brings all lists of its
    set, and a pair leaves the join only if it meets often enough: no long list's pairs are made.
    """
    own = Window.partitionBy("id", "n")
    sizes = open_.groupBy("list").agg(F.count("*").alias("size"))
    rows = open_.join(sizes, "list").withColumn("h", F.count_if(F.col("size") > LONG).over(own)).withColumn("k", F.row_number().over(own.orderBy("pos")))
    rows = written(rows, "sized")

    def both(part: DataFrame, *more: str) -> DataFrame:
        x, y = (part.select("list", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "pos", "c", "h", "k", *more))) for s in "xy")
        apart = (x["list"] == y["list"]) & (F.col("id_x") < F.col("id_y")) & (F.col("c_x") != F.col("c_y")) & _near("n_x", "n_y")
        # up to this list, a pair shares at most as many shingles as either has entries
        apart = apart & (9 * (F.least("k_x", "k_y") + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) - 1) >= 4 * (F.col("n_x") + F.col("n_y")))
        if more:
            common = F.array_intersect("ls_x", "ls_y")
            last = F.element_at(common, -1)
            rest = F.least(*(F.col(f"n_{s}") - F.element_at(F.col(f"ps_{s}"), F.array_position(f"ls_{s}", last).cast("int")) for s in "xy"))
            apart = apart & (F.size(common) >= _least("n_x", "n_y")) & (9 * (F.size(common) + rest - 1) >= 4 * (F.col("n_x") + F.col("n_y")))
        return x.join(y, apart)

    few = both(rows.where(F.col("size") <= LONG)).groupBy("id_x", "id_y", "n_x", "n_y", "h_x", "h_y").agg(F.count("*").alias("times"), F.max("pos_x").alias("p"), F.max("pos_y").alias("q"))
    times = F.col("times") + F.least("h_x", "h_y")  # and at most so many long lists
    few = few.where((times >= _least("n_x", "n_y")) & (9 * (times + F.least(F.col("n_x") - F.col("p"), F.col("n_y") - F.col("q")) - 1) >= 4 * (F.col("n_x") + F.col("n_y"))))
    entries = F.array_sort(F.collect_list(F.struct("pos", "list")).over(own))
    many = rows.where("h > 0").withColumn("e", entries).where(F.col("size") > LONG)
    many = both(many.withColumns({"ls": F.transform("e", lambda e: e["list"]), "ps": F.transform("e", lambda e: e["pos"])}), "ls", "ps")
    return few.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).unionByName(many.select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))).distinct()


def _with_leaders(open_: DataFrame, orders: tuple[str, ...]) -> DataFrame:
    """(a, b): each member and, for each order, the leader of another component that it meets in most lists."""
    found = None
    for order in orders:
        key = F.col("pos") if order == "pos" else F.xxhash64("id", F.lit(order))
        lead = open_.groupBy("list").agg(F.min(F.struct(key.alias("k"), "id", "n", "c")).alias("x")).select("list", F.col("x.id").alias("lead"), F.col("x.n").alias("m"), F.col("x.c").alias("lead_c"))
        met = open_.join(lead, "list").where((F.col("c") != F.col("lead_c")) & _near("n", "m"))
        met = met.groupBy("id", "lead", "n", "m").agg(F.count("*").alias("times")).where(2 * F.col("times") >= _least("n", "m"))  # a choice of what to try first
        best = met.groupBy("id").agg(F.max(F.struct("times", (-F.col("lead")).alias("k"))).alias("x")).select("id", (-F.col("x.k")).alias("lead"))
        found = best if found is None else found.unionByName(best)
    return found.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def _verified(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """(a, b, linked) of candidate pairs."""

    def run(batches):
        for batch in batches:
            out = [reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in rows_of([batch], "x", "y")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    pairs = written(candidates, "pairs")
    sets = _involved(raw, pairs)
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = one.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _involved(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, shingles) of the texts in the pairs, by the hashes that the lists are not made of."""

    def whole(batches):
        for batch in batches:
            sets = [own.tobytes() for own in sets_of((t for (t,) in rows_of([batch], "t")), 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "involved")
    return written(raw.join(ids, "id", "left_semi").mapInArrow(whole, "id long, shingles binary"), "whole")


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id: the smallest id reachable, by min labels and pointer jumping."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("id"), "l"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("l", "m").alias("m"), F.col("l").alias("was"))
        # what an id's old label heard from its members is told to the label's other members as well
        told = hooked.groupBy("was").agg(F.min("m").alias("told")).withColumnRenamed("was", "root")
        step = hooked.join(told, F.col("was") == F.col("root")).select("id", "was", F.least("m", "told").alias("l"))
        step = written(step, "labels")
        jump = step.join(step.select(F.col("id").alias("root"), F.col("l").alias("up")), F.col("l") == F.col("root"), "left").select("id", F.least("l", F.coalesce("up", "l")).alias("l"), "was")
        jump = written(jump, "labels")
        changed = jump.where("l <> was").limit(1).count()
        labels = jump.select("id", "l")
        if not changed:
            return labels.withColumnRenamed("l", "component")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = _raw(docs, id_col, text_col)
    order = spark.sparkContext.broadcast(common_shingles(raw, COMMON, COMMON_KEPT))
    rows = written(_sets(raw, order), "sets")
    classes = written(rows.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix")), "classes")
    lists = written(_lists(classes), "lists")
    own = classes.select("id", F.col("id").alias("c"))
    links = tried = found = None
    for k, orders in enumerate(LEADERS):
        # 1. each member and those of its lists' leaders that it meets most
        open_ = _open(lists, own if found is None else found, k)
        lists = open_.drop("c")  # components only grow: what is settled stays settled
        first = _with_leaders(open_, orders)
        if tried is not None:
            first = first.join(tried, ["a", "b"], "left_anti")
        done = written(_verified(first, raw), "linked")
        tried = done.select("a", "b") if tried is None else tried.unionByName(done.select("a", "b"))
        fresh = done.where("linked").select("a", "b")
        links = fresh if links is None else links.unionByName(fresh)
        found = connected(links)
    # 2. all pairs of a list that are still in different components and may reach the similarity
    open_ = _open(lists, found, len(LEADERS))
    crossed = _crossed(open_)
    more = written(_verified(crossed.join(tried, ["a", "b"], "left_anti"), raw).where("linked").select("a", "b").distinct(), "linked")
    if more.limit(1).count():
        found = connected(links.unionByName(more))
    # back to all rows
    named = classes.join(found, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("c"), "id", "copies").where("copies > 1 OR c <> id").select("k1", "k2", "c")
    out = rows.join(named, ["k1", "k2"], "left")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).cast("long").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: of each component the row of the smallest id."""
    name = "component"
    while name in docs.columns:
        name += "_"
    found = components(docs, id_col, text_col)
    gone = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents."""
    return components(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, g.b FROM reach r JOIN both_ways g ON g.a = r.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.other), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""
