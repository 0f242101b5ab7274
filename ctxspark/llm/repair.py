"""Conversation structure repair: the cheapest edits after which a conversation's roles fit a grammar.

The grammar is ``(s?(ua)+)?`` over role initials, a machine of four states.  After every turn stands a word of
cost layers, four bits a layer: bit q of layer k says that from state q the rest of the conversation can be
repaired at cost base + k.  A turn's edits are shifts of that word: reading it backwards, a kept turn gives
the states before its role, a deleted one the same states four layers up, and so on.  Costs of the states
differ by 7 at most (an inserted turn, or a deleted and an inserted one, leads from any state to the path of
any other), so 16 layers in one word hold all that a cheapest repair can need, however long a conversation is.
The first layer that has the start state gives the cost; following the bits forwards, with the least
edit in ASCII that some layer allows, gives the audit.

Turns go by conversation in sorted partitions and are streamed: a task holds one byte a turn of one
conversation (the audit, one cell of the result, has as many) and ``STEPS`` words.  Repeated rows are counted
where they are before they are sent, and come as one row with a count.

Defined results: turns go by number, null first, then by role and text; null roles and texts are one space;
a role that begins with another letter than s, u or a can only be reroled or deleted; conversations of a null id
are one; of rows that are the same in role and text the first one counts and the others are duplicates; a
conversation without turns has cost 0 and nothing to edit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batcher, rows_of, small_batches, table, written
from .lines import stripped

RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STEPS = 4096
LAYERS = 16
#: A layer's bits: state 0 at the start, 1 after s, 2 after u, 3 after a.
_S, _U, _A = (int(c * LAYERS, 16) for c in "248")
_WORD = (1 << 4 * LAYERS) - 1
ACCEPTING = 0b1001
#: What a turn is to the machine: 3 * role (s, u, a, other) + 0 whole, 1 to be deleted, 2 truncated.
ROLES = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}


def _before(x: int, role: int) -> int:
    """The states from which a turn of this role leads to the states of each layer."""
    if role == 0:
        return (x & _S) >> 1
    if role == 1:
        return (x & _U) >> 2 | (x & _U) >> 1 | (x & _U) << 1
    return (x & _A) >> 1 if role == 2 else 0


def _after(states: int, role: int) -> int:
    if role == 0:
        return 2 * (states & 1)
    if role == 1:
        return 4 if states & 0b1011 else 0
    return 8 if role == 2 and states & 4 else 0


def _either(x: int) -> int:
    return _before(x, 1) | _before(x, 2)


def _closed(x: int) -> int:
    """With turns inserted before: two lead from any state to any that can be reached."""
    for _ in range(2):
        x |= _either(x) << 4 * INSERT
    return x


@lru_cache(None)
def stepped(x: int, turn: int) -> tuple[int, int]:
    """The word before a turn from the one after it, and by how much its base is higher."""
    role, fault = divmod(turn, 3)
    y = x << 4 * DELETE
    if fault != 1:
        own = TRUNCATED if fault == 2 else 0
        y |= _before(x, role) << 4 * own | _either(x) << 4 * (own + RETYPE)
    y, up = _closed(y), 0
    while not y & 15:
        y, up = y >> 4, up + 1
    return y & _WORD, up


def _layer(x: int, k: int) -> int:
    return x >> 4 * k & 15 if 0 <= k < LAYERS else 0


def repaired(turns: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation of such turns."""
    end = _closed(ACCEPTING)
    marks, x, total = [], end, 0  # words at every STEPS-th place, from the end
    for at in range(len(turns) - 1, -1, -1):
        if (at + 1) % STEPS == 0:
            marks.append(x)
        x, up = stepped(x, turns[at])
        total += up
    left = next(k for k in range(LAYERS) if _layer(x, k) & 1)
    cost, states, audit = total + left, 1, bytearray()
    for start in range(0, len(turns) or 1, STEPS):
        own = turns[start : start + STEPS]
        words, ups = [marks.pop() if len(own) == STEPS else end], []
        for turn in reversed(own):
            word, up = stepped(words[-1], turn)
            words.append(word)
            ups.append(up)
        words.reverse()
        ups.reverse()
        for at in range(len(own) + 1):
            last = at == len(own)
            if last and start + STEPS < len(turns):
                break  # the next part begins here
            while True:
                later, role, fault = left, 3, 1
                if not last:
                    later, (role, fault) = left + ups[at], divmod(own[at], 3)
                    if found := states & _layer(words[at + 1], later - DELETE):
                        edit, left, states = "D", later - DELETE, found
                        break
                inserted = _after(states, 1) | _after(states, 2)
                if found := inserted & _layer(words[at], left - INSERT):
                    audit += b"I"
                    left, states = left - INSERT, found
                    continue
                if last:
                    edit = ""
                    break
                own_cost = TRUNCATED if fault == 2 else 0
                if found := _after(states, role) & _layer(words[at + 1], later - own_cost):
                    edit, left, states = "K", later - own_cost, found
                else:
                    edit, left, states = "R", later - own_cost - RETYPE, inserted & _layer(words[at + 1], later - own_cost - RETYPE)
                break
            audit += edit.encode()
    return cost, audit.decode()


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Conversation:
    """What is kept of a conversation's turns as they come by."""

    def __init__(self):
        self.turns = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = 0
        self.least = self.most = self.before = None

    def add(self, number: int | None, initial: str, blank: bool, cut: bool, first: bool, copies: int) -> None:
        if not copies:
            return
        if number is not None and number != self.most:
            self.least = number if self.least is None else self.least
            self.most = number
            self.numbers += 1
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.illegal += copies - 1
        self.before = initial
        role = 3 * ROLES.get(initial, 3)
        live = 1 if first and not blank else 0
        if live:
            self.turns.append(role + (2 if cut else 0))
            self.truncated += cut
        self.turns += bytes([role + 1]) * (copies - live)
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - live

    def report(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.numbers
        cost, audit = repaired(bytes(self.turns))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _runs(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conversation, its rows) of rows that come in order; the rows must be taken before the next conversation."""
    rows = iter(rows)
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def own():
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(rows, None)

        yield key, own()


def applied(rows: Iterable[tuple], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired conversation, from (role, text, copies) in order and its audit."""
    length = len(audit) - audit.count("D")
    at = place = 0

    def role_here() -> str:
        return "user" if (place + length) % 2 == 0 else "assistant"  # u and a in turn up to an a, after s where the length is odd

    def inserted():
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            yield "I", role_here(), ""
            at, place = at + 1, place + 1

    for role, text, copies in rows:
        for _ in range(copies):
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                yield edit, role if edit == "K" else role_here(), text
                place += 1
    yield from inserted()


def counted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, copies, first): equal rows as one, and whether role and text are there for the first time.

    The rows are a table in the shared folder: they are read for the edits and again for the repaired texts.
    """
    space = F.lit(" ")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    rows = written(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "counted")
    rows = rows.withColumns({"key": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), "at": F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("number"))})
    firsts = rows.where(F.col("copies") > 0).groupBy("conv", "key").agg(F.min("at").alias("at_"))
    firsts = firsts.select(F.col("conv").alias("conv_"), F.col("key").alias("key_"), "at_")
    own = rows.join(firsts, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("key") == F.col("key_")), "left")
    return written(own.select("conv", "turn", "role", "text", "copies", F.coalesce(F.col("at") == F.col("at_"), F.lit(False)).alias("first")), "turns")


def edits(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of ``counted`` rows."""
    bare = stripped(F.col("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    seen = ordered.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), "first", "copies")
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *(T.StructField(c, T.LongType()) for c in _REPORT), T.StructField("audit", T.StringType())])

    def run(batches):
        out = None

        def each():
            nonlocal out
            for batch in batches:
                out = out or Batcher(pa.schema([("conv", batch.schema.field("conv").type), *((c, pa.int64()) for c in _REPORT), ("audit", pa.string())]))
                yield from rows_of([batch], "conv", "turn", "initial", "blank", "cut", "first", "copies")

        for conv, own in _runs(each()):
            found = Conversation()
            for _, number, initial, blank, cut, first, copies in own:
                found.add(number, initial, blank, cut, first, copies)
            report = found.report()
            if out.add((conv, *report), 64 + len(report[-1])):
                yield out.flush()
        if out:
            yield out.flush()

    return seen.mapInArrow(run, schema)


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Conversations in order: the row of ``edits``, then the turns."""
    empty = F.lit(None)
    heads = found.select("conv", F.lit(True).alias("head"), empty.cast(rows.schema["turn"].dataType).alias("turn"), empty.cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"), *_REPORT)
    body = rows.where(F.col("copies") > 0).select("conv", F.lit(False).alias("head"), "turn", "role", "text", "copies", *(empty.cast("long").alias(c) for c in _REPORT))
    both = heads.unionByName(body).repartition("conv")
    return both.sortWithinPartitions("conv", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "text")


def _streamed(rows: DataFrame, found: DataFrame, fields: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    """make(report, audit, (edit, role, text) of the repaired conversation) gives the rows of a conversation, without its id and with their size."""
    columns = ("conv", "role", "text", "copies", *_REPORT)
    small_batches(rows.sparkSession)

    def run(batches):
        out = None

        def each():
            nonlocal out
            for batch in batches:
                out = out or Batcher(pa.schema([("conv", batch.schema.field("conv").type), *((c, t) for c, _, t in fields)]))
                yield from rows_of([batch], *columns)

        for conv, own in _runs(each()):
            _, _, audit, _, *report = next(own)
            for row, size in make(report, audit, applied(((role, text, copies) for _, role, text, copies, *_ in own), audit)):
                if out.add((conv, *row), size):
                    yield out.flush()
            for _ in own:
                pass
        if out:
            yield out.flush()

    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *(T.StructField(c, t) for c, t, _ in fields)])
    return _beside(rows, found).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the repaired conversations of ``counted`` rows."""
    fields = [("place", T.LongType(), pa.int64()), ("edit", T.StringType(), pa.string()), ("role", T.StringType(), pa.string()), ("text", T.StringType(), pa.string())]
    return _streamed(rows, edits(rows), fields, lambda report, audit, turns: (((place, *turn), 64 + len(turn[2])) for place, turn in enumerate(turns)))


def reports(rows: DataFrame) -> DataFrame:
    """A row a conversation: faults, cost, audit and the hash of the repaired conversation as ``role:text`` lines."""
    fields = [*((c, T.LongType(), pa.int64()) for c in _REPORT), ("audit", T.StringType(), pa.string()), ("repaired_sha256", T.StringType(), pa.string())]

    def make(report, audit, turns):
        digest = hashlib.sha256()
        for place, (_, role, text) in enumerate(turns):
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield (*report, audit, digest.hexdigest()), 128 + len(audit)

    return _streamed(rows, edits(rows), fields, make)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with every fifth row or so damaged, by a checksum of its place."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(place.cast("binary")) % 20
    text = F.coalesce("text", space)
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and their cheapest repairs."""
    rows = counted(damaged(table(spark, sf_dir, "conversations")), copies=F.col("copies"))
    return reports(rows).withColumnRenamed("conv", "conv_id")
