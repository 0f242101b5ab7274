"""Chains of requests as intervals.

Parent pointers make trees.  Roots are found by doubling the pointers, in written tables.  Requests are numbered once
in preorder, so that "all requests before this one" is a range of numbers: whatever is asked of chains then takes rows in
proportion to the requests and to the result.  Trees of up to ``TREE`` requests are walked in a task, many a task;
larger ones are numbered by ranking the list of a walk around them, by doubled pointers again.

Defined results: requests without id are left out; an id that is repeated counts once, with its smallest parent;
unknown and missing parents end a chain.  A chain that comes back to itself ends before it would repeat a
request: such a circle is cut above its smallest id for the numbers, and ``circles`` adds what the cut hides.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .shared import Scratch

#: Children of one parent are put in order in this many parts.
BUCKETS = 1024
#: Windows over numbers see this many of them, and one row for each such block.
BLOCK_BITS = 16
#: Requests of a tree that one task walks.
TREE = 1 << 16
#: Ranges and places meet in blocks of this many bits at least; what a range does not hold of a block is left out there.
FINE_BITS = 6


def _links(nodes: DataFrame) -> DataFrame:
    """(e, next, downs, net, last): the walk around the trees of ``nodes`` (r, p), two elements a request: down into it, up from it."""
    children = nodes.where("p IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("r"), F.lit(BUCKETS)))
    firsts = children.groupBy("p", "bucket").agg(F.min("r").alias("first"))
    after = firsts.select("p", "bucket", F.lead("first").over(Window.partitionBy("p").orderBy("bucket")).alias("after"))  # BUCKETS rows a parent
    inside = children.withColumn("following", F.lead("r").over(Window.partitionBy("p", "bucket").orderBy("r")))
    siblings = inside.join(after, ["p", "bucket"]).select("r", F.coalesce("following", "after").alias("following"))
    first = firsts.groupBy(F.col("p").alias("r")).agg(F.min_by("first", "bucket").alias("first"))

    def element(column: str, up: bool) -> Column:
        return F.struct(F.col(column).alias("r"), F.lit(up).alias("up"))

    down = nodes.join(first, "r", "left").select(element("r", False).alias("e"), F.when(F.col("first").isNotNull(), element("first", False)).otherwise(element("r", True)).alias("next"))
    above = F.when(F.col("following").isNotNull(), element("following", False)).when(F.col("p").isNotNull(), element("p", True))
    up = nodes.join(siblings, "r", "left").select(element("r", True).alias("e"), above.alias("next"))
    step = F.when(F.col("e.up"), 0).otherwise(1).cast("long")
    return down.unionByName(up).select("e", "next", step.alias("downs"), (2 * step - 1).alias("net"), F.col("e.r").alias("last"))


def _ranked(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``links`` with pointers at the end of their walks; what lies on no walk with an end keeps a pointer.

    Each round doubles the reach, so some walk that has an end gets there in every round: a round that finishes none is the last.
    """
    table = scratch.written(links)
    left = table.where("next IS NOT NULL").count()
    while left:
        hop = table.select(F.col("e").alias("next"), F.col("next").alias("to"), F.col("downs").alias("d"), F.col("net").alias("n"), F.col("last").alias("l"))
        jumped = table.where("next IS NOT NULL").join(hop, "next").select("e", F.col("to").alias("next"), (F.col("downs") + F.col("d")).alias("downs"), (F.col("net") + F.col("n")).alias("net"), F.col("l").alias("last"))
        fresh = scratch.written(table.where("next IS NULL").unionByName(jumped))
        scratch.drop(table)
        before, table, left = left, fresh, fresh.where("next IS NOT NULL").count()
        if left == before:
            break
    return table


def _numbers(ranked: DataFrame) -> DataFrame:
    """(r, root, enter, leave, depth) from a ranked walk."""
    done = ranked.where("next IS NULL")
    one = done.groupBy("e.r").agg(
        F.any_value("last").alias("root"),
        F.max(F.when(~F.col("e.up"), F.col("downs"))).alias("in"),
        F.max(F.when(F.col("e.up"), F.col("downs"))).alias("out"),
        F.max(F.when(~F.col("e.up"), -F.col("net"))).alias("depth"),
    )
    whole = one.where("r = root").select("root", F.col("in").alias("size"))
    return one.join(whole, "root").select("r", "root", (F.col("size") - F.col("in")).alias("enter"), (F.col("size") - F.col("out") - 1).alias("leave"), "depth", "size")


def _rooted(scratch: Scratch, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r, p, root) of ``nodes`` (r, p), and (r) of those whose chains have no end.  What is found is written once."""
    done = [scratch.written(nodes.where("p IS NULL").withColumn("root", F.col("r")))]
    left = scratch.written(nodes.where("p IS NOT NULL").withColumn("to", F.col("p")))
    n = left.count()
    while n:
        none = F.lit(None).cast(nodes.schema["r"].dataType)
        hop = left.select(F.col("r").alias("to"), F.col("to").alias("far"), none.alias("root"))
        for found in done:
            hop = hop.unionByName(found.select(F.col("r").alias("to"), none.alias("far"), "root"))
        jumped = scratch.written(left.join(hop, "to").select("r", "p", F.col("far").alias("to"), "root"))
        scratch.drop(left)
        done.append(jumped.where("root IS NOT NULL").select("r", "p", "root"))
        left = jumped.where("root IS NULL").select("r", "p", "to")
        before, n = n, left.count()
        if n == before:
            break
    rooted = done[0]
    for found in done[1:]:
        rooted = rooted.unionByName(found)
    return rooted, left.select("r")


def _walked(root, rows: list[tuple]) -> Iterator[tuple]:
    """(r, root, enter, leave, depth, size) of a tree's (r, p), in preorder; children of one parent as they come."""
    children: dict = {}
    for r, p in rows:
        if p is not None:
            children.setdefault(p, []).append(r)
    order, above, depth, stack = [], [], [], [(root, 0, 0)]
    while stack:
        r, up, d = stack.pop()
        stack += [(c, len(order), d + 1) for c in reversed(children.get(r, ()))]
        order.append(r)
        above.append(up)
        depth.append(d)
    n = len(order)
    leave = list(range(n))
    for k in range(n - 1, 0, -1):
        if leave[k] > leave[above[k]]:
            leave[above[k]] = leave[k]
    return zip(order, itertools.repeat(root), range(n), leave, depth, itertools.repeat(n))  # noqa: B905


def _numbers_by_tree(rooted: DataFrame) -> DataFrame:
    """(r, root, enter, leave, depth, size): trees lie one after the other in sorted partitions."""
    spark = rooted.sparkSession
    kind = rooted.schema["r"].dataType
    schema = T.StructType([T.StructField("r", kind), T.StructField("root", kind), *(T.StructField(c, T.LongType()) for c in ("enter", "leave", "depth", "size"))])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in batches for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        out: list[tuple] = []
        for root, tree in itertools.groupby(rows, key=lambda row: row[0]):
            out += _walked(root, [row[1:] for row in tree])
            if len(out) >= 4096:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rooted.select("root", "r", "p").repartition(parts, "root").sortWithinPartitions("root", "r").mapInArrow(run, schema)


def _preorder(scratch: Scratch, rooted: DataFrame) -> DataFrame:
    """(r, root, enter, leave, depth, size) of (r, p, root)."""
    large = scratch.written(rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > TREE).select("root"))
    if not large.limit(1).count():
        return _numbers_by_tree(rooted)
    ranked = _ranked(scratch, _links(scratch.written(rooted.join(large, "root", "left_semi").select("r", "p"))))
    return _numbers_by_tree(rooted.join(large, "root", "left_anti")).unionByName(_numbers(ranked))


def _cut(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(r, p, closing): circles of ``nodes``, each cut above its smallest id, whose former parent is ``closing``."""
    n = nodes.count()
    table, span = scratch.written(nodes.select("r", F.col("p").alias("to"), F.col("r").alias("least"))), 1
    while span < n:
        hop = table.select(F.col("r").alias("to"), F.col("to").alias("far"), F.col("least").alias("l"))
        fresh = scratch.written(table.join(hop, "to").select("r", F.col("far").alias("to"), F.least("least", "l").alias("least")))
        scratch.drop(table)
        table, span = fresh, 2 * span
    ahead = table.select(F.col("r").alias("p"), "least")
    cut = F.col("r") == F.col("least")  # only a request of the circle itself can be the least of what lies before it
    return nodes.join(ahead, "p").select("r", F.when(~cut, F.col("p")).alias("p"), F.when(cut, F.col("p")).alias("closing"))


def numbered(requests: DataFrame, request: str = "request_id", parent: str = "parent_id") -> DataFrame:
    """(request, root, enter, leave, depth, size, circle_enter, circle_size), one row a request.

    The requests below one are those of the same root with ``enter`` from its own ``enter`` + 1 to its ``leave``; ``size`` counts the
    root's tree.  ``circle_*`` are null but where a chain comes back to itself: the place of the request that the root names as parent,
    and how many requests lie on the circle.
    """
    scratch = Scratch(requests.sparkSession, "chains")
    own = requests.select(F.col(request).alias("r"), F.col(parent).alias("p")).where("r IS NOT NULL").groupBy("r").agg(F.min("p").alias("p"))
    known = own.select(F.col("r").alias("p"), F.lit(True).alias("known"))
    nodes = scratch.written(own.join(known, "p", "left").select("r", F.when(F.col("known") & (F.col("p") != F.col("r")), F.col("p")).alias("p")))
    rooted, endless = _rooted(scratch, nodes)
    no = F.lit(None).cast("long")
    plain = _preorder(scratch, rooted).withColumns({"circle_enter": no, "circle_size": no})
    if endless.limit(1).count():
        cut = scratch.written(_cut(scratch, scratch.written(nodes.join(endless, "r", "left_semi"))))
        found = scratch.written(_preorder(scratch, _rooted(scratch, cut.select("r", "p"))[0]))
        ends = cut.where("closing IS NOT NULL").select(F.col("closing").alias("r"))
        closing = found.join(ends, "r").select("root", F.col("enter").alias("circle_enter"), (F.col("depth") + 1).alias("circle_size"))
        plain = plain.unionByName(found.join(closing, "root").select(plain.columns))
    out = scratch.written(plain.withColumnRenamed("r", request))
    scratch.drop(nodes)
    return out


def _shifted(places: Column, level: Column) -> Column:
    return F.call_function("shiftrightunsigned", places, level)


def _covered(low: Column, high: Column, size: Column) -> Column:
    """The aligned blocks (level, k) that make up the places from low up to, not including, high; two a level at most."""

    def at(level: Column) -> Column:
        a, b = _shifted(low + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level), _shifted(high, level)
        left = F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("k")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).alias("k")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(_levels(size), at))


def _levels(size: Column) -> Column:
    return F.sequence(F.lit(0), F.length(F.bin(size)) - 1)


def below(upper: DataFrame, numbers: DataFrame, request: str = "request_id") -> DataFrame:
    """``upper`` (root, enter, leave, size, ...) joined with the requests below each row: (request, request_depth, ...).

    Ranges and places meet as aligned blocks, an equality, and what a block holds beside a range is at most two of the
    finest blocks: one root that holds most requests is as many keys as it has blocks, and a small tree is one.
    """
    fine = lambda c: F.shiftrightunsigned(c, FINE_BITS)
    blocks = fine(F.col("size") - 1) + 1
    block = F.explode(_covered(fine(F.col("enter") + 1), fine(F.col("leave")) + 1, blocks)).alias("block")
    ranges = upper.where("leave > enter").select("*", block).drop("size")
    levels = F.transform(_levels(blocks), lambda x: F.struct(x.alias("level"), _shifted(fine(F.col("enter")), x).alias("k")))
    places = numbers.select(F.col(request), F.col("depth").alias("request_depth"), "root", F.col("enter").alias("request_enter"), F.explode(levels).alias("block"))
    inside = (F.col("request_enter") > F.col("enter")) & (F.col("request_enter") <= F.col("leave"))
    return ranges.join(places, ["root", "block"]).where(inside).drop("block", "request_enter")


def circles(numbers: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, ancestor, back) of chains that come back to themselves: what lies behind the cut."""
    some = numbers.where("circle_size IS NOT NULL")
    on = some.where("enter <= circle_enter AND leave >= circle_enter").select("root", F.col(request).alias("ancestor"), F.col("enter").alias("a_enter"), F.col("leave").alias("a_leave"), F.col("depth").alias("a_depth"))
    met = some.join(on, "root").where("NOT (a_enter <= enter AND a_leave >= enter)")
    return met.select(request, "ancestor", (F.col("depth") + F.col("circle_size") - F.col("a_depth")).cast("int").alias("back"))


def ancestors(numbers: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, ancestor, back): every request of each chain before its last, and how many steps back; as many rows as that."""
    upper = numbers.select(F.col(request).alias("ancestor"), "root", "enter", "leave", "size", "depth")
    met = below(upper, numbers, request).select(request, "ancestor", (F.col("request_depth") - F.col("depth")).cast("int").alias("back"))
    return met.unionByName(circles(numbers, request))


def _blocked(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.shiftrightunsigned("enter", BLOCK_BITS))


def first_holders(held: DataFrame, *value: str, one_block: bool = False) -> DataFrame:
    """The rows of ``held`` (root, enter, leave, *value, ...) with no row of the same value above them.

    Ranges lie inside each other or apart, so a row has one above it if the largest ``leave`` of the rows before it reaches it.
    ``one_block``: no tree has more than one block of numbers.
    """
    keys = ["root", *value]
    if one_block:
        before = Window.partitionBy(*keys).orderBy("enter").rowsBetween(Window.unboundedPreceding, -1)
        return held.withColumn("reach", F.max("leave").over(before)).where(F.coalesce("reach", F.lit(-1)) < F.col("enter")).drop("reach")
    before = Window.partitionBy(*keys, "block").orderBy("enter").rowsBetween(Window.unboundedPreceding, -1)
    rows = _blocked(held).withColumn("reach", F.max("leave").over(before))
    blocks = rows.groupBy(*keys, "block").agg(F.max("leave").alias("most"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "block", F.max("most").over(earlier).alias("earlier"))
    far = F.coalesce(F.greatest("reach", "earlier"), F.lit(-1))
    return rows.join(blocks, [*keys, "block"]).where(far < F.col("enter")).drop("block", "reach", "earlier")


def previous_documents(numbers: DataFrame, docs: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, doc, source_request): all documents of the requests before each one, and the first of them that had it.

    ``docs``: (request, doc).  Only the first holder of a document on a chain meets the requests below it.
    """
    named = numbers.select(F.col(request), "root", "enter", "leave", "size", "circle_size")
    held = named.where("circle_size IS NULL").join(docs.select(request, "doc").where("doc IS NOT NULL").distinct(), request).withColumnRenamed(request, "source_request")
    one_block = not numbers.where(F.col("size") > 1 << BLOCK_BITS).limit(1).count()
    straight = below(first_holders(held, "doc", one_block=one_block), numbers, request).select(request, "doc", "source_request")
    around = ancestors(numbers.where("circle_size IS NOT NULL"), request)
    some = around.join(docs.select(F.col(request).alias("ancestor"), "doc").where("doc IS NOT NULL"), "ancestor")
    return straight.unionByName(some.groupBy(request, "doc").agg(F.max_by("ancestor", "back").alias("source_request")))


def upward(numbers: DataFrame, asked: DataFrame, request: str = "request_id") -> DataFrame:
    """The rows of ``numbers`` that lie on the chain of some ``asked`` request, itself included.

    A request does if the next asked one in preorder, from its own place on, lies in its range.
    """
    wanted = asked.select(request, F.lit(True).alias("asked")).where(F.col(request).isNotNull()).distinct()
    rows = _blocked(numbers.join(wanted, request, "left")).withColumn("place", F.when(F.col("asked"), F.col("enter")))
    here = Window.partitionBy("root", "block").orderBy(F.desc("enter")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("near", F.min("place").over(here))
    blocks = rows.groupBy("root", "block").agg(F.min("place").alias("least"), F.count("place").alias("n"))
    by_root = Window.partitionBy("root")
    later = by_root.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("root", "block", F.min("least").over(later).alias("later"), (F.sum("n").over(by_root) > 0).alias("any"))
    on_circle = F.coalesce(F.col("any") & (F.col("enter") <= F.col("circle_enter")) & (F.col("leave") >= F.col("circle_enter")), F.lit(False))
    met = rows.join(blocks, ["root", "block"]).where((F.coalesce("near", "later") <= F.col("leave")) | on_circle)
    return met.select(numbers.columns)


def chain_lengths(numbers: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, n): how many requests each chain has, its last included."""
    extra = circles(numbers, request).groupBy(request).agg(F.count("*").alias("extra"))
    return numbers.join(extra, request, "left").select(request, (F.col("depth") + 1 + F.coalesce("extra", F.lit(0))).alias("n"))
