"""Linkage of large batches on tables.

Only pairs of contexts that share a document have rows; all others are at distance 1.  In each round every
cluster names the cluster that is nearest to it, and two that name each other are merged.  Such two stay each
other's nearest until they are merged, in whatever order the others are: so all of them can be merged at
once, and the merges are those of the greedy order.  Ties go by the clusters' first contexts, of which a
merged one keeps the smaller; for average and complete linkage a merged cluster is as near as another one only
if both its parts are, so ties cannot change either, and for single linkage pairs with ties wait.

Rounds end when a batch has few clusters left, or nothing can be merged.  What is left goes to a task a batch:
few clusters by their matrix, many by a heap of pairs and then, at distance 1, by going through them in order,
in memory in proportion to them and to the pairs that still share a document.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .distance import GRAIN
from .shared import Scratch, group_key

_WHOLE = "decimal(38,0)"


def sharing(rows: DataFrame, method: str, alpha: float) -> DataFrame:
    """(g, i, j, ni, nj, v, cnt) of contexts that share a document; v: how much nearer than 1, or the distance itself."""
    e = rows.select("g", "c", F.size("d").alias("n"), F.posexplode("d").alias("pos", "doc"))
    a, b = (e.select("g", "doc", F.col("c").alias(c), F.col("pos").alias(f"pos_{c}"), F.col("n").alias(f"n_{c}")) for c in "ij")
    met = a.join(b, ["g", "doc"]).where("i < j").groupBy("g", "i", "j", "n_i", "n_j")
    found = met.agg(F.count("*").alias("common"), F.sum(F.abs(F.col("pos_i") - F.col("pos_j"))).alias("moved"))
    far = F.rint((1 - F.col("common") / F.greatest("n_i", "n_j") + F.lit(alpha) * F.col("moved") / F.col("common")) * GRAIN).cast("long")
    one = F.lit(1).cast("long")
    return found.select("g", "i", "j", one.alias("ni"), one.alias("nj"), (GRAIN - far if method == "average" else far).cast(_WHOLE).alias("v"), one.alias("cnt"))


def _far(method: str) -> Column:
    """The distance of two clusters in parts of 1."""
    both = F.col("ni") * F.col("nj")
    if method == "average":
        return (both.cast(_WHOLE) * GRAIN - F.col("v")).cast("double") / both.cast("double")
    edge = F.when(F.col("cnt") < both, F.lit(float(GRAIN)))
    return (F.greatest if method == "complete" else F.least)(F.col("v").cast("double"), edge)


def far_of(method: str, n: int, m: int, v: int, count: int) -> float:
    """The same for numbers."""
    if method == "average":
        return (n * m * GRAIN - v) / (n * m)
    extreme = max if method == "complete" else min
    return float(extreme(v, GRAIN) if count < n * m else v)


_FOLD = {"average": F.sum, "complete": F.max, "single": F.min}
_COMBINE = {"average": lambda x, y: x + y, "complete": max, "single": min}


def merges(rows: DataFrame, large: DataFrame, method: str, alpha: float, most: int) -> DataFrame:
    """(b, i, j, far, size): all merges of the batches named in ``large``, by first contexts; rows: (b, c, d)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "linkage")
    named = large.select(group_key(F.col("b")).alias("g")).distinct()
    own = scratch.written(rows.withColumn("g", group_key(F.col("b"))).join(named, "g", "left_semi"))
    batch = own.schema["b"]
    clusters = scratch.written(own.select("g", "b", "c", F.lit(1).cast("long").alias("size")))
    pairs = scratch.written(sharing(own, method, alpha))
    made: list[DataFrame] = []
    while clusters.groupBy("g").count().where(F.col("count") > most).limit(1).count():
        near = pairs.withColumn("far", _far(method)).where(F.col("far") < GRAIN)
        pair = F.struct("far", F.col("i").alias("lo"), F.col("j").alias("hi"), (F.col("ni") + F.col("nj")).alias("size"))
        best = near.select("g", F.explode(F.array("i", "j")).alias("c"), pair.alias("pair")).groupBy("g", "c")
        if method == "single":  # of equally near ones a merged cluster can come first: only who has one nearest cluster is merged here
            best = best.agg(F.min("pair").alias("pair"), F.max(F.struct(-F.col("pair.far"), "pair.lo", "pair.hi")).alias("last")).where("pair.lo = last.lo AND pair.hi = last.hi").drop("last")
        else:
            best = best.agg(F.min("pair").alias("pair"))
        found = scratch.written(best.groupBy("g", "pair").count().where(F.col("count") == 2).select("g", "pair.*"))
        if not found.limit(1).count():
            scratch.drop(found)
            break
        made.append(found)
        moves = found.select("g", F.explode(F.array("lo", "hi")).alias("at"), F.col("lo").alias("to"), F.col("size").alias("grown"))
        of = clusters.join(moves.withColumnRenamed("at", "c"), ["g", "c"], "left")
        clusters, old = scratch.written(of.select("g", "b", F.coalesce("to", "c").alias("c"), F.coalesce("grown", "size").alias("size")).distinct()), clusters
        scratch.drop(old)
        i, j = (moves.select("g", F.col("at").alias(x), F.col("to").alias(f"to_{x}"), F.col("grown").alias(f"grown_{x}")) for x in "ij")
        ends = pairs.join(i, ["g", "i"], "left").join(j, ["g", "j"], "left")
        ends = ends.select("g", *(F.struct(F.coalesce(f"to_{x}", x).alias("c"), F.coalesce(f"grown_{x}", f"n{x}").alias("n")).alias(x) for x in "ij"), "v", "cnt").where("i.c <> j.c")
        ends = ends.select("g", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v", "cnt")
        ends = ends.groupBy("g", F.col("i.c").alias("i"), F.col("j.c").alias("j"), F.col("i.n").alias("ni"), F.col("j.n").alias("nj"))
        folded = ends.agg(_FOLD[method]("v").cast(_WHOLE).alias("v"), F.sum("cnt").alias("cnt"))
        pairs, old = scratch.written(folded), pairs
        scratch.drop(old)
    out = _rest(clusters, pairs, batch, method, most)
    names = clusters.select("g", "b").distinct()
    for found in made:
        out = out.unionByName(found.join(names, "g").select("b", F.col("lo").cast("long").alias("i"), F.col("hi").cast("long").alias("j"), "far", "size"))
    return out


def _rest(clusters: DataFrame, pairs: DataFrame, batch: StructField, method: str, most: int) -> DataFrame:
    """(b, i, j, far, size): the merges of the clusters that are left."""
    none = F.lit(None)
    heads = clusters.select("g", "b", F.col("c").cast("long").alias("i"), none.cast("long").alias("j"), F.col("size").alias("v"), none.cast("long").alias("cnt"))
    body = pairs.select("g", none.cast(batch.dataType).alias("b"), F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("long"), "cnt")
    both = heads.unionByName(body).repartition("g").sortWithinPartitions("g", F.col("j").asc_nulls_first(), "i")
    schema = StructType([StructField("b", batch.dataType), *_parse_datatype_string("i bigint, j bigint, far double, size bigint").fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in batches for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        for _, group in itertools.groupby(rows, key=lambda row: row[0]):
            sizes: dict[int, int] = {}
            shared: dict[int, dict[int, tuple[int, int]]] = {}
            key = None
            for _, b, i, j, v, count in group:
                if j is None:
                    key, sizes[i] = b, v
                else:
                    shared.setdefault(i, {})[j] = shared.setdefault(j, {})[i] = v, count
            found = left(sizes, shared, method, most)
            for k in range(0, len(found), 10_000):
                part = found[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), kinds.field(0).type), *(pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), list(kinds)[1:], strict=True))], schema=kinds)

    return both.mapInArrow(run, schema)


def left(sizes: dict[int, int], shared: dict[int, dict[int, tuple[int, int]]], method: str, most: int) -> list[tuple[int, int, float, int]]:
    """All merges of clusters: up to ``most`` of them by their matrix, more by the pairs that share a document."""
    names, out = sorted(sizes), []
    if len(names) > most:
        names, out = _nearest_first(names, sizes, shared, method)
        names, more = _at_one(names, sizes, shared, method)
        out += more
    return out + _by_matrix(names, sizes, shared, method)


def _into(i: int, j: int, sizes: dict, shared: dict, method: str) -> None:
    """Cluster j becomes part of cluster i."""
    sizes[i] += sizes[j]
    for k, (v, count) in shared.pop(j, {}).items():
        shared[k].pop(j)
        if k != i:
            w, more = shared.get(i, {}).get(k, (None, 0))
            shared.setdefault(i, {})[k] = shared[k][i] = (v if w is None else _COMBINE[method](v, w)), count + more


def _nearest_first(names: list[int], sizes: dict, shared: dict, method: str) -> tuple[list[int], list[tuple]]:
    """Merges nearer than 1, in order, from a heap of pairs."""
    far = lambda i, j: far_of(method, sizes[i], sizes[j], *shared[i][j])
    heap = [(f, i, j) for i, others in shared.items() for j in others if i < j and (f := far(i, j)) < GRAIN]
    heapq.heapify(heap)
    gone, out = set(), []
    while heap:
        f, i, j = heapq.heappop(heap)
        if i in gone or j in gone or far(i, j) != f:
            continue
        _into(i, j, sizes, shared, method)
        gone.add(j)
        out.append((i, j, f, sizes[i]))
        for k in shared.get(i, ()):
            lo, hi = min(i, k), max(i, k)
            if (f := far(lo, hi)) < GRAIN:
                heapq.heappush(heap, (f, lo, hi))
    return [c for c in names if c not in gone], out


def _at_one(names: list[int], sizes: dict[int, int], shared: dict, method: str) -> tuple[list[int], list[tuple]]:
    """Merges at distance 1 in order, until all that are left are further from each other."""
    out, done = [], 0
    while done < len(names):
        i, at, further = names[done], done + 1, []
        while at < len(names):
            j, at = names[at], at + 1
            pair = shared.get(i, {}).get(j)
            if pair is not None and far_of(method, sizes[i], sizes[j], *pair) != GRAIN:
                further.append(j)
                continue
            _into(i, j, sizes, shared, method)
            out.append((i, j, float(GRAIN), sizes[i]))
            if method == "single" and further:  # what was further can be at 1 now
                names, at, further = [*names[: done + 1], *further, *names[at:]], done + 1, []
        names = [*names[: done + 1], *further]
        done += 1
    return names, out


def _by_matrix(names: list[int], sizes: dict[int, int], shared: dict, method: str) -> list[tuple[int, int, float, int]]:
    from .cluster import joined

    place, size = {c: k for k, c in enumerate(names)}, np.array([sizes[c] for c in names], np.int64)
    whole = np.multiply.outer(size, size) * GRAIN if method == "average" else np.full((len(names), len(names)), GRAIN, np.int64)
    for i, others in shared.items():
        for j, (v, count) in others.items():
            at = place[i], place[j]
            whole[at] = whole[at] - v if method == "average" else far_of(method, sizes[i], sizes[j], v, count)
    return [(names[i], names[j], far, n) for i, j, far, n in joined(whole, size, method)]
