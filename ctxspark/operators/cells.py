"""Nearest vectors from a stored index of k-means cells.

Every vector lies in the folder of its nearest centre; a cell knows its radius.  A search visits the cells
nearest to each query first.  The k-th distance found there is a bound: by the triangle inequality a cell that
is further away than the bound and its own radius holds nothing better, and all others are visited as well.
So the result is that of ``retrieve.vector_topk``; with ``exact=False`` the second step is left out, and
``probes_for`` tells how many cells reach a stated recall: that follows from the vectors, not from their number alone.

Queries and vectors meet by cell, in blocks of bounded size on both sides; a block emits its k best only.

Defined results: vectors that are null, of another length than most, or not finite are neither indexed nor
asked; ids are whole numbers, those of queries are unique; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch

#: Centres are fitted on this many vectors, those with the smallest hashes of their ids.
SAMPLE = 16_384
#: Centres that every task holds, in bytes at most.
CENTRE_BYTES = 32 << 20
#: Cells that an exact search visits for its bound.
PROBES = 8
#: Vectors, and queries, of one block.
BLOCK = 16_384
#: Queries whose distances to a block are in memory at once.
AT_ONCE = 128
#: Distances are ranked in these units.
UNITS = 1e6


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b, summed in the order of the dimensions."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        gap = x[:, None] - y[None, :]
        out += gap * gap
    return out


def _centres(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centres of a bounded sample: the first distinct vectors, moved to the means of what is nearest to them."""
    distinct, first = np.unique(sample, axis=0, return_index=True)
    centres = distinct[np.argsort(first)][:cells]
    for _ in range(rounds if len(sample) else 0):
        own = np.concatenate([_squares(sample[k : k + 1024], centres).argmin(axis=1) for k in range(0, len(sample), 1024)])
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _nearest(qid: int, ids: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest (key, id) but for the query's own id."""
    other = np.flatnonzero(ids != qid)
    if len(other) > k:
        other = other[keys[other] <= np.partition(keys[other], k - 1)[k - 1]]
    best = other[np.lexsort((ids[other], keys[other]))][:k]
    return ids[best], keys[best]


def candidates(qid: int, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, distances) of all that can be among the k nearest once distances are rounded to units: of equal distances the k smallest ids."""
    other = np.flatnonzero(ids != qid)
    if len(other) > k:
        other = other[far[other] <= np.partition(far[other], k - 1)[k - 1] + 2 / UNITS]
    other = other[np.lexsort((ids[other], far[other]))]
    same = np.flatnonzero(np.r_[True, np.diff(far[other]) != 0]) if len(other) else other
    place = np.arange(len(other)) - np.repeat(same, np.diff(np.r_[same, len(other)]))
    other = other[place < k]
    return np.full(len(other), qid), ids[other], far[other]


def _usable(df: DataFrame, id_col: str, vector_col: str, dims: int | None = None) -> DataFrame:
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
    own = own.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return own if dims is None else own.where(F.size("vector") == dims)


class VectorIndex:
    """An index of vectors under a folder that driver and executors share: ``cells`` and ``vectors``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE, rounds: int = 10) -> VectorIndex:
        """Writes the index of all usable vectors; by default about as many cells as the root of their number."""
        own = _usable(vectors, id_col, vector_col)
        sizes = own.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
        dims, n = (sizes[0].dims, sizes[0]["count"]) if sizes else (1, 0)
        own = own.where(F.size("vector") == dims)
        drawn = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()  # bounded
        wanted = max(1, min(cells or round(math.sqrt(n)), CENTRE_BYTES // (8 * dims)))
        centres = _centres(_matrix(drawn["vector"], dims), wanted, rounds)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch["vector"], dims)
                near = [_squares(v[k : k + 1024], centres) for k in range(0, len(v), 1024)]
                cell = np.concatenate([x.argmin(axis=1) for x in near]) if near else np.zeros(0, np.int64)
                far = np.sqrt(np.concatenate([x.min(axis=1) for x in near])) if near else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vector"], pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "vector", "cell", "far"])

        placed = own.mapInArrow(assigned, "id long, vector array<float>, cell int, far double") if len(centres) else own.selectExpr("*", "0 AS cell", "0D AS far")
        # ranges of cell and id: a cell with much of all vectors is cut, small ones share a task
        placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{self.path}/vectors")
        stored = self.spark.read.schema("id long, vector array<float>, far double, cell int").parquet(f"{self.path}/vectors")
        of = self.spark.createDataFrame([(k, list(map(float, c))) for k, c in enumerate(centres)], "cell int, centre array<double>")
        stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(of, "cell").coalesce(1).write.parquet(f"{self.path}/cells")
        return self

    def search(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, exact: bool = True) -> tuple[DataFrame, dict[str, int]]:
        """(query_id, id, rank, distance) of the k nearest vectors by squared distance, and {compared, of}: pairs compared and all pairs.

        ``probes``: cells visited first; by default ``PROBES`` for an exact search, else as many as ``probes_for`` finds.
        """
        if probes is None:
            probes = PROBES if exact else self.probes_for(queries, k, id_col, vector_col)
        known = self.spark.read.schema("cell int, n long, radius double, centre array<double>").parquet(f"{self.path}/cells").orderBy("cell").toArrow()  # bounded by CENTRE_BYTES
        scratch = Scratch(self.spark, "cells")
        if not known.num_rows:
            return self.spark.createDataFrame([], f"query_id long, {id_col} long, rank int, distance double"), {"compared": 0, "of": 0}
        dims = len(known["centre"][0])
        centres, numbers, radii = _matrix(known["centre"], dims), known["cell"].to_numpy(), known["radius"].to_numpy()
        asked = scratch.written(_usable(queries, id_col, vector_col, dims).withColumn("bound", F.lit(None).cast("double")))

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The nearest cells of queries without a bound; of those with one, the further cells that it does not rule out."""
            for batch in batches:
                q, bound = _matrix(batch["vector"], dims), batch["bound"].to_numpy(zero_copy_only=False).astype(float)
                for at in range(0, len(q), 1024):
                    far = np.sqrt(_squares(q[at : at + 1024], centres))
                    order = np.argsort(far, axis=1, kind="stable")
                    first = np.zeros_like(far, dtype=bool)
                    np.put_along_axis(first, order[:, :probes], True, axis=1)
                    b = bound[at : at + 1024, None]
                    # the slack outweighs rounding: of distances to units, and of roots and centres
                    least = np.maximum(far - radii[None, :] * (1 + 1e-9) - 1e-9 * (1 + far), 0) ** 2
                    go = np.where(np.isnan(b), first, ~first & (least <= b + 2 / UNITS))
                    rows, cols = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows + at)), batch["vector"].take(pa.array(rows + at)), pa.array(numbers[cols].astype(np.int32))], ["qid", "query", "cell"])

        met, compared = self._met(scratch, asked.mapInArrow(routed, "qid long, query array<float>, cell int"), k, dims)
        if exact and len(centres) > probes:
            last = met.groupBy(F.col("qid").alias("id")).agg(F.max(F.when(F.col("place") == k, F.col("key") / UNITS)).alias("b"))
            bounded = asked.drop("bound").join(last, "id", "left").select("id", "vector", F.coalesce("b", F.lit(float("inf"))).alias("bound"))
            more, further = self._met(scratch, bounded.mapInArrow(routed, "qid long, query array<float>, cell int"), k, dims)
            met, compared = _best(met.drop("place").unionByName(more.drop("place")), k), compared + further
        total = sum(known["n"].to_pylist()) * asked.count()
        return met.select(F.col("qid").alias("query_id"), F.col("id").alias(id_col), F.col("place").alias("rank"), (F.col("key") / UNITS).alias("distance")), {"compared": compared, "of": total}

    def probes_for(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", target: float = 0.95, sample: int = 64) -> int:
        """How many of the nearest cells hold ``target`` of the true neighbours of ``sample`` queries, those with the smallest hashes of their ids."""
        some = queries.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(id_col, vector_col)
        truth = self.search(some, k, id_col, vector_col, PROBES)[0].select("query_id", F.col(id_col).alias("id"))
        stored = self.spark.read.schema("id long, cell int").parquet(f"{self.path}/vectors")
        cells = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/cells")
        near = truth.join(stored, "id").join(some.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query")), "query_id")
        apart = F.aggregate(F.zip_with("query", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        far = some.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query")).join(F.broadcast(cells)).select("query_id", "cell", apart.alias("far"))
        place = far.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("far", "cell")))
        found = near.join(place, ["query_id", "cell"]).agg(F.percentile("place", target).alias("p")).first().p
        return max(1, math.ceil(found or 1))

    def _met(self, scratch: Scratch, routes: DataFrame, k: int, dims: int) -> tuple[DataFrame, int]:
        """(qid, id, key, place) of the k best over all blocks that ``routes`` (qid, query, cell) name, and the pairs compared."""
        routes = scratch.written(routes)
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        cells = self.spark.read.schema("cell int, n long").parquet(f"{self.path}/cells")
        # a row a cell: bounded as the centres are
        plan = scratch.written(routes.groupBy("cell").agg(F.count("*").alias("nq")).join(cells, "cell").select("cell", "n", "nq", blocks("n").alias("vs"), blocks("nq").alias("qs")))
        compared = plan.agg(F.sum(F.col("n") * F.col("nq"))).first()[0] or 0
        visited = [r.cell for r in plan.select("cell").collect()]
        stored = self.spark.read.schema("id long, vector array<float>, cell int").parquet(f"{self.path}/vectors").where(F.col("cell").isin(visited))
        plan = F.broadcast(plan)

        def part(key: str, of: str) -> Column:
            return F.pmod(F.xxhash64(key), F.col(of)).cast("int")

        def every(of: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

        vectors = stored.join(plan, "cell").select("id", "vector", "cell", part("id", "vs").alias("v"), every("qs").alias("q"))
        asking = routes.join(plan, "cell").select("qid", "query", "cell", part("qid", "qs").alias("q"), every("vs").alias("v"))

        def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
            qids, ids, places = left["qid"].to_numpy(), right["id"].to_numpy(), []
            if len(qids) and len(ids):
                q, v = _matrix(left["query"], dims), _matrix(right["vector"], dims)
                for at in range(0, len(q), AT_ONCE):
                    keys = np.floor(_squares(q[at : at + AT_ONCE], v) * UNITS + 0.5)
                    places += [(np.full(len(i), qid), i, d) for qid, (i, d) in ((x, _nearest(x, ids, row, k)) for x, row in zip(qids[at : at + AT_ONCE], keys, strict=True))]
            columns = [np.concatenate(x) for x in zip(*places, strict=True)] if places else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table({"qid": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "key": pa.array(columns[2], pa.float64())})

        found = asking.groupBy("cell", "v", "q").cogroup(vectors.groupBy("cell", "v", "q")).applyInArrow(nearest, "qid long, id long, key double")
        return scratch.written(_best(found, k)), compared


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy("key", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def recall(found: DataFrame, truth: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(recall): the share of the true neighbours that were found."""
    hit = truth.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
