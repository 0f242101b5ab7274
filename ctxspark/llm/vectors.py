"""Vector codes: product codebooks by exact k-means, nearest entries by Exponion search.

Components are whole numbers, floor(1024 x), and vectors are cut into equal parts; each part position has a
codebook of at most 256 entries.  The nearest entry of a part is looked for from its previous entry ``a``: an
entry that is as near as ``a`` lies within twice the part's distance to ``a``, so of the list of a's
neighbours, sorted by distance, only the beginning with D(a, c) <= 4 d(x, a) (squared distances) is scanned.
All distances are exact: in doubles while every term is below 2^53, else in 64-bit integers; ties go to the
lower index.

Each round reads a table of vectors and codes and writes the next in the shared folder; sums and counts
are added up in the tasks, then by Spark, and the driver gets one row an entry.

Defined results: rows whose vector is null, empty or holds a null or non-finite component go; the number of
components is that of the row with the smallest id (then smallest vector), and rows of another number go as
well, as do all rows if it is no multiple of the parts; ids of null come last in the order; repeated rows count
as often as they are there; an empty table gives no rows; other columns are carried (``keep``), whatever
their names.  Components of which the squared distances don't fit in 63 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete_path, scratch_path, small_batches, table, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components that are held at once, and rows that share a radius.
CHUNK, BLOCK = 1 << 20, 128


def exact_type(width: int, most: int) -> type:
    """The number type in which squared distances of ``width`` components up to ``most`` are exact."""
    bound = width * (2 * int(most)) ** 2
    if bound >= 1 << 63:
        raise OverflowError(f"squared distances of {width} components of {most} don't fit in 63 bits")
    return np.float64 if bound < 1 << 53 else np.int64


class Codebook:
    """Entries of one part position, each with the others sorted by distance."""

    def __init__(self, entries: np.ndarray, most: int):
        self.kind = exact_type(entries.shape[1], most)
        self.entries = entries.astype(self.kind)
        self.squares = (self.entries**2).sum(1)
        apart = self.squares[:, None] - 2 * self.entries @ self.entries.T + self.squares[None]
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, 1)

    def nearest(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, and the squared distance to it."""
        x = parts.astype(self.kind)
        own = (x**2).sum(1)
        reach = 4 * ((x - self.entries[start]) ** 2).sum(1)
        best, least = start.astype(np.int64), np.zeros(len(x), np.int64)
        order = np.argsort(start, kind="stable")
        ends = np.flatnonzero(np.diff(start[order])) + 1
        for rows in np.split(order, ends) if len(order) else ():
            a = start[rows[0]]
            within = np.searchsorted(self.apart[a], reach[rows], side="right")
            by_reach = np.argsort(within, kind="stable")
            rows, within = rows[by_reach], within[by_reach]
            for k in range(0, len(rows), BLOCK):
                some = rows[k : k + BLOCK]
                near = self.near[a, : within[min(k + BLOCK, len(rows)) - 1]]
                d = own[some][:, None] - 2 * x[some] @ self.entries[near].T + self.squares[near][None]
                low = d.min(1)
                best[some] = np.where(d == low[:, None], near[None], len(self.entries)).min(1)
                least[some] = low
        return best, least


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``CHUNK`` components."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("v").flatten())
        if size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of one byte a part."""
    return np.frombuffer(batch.column("c").cast(pa.binary(PARTS)).buffers()[1], np.uint8, batch.num_rows * PARTS, batch.column("c").offset * PARTS).reshape(-1, PARTS)


def _assigned(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``rows`` with codes ``c`` and errors ``e`` of the given codebooks, the search starting from the rows' codes."""
    most_entry = max(int(np.abs(b).max()) for b in books)

    def run(batches):
        ready: list[Codebook] = []
        most = -1
        for batch in _chunks(batches):
            v, c = _vectors(batch), _codes(batch)
            reach = max(most_entry, int(v.max()), -int(v.min()))
            if reach > most:
                ready, most = [Codebook(b, reach) for b in books], reach
            width = v.shape[1] // PARTS
            found = [book.nearest(v[:, k * width : (k + 1) * width], c[:, k].astype(np.int64)) for k, book in enumerate(ready)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            arrays = {"c": pa.array([r.tobytes() for r in codes], pa.binary()), "e": pa.array(sum(f[1] for f in found), pa.int64())}
            for name, made in arrays.items():
                batch = batch.set_column(batch.schema.get_field_index(name), name, made)
            yield from (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000))

    return rows.mapInArrow(run, rows.schema)


_SUMS = "part int, entry int, n bigint, sums array<bigint>"


def _moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks with every entry at the floor of the mean of its parts; unused ones stay."""
    width, sizes = books[0].shape[1], len(books[0])

    def run(batches):
        n, sums = np.zeros((PARTS, sizes), np.int64), np.zeros((PARTS, sizes, width), np.int64)
        for batch in _chunks(batches):
            v, c = _vectors(batch), _codes(batch)
            for k in range(PARTS):
                np.add.at(n[k], c[:, k], 1)
                np.add.at(sums[k], c[:, k], v[:, k * width : (k + 1) * width])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n[part, entry]), "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

    partial = rows.select("v", "c").mapInArrow(run, _SUMS)
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)))
    out = [b.copy() for b in books]
    for part, entry, n, *sums in total.collect():  # a row an entry: PARTS * ENTRIES at most
        out[part][entry] = [int(s) // n for s in sums]
    return out


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, keep: tuple[str, ...]) -> DataFrame:
    """id, k0, k1 ... (the ``keep`` columns) and v, the vector in whole numbers, of the rows that can be coded."""
    v = F.col(vec_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~odd)
    return kept.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"k{n}") for n, c in enumerate(keep)), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def coded(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = (), rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, k0, k1 ..., v, c, e) and the final codebooks: whole numbers, a byte a part, squared distance; no codebooks without vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole_numbers(vectors, id_col, vec_col, keep).withColumns({"c": F.lit(bytes(PARTS)), "e": F.lit(0).cast("long")})
    rows = written(rows, "vectors")
    order = [F.col("id").asc_nulls_last(), F.col("v").asc()]
    first = rows.orderBy(*order).select(F.size("v")).head()
    if first is None or first[0] % PARTS:
        return rows.limit(0), []
    rows = rows.where(F.size("v") == first[0])
    start = np.array([r[0] for r in rows.orderBy(*order).select("v").limit(min(entries, 256)).collect()], np.int64)
    books = [part.copy() for part in np.split(start, PARTS, axis=1)]
    schema, last = rows.schema, None
    for k in range(rounds + 1):
        path = scratch_path(spark, "codes")
        _assigned(rows, books).write.parquet(path)
        rows = spark.read.schema(schema).parquet(path)
        if last:
            delete_path(spark, last)
        last = path
        if k < rounds:
            books = _moved(rows, books)
    return rows, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors under codebooks of four rounds, with their errors."""
    rows, books = coded(table(spark, sf_dir, "embeddings"), keep=("label",))
    rows = rows.select("id", F.col("k0").alias("label"), F.lower(F.hex("c")).alias("code"), F.col("e").alias("error"))
    by_label = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    rows = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
