"""A stored inverted index: postings in blocks with bounds, grown by segments, searched by block maxima.

A segment is a table of blocks: a term, up to ``BLOCK`` documents by id with their counts and lengths, and
the block's greatest count and least length.  BM25 weights grow with the count and fall with the length, so
these two bound every weight in the block, whatever is added to the index later.  Blocks lie in folders by a
hash of the term and are sorted by term: a search opens the folders of its terms only, and bounds are
read before, and apart from, the postings.

Search: the blocks with the highest bounds of each query give each document a part of its score, and the k-th
best of these is a threshold that the k best documents reach.  Terms whose bounds together stay below it
are not looked at for new documents; a block of another term is skipped if its bound and the other terms' bounds
do not reach it.  Only for documents found so the remaining terms' blocks are opened, where their ids can be.
A block holds documents of one part, by hash of their ids: the opened blocks of a part meet in one task,
which scores its documents and hands on what can be among the k best.
Ranks and scores are those of ``retrieve.bm25``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import words
from .retrieve import B, K1, row_counts, term_counts
from .shared import Scratch

BLOCK = 128
FOLDERS = 64
#: Documents of a part: all postings of a document lie in blocks of its part.
PART = 4096
#: Ways that one term's postings go when an index is written.
SPREAD = 8
#: So many terms of queries go to every task.
FEW = 1_000_000
#: Blocks of a query that are looked at first.
FIRST = 8
#: Scores are compared with this much room, as sums of doubles depend on their order.
SLACK = 1e-6


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def weight(tf: Column, dl: Column, df: Column, n_docs: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted postings (term, id, tf, dl): runs of a term cut to ``size``; a block ends with its batch.

    Rows of one term, id and length are one posting; the last of a batch waits for the next one.
    """
    task, number, waiting = TaskContext.get(), 0, None
    for batch in chain(batches, [None]):
        rows = pa.Table.from_batches([b for b in (waiting, batch) if b is not None]).combine_chunks() if waiting is not None or batch is not None else None
        if rows is None or not rows.num_rows:
            continue
        same = pc.and_kleene(pc.equal(rows["term"][1:], rows["term"][:-1]), pc.equal(rows["dl"][1:], rows["dl"][:-1]))
        both_null = pc.and_(pc.is_null(rows["id"][1:]), pc.is_null(rows["id"][:-1]))
        same = pc.and_kleene(same, pc.or_(both_null, pc.fill_null(pc.equal(rows["id"][1:], rows["id"][:-1]), False)))
        starts = np.flatnonzero(np.concatenate([[True], ~np.asarray(same)]))
        tf = np.add.reduceat(rows["tf"].to_numpy(), starts)
        rows = rows.take(pa.array(starts)).set_column(rows.column_names.index("tf"), "tf", pa.array(tf))
        if batch is not None:
            waiting, rows = rows[-1:].to_batches()[0], rows[:-1]
        if not rows.num_rows:
            continue
        rows, n = rows.combine_chunks(), rows.num_rows
        fresh = np.concatenate([[True], np.asarray(pc.not_equal(rows["term"][1:], rows["term"][:-1]))])
        runs = np.flatnonzero(fresh)
        place = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
        starts = np.flatnonzero(place % size == 0)
        ends = np.append(starts[1:], n)
        ids, dl, tf = (rows[c].combine_chunks() for c in ("id", "dl", "tf"))
        entries = pa.StructArray.from_arrays([ids, tf, dl], names=["id", "tf", "dl"])
        first = pc.if_else(pc.is_null(ids.take(pa.array(starts))), ids.take(pa.array(np.minimum(starts + 1, ends - 1))), ids.take(pa.array(starts)))  # nulls come first
        columns = {
            "block": pa.array((task.partitionId() << 32) + number + np.arange(len(starts))), "term": rows["term"].combine_chunks().take(pa.array(starts)), "low": first, "high": ids.take(pa.array(ends - 1)),
            "n": pa.array(ends - starts), "most": pa.array(np.maximum.reduceat(tf.to_numpy(), starts)), "least": pa.array(np.minimum.reduceat(dl.to_numpy(), starts)),
            "entries": pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), entries),
        }
        number += len(starts)
        yield pa.RecordBatch.from_pydict(columns)


BLOCKS = "block long, term string, low long, high long, n long, most long, least int, entries array<struct<id:long,tf:long,dl:int>>"


SEGMENT = "segment string, n_docs long, n_texts long, n_words long, replaces array<string>"


class PostingsIndex:
    """Segments of blocks below one path; ``segments`` is a table of (segment, n_docs, n_texts, n_words): rows, rows with a text, words."""

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS, block: int = BLOCK):
        self.spark, self.path, self.folders, self.block = spark, path.rstrip("/"), folders, block

    def _segments(self) -> list[tuple[str, tuple[int, int, int]]]:
        """The index's segments and their sizes: one row each, and one a merge."""
        rows = self.spark.read.schema(SEGMENT).parquet(f"{self.path}/segments").collect()
        gone = {s for r in rows for s in r["replaces"]}
        return [(r["segment"], (r["n_docs"], r["n_texts"], r["n_words"])) for r in rows if r["segment"] not in gone]

    def _write(self, postings: DataFrame, sizes: tuple[int, int, int], replaces: list[str]) -> None:
        """Writes (id, term, tf, dl) as a segment: postings are shuffled once, by folder and part of the documents, and cut to blocks in their order."""
        name, size = uuid.uuid4().hex, self.block
        part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-sizes[0] // PART)))).cast("int")
        rows = postings.select("term", "id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("int").alias("dl"))
        sorted_ = rows.repartition(_folder(F.col("term"), self.folders), F.pmod(part, F.lit(SPREAD))).sortWithinPartitions("term", part, "id", "dl")
        sorted_ = sorted_.withColumn("part", part)
        # a block is of one part: parts are told apart by the term that it is cut by
        blocks = sorted_.select(F.concat(F.col("part").cast("string"), F.lit(" "), "term").alias("term"), "id", "tf", "dl").mapInArrow(lambda batches: _cut(batches, size), BLOCKS)
        own = blocks.withColumns({"part": F.substring_index("term", " ", 1).cast("int"), "term": F.expr("substring(term, instr(term, ' ') + 1)")})
        own = own.withColumn("folder", _folder(F.col("term"), self.folders))
        own.sortWithinPartitions("folder", "term", "low").write.partitionBy("folder").parquet(f"{self.path}/blocks/{name}")
        # a segment counts from here on: a failure before leaves files that nobody reads
        row = self.spark.createDataFrame([(name, *sizes, replaces)], SEGMENT)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds documents as a segment; their ids must be new to the index."""
        w = words(F.col(text_col))
        n_docs, n_texts, n_words = docs.agg(F.count("*"), F.count(text_col), F.coalesce(F.sum(F.when(F.col(text_col).isNotNull(), F.size(w))), F.lit(0))).first()
        self._write(row_counts(docs, id_col, text_col), (n_docs, n_texts, n_words), [])

    def merge(self) -> None:
        """Makes one segment of all."""
        old = self._segments()
        entries = self._blocks().select("term", F.explode("entries").alias("e")).select("term", "e.*")
        self._write(entries, tuple(sum(s[1][k] for s in old) for k in range(3)), [s[0] for s in old])

    def _blocks(self) -> DataFrame:
        read = self.spark.read.schema(f"{BLOCKS}, part int, folder int")
        out = None
        for segment, _ in self._segments():
            p = f"{self.path}/blocks/{segment}"
            part = read.option("basePath", p).parquet(p).withColumn("segment", F.lit(segment))
            out = part if out is None else out.unionByName(part)
        return out

    def search(self, queries: DataFrame, k: int, query_col: str = "item_id", query_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """(query_id, doc_id, rank, score) of the k best documents, and (blocks, read) as one row: how many blocks the terms have and how many were opened."""
        segments = self._segments()
        scratch = Scratch(self.spark, "search")
        n_docs, n_texts, n_words = (sum(s[1][j] for s in segments) for j in range(3))
        asked = term_counts(queries, query_col, query_text_col).select(F.col("id").alias("query_id"), "term", F.col("tf").alias("qtf"))
        asked = scratch.written(asked.withColumn("folder", _folder(F.col("term"), self.folders)))
        few = F.broadcast if asked.count() <= FEW else lambda df: df
        all_blocks = self._blocks().join(few(asked.select("folder", "term").distinct()), ["folder", "term"], "left_semi")
        bounds = scratch.written(all_blocks.drop("entries"))
        df = bounds.groupBy("term").agg(F.sum("n").alias("df"))
        sizes = float(n_docs), n_words / max(n_texts, 1)
        weights = scratch.written(asked.join(df, "term"))
        most = weight(F.col("most"), F.col("least"), F.col("df"), *map(F.lit, sizes)) * F.col("qtf")
        key = ["segment", "part", "block"]
        by_query = bounds.join(few(weights), ["folder", "term"]).select("query_id", "term", *key, "low", "high", "df", "qtf", most.alias("bound"))

        # 1. a threshold from the highest blocks
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", *key)
        first = by_query.withColumn("r", F.row_number().over(best)).where(F.col("r") <= FIRST).drop("r")
        first = scratch.written(first.select("query_id", *key, "df", "qtf"))
        opened = all_blocks.select(*key, F.col("entries")).join(few(first), key).select("query_id", "df", "qtf", F.explode("entries").alias("e"))
        parts = opened.groupBy("query_id", F.col("e.id").alias("id")).agg(F.sum(weight(F.col("e.tf"), F.col("e.dl"), F.col("df"), *map(F.lit, sizes)) * F.col("qtf")).alias("score"))
        kth = parts.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") == k)
        threshold = kth.select("query_id", (F.col("score") - SLACK).alias("threshold"))
        # 2. terms that are needed for new documents, and their blocks that can matter
        tops = by_query.groupBy("query_id", "term").agg(F.max("bound").alias("top"))
        upto = F.sum("top").over(Window.partitionBy("query_id").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0))
        tops = tops.withColumns({"upto": upto, "all": F.sum("top").over(Window.partitionBy("query_id"))}).join(threshold, "query_id", "left")
        least = F.coalesce("threshold", F.lit(0.0))
        tops = scratch.written(tops.select("query_id", "term", (F.col("upto") >= least).alias("needed"), (F.col("all") - F.col("top")).alias("others"), least.alias("threshold")))
        needed = F.col("needed") & (F.col("bound") + F.col("others") + SLACK >= F.col("threshold"))
        own = by_query.join(few(tops), ["query_id", "term"]).withColumn("needed", needed).drop("others", "threshold")
        # 3. of all other blocks those that can hold a document found; nulls are ids as well
        span = own.where("needed").groupBy("query_id", "segment", "part").agg(F.min("low").alias("least_id"), F.max("high").alias("most_id"), F.bool_or(F.col("low").isNull() | (F.col("high").isNull())).alias("odd"))
        matters = F.col("needed") | F.col("odd") | F.col("low").isNull() | ((F.col("high") >= F.col("least_id")) & (F.col("low") <= F.col("most_id")))
        chosen = scratch.written(own.join(span, ["query_id", "segment", "part"]).where(matters).select("query_id", *key, "df", "qtf", "needed"))
        # all postings of a document are of one part: it is scored where its part's blocks meet
        kind = chosen.schema["query_id"].dataType.simpleString()

        def scored(blocks: pa.Table, chosen: pa.Table) -> pa.Table:
            return _best(blocks, chosen, k, *sizes)

        by_part = [df.groupBy("segment", "part") for df in (all_blocks.select(*key, "entries"), chosen)]
        found = by_part[0].cogroup(by_part[1]).applyInArrow(scored, f"query_id {kind}, id long, score double")
        found = found.select("query_id", "id", F.round("score", 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        read = first.select(*key).unionByName(chosen.select(*key)).distinct().agg(F.count("*").alias("read"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias("doc_id"), "rank", "score"), bounds.agg(F.count("*").alias("blocks")).join(read)


def _best(blocks: pa.Table, chosen: pa.Table, k: int, n_docs: float, avgdl: float) -> pa.Table:
    """(query_id, id, score) of what can be among the k best: the documents of one part that a needed block holds, with all their chosen blocks."""
    out = []
    if blocks.num_rows and chosen.num_rows:
        entries = blocks["entries"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(entries).to_numpy())])
        flat = entries.flatten()
        names = flat.field("id").dictionary_encode(null_encoding="encode")
        doc, tf, dl = names.indices.to_numpy(), flat.field("tf").to_numpy().astype(float), flat.field("dl").to_numpy().astype(float)
        shape = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        at = blocks["block"].to_numpy()
        order = np.argsort(at)
        rows = order[np.searchsorted(at, chosen["block"].to_numpy(), sorter=order)]
        df = chosen["df"].to_numpy().astype(float)
        factor = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * chosen["qtf"].to_numpy()
        needed, queries = np.asarray(chosen["needed"]), chosen["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        query, m = queries.indices.to_numpy(), len(names.dictionary)
        by_query = np.argsort(query, kind="stable")
        for own in np.split(by_query, np.flatnonzero(np.diff(query[by_query])) + 1):
            places = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows[own]])
            n = ends[rows[own] + 1] - ends[rows[own]]
            total = np.bincount(doc[places], shape[places] * np.repeat(factor[own], n), m)
            hit = np.flatnonzero(np.bincount(doc[places], np.repeat(needed[own], n), m))
            if len(hit) > k:
                hit = hit[total[hit] >= np.partition(total[hit], len(hit) - k)[len(hit) - k] - SLACK]
            out.append((pa.array(np.full(len(hit), query[own[0]])), pa.array(hit), total[hit]))
    if not out:
        return pa.table({"query_id": chosen["query_id"][:0], "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    take = lambda of, j: of.take(pa.concat_arrays([o[j] for o in out]))
    return pa.table({"query_id": take(queries.dictionary, 0), "id": take(names.dictionary, 1), "score": np.concatenate([o[2] for o in out])})
