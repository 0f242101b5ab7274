"""Retrieval: BM25, vector top-k, and shaping of retrieval results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ..functions.text import words
from . import cells

# The usual BM25 parameters.
K1, B = 1.2, 0.75
#: Rows of term counts that a task hands on at once.
COUNTS_A_BATCH = 50_000
#: A side of so many texts goes to every task.
FEW = 10_000
#: Pairs of a query and a document that a task adds up, more if that made too many tasks.
PAIRS_A_TASK, MOST_TASKS = 1 << 19, 4096


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl)."""
    w = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return w.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def row_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl) of each row for itself, without a shuffle: rows of one id are not added up."""
    own = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dl = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            terms = batch.column(1).flatten().dictionary_encode()
            n = len(terms.dictionary)
            key, tf = np.unique(np.repeat(np.arange(len(dl), dtype=np.int64), dl) * n + terms.indices.to_numpy(), return_counts=True) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for at in range(0, len(key), COUNTS_A_BATCH):
                some = key[at : at + COUNTS_A_BATCH]
                columns = [batch.column(0).take(pa.array(some // n)), terms.dictionary.take(pa.array(some % n)), pa.array(tf[at : at + COUNTS_A_BATCH]), pa.array(dl[some // n])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "term", "tf", "dl"])

    return own.mapInArrow(counted, f"id {own.schema['id'].dataType.simpleString()}, term string, tf long, dl int")


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, rank, score): the k best documents of each query, ties by id.

    Only the queries' terms of the corpus are kept: the index of all others is never made.  Statistics
    cover all documents.  The longer side is dealt by its ids and the other one goes to every task, if it has ``FEW``
    rows at most: a pair's terms then add up where they meet, and a task hands on its k best of each query.
    """
    n_docs, n_queries = docs.count(), queries.count()
    parts = min(max(1, n_docs * n_queries // PAIRS_A_TASK), MOST_TASKS)
    many_docs, few = n_docs >= n_queries, F.broadcast if min(n_docs, n_queries) <= FEW else lambda df: df
    stats = docs.select(words(F.col(text_col)).alias("w")).agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avgdl"))  # one row
    asked, tf = row_counts(queries, query_col, query_text_col), row_counts(docs, id_col, text_col)
    if many_docs:
        asked = asked.groupBy(F.col("id").alias("query_id"), "term").agg(F.sum("tf").alias("qtf"))
        tf = tf.join(few(asked.select("term").distinct()), "term", "left_semi").repartition(parts, "id")
    else:
        asked = asked.withColumnRenamed("id", "query_id").repartition(parts, "query_id").groupBy("query_id", "term").agg(F.sum("tf").alias("qtf"))
    tf = tf.groupBy("id", "term", "dl").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = tf.join(few(df), "term").join(F.broadcast(stats)).select("id", "term", weight.alias("weight"))
    met = weighted.join(few(asked), "term") if many_docs else asked.join(few(weighted), "term")
    scored = met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("qtf")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias("doc_id"), "rank", "score")


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, rank, distance): exact nearest vectors by squared L2, ties by id; the query itself is left out.

    Every stated query meets every vector (that is the exact search), in blocks of bounded size on both sides;
    a block hands on what can be among the k best.  Vectors with nulls, infinite components or another
    length than most, whose distances are null or not finite, meet the others row by row.
    """
    sizes = vectors.groupBy(F.size(vector_col).alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), "dims").limit(1).collect()
    dims, n = (sizes[0].dims, sizes[0]["count"]) if sizes else (0, 0)
    whole = isinstance(vectors.schema[id_col].dataType, IntegralType) and dims > 0
    plain = F.lit(whole) & F.coalesce((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    own, asked = (df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("plain", plain) for df in (vectors, queries))
    q, v = asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("plain").alias("q_plain")), own
    odd = v.where("NOT plain").join(q, F.col("id") != F.col("query_id")).unionByName(v.where("plain").join(q.where("NOT q_plain"), F.col("id") != F.col("query_id")))
    near = odd.select("query_id", "id", squared_l2(F.col("v"), F.col("qv")).alias("raw"))
    if whole:
        parts = max(1, -(-n // cells.BLOCK))
        asked = asked.where("plain AND id IS NOT NULL")
        q_parts = max(1, -(-asked.count() // cells.BLOCK))
        dealt = lambda df, by: df.where("plain AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), *by)
        block, every = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"), lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        both = dealt(own, [block(parts).alias("part"), every(q_parts).alias("q_part"), F.lit(False).alias("asks")])
        both = both.unionByName(dealt(asked, [every(parts).alias("part"), block(q_parts).alias("q_part"), F.lit(True).alias("asks")]))

        def met(block: pa.Table) -> pa.Table:
            asks = block["asks"].to_numpy()
            ids, m = block["id"].to_numpy(), cells._matrix(block["v"], dims)
            found = [cells.candidates(q_id, ids[~asks], row, k) for at in range(0, asks.sum(), cells.AT_ONCE) for q_id, row in zip(ids[asks][at : at + cells.AT_ONCE], cells._squares(m[asks][at : at + cells.AT_ONCE], m[~asks]), strict=True)]
            columns = [np.concatenate([np.zeros(0, t), *(f[c] for f in found)]) for c, t in enumerate((np.int64, np.int64, np.float64))]
            return pa.table(columns, names=["query_id", "id", "raw"])

        kind = vectors.schema[id_col].dataType.simpleString()
        some = both.groupBy("part", "q_part").applyInArrow(met, "query_id long, id long, raw double")
        near = near.unionByName(some.select(F.col("query_id").cast(kind).alias("query_id"), F.col("id").cast(kind).alias("id"), "raw"))
    near = near.select("query_id", F.col("id").alias(id_col), F.round("raw", 6).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", id_col, "rank", "distance")


def overlap_ratio(results: DataFrame, *by: str) -> DataFrame:
    """(*by, n_retrieved, n_unique, reuse_ratio): the share of retrieved documents that others retrieved as well."""
    g = results.groupBy(*by).agg(F.count("*").alias("n_retrieved"), F.count_distinct("doc_id").alias("n_unique"))
    return g.withColumn("reuse_ratio", F.round(1 - F.col("n_unique") / F.col("n_retrieved"), 6))


def normalized_results(rows: DataFrame) -> DataFrame:
    """(doc_id, text): identifiers and texts under any of the names that sources use."""
    ids = [F.col(c).cast("string") for c in ("chunk_id", "document_id", "_id", "doc_id") if c in rows.columns]
    texts = [F.col(c) for c in ("text", "content") if c in rows.columns]
    return rows.select(F.coalesce(*ids).alias("doc_id"), F.coalesce(*texts).alias("text"))


def normalized_queries(rows: DataFrame) -> DataFrame:
    """(qid, text): given numbers; rows without one are numbered from 0 by their text, equal texts alike.

    Numbers are given inside ranges of texts and shifted by the counts of earlier ranges.
    """
    text = F.coalesce(*(F.col(c) for c in ("text", "question") if c in rows.columns))
    qid = F.col("qid").cast("string") if "qid" in rows.columns else F.lit(None).cast("string")
    own = rows.select(qid.alias("qid"), text.alias("text"))
    texts = own.where("qid IS NULL").select("text").distinct().withColumn("range", F.substring("text", 1, 2))
    counts = texts.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select(F.col("range").alias("r"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("range").orderBy("text")) - 1
    numbers = texts.withColumn("inside", inside).join(before, F.col("range").eqNullSafe(F.col("r"))).select(F.col("text").alias("t"), (F.col("inside") + F.col("before")).cast("string").alias("k"))
    given = own.where("qid IS NOT NULL")
    return given.unionByName(own.where("qid IS NULL").join(numbers, F.col("text").eqNullSafe(F.col("t"))).select(F.col("k").alias("qid"), "text"))


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, start, text): windows of words; a window begins every size - overlap words (size, if that is none)."""
    step = size - overlap if size > overlap else size
    w = docs.select(F.col(id_col), F.filter(F.split(text_col, r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
    return w.select(id_col, "w", F.explode(starts).alias("start")).select(id_col, "start", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text"))


#: Rows of a flattened tree that a task hands on at once.
NODES_A_BATCH = 10_000
NODE_FIELDS = [pa.field("path", pa.list_(pa.int32())), pa.field("place", pa.int64()), *(pa.field(name, pa.string()) for name in ("node_id", "title", "text"))]
NODE_OUT = "path array<int>, place bigint, node_id string, title string, text string"


def _text_of(value) -> str | None:
    return value if value is None or type(value) is str else str(value) if type(value) is int else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class _Nodes:
    """Columns of nodes; the paths lie behind each other in one list."""

    def __init__(self):
        self.doc, self.steps, self.ends, self.place, self.fields = [], [], [0], [], ([], [], [])

    def of(self, k: int, tree: str | None) -> Iterator[bool]:
        """Adds a tree's nodes, parents first, children in order, and stops where a batch is full; what is still to come is a list, so depth is no matter of the stack."""
        try:
            root = json.loads(tree) if tree else None
        except ValueError:
            root = None
        ahead, place = [((0,), root)], 0
        while ahead:
            path, node = ahead.pop()
            fields = node if isinstance(node, dict) else {}
            self.doc.append(k)
            self.steps += path
            self.ends.append(len(self.steps))
            self.place.append(place)
            for column, name in zip(self.fields, ("node_id", "title", "text"), strict=True):
                column.append(_text_of(fields.get(name)))
            place += 1
            children = fields.get("nodes")
            if isinstance(children, list):
                ahead.extend(((*path, j), children[j]) for j in range(len(children) - 1, -1, -1))
            if len(self.doc) >= NODES_A_BATCH:
                yield True

    def batch(self, docs: pa.Array) -> pa.RecordBatch:
        paths = pa.ListArray.from_arrays(pa.array(self.ends, type=pa.int32()), pa.array(self.steps, type=pa.int32()))
        columns = [docs.take(pa.array(self.doc, type=pa.int64())), paths, pa.array(self.place, type=pa.int64()), *(pa.array(c, type=pa.string()) for c in self.fields)]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field("doc", docs.type), *NODE_FIELDS]))


def flattened_tree(nodes: DataFrame, doc_col: str = "doc_name", json_col: str = "tree") -> DataFrame:
    """(doc, path, place, node_id, title, text) of a nested page tree: parents first, ``place`` counts a tree's nodes in that order.

    One pass whatever the depth; a task holds one tree at a time, and hands nodes of many small trees on together.
    A tree that is null or no JSON is one node of nulls, a field that is no text is its JSON, and children that are
    no list are none.
    """
    kind = nodes.schema[doc_col].dataType.simpleString()

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _Nodes()
            for k, tree in enumerate(batch.column(1)):
                for _ in made.of(k, tree.as_py()):
                    yield made.batch(batch.column(0)).rename_columns([doc_col, *(f.name for f in NODE_FIELDS)])
            if made.doc:
                yield made.batch(batch.column(0)).rename_columns([doc_col, *(f.name for f in NODE_FIELDS)])

    return nodes.select(doc_col, F.col(json_col).cast("string")).mapInArrow(walked, f"`{doc_col}` {kind}, {NODE_OUT}")


def memory_search(memories: DataFrame, queries: DataFrame, k: int, scope: tuple[str, ...], threshold: float | None = None) -> DataFrame:
    """(query_id, memory_id, rank, score): each query's best memories of its own scope.

    ``memories``: (memory_id, vector, *scope); ``queries``: (query_id, vector, *scope).  The first scope
    column must be equal (memories and queries meet by it); another one that is null in a query takes all.  The score is the cosine of the vectors; ties go to the smaller id.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    m = memories.select("memory_id", F.col("vector").alias("mv"), *(F.col(c).alias(f"m_{c}") for c in scope))
    first, rest = scope[0], scope[1:]
    inside = F.col(first) == F.col(f"m_{first}")
    for c in rest:
        inside = inside & (F.col(c).isNull() | (F.col(c) == F.col(f"m_{c}")))
    met = queries.join(m, inside)
    score = dot(F.col("vector"), F.col("mv")) / F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col("mv"), F.col("mv")))
    met = met.select("query_id", "memory_id", F.round(score, 6).alias("score"))
    if threshold is not None:
        met = met.where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def memory_corpus(memories: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc_id, text): memories as rows of a corpus, under their dense numbers as strings.  ``numbers``: (doc, doc_number)."""
    return memories.join(numbers, F.col("memory_id") == F.col("doc")).select(F.col("doc_number").cast("string").alias("doc_id"), "text")


def chunk_items(chunks_: DataFrame, items: DataFrame) -> DataFrame:
    """``chunks_`` (doc_name, node_id, ...) with ``item_id``: the first item of that document and node, or null."""
    first = items.groupBy("doc_name", "node_id").agg(F.min("item_id").alias("item_id"))
    return chunks_.join(first, ["doc_name", "node_id"], "left")


def tree_without(tree: Column, field: str = "text") -> Column:
    """A page tree's JSON without a string field, at any depth.

    Escaped signs stand aside as control characters, which JSON cannot hold, so that a string ends at the
    next quote and the pattern needs no repeated group, however long the text.
    """
    plain = F.replace(F.replace(tree, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    pair = rf'"{field}"\s*:\s*"[^"]*+"'
    left = F.regexp_replace(F.regexp_replace(plain, rf",\s*{pair}", ""), rf"{pair}\s*,?\s*", "")
    return F.replace(F.replace(left, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
