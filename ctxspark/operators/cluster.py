"""Hierarchical clustering of a batch of contexts into a prefix tree, and the orders that follow from it.

A batch (the contexts scheduled together) is clustered on its own, so batches run in parallel.  Batches of
up to ``max_batch`` contexts are linked on their matrix of distances in one task; larger ones on tables
(``rounds``), to the same merges, and a task holds their contexts and merges only.

The tree follows from the list of merges in four steps: a cluster's content is what all its contexts
share; each cluster has a head, the node that stands for it; every merge of two heads gives two links;
nodes without content are no nodes.

Rules: the nearest pair is merged first, ties by the smaller and then the larger of the two clusters' first
contexts; merges are numbered by distance, then size, then first context; distances are whole numbers
of 1e-9, so equal means are equal; a context's set seen before shares its head; a merge whose content an
existing third node has gets that node as its head.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import rounds
from .contexts import exploded
from .distance import ALPHA, GRAIN
from .shared import Scratch

LINKAGES = ("average", "complete", "single")
#: Contexts, or clusters that are left of them, of which one task holds the matrix.
MAX_BATCH = 4000


def distance_matrix(contexts: list[list[int]], alpha: float = ALPHA) -> np.ndarray:
    """All distances of lists without repeats, by the documents that lists share."""
    n = len(contexts)
    common, moved = np.zeros((n, n)), np.zeros((n, n))
    places: dict[int, tuple[list[int], list[int]]] = {}
    for k, docs in enumerate(contexts):
        for pos, d in enumerate(docs):
            who, where = places.setdefault(d, ([], []))
            who.append(k)
            where.append(pos)
    for who, where in places.values():
        if len(who) > 1:
            at, p = np.ix_(who, who), np.array(where)
            common[at] += 1
            moved[at] += np.abs(p[:, None] - p[None, :])
    size = np.array([len(c) for c in contexts])
    longer = np.maximum(np.maximum.outer(size, size), 1)
    out = np.where(common > 0, 1 - common / longer + alpha * moved / np.maximum(common, 1), 1.0)
    np.fill_diagonal(out, 0)
    return out



def joined(whole: np.ndarray, size: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """(first, second, distance in parts, size) of the merges of clusters, each named by its place; the first names both then.

    ``whole``: sums of the distances of two clusters' contexts, or the extreme one.  One matrix, changed in
    place: a merged cluster takes the first row of its own two, and only rows whose nearest row was one
    of these are searched anew.
    """
    n, size, alive = len(whole), size.astype(np.int64), np.ones(len(whole), bool)
    mean = whole / np.multiply.outer(size, size) if method == "average" else whole.astype(float)
    np.fill_diagonal(mean, np.inf)
    nearest = mean.min(axis=1) if n else np.zeros(0)
    merges = []
    for _ in range(n - 1):
        i = int(np.argmin(nearest))
        least = nearest[i]
        j = int(np.argmin(mean[i]))
        both = whole[i] + whole[j] if method == "average" else np.maximum(whole[i], whole[j]) if method == "complete" else np.minimum(whole[i], whole[j])
        size[i] += size[j]
        merges.append((i, j, float(least), int(size[i])))
        alive[j] = False
        whole[i] = whole[:, i] = both
        own = both / (size[i] * size) if method == "average" else both.astype(float)
        own[~alive] = own[i] = np.inf
        stale = alive & ((mean[:, i] == nearest) | (mean[:, j] == nearest))
        mean[i] = mean[:, i] = own
        mean[j] = mean[:, j] = np.inf
        nearest = np.minimum(nearest, own)
        stale[i], nearest[j] = True, np.inf
        nearest[stale] = mean[stale].min(axis=1)
    return merges


def numbered(n: int, merges: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    """(left, right, distance, size) by cluster numbers of merges by first contexts; cluster n + k is made by merge k."""
    number, out = list(range(n)), []
    for k, (i, j, far, size) in enumerate(sorted(merges, key=lambda m: (m[2], m[3], m[0]))):
        out.append((*sorted((number[i], number[j])), far / GRAIN, size))
        number[i] = n + k
    return out


def linkage(distances: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """(left, right, distance, size) of n - 1 merges; cluster n + k is made by merge k."""
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method!r}")
    n = len(distances)
    whole = np.rint(np.asarray(distances, float) * GRAIN).astype(np.int64)
    return numbered(n, joined(whole, np.ones(n, np.int64), method))


def contents(contexts: list[list[int]], merges: list[tuple]) -> list[frozenset]:
    """What all contexts of each cluster share, by cluster number."""
    shared = [frozenset(docs) for docs in contexts]
    for left, right, *_ in merges:
        shared.append(shared[left] & shared[right])
    return shared


def heads(n: int, merges: list[tuple], shared: list[frozenset]) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """The head of each cluster, and (cluster, head, head of left, head of right) of merges that join two heads.

    ``newest`` is the last node that was made with a content: a later one takes its place.
    """
    newest: dict[frozenset, int] = {}
    head = [newest.setdefault(shared[k], k) for k in range(n)]
    joins = []
    for c, (left, right, *_) in enumerate(merges, n):
        x, y = head[left], head[right]
        if x != y:
            known = newest.get(shared[c], x) if shared[c] else x
            own = c if known in (x, y) else known
            if own == c and shared[c]:
                newest[shared[c]] = c
            joins.append((c, own, x, y))
            head.append(own)
        else:
            head.append(x)
    return head, joins


@dataclass
class Node:
    content: frozenset
    members: frozenset  # contexts
    children: list[int]
    parent: int | None
    distance: float
    frequency: int


class Tree:
    """The prefix tree of one batch."""

    def __init__(self, contexts: list[list[int]], method: str = "average", alpha: float = ALPHA, merges: list[tuple] | None = None):
        self.contexts = contexts
        n = len(contexts)
        if merges is None:
            merges = linkage(distance_matrix(contexts, alpha), method) if n > 1 else []
        shared = contents(contexts, merges)
        head, joins = heads(n, merges, shared)
        members: dict[int, set[int]] = {}
        for k in range(n):
            members.setdefault(head[k], set()).add(k)
        weight = {k: len(m) for k, m in members.items()}
        below: dict[int, dict[int, None]] = {k: {} for k in weight}
        above: dict[int, int | None] = {}
        for c, own, x, y in joins:
            both = weight[x] + weight[y]
            weight[own] = both if own == c else max(weight[own], both)
            members[own] = members.get(own, set()) | members[x] | members[y]
            below.setdefault(own, {}).update(dict.fromkeys((x, y)))
            for k in (x, y):  # what ever hung below a node without content hangs below nothing
                above[k] = own if shared[own] and above.get(k, own) is not None else None
        kept = [k for k in sorted(weight) if shared[k] or n == 1]
        self.nodes: dict[int, Node] = {}
        for k in kept:
            far = merges[k - n][2] if k >= n else 0.0
            self.nodes[k] = Node(shared[k], frozenset(members[k]), [c for c in below[k] if c != k], above.get(k), far, weight[k])
        roots = [k for k in kept if self.nodes[k].parent is None]
        self.root = roots[0] if roots else None
        if len(roots) > 1 or n == 1:
            self.root = max(kept) + 1
            self.nodes[self.root] = Node(frozenset(), frozenset(), roots, None, 0.0, sum(weight[r] for r in roots))
            for r in roots:
                self.nodes[r].parent = self.root

    def walk(self) -> Iterator[tuple[int, list[int], list[int]]]:
        """(node, path of child numbers, ordered documents) from the root down."""
        if self.root is None:
            return
        stack: list[tuple[int, list[int], list[int]]] = [(self.root, [], [])]
        seen = set()
        while stack:
            k, path, prefix = stack.pop()
            if k in seen:
                continue
            seen.add(k)
            v = self.nodes[k]
            own = sorted(v.content) if v.children else list(self.contexts[min(v.members)])
            inside = set(prefix)
            docs = prefix + [d for d in own if d not in inside]
            yield k, path, docs
            stack += [(c, [*path, n], docs) for n, c in reversed(list(enumerate(v.children))) if c in self.nodes]

    def arranged(self) -> list[tuple[list[int], list[int]]]:
        """(reordered documents, path) of every context; contexts without a leaf keep their order and have no path."""
        out = [(list(c), []) for c in self.contexts]
        for k, path, docs in self.walk():
            if not self.nodes[k].children:
                for m in self.nodes[k].members:
                    out[m] = (docs or list(self.contexts[m]), path)
        return out

    def stats(self) -> dict[str, int]:
        leaf = sum(not v.children for v in self.nodes.values())
        return {"total_nodes": len(self.nodes), "leaf_nodes": leaf, "root_nodes": sum(v.parent is None for v in self.nodes.values()), "internal_nodes": len(self.nodes) - leaf}


def by_batch(contexts: DataFrame, batch: str, made: Callable[[object, list, Tree], list[tuple]], schema: T.StructType, method: str, alpha: float, max_batch: int) -> DataFrame:
    """The rows that ``made`` (batch, context ids, tree) gives for each batch, contexts in the order of ctx_id.

    Batches lie one after the other in sorted partitions: one worker takes many without a start for each.
    The number of partitions is fixed, as a batch costs far more time than its bytes tell.  Batches of more
    than ``max_batch`` contexts bring their merges with them.
    """
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method!r}")
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = contexts.select(F.col(batch).alias("b"), F.col("ctx_id").alias("c"), F.col("docs").cast("array<bigint>").alias("d"))
    rows = Scratch(contexts.sparkSession, "batches").written(rows)  # made once, to be counted and to be linked
    large = rows.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > max_batch)
    none = F.lit(None)
    merge = "struct<i:bigint,j:bigint,far:double,size:bigint>"
    both = rows.withColumn("m", none.cast(merge))
    if large.limit(1).count():
        own = rounds.merges(rows, large.select("b"), method, alpha, max_batch)
        both = both.unionByName(own.select("b", none.cast(rows.schema["c"].dataType).alias("c"), none.cast("array<bigint>").alias("d"), F.struct("i", "j", "far", "size").alias("m")))
    both = both.repartition(parts, "b").sortWithinPartitions("b", "c")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in batches for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        out: list[tuple] = []
        for key, group in itertools.groupby(rows, key=lambda row: row[0]):
            ids, lists, merges = [], [], []
            for _, c, docs, m in group:
                if m is None:
                    ids.append(c)
                    lists.append(docs)
                else:
                    merges.append((m["i"], m["j"], m["far"], m["size"]))
            known = None
            if len(ids) > max_batch:
                place = {c: k for k, c in enumerate(ids)}
                known = numbered(len(ids), [(place[i], place[j], far, size) for i, j, far, size in merges])
            out += made(key, ids, Tree(lists, method, alpha, known))
            if len(out) >= OUT_ROWS:
                yield _batch(out, kinds)
                out = []
        if out:
            yield _batch(out, kinds)

    return both.mapInArrow(run, schema)


#: Rows of an output batch, and then the rest of the last group.
OUT_ROWS = 2000


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def arranged(contexts: DataFrame, batch: str, method: str = "average", alpha: float = ALPHA, max_batch: int = MAX_BATCH) -> DataFrame:
    """(batch, ctx_id, docs, reordered, path) of every context; contexts of a batch in the order of ctx_id."""

    def made(key, ids: list, tree: Tree) -> list[tuple]:
        return [(key, c, docs, order, path) for c, docs, (order, path) in zip(ids, tree.contexts, tree.arranged(), strict=True)]

    numbers, places = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    own = [contexts.schema[batch], contexts.schema["ctx_id"], T.StructField("docs", numbers)]
    schema = T.StructType([*own, T.StructField("reordered", numbers), T.StructField("path", places)])
    return by_batch(contexts, batch, made, schema, method, alpha, max_batch)


def tree_nodes(contexts: DataFrame, batch: str, method: str = "average", alpha: float = ALPHA, max_batch: int = MAX_BATCH) -> DataFrame:
    """(batch, node_id, parent_id, child_no, path, docs, content, frequency, merge_distance, is_leaf): each batch's tree."""

    def made(key, ids: list, tree: Tree) -> list[tuple]:
        rows = []
        for k, path, docs in tree.walk():
            v = tree.nodes[k]
            rows.append((key, k, v.parent, path[-1] if path else None, path, docs, sorted(v.content), v.frequency, v.distance, not v.children))
        return rows

    schema = T.StructType([contexts.schema[batch], *T.StructType.fromDDL(NODE).fields])
    return by_batch(contexts, batch, made, schema, method, alpha, max_batch)


NODE = (
    "node_id bigint, parent_id bigint, child_no int, path array<int>, docs array<bigint>, content array<bigint>, "
    "frequency bigint, merge_distance double, is_leaf boolean"
)


def component_batches(contexts: DataFrame) -> DataFrame:
    """``contexts`` with ``component``: contexts that share documents, directly or through others.

    Labels are the smallest context reached; each round looks two steps further, and lineage is cut
    by reliable checkpoints.
    """
    spark = contexts.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        raise ValueError("set a checkpoint directory first")
    e = exploded(contexts).select("ctx_id", "doc")
    labels = contexts.select("ctx_id", F.col("ctx_id").alias("component"))
    while True:
        by_doc = e.join(labels, "ctx_id").groupBy("doc").agg(F.min("component").alias("low"))
        heard = e.join(by_doc, "doc").groupBy("ctx_id").agg(F.min("low").alias("low"))
        step = labels.join(heard, "ctx_id", "left").select("ctx_id", F.least("component", F.coalesce("low", "component")).alias("next"), "component")
        jump = step.join(step.select(F.col("ctx_id").alias("next"), F.col("next").alias("further")), "next", "left").select("ctx_id", F.coalesce("further", "next").alias("next"), "component").checkpoint()
        labels = jump.select("ctx_id", F.col("next").alias("component"))
        if not jump.where("next <> component").limit(1).count():
            break
    return contexts.join(labels, "ctx_id")
