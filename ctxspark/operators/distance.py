"""Context distances through the inverted index: only pairs that share a document are made.

distance = 1 - common / longer + alpha * mean difference of places; a pair that shares nothing, and
so has no row, is at distance 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contexts import exploded

ALPHA = 0.001
#: Lists of up to so many documents travel with each of them.
TRAVELS = 64
#: Distances are counted in these parts of 1 where they are added up, so that sums and ties are exact.
GRAIN = 1_000_000_000


def distance_of(common: Column, moved: Column, n: Column, m: Column, alpha: float = ALPHA) -> Column:
    return F.round(1 - common / F.greatest(n, m) + F.lit(alpha) * moved / common, 6)


def pairs(contexts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(ctx_i, ctx_j, n_common, distance) of all pairs that share a document, ctx_i < ctx_j.

    Lists travel with their documents, so that a pair is whole where it meets: it comes from the first
    document that both have, and pairs are not shuffled.  Pairs with a list of more than ``TRAVELS`` documents,
    which would travel too often, are counted up by grouping.
    """
    e = contexts.select("ctx_id", F.size("docs").alias("n"), F.posexplode("docs").alias("pos", "doc"), "docs")
    own, overlap = e.where(F.col("n") <= TRAVELS), lambda c: F.coalesce(F.arrays_overlap(c, "docs_j"), F.lit(False))
    before, after = F.slice("docs", 1, F.col("pos")), F.slice("docs", F.col("pos") + 2, F.col("n"))
    a = own.select("doc", F.col("ctx_id").alias("ctx_i"), F.col("pos").alias("pos_i"), F.col("n").alias("n_i"), before.alias("before"), after.alias("after"))
    b = own.select("doc", F.col("ctx_id").alias("ctx_j"), F.col("pos").alias("pos_j"), F.col("n").alias("n_j"), F.col("docs").alias("docs_j"))
    met = a.join(b, "doc").where((F.col("ctx_i") < F.col("ctx_j")) & ~overlap("before")).withColumn("more", overlap("after"))
    rest = F.array_compact(F.array_intersect("after", "docs_j"))  # of the few pairs with more documents in common
    here, place = F.abs(F.col("pos_i") - F.col("pos_j")).cast("long"), lambda d: F.col("pos_i") + F.array_position("after", d) - F.array_position("docs_j", d) + 1
    moved = F.when(F.col("more"), F.aggregate(rest, here, lambda s, d: s + F.abs(place(d)))).otherwise(here)
    n_common = F.when(F.col("more"), F.size(rest) + 1).otherwise(1).cast("long")
    out = met.select("ctx_i", "ctx_j", n_common.alias("n_common"), distance_of(n_common, moved, F.col("n_i"), F.col("n_j"), alpha).alias("distance"))

    a, b = (e.select("doc", F.col("ctx_id").alias(f"ctx_{k}"), F.col("pos").alias(f"pos_{k}"), F.col("n").alias(f"n_{k}")) for k in ("a", "b"))
    long_ones = a.where(F.col("n_a") > TRAVELS).join(b, "doc").where((F.col("ctx_a") < F.col("ctx_b")) | ((F.col("n_b") <= TRAVELS) & (F.col("ctx_a") > F.col("ctx_b"))))
    # list lengths belong to the context: they ride along as group keys instead of being joined again
    found = long_ones.groupBy("ctx_a", "ctx_b", "n_a", "n_b").agg(F.count("*").alias("n_common"), F.sum(F.abs(F.col("pos_a") - F.col("pos_b"))).alias("moved"))
    far = distance_of(F.col("n_common"), F.col("moved"), F.col("n_a"), F.col("n_b"), alpha)
    return out.unionByName(found.select(F.least("ctx_a", "ctx_b").alias("ctx_i"), F.greatest("ctx_a", "ctx_b").alias("ctx_j"), "n_common", far.alias("distance")))


def cross(queries: DataFrame, targets: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(ctx_id, target_id, n_common, distance) of queries and targets that share a document.

    The number of tasks is fixed: pairs are counted up in a task's memory, of which the bytes that are shuffled tell little.
    """
    q = exploded(queries).repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")
    t = exploded(targets).select("doc", F.col("ctx_id").alias("target_id"), F.col("pos").alias("target_pos"), F.col("n").alias("m"))
    found = q.join(t, "doc").groupBy("ctx_id", "target_id", "n", "m").agg(F.count("*").alias("n_common"), F.sum(F.abs(F.col("pos") - F.col("target_pos"))).alias("moved"))
    return found.select("ctx_id", "target_id", "n_common", distance_of(F.col("n_common"), F.col("moved"), F.col("n"), F.col("m"), alpha).alias("distance"))


def between(a: Column, b: Column, alpha: float = ALPHA) -> Column:
    """The distance of two lists without repeats, as one expression."""
    common = F.array_intersect(a, b)
    moved = F.aggregate(common, F.lit(0).cast("long"), lambda s, d: s + F.abs(F.array_position(a, d) - F.array_position(b, d)))
    n = F.size(common)
    return F.when(n == 0, F.lit(1.0)).otherwise(distance_of(n, moved, F.size(a), F.size(b), alpha))


def _cross_matrix(a: list, b: list, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(n_common, distance) of two blocks of lists without repeats."""
    common, moved = np.zeros((len(a), len(b)), np.int32), np.zeros((len(a), len(b)), np.int32)
    places: dict = {}
    for side, lists in enumerate((a, b)):
        for k, docs in enumerate(lists):
            for pos, d in enumerate(docs):
                known = places.setdefault(d, ([], [], [], []))
                known[2 * side].append(k)
                known[2 * side + 1].append(pos)
    for rows, p, columns, q in places.values():
        if rows and columns:
            at = np.ix_(rows, columns)
            common[at] += 1
            moved[at] += np.abs(np.array(p, np.int32)[:, None] - np.array(q, np.int32)[None, :])
    longer = np.maximum.outer([len(x) for x in a], [len(x) for x in b])
    return common, 1 - common / np.maximum(longer, 1) + alpha * moved / np.maximum(common, 1)


def pairs_blocked(contexts: DataFrame, block: int = 1000, alpha: float = ALPHA) -> DataFrame:
    """The rows of ``pairs``, for contexts that nearly all share documents.

    Where a document is in a large part of the contexts, the inverted index makes more rows than there
    are pairs.  Here contexts are dealt in blocks, every pair of blocks is one task's matrix, and a row
    travels once for each block: the work is the number of pairs, whatever documents are shared.
    """
    n = max(1, -(-contexts.count() // block))
    own = contexts.select("ctx_id", "docs").withColumn("b", F.pmod(F.xxhash64("ctx_id"), F.lit(n)).cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("ctx_id", "docs", "b", F.least("b", "other").alias("low"), F.greatest("b", "other").alias("high"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        x, y = frame[frame["b"] == low], frame[frame["b"] == high]
        common, far = _cross_matrix(x["docs"].tolist(), y["docs"].tolist(), alpha)
        i, j = x["ctx_id"].to_numpy(), y["ctx_id"].to_numpy()
        found = common > 0
        if low == high:
            found &= i[:, None] < j[None, :]
        r, c = np.nonzero(found)
        return pd.DataFrame({"ctx_i": np.minimum(i[r], j[c]), "ctx_j": np.maximum(i[r], j[c]), "n_common": common[r, c].astype(np.int64), "distance": np.round(far[r, c], 6)})

    kind = contexts.schema["ctx_id"].dataType.simpleString()
    return sent.groupBy("low", "high").applyInPandas(run, f"ctx_i {kind}, ctx_j {kind}, n_common bigint, distance double")
