"""The vector index against brute force."""

import numpy as np
import pytest

from ctxspark.operators import cells, retrieve
from ctxspark.operators.shared import Scratch

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dims)) * 8
    return np.float32(middles[rng.integers(0, 12, n) * rng.integers(0, 2, n)] + rng.normal(size=(n, dims)))  # half of all lie in one group


def brute(vectors, queries, k):
    out = []
    for q, x in queries:
        keys = [(np.floor(((np.float64(v) - np.float64(x)) ** 2).sum() * 1e6 + 0.5), i) for i, v in vectors if i != q]
        out += [(q, i, place + 1, round(float(d) / 1e6, 6)) for place, (d, i) in enumerate(sorted(keys)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    v = clustered(600, 8, 3)
    v[500:560] = v[0]  # copies: ties by id
    return [(k * 7 - 50, x) for k, x in enumerate(v)]


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block,n_cells", [(cells.BLOCK, 20), (17, 5)])
def test_exact_search_is_brute_force(spark, rows, monkeypatch, block, n_cells):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "AT_ONCE", 4)
    asked = rows[::25] + [(10**9, rows[3][1])]
    index = cells.VectorIndex(spark, Scratch(spark, "t").path()).build(frame(spark, rows), cells=n_cells)
    found, work = index.search(frame(spark, asked), 10, probes=2)
    assert sorted((r.query_id, r.vec_id, r["rank"], round(r.distance, 6)) for r in found.collect()) == brute(rows, asked, 10)
    assert work["of"] == len(rows) * len(asked) and work["compared"] < (0.8 if n_cells == 20 else 1.01) * work["of"]


def test_recall_of_the_nearest_cells(spark, rows):
    index = cells.VectorIndex(spark, Scratch(spark, "t").path()).build(frame(spark, rows))
    queries = frame(spark, rows[::10])
    found, work = index.search(queries, 10, probes=8, exact=False)
    share = cells.recall(found, retrieve.vector_topk(frame(spark, rows), queries, 10)).first().recall
    assert share >= 0.9 and work["compared"] < work["of"] / 1.5


def test_probes_reach_the_recall_of_vectors_without_groups(spark):
    rng = np.random.default_rng(5)
    plain = frame(spark, list(enumerate(np.float32(rng.normal(size=(800, 16))))))
    index = cells.VectorIndex(spark, Scratch(spark, "t").path()).build(plain)
    queries = plain.where("vec_id % 8 = 0")
    found, _ = index.search(queries, 10, exact=False)
    assert cells.recall(found, retrieve.vector_topk(plain, queries, 10)).first().recall >= 0.9


def test_unusable_vectors_few_and_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    found, _ = cells.VectorIndex(spark, Scratch(spark, "t").path()).build(df).search(df, 10)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1, 1.0), (2, 1, 1, 1.0)]
    none = df.where("vec_id = 3")
    assert cells.VectorIndex(spark, Scratch(spark, "t").path()).build(none).search(df, 10)[0].collect() == []
