"""The stored index: ranks of the plain search, grown and merged, with blocks left unopened."""

import random

import pytest

from ctxspark.operators import postings, retrieve


def corpus(spark, n, seed=1, start=0):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    say = lambda: " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(200)], k=r.randint(0, 60)))
    return spark.createDataFrame([(start + k, r.choice([say(), say(), say() + " rare", None, ""])) for k in range(n)], "doc_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, "w0 w1 w5"), (1, "rare w0"), (2, "w150 w0 w0"), (3, "unknown"), (4, None), (5, "w7 w8 w9 w10 w11 rare"), (6, "w60 w0")], "item_id long, text string")


def ranks(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize(("block", "k"), [(4, 3), (16, 10), (128, 50)])
def test_ranks_are_those_of_the_plain_search(spark, tmp_path, asked, block, k):
    docs = corpus(spark, 400)
    index = postings.PostingsIndex(spark, str(tmp_path / "index"), folders=8, block=block)
    index.add(docs)
    found, opened = index.search(asked, k)
    assert ranks(found) == ranks(retrieve.bm25(docs, asked, k))
    row = opened.first()
    assert 0 < row["read"] <= row["blocks"]


def test_growing_and_merging(spark, tmp_path, asked):
    parts = [corpus(spark, 150, 1), corpus(spark, 90, 2, 1000), corpus(spark, 60, 3, 2000)]
    index = postings.PostingsIndex(spark, str(tmp_path / "index"), folders=4, block=8)
    docs = None
    for part in parts:
        index.add(part)
        docs = part if docs is None else docs.unionByName(part)
        assert ranks(index.search(asked, 5)[0]) == ranks(retrieve.bm25(docs, asked, 5))
    assert len(index._segments()) == 3
    index.merge()
    assert len(index._segments()) == 1
    assert ranks(index.search(asked, 5)[0]) == ranks(retrieve.bm25(docs, asked, 5))


def test_blocks_that_cannot_matter_stay_closed(spark, tmp_path):
    """A rare term fills the ranks: of the frequent term only blocks that can hold the documents found are opened."""
    rows = [(k, "often " * (1 + k % 3) + "filler " * 20) for k in range(2000)] + [(5000 + k, "rare rare rare often") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(0, "rare often")], "item_id long, text string")
    index = postings.PostingsIndex(spark, str(tmp_path / "index"), folders=4, block=16)
    index.add(docs)
    found, opened = index.search(asked, 5)
    assert ranks(found) == ranks(retrieve.bm25(docs, asked, 5))
    row = opened.first()
    assert row["read"] < row["blocks"] / 2


def test_an_empty_index(spark, tmp_path, asked):
    index = postings.PostingsIndex(spark, str(tmp_path / "index"))
    index.add(corpus(spark, 0))
    assert index.search(asked, 5)[0].count() == 0
