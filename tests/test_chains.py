"""Chains by intervals, against walks of the pointers."""

import random

import pytest

from ctxspark.operators import chains, multiturn


def walk(parents, r):
    """The chain before r, nearest first."""
    found, seen = [], {r}
    while parents.get(r) in parents and parents[r] not in seen:
        r = parents[r]
        seen.add(r)
        found.append(r)
    return found


def forest(seed, n):
    """Branches, chains, unknown and own parents, and circles with tails."""
    rng = random.Random(seed)
    parents = {}
    for k in range(n):
        parents[k] = rng.choice([None, 10_000, k] + [max(0, k - 1)] * 8 + [rng.randrange(max(1, k))] * 4)
    for size in (2, 3, 7):
        ring = rng.sample(range(n, n + 20), size)
        parents.update({a: b for a, b in zip(ring, ring[1:] + ring[:1], strict=True)})
        n += 20
        tail = ring[0]
        for k in range(n, n + 4):
            parents[k] = rng.choice([tail, ring[-1]])
            tail = k
        n += 4
    return parents


@pytest.fixture(scope="module", params=[1])
def case(request, spark):
    parents = forest(request.param, 120)
    rng = random.Random(request.param)
    docs = {k: rng.sample(range(30), rng.randrange(5)) for k in parents}
    df = spark.createDataFrame([*parents.items(), (None, 3)], "request_id long, parent_id long").repartition(5)
    return parents, docs, df, chains.numbered(df)


def test_numbers_are_preorders(case):
    parents, _, _, numbers = case
    rows = numbers.collect()
    assert sorted(r.request_id for r in rows) == sorted(parents)
    for root in {r.root for r in rows}:
        own = [r for r in rows if r.root == root]
        assert sorted(r.enter for r in own) == list(range(len(own))) and {r["size"] for r in own} == {len(own)}


def test_ancestors_are_walks(case):
    parents, _, df, _ = case
    got = sorted(map(tuple, multiturn.ancestors(df).collect()))
    assert got == sorted((r, a, k + 1) for r in parents for k, a in enumerate(walk(parents, r)))


def test_previous_documents(case, spark, monkeypatch):
    parents, docs, _, numbers = case
    table = spark.createDataFrame([(r, d) for r, ds in docs.items() for d in ds], "request_id long, doc int")
    want = {}
    for r in parents:
        for a in reversed(walk(parents, r)):
            for d in docs[a]:
                want.setdefault((r, d), a)
    for bits in (16, 2):
        monkeypatch.setattr(chains, "BLOCK_BITS", bits)
        got = chains.previous_documents(numbers, table).collect()
        assert sorted(map(tuple, got)) == sorted((*k, v) for k, v in want.items())


def test_cleared(case, spark, monkeypatch):
    parents, _, df, _ = case
    asked = random.Random(7).sample(sorted(parents), 6) + [max(parents), -5]
    table = spark.createDataFrame([(a,) for a in asked + asked[:2]], "request_id long")
    gone = {x for a in asked if a in parents for x in [a, *walk(parents, a)]}
    for bits in (16, 2):
        monkeypatch.setattr(chains, "BLOCK_BITS", bits)
        left, counts = multiturn.cleared(df, table)
        assert sorted(r.request_id for r in left.where("request_id IS NOT NULL").collect()) == sorted(set(parents) - gone)
        assert {r.request_id: r.removed for r in counts.collect()} == {a: 1 + len(walk(parents, a)) if a in parents else 0 for a in asked}


def test_no_requests_and_repeated_ones(spark):
    assert chains.ancestors(chains.numbered(spark.createDataFrame([], "request_id string, parent_id string"))).collect() == []
    twice = spark.createDataFrame([("b", "a"), ("b", "c"), ("a", None), ("c", "a"), ("a", None)], "request_id string, parent_id string")
    assert sorted(map(tuple, multiturn.ancestors(twice).collect())) == [("b", "a", 1), ("c", "a", 1)]


def test_a_long_chain(spark):
    """Numbers, lengths and first holders of a chain of 100,000 requests, of which every one has one document of three."""
    n = 100_000
    df = spark.range(n).selectExpr("id AS request_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    numbers = chains.numbered(df)
    assert numbers.where("enter <> request_id OR depth <> request_id OR leave <> 99999 OR root <> 0").count() == 0
    got = chains.previous_documents(numbers, df.selectExpr("request_id", "request_id % 3 AS doc")).groupBy("doc", "source_request").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, n - 1), (1, 1, n - 2), (2, 2, n - 3)]
    left, counts = multiturn.cleared(df, spark.createDataFrame([(60_000,)], "request_id long"))
    assert left.count() == n - 60_001 and counts.first().removed == 60_001


@pytest.mark.parametrize("tree", [4, 40])
def test_trees_by_walks_and_by_ranks(case, spark, monkeypatch, tree):
    """Large trees are ranked, small ones walked, whatever the blocks that ranges and places meet in."""
    parents, _, df, _ = case
    monkeypatch.setattr(chains, "TREE", tree)
    numbers = chains.numbered(df)
    test_numbers_are_preorders((parents, None, None, numbers))
    for bits in (0, 2):
        monkeypatch.setattr(chains, "FINE_BITS", bits)
        got = sorted(map(tuple, chains.ancestors(numbers).collect()))
        assert got == sorted((r, a, k + 1) for r in parents for k, a in enumerate(walk(parents, r)))


def test_small_trees_are_not_ranked(case, monkeypatch):
    """A walk of two elements a request, written and shuffled each round, is for trees that no task should hold."""

    def refused(nodes):
        raise AssertionError("a walk of small trees")

    monkeypatch.setattr(chains, "_links", refused)
    assert chains.numbered(case[2]).count() == len(case[0])
