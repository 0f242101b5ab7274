"""Linkage, trees, orders and schedules against plain restatements and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.engine import ContextEngine, Settings
from ctxspark.operators import cluster, schedule
from ctxspark.operators import contexts as cx
from ctxspark.operators import distance, index, rounds
from ctxspark.operators.distance import GRAIN


def plain_distance(a, b, alpha=0.001):
    common = [d for d in a if d in b]
    if not common:
        return 1.0
    return 1 - len(common) / max(len(a), len(b)) + alpha * sum(abs(a.index(d) - b.index(d)) for d in common) / len(common)


def batches(n, seed=3):
    r = random.Random(seed)
    return [[r.sample(range(9), r.randint(1, 6)) for _ in range(r.randint(1, 9))] for _ in range(n)]


def test_distance_worked_case():
    assert plain_distance([1, 2, 3, 4], [2, 3, 9]) == pytest.approx(0.501)
    assert cluster.distance_matrix([[1, 2, 3, 4], [2, 3, 9]])[0, 1] == pytest.approx(0.501)


def test_distance_matrix_is_the_plain_one():
    for contexts in batches(60):
        m = cluster.distance_matrix(contexts)
        for i, a in enumerate(contexts):
            for j, b in enumerate(contexts):
                assert m[i, j] == pytest.approx(0 if i == j else plain_distance(a, b), abs=1e-9)


@pytest.mark.parametrize("method", cluster.LINKAGES)
def test_linkage_is_the_greedy_one(method):
    def plain(d):
        groups, out, nxt = {k: [k] for k in range(len(d))}, [], len(d)
        far = {"average": lambda v: sum(v) / len(v), "complete": max, "single": min}[method]
        while len(groups) > 1:
            pairs = [(round(far([d[x][y] for x in groups[a] for y in groups[b]]), 9), a, b) for a in groups for b in groups if a < b]
            dist, a, b = min(pairs)
            out.append((a, b, dist))
            groups[nxt] = groups.pop(a) + groups.pop(b)
            nxt += 1
        return out

    r = np.random.default_rng(5)
    for n in (2, 3, 7, 12):
        x = r.random((n, n))
        x = (x + x.T) / 2
        got = cluster.linkage(x, method)
        assert [(a, b) for a, b, *_ in got] == [(a, b) for a, b, _ in plain(x)]
        assert [g[2] for g in got] == pytest.approx([p[2] for p in plain(x)], abs=1e-6)


@pytest.mark.parametrize("contexts", batches(80, 9))
def test_tree_invariants(contexts):
    tree = cluster.Tree(contexts)
    assert sum(v.parent is None for v in tree.nodes.values()) == 1
    made = tree.arranged()
    for docs, (order, _) in zip(contexts, made, strict=True):
        assert sorted(order) == sorted(docs)
    for k, v in tree.nodes.items():
        for c in v.children:
            assert tree.nodes[c].parent == k
            assert v.content <= tree.nodes[c].content


def test_leaf_that_becomes_inner():
    made = cluster.Tree([[5, 1, 2], [1, 2, 3, 5], [1, 2, 4, 5]]).arranged()
    assert made[0] == ([5, 1, 2], [])
    assert made[1][0] == [1, 2, 5, 3] and made[2][0] == [1, 2, 5, 4]


def test_single_and_equal_contexts():
    assert cluster.Tree([[3, 1]]).arranged() == [([3, 1], [0])]
    assert cluster.Tree([[3, 1], [1, 3]]).arranged() == [([3, 1], [])] * 2
    assert cluster.Tree([[], [1, 2], []]).arranged() == [([], []), ([1, 2], []), ([], [])]


def model(contexts, merges):
    """The tree by its rules, clusters as plain sets: {node: (content, children, parent, frequency)} without a root above."""
    n = len(contexts)
    held = [set(c) for c in contexts]
    first = {k: min(j for j in range(n) if held[j] == held[k]) for k in range(n)}
    stands, made = dict(first), []  # made: (node, content) in the order of their making
    for k in range(n):
        if first[k] == k:
            made.append((k, held[k]))
    often = {k: sum(first[j] == k for j in range(n)) for k in set(first.values())}
    pairs = []
    for c, (a, b, *_) in enumerate(merges, n):
        held.append(held[a] & held[b])
        x, y = stands[a], stands[b]
        if x == y:
            stands[c] = x
            continue
        same = [k for k, content in made if content == held[c]]
        if held[c] and same and same[-1] not in (x, y):
            stands[c] = same[-1]
            often[same[-1]] = max(often[same[-1]], often[x] + often[y])
        else:
            stands[c] = c
            made.append((c, held[c]))
            often[c] = often[x] + often[y]
        pairs.append((stands[c], (x, y)))
    out = {}
    for k, content in made:
        if content:
            over = [p for p, two in pairs if k in two]
            children = list(dict.fromkeys(j for p, two in pairs if p == k for j in two))
            out[k] = (content, children, over[-1] if over and all(held[p] for p in over) else None, often[k])
    return out


def test_tree_is_the_model():
    for contexts in batches(400, 21):
        if len(contexts) > 1:
            tree = cluster.Tree(contexts)
            want = model(contexts, cluster.linkage(cluster.distance_matrix(contexts)))
            roots = [k for k, v in want.items() if v[2] is None]
            for k, (content, children, parent, often) in want.items():
                v = tree.nodes[k]
                top = parent if parent is not None or len(roots) == 1 else tree.root
                assert (set(v.content), v.children, v.parent, v.frequency) == (content, children, top, often)
            assert len(tree.nodes) == len(want) + (len(roots) > 1)


def frame(spark, contexts):
    return spark.createDataFrame([(b, k, d) for b, c in enumerate(contexts) for k, d in enumerate(c)], "batch long, ctx_id long, docs array<bigint>")


def test_schedule_is_a_permutation_and_sorted(spark):
    made = schedule.scheduled(cluster.arranged(frame(spark, batches(6)), "batch"), "batch").collect()
    for b in {r.batch for r in made}:
        rows = sorted((r for r in made if r.batch == b), key=lambda r: r.exec_pos)
        assert [r.exec_pos for r in rows] == list(range(len(rows)))
        sizes = [r.group_size for r in rows]
        assert sizes == sorted(sizes, reverse=True)
        for x, y in zip(rows, rows[1:], strict=False):
            if x.group_id == y.group_id:
                assert (-len(x.path), x.path, x.ctx_id) < (-len(y.path), y.path, y.ctx_id)


def test_pairs_expression_and_matrix_agree(spark):
    contexts = batches(1, 4)[0] + [[1, 2, 3, 4], [2, 3, 9]]
    df = frame(spark, [contexts]).drop("batch")
    got = {(r.ctx_i, r.ctx_j): r.distance for r in distance.pairs(df).collect()}
    m = cluster.distance_matrix(contexts)
    for i in range(len(contexts)):
        for j in range(i + 1, len(contexts)):
            assert got.get((i, j), 1.0) == pytest.approx(m[i, j], abs=1e-6)
    blocked = sorted(map(tuple, distance.pairs_blocked(df, 3).collect()))
    assert blocked == sorted(map(tuple, distance.pairs(df).collect()))
    a, b = df.select(F.col("ctx_id").alias("i"), F.col("docs").alias("a")), df.select(F.col("ctx_id").alias("j"), F.col("docs").alias("b"))
    for r in a.join(b, F.col("i") < F.col("j")).select("i", "j", distance.between(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == pytest.approx(m[r.i, r.j], abs=1e-6)


def test_prefix_functions(spark):
    row = spark.range(1).select(
        cx.reordered_with_prefix(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "ca"))).alias("r"),
        cx.common_prefix_length(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 2, 4)))).alias("n"),
        cx.common_prefix_length(F.array(F.lit(1)), F.array(F.lit(1))).alias("all"),
        cx.common_prefix_length(F.array().cast("array<int>"), F.array(F.lit(1))).alias("none"),
    ).first()
    assert row.r == ["c", "a", "b"] and (row.n, row["all"], row.none) == (2, 1, 0)


def test_components(spark):
    df = frame(spark, [[[1, 2], [2, 3], [9], [3, 4], [9, 8], [7]]]).drop("batch")
    got = {r.ctx_id: r.component for r in cluster.component_batches(df).collect()}
    assert got == {0: 0, 1: 0, 3: 0, 2: 2, 4: 2, 5: 5}


def test_search_follows_prefixes(spark):
    known = frame(spark, [[[1, 2, 3, 4, 5], [1, 2, 3, 6, 7], [10, 11, 12]]])
    asked = frame(spark, [[[1, 2, 3, 9], [50, 51], [12, 60]]])
    got = {r.ctx_id: r for r in index.searched(known, asked, "batch").collect()}
    assert got[0].has_prefix and got[0].overlap == 3
    assert (got[1].search_path, got[1].node_id, got[1].overlap) == ([], -1, 0)
    assert got[2].overlap == 1 and not got[2].has_prefix


def plain_search(tree, context, alpha=0.001):
    """(path, node, overlap, has_prefix) by walking down one tree."""
    docs = {k: d for k, _, d in tree.walk()}
    paths = {k: p for k, p, _ in tree.walk()}
    asked, at = set(context), tree.root
    while at is not None:
        near = [(plain_distance(context, docs[c], alpha), n, c) for n, c in enumerate(tree.nodes[at].children) if asked & set(docs[c])]
        if not near:
            return (paths[at], at, len(asked & set(docs[at])), True) if at != tree.root else ([], -1, 0, False)
        c = min(near)[2]
        if docs[c][0] not in asked or not tree.nodes[c].children:
            return paths[c], c, len(asked & set(docs[c])), docs[c][0] in asked
        at = c
    return [], -1, 0, False


def plain_incremental(known, new):
    """{place of the context: (reordered, path, matched)} of one batch."""
    tree = cluster.Tree(known)
    docs, paths = {k: d for k, _, d in tree.walk()}, {k: p for k, p, _ in tree.walk()}
    out, rest, more = {}, [], {}
    for n, c in enumerate(new):
        _, node, _, has_prefix = plain_search(tree, c)
        if node < 0:
            rest.append(n)
            continue
        v = tree.nodes[node]
        parent = node if v.children and has_prefix else v.parent
        head = [d for d in docs[node] if d in c] if has_prefix else []
        out[n] = head + [d for d in c if d not in head], [*paths[parent], len(tree.nodes[parent].children) + more.get(parent, 0)], True
        more[parent] = more.get(parent, 0) + 1
    base = len(tree.nodes[tree.root].children) + more.get(tree.root, 0) if tree.root is not None else 0
    for n, (order, path) in zip(rest, cluster.Tree([new[n] for n in rest]).arranged(), strict=True):
        out[n] = order, [path[0] + base, *path[1:]] if path else [], False
    return out


@pytest.mark.parametrize("most", [cluster.MAX_BATCH, 3])
def test_search_and_incremental_build_are_the_plain_ones(spark, monkeypatch, most):
    if most == 3:
        for f in (cluster.tree_nodes, cluster.arranged):
            monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], most))
    known, new = [*batches(12, 1), many(60, 5), [[], []]], [*batches(12, 2), many(50, 6), [[1, 2], []]]
    found = {(r.batch, r.ctx_id): (r.search_path, r.node_id, r.overlap, r.has_prefix) for r in index.searched(frame(spark, known), frame(spark, new), "batch").collect()}
    built = index.built_incrementally(frame(spark, known), frame(spark, new), "batch").collect()
    for b, contexts in enumerate(new):
        tree, want = cluster.Tree(known[b]), plain_incremental(known[b], contexts)
        assert [found[b, n] for n in range(len(contexts))] == [plain_search(tree, c) for c in contexts]
        own = {r.ctx_id: r for r in built if r.batch == b}
        assert {n: (r.reordered, r.path, r.matched) for n, r in own.items()} == want
        order = sorted(own, key=lambda n: (own[n].path[0] if own[n].path else -1, -len(own[n].path), not own[n].matched, n))
        assert [own[n].exec_pos for n in order] == list(range(len(order)))


def test_ranks_over_ranges(spark):
    df = spark.createDataFrame([(k % 3, 7 * k) for k in range(40)], "g int, v long")
    got = sorted((r.g, r.v, r.place) for r in cx.ranked(df, ["g"], "v", "place", 20).collect())
    assert got == sorted((g, v, n) for g in range(3) for n, v in enumerate(sorted(7 * k for k in range(40) if k % 3 == g)))


def test_incremental_build_keeps_documents(spark):
    known, asked = frame(spark, batches(4, 1)), frame(spark, batches(4, 2))
    for r in index.built_incrementally(known, asked, "batch").collect():
        assert sorted(r.docs) == sorted(r.reordered)


def test_pruning(spark):
    nodes = cluster.tree_nodes(frame(spark, [[[1, 2, 3], [1, 2, 4], [9, 8]]]), "batch").cache()
    leaves = [r.node_id for r in nodes.where("is_leaf").collect()]
    gone = spark.createDataFrame([(0, leaves[0]), (0, leaves[1])], "batch long, node_id long")
    got = {r.node_id: r.removed for r in index.pruned(nodes, gone, "batch").collect()}
    docs = {r.node_id: tuple(r.content) for r in nodes.collect()}
    for k, removed in got.items():
        own = [n for n in leaves if set(docs[k]) <= set(docs[n])]
        if docs[k]:
            assert removed == all(n in leaves[:2] for n in own)


def test_engine_with_names(spark):
    df = spark.createDataFrame([(0, 0, ["b", "a", "b"]), (0, 1, ["a", "c"]), (0, 2, ["z"])], "batch long, ctx_id long, docs array<string>")
    made = {r.ctx_id: r for r in ContextEngine().reorder(df).collect()}
    assert sorted(made[0].reordered) == ["a", "b"] and made[2].reordered == ["z"]
    asked = spark.createDataFrame([(0, "q0"), (1, "q1"), (2, "q2")], "ctx_id long, query string")
    assert all("<documents>" in r.system_prompt for r in ContextEngine().optimize_batch(df, asked, instruction="Be brief.").collect())
    with pytest.raises(ValueError):
        Settings(linkage="ward")


def many(n, seed, docs=40, most=6):
    """One batch with ties, far pairs that share a document, and contexts that share nothing."""
    r = random.Random(seed)
    out = [r.sample(range(docs), r.randint(0, most)) for _ in range(n)]
    return out + [[100, *range(200, 230)], [*range(300, 390), 100], [*range(400, 480), 100], [7000]]


@pytest.mark.parametrize("method", cluster.LINKAGES)
def test_large_batches_are_linked_as_small_ones(spark, method):
    """The merges of tables, to the end and handed over at several sizes, are those of the matrix."""
    contexts = [many(90, 1), many(40, 2, docs=200), [[1], [2], [3]], [[5, 6]] * 4 + [[6, 5]]]
    df = frame(spark, contexts)
    want = sorted(map(tuple, cluster.tree_nodes(df, "batch", method).collect()))
    for most in (1, 30) if method == "average" else (2,):
        assert sorted(map(tuple, cluster.tree_nodes(df, "batch", method, max_batch=most).collect())) == want


@pytest.mark.parametrize("method", cluster.LINKAGES)
def test_all_merges_without_spark(method):
    """Clusters at 1 and beyond, as the last task gets them."""
    for seed in range(60):
        r = random.Random(seed)
        n, low = r.randint(1, 9), r.random() < 0.5
        sizes = {k: 1 for k in range(n)}
        far = {(i, j): r.choice([GRAIN, GRAIN + 1000, GRAIN + 5000] + [GRAIN - 7000] * low) for i in range(n) for j in range(i) if r.random() < 0.6}
        shared = {}
        for (i, j), w in far.items():
            pair = (GRAIN - w if method == "average" else w), 1
            shared.setdefault(i, {})[j] = shared.setdefault(j, {})[i] = pair
        m = np.full((n, n), GRAIN, np.int64)
        for (i, j), w in far.items():
            m[i, j] = m[j, i] = w
        want = cluster.joined(m, np.ones(n, np.int64), method)
        assert sorted(rounds.left(dict(sizes), shared, method, n if low else 0)) == sorted(want)


def test_numbers_by_distance_size_and_first_context():
    """Ties: nearest first, then the clusters' first contexts; a cluster is numbered after those in it."""
    m = np.array([[0, 5, 1, 5], [5, 0, 5, 1], [1, 5, 0, 5], [5, 1, 5, 0]], float)
    assert [x[:2] for x in cluster.linkage(m)] == [(0, 2), (1, 3), (4, 5)]
    assert [x[:2] for x in cluster.linkage(np.ones((4, 4)) - np.eye(4))] == [(0, 1), (2, 4), (3, 5)]


def test_a_large_batch_with_a_null_key(spark):
    rows = [(None, k, [k % 3, 10 + k % 2]) for k in range(12)]
    df = spark.createDataFrame(rows, "batch long, ctx_id long, docs array<bigint>")
    want = sorted(map(tuple, cluster.arranged(df, "batch").collect()), key=repr)
    assert sorted(map(tuple, cluster.arranged(df, "batch", max_batch=3).collect()), key=repr) == want
