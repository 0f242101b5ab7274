"""The context queries without SQL, row by row against plain models made from the same Parquet files."""

from collections import defaultdict
from fractions import Fraction

import pandas as pd
import pytest
from plans import exchanged
from test_cluster import model, plain_distance, plain_incremental, plain_search

from ctxspark.operators import cluster, contexts, distance
from ctxspark.plans import index_queries, registry

FOLDER = "/root/testdata/sf0.001"


def plain_merges(contexts):
    """Average linkage by whole numbers, nearest first, ties by first contexts; numbered by distance, size and first context."""
    far = {(i, j): round(plain_distance(a, b) * 1e9) for i, a in enumerate(contexts) for j, b in enumerate(contexts)}
    groups, out = {k: [k] for k in range(len(contexts))}, []
    while len(groups) > 1:
        d, a, b = min((Fraction(sum(far[x, y] for x in groups[a] for y in groups[b]), len(groups[a]) * len(groups[b])), a, b) for a in groups for b in groups if a < b)
        groups[a] += groups.pop(b)
        out.append((d, len(groups[a]), a, b))
    number, merges = list(range(len(contexts))), []
    for k, (d, _, a, b) in enumerate(sorted(out)):
        merges.append((*sorted((number[a], number[b])), float(d) / 1e9))
        number[a] = len(contexts) + k
    return merges


class Plain:
    """A batch's tree: node -> (content, children, parent, frequency, path, documents, distance)."""

    def __init__(self, contexts):
        n, merges = len(contexts), plain_merges(contexts)
        nodes = model(contexts, merges)
        first = {}
        for k, c in enumerate(contexts):
            first.setdefault(frozenset(c), k)
        roots = [k for k in sorted(nodes) if nodes[k][2] is None]
        top = roots[0] if roots else None
        if len(roots) > 1 or n == 1:
            top = max(nodes) + 1
            nodes = {k: (v[0], v[1], top if k in roots else v[2], v[3]) for k, v in nodes.items()}
            nodes[top] = (set(), roots, None, sum(nodes[r][3] for r in roots))
        self.rows, self.places, self.contexts = {}, {}, contexts
        todo = [(top, [], [])] if top is not None else []
        while todo:
            k, path, docs = todo.pop()
            content, children, parent, often = nodes[k]
            docs = docs + [d for d in (sorted(content) if children or k == top else contexts[first[frozenset(content)]]) if d not in docs]
            self.rows[k] = (parent, path[-1] if path else None, path, docs, sorted(content), often, merges[k - n][2] if n <= k < n + len(merges) and content else 0.0, not children)
            todo += [(c, [*path, place], docs) for place, c in enumerate(children)]
        for k, c in enumerate(contexts):
            leaf = [r for r in self.rows.values() if r[7] and set(r[4]) == set(c)]
            self.places[k] = (leaf[0][3], leaf[0][2]) if leaf else (c, [])


@pytest.fixture(scope="module")
def customers():
    """{customer: [(order, its suppliers)] by turn}."""
    lines = pd.read_parquet(f"{FOLDER}/lineitem.parquet").sort_values(["l_orderkey", "l_linenumber", "l_suppkey"])
    docs = {k: list(dict.fromkeys(v)) for k, v in lines.groupby("l_orderkey")["l_suppkey"]}
    orders = pd.read_parquet(f"{FOLDER}/orders.parquet").sort_values(["o_custkey", "o_orderdate", "o_orderkey"])
    out = defaultdict(list)
    for key, customer in zip(orders["o_orderkey"], orders["o_custkey"], strict=True):
        if key in docs:
            out[customer].append((key, docs[key]))
    return out


@pytest.fixture(scope="module")
def trees(customers):
    return {b: (sorted(own), Plain([docs for _, docs in sorted(own)])) for b, own in customers.items()}


def text(values, sep=","):
    return sep.join(str(v) for v in values)


def rows(spark, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in registry.queries()[name](spark, FOLDER).collect()), key=repr)


def scheduled(trees):
    """(batch, position, order, group, size, documents, given documents, path), batch by batch in order."""
    out = []
    for b, (own, tree) in trees.items():
        groups = defaultdict(list)
        for n, (key, docs) in enumerate(own):
            order, path = tree.places[n]
            groups[path[0] if path else -1].append((-len(path), path, key, order, docs))
        at = 0
        ordered = {g: sorted(members) for g, members in groups.items()}
        for g, members in sorted(ordered.items(), key=lambda x: (-len(x[1]), x[1][0][2])):
            for _, path, key, order, docs in members:
                out.append((b, at, key, g, len(members), order, docs, path))
                at += 1
    return out


def test_schedule_contexts(spark, trees):
    got = rows(spark, "schedule_contexts", "batch", "exec_pos", "ctx_id", "group_id", "group_size", "docs", "original_docs", "path")
    assert got == sorted(((*r[:5], text(r[5]), text(r[6]), text(r[7], ".")) for r in scheduled(trees)), key=repr)


def test_context_tree(spark, trees):
    got = rows(spark, "context_tree", "batch", "node_id", "parent_id", "child_no", "path", "docs", "content", "frequency", "merge_distance", "is_leaf")
    want = [(b, k, r[0], r[1], text(r[2], "."), text(r[3]), text(r[4]), r[5], round(r[6], 6), r[7]) for b, (_, tree) in trees.items() for k, r in tree.rows.items()]
    assert [g[:8] + g[9:] for g in got] == [w[:8] + w[9:] for w in sorted(want, key=repr)]
    assert [g[8] for g in got] == pytest.approx([w[8] for w in sorted(want, key=repr)], abs=2e-6)


def test_tree_stats(spark, trees):
    want = [(b, len(t.rows), sum(r[7] for r in t.rows.values()), sum(r[0] is None for r in t.rows.values()), sum(not r[7] for r in t.rows.values())) for b, (_, t) in trees.items() if t.rows]
    assert rows(spark, "tree_stats", "batch", "total_nodes", "leaf_nodes", "root_nodes", "internal_nodes") == sorted(want, key=repr)


def test_prefix_sharing(spark, trees):
    def mean(batches):
        shared = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for docs in batches for a, b in zip(docs, docs[1:], strict=False)]
        return sum(shared) / sum(map(len, batches))

    plan = defaultdict(list)
    for r in scheduled(trees):
        plan[r[0]].append(r)
    before = mean([[docs for _, docs in own] for own, _ in trees.values()])
    after = mean([[r[5] for r in sorted(own, key=lambda r: r[1])] for own in plan.values()])
    ((n, a, b),) = rows(spark, "prefix_sharing", "n_contexts", "mean_prefix_before", "mean_prefix_after")
    assert n == sum(len(own) for own, _ in trees.values()) and (a, b) == pytest.approx((before, after), abs=1e-6)


def test_evict_requests(spark, trees):
    want = []
    for b, (_, tree) in trees.items():
        def gone(k, tree=tree):
            r = tree.rows[k]
            below = [c for c, x in tree.rows.items() if x[0] == k]
            return all(gone(c) for c in below) if below else r[7] and len(r[3]) <= 3

        want += [(b, k, bool(r[2]) and gone(k)) for k, r in tree.rows.items()]
    assert rows(spark, "evict_requests", "batch", "node_id", "removed") == sorted(want, key=repr)


def test_trees_are_built_once_and_their_contexts_made_once(spark, monkeypatch):
    """What is counted, clustered and evicted from is read from tables."""
    read = []
    build = cluster.by_batch

    def noted(contexts, *rest):
        out = build(contexts, *rest)
        read.append(str(out._jdf.queryExecution().executedPlan()))
        return out

    monkeypatch.setattr(cluster, "by_batch", noted)
    made = index_queries.evict_requests(spark, FOLDER)
    assert "MapInArrow" not in str(made._jdf.queryExecution().executedPlan())
    assert len(read) == 1 and "l_linenumber" not in read[0]


def halves(customers):
    for b, own in customers.items():
        if own[5:]:
            yield b, [d for _, d in sorted(own[:5])], sorted(own[5:])


def test_live_search(spark, customers):
    want = []
    for b, known, new in halves(customers):
        tree = cluster.Tree(known)
        want += [(b, key, text(p, "."), n, o, h) for key, docs in new for p, n, o, h in [plain_search(tree, docs)]]
    assert rows(spark, "live_search", "batch", "ctx_id", "search_path", "node_id", "overlap", "has_prefix") == sorted(want, key=repr)


def test_incremental_build(spark, customers):
    want = []
    for b, known, new in halves(customers):
        made = [(key, *plain_incremental(known, [d for _, d in new])[n]) for n, (key, _) in enumerate(new)]
        made.sort(key=lambda r: (r[2][0] if r[2] else -1, -len(r[2]), not r[3], r[0]))
        want += [(b, key, at, path[0] if path else -1, text(order), text(path, "."), hit) for at, (key, order, path, hit) in enumerate(made)]
    assert rows(spark, "incremental_build", "batch", "ctx_id", "exec_pos", "group_id", "docs", "path", "matched") == sorted(want, key=repr)


def test_rows_of_contexts_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, 7, 3), (1, 8, 2), (1, 7, 1), (2, None, 1), (2, 9, None), (2, None, 2)], "c long, d long, at int")
    made = contexts.from_rows(rows, "c", "d", "at")
    assert exchanged(made, "ctx_id") == 1
    assert {r.ctx_id: r.docs for r in made.collect()} == {1: [7, 8], 2: [9, None]}


def test_tasks_of_cross_distances_are_not_merged(spark):
    """Pairs are counted up in as many tasks as are asked for, however few bytes are shuffled."""
    a = spark.createDataFrame([(1, [1, 2]), (2, [3])], "ctx_id long, docs array<long>")
    b = spark.createDataFrame([(8, [2, 1]), (9, [4])], "ctx_id long, docs array<long>")
    made = distance.cross(a, b)
    assert [tuple(r)[:3] for r in made.collect()] == [(1, 8, 2)]
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
