"""Hierarchies against a plain search, on both paths, with dirt and cycles."""

import random

import numpy as np
import pytest

from flowspark.operators.hierarchy import contract, descendant_counts, descendants, hierarchy

NODES, EDGES = "dag_id long, node_id string, actor string", "dag_id long, src string, dst string, label string"


def plain(nodes, edges):
    """Status of every node by reachability."""
    v = {(g, n.strip()) for g, n in nodes if g is not None and n is not None}
    down, up = {}, {}
    for g, a, b in edges:
        if g is None or a is None or b is None:
            continue
        a, b = (g, a.strip()), (g, b.strip())
        if a in v and b in v:
            down.setdefault(a, set()).add(b)
            up.setdefault(b, set()).add(a)

    def reach(x):
        seen, todo = set(), list(down.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += down.get(y, ())
        return seen

    on = {x for x in v if x in reach(x)}
    below = set().union(*(reach(x) for x in on)) - on if on else set()
    out = {}
    for x in v:
        if x in on or x in below:
            out[x] = ("", -1 if x in on else -2)
            continue
        y, k = x, 0
        while up.get(y):
            y, k = min(up[y]), k + 1
        out[x] = (y[1], k)
    return out


def random_graphs(seed, graphs=12, size=25):
    r = random.Random(seed)
    nodes, edges = [], []
    for g in range(graphs):
        n = r.randint(1, size)
        names = [f"n{i}" for i in range(n)]
        nodes += [(g, x) for x in names]
        chain = r.random() < 0.3
        for i in range(1, n):
            if r.random() < 0.9:
                edges.append((g, names[i - 1 if chain else r.randrange(i)], names[i]))
        parent = {b: a for gg, a, b in edges if gg == g}
        for _ in range(r.choice([0, 0, 1, 2, 3])):  # edges back to an ancestor, or to itself
            x = r.choice(names)
            y = x
            while y in parent and r.random() < 0.7:
                y = parent[y]
            edges.append((g, x, y))
        if r.random() < 0.2 and n > 4:  # an intertwined core that is no tree
            edges += [(g, names[1], names[2]), (g, names[2], names[1]), (g, names[0], names[2]), (g, names[3], names[1]), (g, names[2], names[3])]
    return nodes, edges


def run(spark, nodes, edges, **kw):
    n = spark.createDataFrame([(g, v, "user") for g, v in nodes], NODES)
    e = spark.createDataFrame([(g, a, b, "x") for g, a, b in edges], EDGES)
    return {(r.dag_id, r.node_id): (r.root_id, r.depth) for r in hierarchy(spark, n, e, **kw).collect()}


@pytest.mark.parametrize("seed", range(40))
def test_contract_matches_search(seed):
    nodes, edges = random_graphs(seed, graphs=1, size=40)
    want = plain(nodes, edges)
    names = sorted(v for _, v in nodes)
    at = {v: i for i, v in enumerate(names)}
    e = sorted({(at[a], at[b]) for _, a, b in edges})
    root, depth, cycle = contract(np.array([a for a, _ in e], np.int64), np.array([b for _, b in e], np.int64), len(names))
    got = {(0, v): ("", -1) if cycle[i] >= 0 else ("", -2) if root[i] < 0 else (names[root[i]], int(depth[i])) for v, i in at.items()}
    assert {k: x for k, x in got.items() if x[1] < 0} == {k: x for k, x in want.items() if x[1] < 0}
    parents = {}
    for a, b in e:
        parents.setdefault(b, []).append(a)
    single = {(0, v) for v in names if all(len(parents.get(at[u], [])) <= 1 for u in names)}
    assert all(got[k] == want[k] for k in single)


@pytest.mark.parametrize("local", [50_000, 0])
def test_both_paths(spark, local):
    nodes, edges = random_graphs(7, graphs=8 if local else 4)
    edges = [x for x in edges if x[1:] not in [("n0", "n2"), ("n3", "n1")]]
    assert run(spark, nodes, edges, local_nodes=local, paths=False) == plain(nodes, edges)


def test_long_chain_needs_few_rounds():
    n = 20_000
    root, depth, cycle = contract(np.arange(n - 1), np.arange(1, n), n)
    assert (root == 0).all() and (depth == np.arange(n)).all() and (cycle < 0).all()


def test_dirt(spark):
    nodes = [(1, "a"), (1, "a "), (1, "b"), (1, None), (None, "z"), (2, "a"), (1, "lone")]
    edges = [(1, " a", "b "), (1, "a", "b"), (1, None, "b"), (1, "a", None), (1, "__ROOT__", "a"), (2, "a", "a"), (1, "b", "ghost")]
    assert run(spark, nodes, edges, paths=False) == {(1, "a"): ("a", 0), (1, "b"): ("a", 1), (1, "lone"): ("lone", 0), (2, "a"): ("", -1)}


def test_empty(spark):
    assert run(spark, [], [], paths=False) == {}
    assert run(spark, [(1, "a")], [], paths=False) == {(1, "a"): ("a", 0)}


@pytest.mark.parametrize("local", [50_000, 0])
def test_paths_and_descendants(spark, local):
    n = spark.createDataFrame([(1, v, "u") for v in "abcdx"], NODES)
    e = spark.createDataFrame([(1, "a", "b", ""), (1, "b", "c", ""), (1, "b", "d", ""), (1, "x", "x", "")], EDGES)
    t = hierarchy(spark, n, e, local_nodes=local)
    assert {r.node_id: r.path for r in t.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "d"], "x": None}
    assert {(r.node_id, r.descendant_id, r.distance) for r in descendants(t).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}
    assert {r.node_id: r.n_descendants for r in descendant_counts(t).collect()} == {"a": 3, "b": 2, "c": 0, "d": 0, "x": None}
