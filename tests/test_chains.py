"""Chains, layers and first-seen sets against exhaustive search."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import chains, graph


def longest(edges, root, depth):
    """(edges, least path) over all simple paths."""
    best = (0, [root])
    stack = [[root]]
    while stack:
        path = stack.pop()
        if (len(path) - 1, [-x for x in path]) > (best[0], [-x for x in best[1]]):
            best = (len(path) - 1, path)
        if len(path) <= depth:
            stack += [[*path, d] for s, d in edges if s == path[-1] and d not in path]
    return best


@pytest.mark.parametrize(("nodes", "degree", "depth"), [(9, 2.5, 7), (8, 5, 3), (10, 1.3, 7)])
def test_chains_by_exhaustive_search(spark, nodes, degree, depth):
    rng = random.Random(nodes)
    edges = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(int(nodes * degree))})
    df = spark.createDataFrame(edges, "src long, dst long")
    roots = spark.createDataFrame([(i,) for i in range(0, nodes, 2)] + [(99,), (None,)], "node long")
    got = {r.root: (r.depth, r.path) for r in chains.chains(df, roots, depth).collect()}
    assert got == {r: longest(edges, r, depth) for r in [*range(0, nodes, 2), 99]}
    top = [(r.root, r.depth) for r in chains.top_chains(df, roots, 3, depth).collect()]
    assert top == sorted([(r, d) for r, (d, _) in got.items() if d], key=lambda x: (-x[1], x[0]))[:3]


def test_dense_graphs_stay_small():
    """All paths of a complete graph of 12 nodes to one node, seven edges long at most: few are kept."""
    from itertools import combinations

    for p, left in ((1, 6), (2, 5), (3, 4), (4, 3), (5, 2), (6, 1)):
        kept = []
        for own in combinations(range(11), p):
            if chains.hits_all(kept, frozenset(own), left):
                kept.append(frozenset(own))
        assert len(kept) <= {1: 7, 2: 21, 3: 35, 4: 35, 5: 21, 6: 7}[p]
        # whatever extension some path allows, a kept one allows too
        for y in combinations(range(11), left):
            assert any(not set(y) & set(o) for o in combinations(range(11), p)) == any(not set(y) & k for k in kept)


def test_contracted_and_layered(spark):
    edges = spark.createDataFrame([("a1", "b1"), ("a2", "b1"), ("b1", "c1"), ("c1", "c2"), ("a1", "c2"), ("x", "y"), ("y", "x"), ("c1", "x")], "src string, dst string")
    groups = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C"), ("c2", "C"), ("x", "X"), ("y", "Y")], "node string, group string")
    small = chains.contracted(edges, groups)
    assert sorted(map(tuple, small.collect())) == [("A", "B", 2), ("A", "C", 1), ("B", "C", 1), ("C", "X", 1), ("X", "Y", 1), ("Y", "X", 1)]
    layers = chains.layered(small, groups.select(F.col("group").alias("node")))
    assert sorted(map(tuple, layers.collect())) == [("A", 0), ("B", 1), ("C", 2), ("X", 3), ("Y", 4)]


def test_first_seen(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["p", "q", None]), i, [rng.choice("abcdef") for _ in range(rng.randint(0, 3))], rng.choice(["t1", "t2", None])) for i in rng.sample(range(1000), 120)] + [("lonely", 5000, None, None)]
    df = spark.createDataFrame(rows, "s string, at long, files array<string>, title string")
    got = {r.s: (r.files, r.titles) for r in chains.first_seen(df, "s", "at", files=F.col("files"), titles=F.array("title")).collect()}
    want = {}
    for s, _, f, t in sorted(rows, key=lambda r: r[1]):
        own = want.setdefault(s, ([], []))
        own[0].extend(x for x in dict.fromkeys(f or []) if x not in own[0])
        own[1].extend(x for x in [t] if x and x not in own[1])
    assert got == {s: (list(f), list(t)) for s, (f, t) in want.items()}
    assert graph.longest_chains(spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([(1,)], "node long")).collect()[0].depth == 1


def test_top_chains_search_few_roots(spark, monkeypatch):
    """The best of a graph with circles, equal to those of all roots; only roots of the longest walks are searched."""
    rng = random.Random(3)
    edges = [(i, j) for i in range(120) for j in ((i + 1) % 6 if i < 6 else rng.randrange(i),)] + [(i, i) for i in range(9)] + [(70, 71), (71, 70)]
    graph, roots = spark.createDataFrame(edges, "src long, dst long"), spark.range(120).withColumnRenamed("id", "node")
    whole, asked = chains.chains, []
    want = [tuple(r) for r in whole(graph, roots, 7).where("depth > 0").orderBy(F.desc("depth"), "root").limit(2).collect()]
    monkeypatch.setattr(chains, "chains", lambda e, r, d=7: asked.append(r.count()) or whole(e, r, d))
    assert [tuple(r) for r in chains.top_chains(graph, roots, 2).collect()] == want
    assert asked[0] == 32


@pytest.mark.parametrize("seed", range(2))
def test_top_chains_of_any_length(spark, seed):
    """Chains longer than any bound, in graphs without circles and with some, against exhaustive search."""
    rng = random.Random(seed)
    nodes = 14
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(24)]
    edges = [*sorted({(max(p), min(p)) for p in pairs} | {(i + 1, i) for i in range(9)} | {(40, 41)}), (None, 3), (3, None)]
    if seed % 2:
        edges += [(0, 30), (30, 31), (31, 32), (32, 30), (31, 1)]
    known = [e for e in edges if None not in e]
    every = sorted({x for e in known for x in e} | {99})
    want = sorted(((r, *longest(known, r, 60)) for r in every), key=lambda x: (-x[1], x[0]))
    df, roots = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in [*every, None]], "node long")
    assert [(r.root, r.depth, r.path) for r in chains.top_chains(df, roots, 4, None).collect()] == [w for w in want if w[1]][:4] and want[0][1] > 8
    some = roots.where("node % 3 = 0")
    assert [(r.root, r.depth, r.path) for r in chains.top_chains(df, some, 4, None).collect()] == [w for w in want if w[1] and w[0] % 3 == 0][:4]
    assert chains.top_chains(df.where("false"), roots, 4, None).collect() == []


def test_top_chains_search_on_until_no_root_is_better(spark):
    """Roots of endless walks and short chains come first; the longest chains are those of the last roots, which further rounds reach."""
    edges = [x for i in range(0, 2000, 2) for x in ((i, i + 1), (i + 1, i))] + [(3000 + i, 3001 + i) for i in range(7)]
    got = chains.top_chains(spark.createDataFrame(edges, "src long, dst long"), spark.range(4000).withColumnRenamed("id", "node"), 3).collect()
    assert [(r.root, r.depth) for r in got] == [(3000, 7), (3001, 6), (3002, 5)]
