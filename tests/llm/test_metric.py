import math
import random

import numpy as np

from lorekeep.llm import metric
from lorekeep.llm.graph import components


def rows_of(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    out = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=8) * spread * (i % 4)
        out.append((i, [float(np.float32(x)) for x in v], i % 2 if i % 11 else None))
    out += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0, None] + [0.0] * 6, 1), (1003, [float("nan")] * 8, 0), (1004, [float("inf")] + [1.0] * 7, 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (None, [1.0, 2.0], 0), (5, out[5][1], out[5][2]), (5, out[5][1], out[5][2])]
    return out


def brute(rows, least):
    good = [i for i, (_, v, l) in enumerate(rows) if v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    up[max(root(a), root(b))] = min(root(a), root(b))
    first = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            first[root(i)] = min(k, first.get(root(i), k))
    return sorted(((k, links[i], first.get(root(i), k)) for i, (k, _, _) in enumerate(rows)), key=str)


def test_by_brute_force(spark, monkeypatch):
    for per_pivot, block, seed, spread in ((1024, 4096, 1, 0.1), (10, 4096, 2, 0.1), (5, 8, 3, 0.3)):
        monkeypatch.setattr(metric, "PER_PIVOT", per_pivot)
        monkeypatch.setattr(metric, "BLOCK", block)
        rows = rows_of(seed, 150, spread)
        df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<double>, label int, id string, cell double")
        got = metric.range_join(df, "vec_id", "embedding", "label", 0.98).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 0.98)


def test_cells_are_parted_again_and_dense_ones_are_not(spark, monkeypatch):
    monkeypatch.setattr(metric, "PER_PIVOT", 8)
    monkeypatch.setattr(metric, "MOST_PIVOTS", 3)
    monkeypatch.setattr(metric, "BLOCK", 16)
    for most, passes in ((8, 3 * 64 * 8), (0.5, 64 << 20)):  # small passes; and cells whose parting is refused
        monkeypatch.setattr(metric, "MOST_COPIES", most)
        monkeypatch.setattr(metric, "PIVOT_BYTES", passes)
        rows = rows_of(4, 200, 0.2)
        got = metric.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label", 0.98).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 0.98)


def test_close_calls_are_decided_on_the_given_vectors():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = rng.normal(size=16) * 1e200, rng.normal(size=16) * 1e-3
        cosine = metric.exact_cosine(a, b)
        assert metric.similar(a[None], b[None], cosine)[0, 0] and not metric.similar(a[None], b[None], np.nextafter(cosine, 2))[0, 0]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert metric.range_join(df, "vec_id", "embedding", "label", 0.98).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (201, 202), (202, 201)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in up}


def test_names_that_clash_are_replaced(spark, monkeypatch):
    rows = rows_of(5, 60, 0.02)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(map(str, (tuple(r) for r in metric.range_join(df, "vec_id", "embedding", "label", 0.98).collect())))
    real = metric.F.xxhash64
    monkeypatch.setattr(metric.F, "xxhash64", lambda *c: metric.F.lit(7).cast("long") if isinstance(c[0], str) and c[0] == "_label" else real(*c))
    assert sorted(map(str, (tuple(r) for r in metric.range_join(df, "vec_id", "embedding", "label", 0.98).collect()))) == want
