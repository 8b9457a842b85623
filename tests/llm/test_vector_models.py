import hashlib
import math
import random

import numpy as np
import pytest

from lorekeep.llm import codes, queries, whitening


def vectors(seed, n, width, spread=3.0):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(width, width))
    rows = [(i, [float(np.float32(x)) for x in (mixing @ rng.normal(size=width)) * spread], ["a", "b", None][i % 3]) for i in range(n)]
    rows += [(n, rows[0][1], "a"), (n, rows[0][1], "a"), (n + 1, None, "a"), (n + 2, [None, *rows[0][1][1:]], "b"), (n + 3, [math.nan, *rows[0][1][1:]], "b"), (n + 4, [math.inf, *rows[0][1][1:]], None), (n + 5, [], "a"), (n + 6, [1.0], "a"), (None, rows[3][1], "c")]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label string"


def kept(rows, scale, width):
    return [(k, [math.floor(scale * x) for x in v], g) for k, v, g in rows if v and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("width", [3, 20])
def test_whitening_by_brute_force(spark, width):
    rows = vectors(width, 200, width)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()
    good = [(k, [x + 1_000_000 for x in v]) for k, v, _ in kept(rows, 64, width)]
    fit = sorted({tuple(v) for _, v in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], float) / n
    values, basis = np.linalg.eigh(x.T @ x / n)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    most = min(16, width)
    assert len(got) == most * len(good) and {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-9 for r in got)
    for j in range(most):
        told = sorted(((r.vec_id is None, r.vec_id or 0, r.whitened, int(r.deviation), r.explained) for r in got if r.component == j + 1), key=lambda r: r[:2])
        want = sorted(((k is None, k or 0, float((np.array([n * a - s for a, s in zip(v, sums, strict=True)], float) / n) @ basis[:, j] / math.sqrt(values[j])), sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for k, v in good), key=lambda r: r[:2])
        sign = 1 if told[0][2] * want[0][2] > 0 else -1
        assert all(a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - sign * b[2]) < 1e-6 for a, b in zip(told, want, strict=True))
        assert all(abs(a[4] / (values[j] / np.trace(x.T @ x / n)) - 1) < 1e-9 for a in told)


def test_products_of_limbs_are_exact():
    rng = random.Random(1)
    for bits in (3, 20, 45, 62, 200):
        y = np.array([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(4)] for _ in range(50)], object)
        y = y if bits > 62 else y.astype(np.int64)
        want = [[sum(int(y[k, i]) * int(y[k, j]) for k in range(50)) for j in range(4)] for i in range(4)]
        assert whitening.exact_gram(y).tolist() == want
    edge = np.full((whitening.ROWS + 5, 2), -(1 << 21), np.int64)
    assert whitening.exact_gram(edge).tolist() == [[(whitening.ROWS + 5) << 42] * 2] * 2


def test_whitening_of_large_numbers_no_variance_and_no_rows(spark):
    rows = [(i, [1e12 + i, -3.0, float(i % 7)], None) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: False, 3: True}
    n, sums = 40, [sum(64 * (10**12 + i) for i in range(40)), -192 * 40, sum(64 * (i % 7) for i in range(40))]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((n * a - s) ** 2 for a, s in zip([64 * (10**12 + i), -192, 64 * (i % 7)], sums, strict=True)) for i in range(40)}
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], None)] * 3, SCHEMA), "vec_id", "embedding").collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in same)
    assert whitening.whiten(spark.createDataFrame([(1, None, None)], SCHEMA), "vec_id", "embedding").collect() == []
    clash = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(5)], "component long, _x array<double>")
    assert whitening.whiten(clash, "component", "_x").columns[0] == "_key"


def brute_codes(rows, width, entries=256, rounds=4):
    good = kept(rows, 1024, width)
    size, more = divmod(width, 4)
    ends = [0]
    for i in range(4):
        ends.append(ends[-1] + size + (i < more))
    drawn = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], np.int32 if max(map(abs, r[1])) < 1 << 31 else np.int64).tobytes()))[:entries]
    books = [[v[a:z] for _, v, _ in drawn] for a, z in zip(ends, ends[1:], strict=False)]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
            own = {}
            for _, v, _ in good:
                own.setdefault(nearest(v[a:z], books[p])[1], []).append(v[a:z])
            books[p] = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(books[p])]
    out, errors = [], {}
    for k, v, g in good:
        found = [nearest(v[a:z], books[p]) for p, (a, z) in enumerate(zip(ends, ends[1:], strict=False))]
        error = sum(d for d, _ in found)
        errors[g] = errors.get(g, 0) + error
        out.append((k, "".join(f"{j:02x}" for _, j in found), error, g))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((k, c, e, errors[g], sha) for k, c, e, g in out), key=str)


@pytest.mark.parametrize(("width", "n", "spread"), [(8, 300, 0.01), (10, 500, 3.0), (4, 700, 0.004)])
def test_codes_by_brute_force(spark, width, n, spread):
    rows = vectors(n, n, width, spread)
    got = codes.compress(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label").collect()
    assert sorted(((r.vec_id, r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in got), key=str) == brute_codes(rows, width)


def test_codes_of_few_rows_large_numbers_and_no_rows(spark):
    rows = [(i, [float(i % 3) * 1e9, 2.0, -1e9 * i, 0.5], "x") for i in range(9)]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label").collect()
    want = [(k, [math.floor(1024 * x) for x in v], g) for k, v, g in rows]
    assert sorted(((r.vec_id, r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in got), key=str) == brute_codes([(k, [x / 1024 for x in v], g) for k, v, g in want], 4)
    assert codes.compress(spark.createDataFrame([(1, None, "x")], SCHEMA), "vec_id", "embedding", "label").collect() == []
    short = codes.compress(spark.createDataFrame([(1, [0.5], None), (2, [7.0], None)], SCHEMA), "vec_id", "embedding", "label").collect()
    assert {(r.vec_id, r.code, int(r.error)) for r in short} == {(1, "00000000", 0), (2, "01000000", 0)}
    clash = spark.createDataFrame([(i, [float(i)] * 4, i % 2) for i in range(5)], "code long, error array<double>, label int")
    assert codes.compress(clash, "code", "error", "label").columns[0] == "_key"


def test_pruning_changes_nothing_and_measures_less():
    """Bounds shifted over rounds against all distances, with stored bounds in between."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, (256, 6))
    x = centres[rng.integers(0, 256, 3000)] + rng.integers(-40, 40, (3000, 6))
    old = centres + rng.integers(-9, 9, centres.shape)
    part, measured = codes.Rows.first(x, codes.Book(old)), 0
    for _ in range(4):
        new = old + rng.integers(-4, 4, old.shape)
        width, steps = codes.stored(part.lower)
        part.lower = steps.astype(float) * width.astype(float)[:, None]
        measured += part.again(codes.Book(new), codes._moves(old, new))
        all_ = ((x[:, None, :] - new[None]) ** 2).sum(axis=2)
        assert (part.code == all_.argmin(axis=1)).all()
        assert (part.lower <= np.sqrt(all_) + 1e-6).all() and (part.upper >= np.sqrt(all_.min(axis=1))).all()
        old = new
    assert 0 < measured < 0.1 * 4 * x.shape[0] * 256


def test_queries(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    told = queries.op11_slice_whitening(spark, sf_dir)
    assert told.count() == 16 * n and told.schema["deviation"].dataType.simpleString() == "bigint"
    assert queries.op13_elkan_codes(spark, sf_dir).count() == n
