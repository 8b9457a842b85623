"""Operator 11: whitening of embeddings by exact covariances.

Entries become integers. Over the fit list (each distinct integer vector once, n of them with sums S) the centred integers
n * x - S are split into limbs of LIMB bits; products of limbs over blocks of ROWS rows stay below 2**53, so float64
matrix products give them exactly. Limbs are put together again as integers of any size, tasks' sums are merged by
Spark, and only the covariance of d * d numbers, an exact fraction, comes to the driver, where its eigenvectors are taken.

Defined cases: see :func:`lorekeep.llm.vectors.integer_vectors` for what is dropped; repeated rows are one vector of the
fit list and rows of their own in the result; null keys are kept; an empty table gives an empty result; a component
whose eigenvalue is nothing (constant dimensions, fewer vectors than dimensions) has no whitened value (null), and
with no variance at all ``explained`` is null too. Other columns are not looked at; a key that has the name of a column
of the result is called ``_key`` there.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import cut
from .vectors import blocks, integer_vectors, unpacked

#: Bits of a limb; rows of a product: ROWS * 2 ** (2 * LIMB) is 2 ** 53.
LIMB, ROWS = 21, 1 << 11
#: Where sums are split in two for Spark's decimals.
HALF = 62


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` (integers, of 64 bits or of any size) as float64 limbs of LIMB bits, the last one with the sign."""
    out = []
    while x.size and (int(x.max()) >= 1 << LIMB or int(x.min()) < -(1 << LIMB)):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def exact_gram(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` as integers of any size."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), ROWS):
        parts = limbs(y[at : at + ROWS])
        sums: dict[int, np.ndarray] = {}
        for i, a in enumerate(parts):
            for j in range(i, len(parts)):
                product = (a.T @ parts[j]).astype(np.int64)
                sums[i + j] = sums.get(i + j, 0) + (product if i == j else product + product.T)  # below 2**53 each
        for k, v in sums.items():
            total = total + (v.astype(object) << (LIMB * k))
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, in 64 bits if they fit."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array([int(s) for s in sums], np.int64)


def squares(y: np.ndarray) -> list[int]:
    """Of each row the sum of its squares."""
    if y.dtype == object or (len(y) and int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 63):
        return (y.astype(object) ** 2).sum(axis=1).tolist()
    return (y * y).sum(axis=1).tolist()


def _totals(rows: DataFrame) -> dict[int, int]:
    """Sums of ``at, high, low`` rows (high * 2**HALF + low) by place; there are as many places as the model has numbers."""
    told = rows.groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {r["at"]: (int(r.high) << HALF) + int(r.low) for r in told}


def _told(places: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    at, values = zip(*places, strict=True) if places else ((), ())
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([int(v) >> HALF for v in values], kind), pa.array([int(v) & ((1 << HALF) - 1) for v in values], kind)], ["at", "high", "low"])


_TOLD = "at long, high decimal(38,0), low decimal(38,0)"


class Whitening:
    """n, the sums S, the components (columns), their eigenvalues and share of the variance."""

    def __init__(self, n: int, sums: list[int], gram: np.ndarray, most: int) -> None:
        self.n, self.sums = n, sums
        exact = [[Fraction(int(g), n**3) for g in row] for row in gram]
        trace = sum(exact[i][i] for i in range(len(sums)))
        unit = Fraction(1) if not trace else trace
        values, vectors = np.linalg.eigh(np.array([[float(c / unit) for c in row] for row in exact]))
        order = np.argsort(-values, kind="stable")[:most]
        values, self.vectors = values[order], vectors[:, order]
        self.live = values > len(sums) * np.finfo(float).eps if trace else np.zeros(len(values), bool)
        self.values = np.where(self.live, values * float(unit), 0.0)
        self.explained = [max(0.0, float(v)) if trace else None for v in values]

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of rows of n * x - S; of components without variance NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values), np.nan)


def fit(vectors: DataFrame, width: int, most: int) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct rows of ``_x``, and that fit list."""
    listed = cut(vectors.select("_x").distinct())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for b in blocks(batches, ROWS):  # 2**11 integers of 60 bits: halves are summed in 64 bits
            x = unpacked(b.column("_x"), width)
            high, low = (x >> 30).sum(axis=0), (x & ((1 << 30) - 1)).sum(axis=0)
            total = [t + v for t, v in zip(total, [*((int(h) << 30) + int(w) for h, w in zip(high, low, strict=True)), len(x)], strict=True)]
        yield _told(list(enumerate(total)))

    total = _totals(listed.mapInArrow(sums, _TOLD))
    n = total.get(width, 0)
    if not n or not width:
        return None, listed
    s = [total[i] for i in range(width)]
    upper = np.triu_indices(width)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width), object)
        for b in blocks(batches, ROWS):
            gram = gram + exact_gram(centred(unpacked(b.column("_x"), width), n, s))
        if gram.any():
            yield _told(list(enumerate(gram[upper].tolist())))

    told, gram = _totals(listed.mapInArrow(grams, _TOLD)), np.zeros((width, width), object)
    gram[upper] = [told.get(i, 0) for i in range(len(upper[0]))]
    gram = gram + np.triu(gram, 1).T
    return Whitening(n, s, gram, most), listed


def identity_error(listed: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance (divisor n) minus the identity."""
    width, live = len(model.sums), np.flatnonzero(model.live)
    shared = listed.sparkSession.sparkContext.broadcast(model)
    k = len(live)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moments = 0, np.zeros(k), np.zeros((k, k))
        for b in blocks(batches, ROWS):
            m = shared.value
            w = m.project(centred(unpacked(b.column("_x"), width), m.n, m.sums))[:, live]
            n, mean, moments = merged((n, mean, moments), (len(w), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0))))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([moments.tobytes()], pa.binary())], ["n", "mean", "moments"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (0, np.zeros(k), np.zeros((k, k)))
        for b in batches:
            for n, mean, moments in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                whole = merged(whole, (n, np.frombuffer(mean), np.frombuffer(moments).reshape(k, k)))
        yield pa.RecordBatch.from_arrays([pa.array([whole[0]], pa.int64()), pa.array([whole[1].tobytes()], pa.binary()), pa.array([whole[2].tobytes()], pa.binary())], ["n", "mean", "moments"])

    # A row of k * k numbers a task, folded by few tasks and then by one.
    schema = "n long, mean binary, moments binary"
    got = listed.mapInArrow(run, schema).repartition(32).mapInArrow(fold, schema).repartition(1).mapInArrow(fold, schema).collect()
    return float(np.abs(np.frombuffer(got[0].moments).reshape(k, k) / got[0].n - np.eye(k)).max())


def merged(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred moments of two parts as those of both."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


_NAMES = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whiten(df: DataFrame, key: str, vector: str, scale: int = 64, shift: int = 1_000_000, most: int = 16) -> DataFrame:
    """``key, component, n, deviation (decimal), whitened, explained, identity_error``: a row a vector and component.

    An entry c counts as the integer floor(scale * c) + shift; ``deviation`` is the exact sum of (n * x - S) ** 2.
    """
    rows, width = integer_vectors(df, key, vector, scale)
    rows = cut(rows.drop("_extra"))  # the shift is the same in x and in S / n and cancels in all that is told
    model, listed = fit(rows, width, most)
    error = identity_error(listed, model) if model else None
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, ROWS):
            y = centred(unpacked(b.column("_x"), width), shared.value.n, shared.value.sums)
            w = shared.value.project(y)
            told = [v if v < 10**38 else None for v in squares(y)]
            values = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # NaN as null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(told, pa.decimal128(38, 0)), lists], ["_key", "deviation", "w"])

    fields = [StructField("_key", rows.schema["_key"].dataType), *_parse_datatype_string("deviation decimal(38,0), w array<double>").fields]
    told = rows.mapInArrow(run, StructType(fields)) if model else df.sparkSession.createDataFrame([], StructType(fields))
    share = F.array(*(F.lit(e).cast("double") for e in model.explained)) if model else F.array().cast("array<double>")
    return told.select("_key", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("_key").alias("_key" if key in _NAMES else key), (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
