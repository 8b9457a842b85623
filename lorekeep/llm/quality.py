"""Operator 9: naive Bayes support vectors for document quality.

Token n-grams (n = 1, 2) are hashed to a fixed number of indicators, scaled by the log-count ratio
of the classes, set to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent; a logistic curve fitted to cross-validated margins turns the margin into a score.

Defined cases: a null or empty text has no features and scores the intercept; labels that are null
are not learnt from, and several labels of one document count as their majority (ties: 1); an
unlabelled or one-class training set gives a constant score; a null id is not held out. An id
may be of any type. Other columns are not looked at; a ``score`` column is replaced. Rows are scored one by one, so repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, small_batches

#: Size of the hashed indicator space.
BUCKETS = 1 << 18
#: The training set: at most about so many labelled documents, those of the least hash of their id.
MAX_TRAIN = 16_000
#: Features of the training set, at most about (4 bytes each, in the one task that fits).
MAX_FEATURES = 1 << 27
#: Seen in fewer training documents than this, an n-gram counts for nothing.
MIN_DOCS = 3
EPOCHS, COST, SMOOTH = 12, 1.0, 1.0
#: Tokens whose codes a task remembers.
MEMORY = 200_000
#: What a token is written as that stands twice running.
AGAIN = zlib.crc32(b"\x03")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class _Codes(dict):
    """Token to hash; capital words and numbers share one code each."""

    def __missing__(self, token: str) -> int:
        kind = "\x01" if len(token) > 1 and token.isupper() else "\x02" if token.isdecimal() else token.lower()
        code = zlib.crc32(kind.encode("utf-8", "surrogatepass"))
        if len(self) < MEMORY:
            self[token] = code
        return code


def indicators(text: str | None, codes: _Codes) -> np.ndarray:
    """The distinct hashed n-grams of a text, ascending."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    one[1:][one[1:] == one[:-1]] = AGAIN
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)
    both = np.concatenate([one * np.uint64(0xC2B2AE3D27D4EB4F), two * np.uint64(0x9E3779B97F4A7C15)])
    return np.unique(both >> np.uint64(46)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Weight of each indicator (ratio times hinge weight), intercept, and the logistic curve."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / math.sqrt(len(at)) + self.intercept) if len(at) else self.intercept

    def score(self, at: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.margin(at) + self.shift))))


def log_ratio(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """ln of the classes' smoothed shares of each indicator; 0 where it is too rare."""
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(d for d, v in zip(docs, y, strict=True) if v == c)]), minlength=BUCKETS) for c in (0, 1)]
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    return np.where(counts[0] + counts[1] >= MIN_DOCS, ratio, 0.0)


def dual_descent(docs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and intercept by dual coordinate descent; classes weigh alike."""
    sign = np.where(y == 1, 1.0, -1.0)
    share = max(1e-9, y.mean()), max(1e-9, 1 - y.mean())
    cost = np.where(y == 1, 0.5 / share[0], 0.5 / share[1]) * COST
    scaled = [ratio[d] / math.sqrt(max(1, len(d))) for d in docs]
    norm = np.array([float(x @ x) + 1.0 for x in scaled])
    w, b, alpha, rng = np.zeros(BUCKETS), 0.0, np.zeros(len(docs)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(docs)):
            gradient = sign[i] * (w[docs[i]] @ scaled[i] + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * sign[i]:
                w[docs[i]] += step * scaled[i]
                b += step
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve, by damped Newton steps."""
    a, b, target = 1.0, 0.0, np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * margins).sum(), g.sum()])
        step /= max(1.0, np.abs(step).max() / 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def fit(docs: list[np.ndarray], y: np.ndarray, folds: int = 3) -> Model:
    """Fit on all rows; the logistic curve sees margins of rows that their fold's model did not see."""
    if len(y) < 2 * folds or y.min() == y.max():
        prior = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), 0.0, 1.0, math.log(prior / (1 - prior)))
    fold, margins = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        seen = [d for d, f in zip(docs, fold, strict=True) if f != k]
        ratio = log_ratio(seen, y[fold != k])
        w, b = dual_descent(seen, y[fold != k], ratio)
        part = Model(w * ratio, b, 1.0, 0.0)
        margins[fold == k] = [part.margin(d) for d, f in zip(docs, fold, strict=True) if f == k]
    ratio = log_ratio(docs, y)
    w, b = dual_descent(docs, y, ratio)
    return Model(w * ratio, b, *logistic(margins, y))


def held_out(column: str = "doc_id"):
    """crc32 of the id as text is divisible by 5; a null id is not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    """Learn from labelled rows that are not held out: at most about ``max_train`` of them, of about ``max_features`` features in all.

    Features are drawn by all tasks; one task fits on the bounded sample; only the model (2 MB,
    whatever the input) comes to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    known = known.where(~held_out("doc_id")).withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    total = known.count()
    limit = (1 << 30) if total <= max_train else int((1 << 30) * max_train / total)
    sample = F.broadcast(known.where(F.col("_h") < limit))  # at most about max_train rows of 3 numbers
    # A text has at most as many features as bytes, and BUCKETS; the sample shrinks where long texts would outgrow max_features.
    texts = docs.select("doc_id", F.least(F.octet_length("text"), F.lit(BUCKETS)).alias("_n")).join(sample, "doc_id")
    weight = texts.agg(F.sum("_n")).first()[0] or 0
    if weight > max_features:
        sample = F.broadcast(known.where(F.col("_h") < int(limit * max_features / weight)))

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = _Codes()
        texts, ids, ys = (batch.column(c).to_pylist() for c in ("text", "doc_id", "_y"))
        packed = [indicators(t, codes).astype(np.int32).tobytes() for t in texts]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ys, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "y", "at"])

    labelled = docs.select("doc_id", "text").join(sample, "doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))
    drawn = per_row(labelled, ["doc_id", "text", "_y"], draw, "doc_id string, y int, at binary")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(i, y, at) for b in batches for i, y, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "at")), strict=True)})
        model = fit([np.frombuffer(at, np.int32).astype(np.int64) for _, _, at in rows], np.array([y for _, y, _ in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), *(pa.array([v], pa.float64()) for v in (model.intercept, model.slope, model.shift))], ["w", "b", "slope", "shift"])

    row = drawn.repartition(1).mapInArrow(learn, "w binary, b double, slope double, shift double").collect()
    if not row:
        return fit([], np.zeros(0, np.int64))
    return Model(np.frombuffer(row[0].w, np.float32).astype(np.float64), row[0].b, row[0].slope, row[0].shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1); the text alone decides it, one narrow pass."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes = shared.value, _Codes()
        for batch in batches:
            scores = [model.score(indicators(t, codes)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
