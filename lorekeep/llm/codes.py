"""Operator 13: compression of vectors to product codes, codebooks trained by Elkan's form of Lloyd's rounds.

Vectors become integers and are cut into PARTS parts. A row keeps, from round to round, for each part its entry, an
upper bound of the distance to it, and a lower bound of the distance to every entry. After entries have moved, bounds are
shifted by as much; an entry is passed over only if its lower bound, or half its distance to the row's own entry,
is strictly above the upper bound, so ties are never passed over. What is left is measured, and measures that rounding
can't tell apart are decided by integers. The state is a table in the shared folder, written once a round together with the
round's sums; a lost executor costs its tasks, not the rounds. Lower bounds are stored in eight bits each, rounded down.

Defined cases: see :func:`lorekeep.llm.vectors.integer_vectors` for what is dropped; parts of a length that PARTS does
not divide differ by one (the first are longer; those of no length cost nothing); with fewer vectors than ENTRIES there are as
many entries; repeated keys are in the order of their vectors' bytes, null keys come last; an empty table gives an empty result.
Other columns are not looked at; a key or label that has the name of a column of the result is called ``_key`` or ``_label`` there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import cut, scratch_table
from .vectors import blocks, integer_vectors, unpacked

#: Parts of a vector, entries of a codebook, rounds of training.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows that are compared at once; entries of a row beyond which all of its distances are taken at once.
ROWS, FEW = 2048, 12
#: Labels that may hold more than a MANY-th of all rows, of which there are at most so many, are broadcast with their sums.
MANY = 1000
#: Relative slack of bounds for rounding.
SLACK = 1e-9


def part_bounds(width: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end."""
    size, more = divmod(width, PARTS)
    ends = np.cumsum([0, *(size + (i < more) for i in range(PARTS))]).tolist()
    return list(zip(ends, ends[1:], strict=False))


def exact_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, in 64 bits or, where they might not fit, of any size."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    most = int(np.abs(x).max()) + int(np.abs(entries).max())
    d = x - entries if most * most * x.shape[1] < 1 << 62 else x.astype(object) - entries.astype(object)
    return (d * d).sum(axis=1)


class Book:
    """A part's entries with what comparisons need."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.real = entries, entries.astype(np.float64)
        self.norms = (self.real**2).sum(axis=1)
        gaps = np.sqrt(np.maximum(0, self.squares(entries)[0]))
        self.half = gaps * 0.5 * (1 - SLACK)
        self.half -= np.sqrt(self.error(entries))[:, None] * 0.5

    def error(self, x: np.ndarray) -> np.ndarray:
        """A bound of the error of :meth:`squares` for each row."""
        most = np.abs(x).max(axis=1).astype(np.float64) if x.size else np.zeros(len(x))
        top = (most + (np.abs(self.real).max() if self.real.size else 0.0)) ** 2 * max(1, x.shape[1])
        return np.where(top < 2.0**52, 0.0, top * 2.0**-48)

    def squares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to all entries in double precision, and a bound of each row's error (0: they are exact)."""
        real = x.astype(np.float64)
        return (real**2).sum(axis=1)[:, None] - 2 * (real @ self.real.T) + self.norms, self.error(x)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest entry (of several the first), and lower bounds of the distances to all."""
        d, error = self.squares(x)
        best = d.argmin(axis=1)
        close = (d <= (d[np.arange(len(d)), best] + 2 * error)[:, None]) & (error > 0)[:, None]
        for i in np.flatnonzero(close.sum(axis=1) > 1).tolist():  # rounding can't tell
            among = np.flatnonzero(close[i])
            told = exact_squares(np.broadcast_to(x[i], (len(among), x.shape[1])), self.entries[among]).tolist()
            best[i] = among[told.index(min(told))]
        return best, np.sqrt(np.maximum(0.0, d - error[:, None])) * (1 - SLACK)


def stored(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds as steps of a row's own width, rounded down: (widths, steps)."""
    width = (lower.max(axis=1) / 255 * (1 + 1e-6)).astype(np.float32) if lower.size else np.zeros(len(lower), np.float32)
    steps = np.floor(lower * (1 - SLACK) / np.where(width > 0, width, 1).astype(np.float64)[:, None])
    return width, np.clip(steps, 0, 255).astype(np.uint8)


class Rows:
    """A block of rows of one part: integers, entries, upper and lower bounds."""

    def __init__(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        self.x, self.code, self.upper, self.lower = x, code, upper, lower

    @classmethod
    def first(cls, x: np.ndarray, book: Book) -> Rows:
        """All distances are taken."""
        code, lower = book.nearest(x)
        return cls(x, code, _upper(x, book, code), lower)

    def again(self, book: Book, moved: np.ndarray) -> int:
        """Entries have moved by ``moved``: shift bounds, pass over what they rule out, measure the rest; how many were measured."""
        self.upper = self.upper + moved[self.code]
        self.lower = np.maximum(0.0, self.lower - moved)
        open_ = np.flatnonzero(self._left(np.arange(len(self.x)), book).any(axis=1))
        if not len(open_):
            return 0
        self.upper[open_] = _upper(self.x[open_], book, self.code[open_])
        left = self._left(open_, book)
        count = left.sum(axis=1)
        whole = open_[count > FEW]
        if len(whole):
            self.code[whole], self.lower[whole] = book.nearest(self.x[whole])
        at, j = np.nonzero(left & (count <= FEW)[:, None])
        i = open_[at]
        if len(i):
            told, own = exact_squares(self.x[i], book.entries[j]), exact_squares(self.x[open_], book.entries[self.code[open_]])
            self.lower[i, j] = np.sqrt(told.astype(np.float64)) * (1 - SLACK)
            best, code = own.copy(), self.code[open_].copy()
            turn = np.arange(len(at)) - np.searchsorted(at, at)  # a row's candidates one after the other
            for t in range(int(turn.max()) + 1):
                now = turn == t
                r, d, k = at[now], told[now], j[now]
                better = (d < best[r]) | ((d == best[r]) & (k < code[r]))
                best[r[better]], code[r[better]] = d[better], k[better]
            few = (count <= FEW) & (count > 0)
            self.code[open_[few]] = code[few]
        self.upper[open_] = _upper(self.x[open_], book, self.code[open_])
        return int(count.sum())

    def _left(self, rows: np.ndarray, book: Book) -> np.ndarray:
        upper, code = self.upper[rows][:, None], self.code[rows]
        left = (self.lower[rows] <= upper) & (book.half[code] <= upper)
        left[np.arange(len(rows)), code] = False
        return left


def _upper(x: np.ndarray, book: Book, code: np.ndarray) -> np.ndarray:
    return np.sqrt(exact_squares(x, book.entries[code]).astype(np.float64)) * (1 + SLACK)


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.sqrt(exact_squares(new, old).astype(np.float64)) * (1 + SLACK)


_SUMS = "at long, high decimal(38,0), low decimal(38,0)"
_STATE = "_x binary, code binary, upper binary, widths binary, lower binary"


class _Sums:
    """A task's counts and sums of the rows of every entry."""

    def __init__(self, width: int) -> None:
        self.bounds, self.width = part_bounds(width), width
        self.counts = np.zeros((PARTS, ENTRIES), np.int64)
        self.high, self.low = (np.zeros((ENTRIES, width), np.int64) for _ in range(2))

    def add(self, part: int, x: np.ndarray, code: np.ndarray) -> None:
        """Halves of 30 bits, so that 2**33 rows of a task can't overflow."""
        a, z = self.bounds[part]
        self.counts[part] += np.bincount(code, minlength=ENTRIES)
        np.add.at(self.high[:, a:z], code, x >> 30)
        np.add.at(self.low[:, a:z], code, x & ((1 << 30) - 1))

    def rows(self) -> tuple[list[int], list[int], list[int]]:
        """Places (counts first, then sums), high and low halves."""
        at, high, low = [], [], []
        for p, (a, z) in enumerate(self.bounds):
            for k in np.flatnonzero(self.counts[p]).tolist():
                at.append(p * ENTRIES + k)
                high.append(0)
                low.append(int(self.counts[p, k]))
                at += range(PARTS * ENTRIES + k * self.width + a, PARTS * ENTRIES + k * self.width + z)
                high += self.high[k, a:z].tolist()
                low += self.low[k, a:z].tolist()
        return at, high, low


def _round(rows: DataFrame, width: int, books: list[np.ndarray], before: list[np.ndarray] | None) -> DataFrame:
    """Rows of the state after one assignment (``at`` is null), and rows of the sums (the others are null)."""
    shared = rows.sparkSession.sparkContext.broadcast((books, before))
    kept = [f for f in rows.schema.fields if f.name in ("_key", "_extra")]
    schema = StructType([*kept, *_parse_datatype_string(_STATE + ", " + _SUMS).fields])
    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = shared.value
        held, sums, bounds = [Book(b) for b in now], _Sums(width), part_bounds(width)
        moved = None if old is None else [_moves(a, b) for a, b in zip(old, now, strict=True)]
        types: list[pa.DataType] = []
        for b in blocks(batches, ROWS):
            types = [b.column(f.name).type for f in kept]
            x = unpacked(b.column("_x"), width)
            parts = []
            for p, (a, z) in enumerate(bounds):
                own = np.ascontiguousarray(x[:, a:z])
                if old is None:
                    part = Rows.first(own, held[p])
                else:
                    code, upper, widths = (_matrix(b.column(c), t)[:, p] for c, t in (("code", np.uint8), ("upper", np.float64), ("widths", np.float32)))
                    steps = _matrix(b.column("lower"), np.uint8, -1)[:, p]
                    part = Rows(own, code.astype(np.int64), upper.copy(), steps.astype(np.float64) * widths.astype(np.float64)[:, None])
                    part.again(held[p], moved[p])
                sums.add(p, own, part.code)
                parts.append((part.code.astype(np.uint8), part.upper, *stored(part.lower)))
            columns = [np.stack(c, axis=1) for c in zip(*parts, strict=True)]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), b.column("_x"), *(pa.array([r.tobytes() for r in c], pa.binary()) for c in columns), pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, kind)], schema.names)
        at, high, low = sums.rows()
        if at:
            n = len(at)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in types), *(pa.nulls(n, pa.binary()) for _ in range(5)), pa.array(at, pa.int64()), pa.array(high, kind), pa.array(low, kind)], schema.names)

    return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array, kind: type, *lists: int) -> np.ndarray:
    """Rows of PARTS values, or with ``lists`` (their length, -1: any) of PARTS lists."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), PARTS, *lists)


def _updated(state: DataFrame, width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries as the floors of the means of their rows; those without rows stay. At most ENTRIES * width sums come to the driver."""
    told = {r["at"]: (int(r.high) << 30) + int(r.low) for r in state.where("at is not null").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    out = []
    for p, ((a, z), book) in enumerate(zip(part_bounds(width), books, strict=True)):
        new = book.copy()
        for k in range(len(book)):
            if count := told.get(p * ENTRIES + k):
                new[k] = [told[PARTS * ENTRIES + k * width + i] // count for i in range(a, z)]
        out.append(new)
    return out


def train(rows: DataFrame, width: int, rounds: int = ROUNDS) -> tuple[list[np.ndarray], DataFrame, object]:
    """Codebooks of all parts, the rows' state after the last round's assignment (``at`` null), and the books of that round."""
    drawn = rows.orderBy(F.asc_nulls_last("_key"), "_x").limit(ENTRIES).select("_x").collect()
    first = unpacked(pa.array([bytes(r._x) for r in drawn], pa.binary()), width)
    books, before, release = [first[:, a:z].copy() for a, z in part_bounds(width)], None, None
    for _ in range(rounds):
        state, done = scratch_table(_round(rows, width, books, before))
        if release:
            release()  # the state of the round before
        rows, release = state.where("at is null").drop("at", "high", "low"), done
        before, books = books, _updated(state, width, books)
    return books, rows, (before, release)


def _assigned(rows: DataFrame, width: int, books: list[np.ndarray], before: list[np.ndarray] | None) -> DataFrame:
    """``_key, _extra, code, error``: the last assignment and its exact squared distances."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kept = [f for f in rows.schema.fields if f.name in ("_key", "_extra")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, ROWS):
            x, code = unpacked(b.column("_x"), width), _matrix(b.column("code"), np.uint8)
            error = np.zeros(len(x), object)
            for p, (a, z) in enumerate(part_bounds(width)):
                error = error + exact_squares(x[:, a:z], shared.value[p][code[:, p]]).astype(object)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array([bytes(c).hex() for c in code], pa.string()), pa.array(error.tolist(), pa.decimal128(38, 0))], [*(f.name for f in kept), "code", "error"])

    schema = StructType([*kept, *_parse_datatype_string("code string, error decimal(38,0)").fields])
    return _round(rows, width, books, before).where("at is null").select(*(f.name for f in kept), "_x", "code").mapInArrow(run, schema)


def books_hash(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


_NAMES = ("code", "error", "label_error", "codebooks_sha256")


def compress(df: DataFrame, key: str, vector: str, label: str, scale: int = 1024) -> DataFrame:
    """``key, label, code, error, label_error (decimals), codebooks_sha256`` of every row that is kept; an entry counts as floor(scale * entry)."""
    rows, width = integer_vectors(df, key, vector, scale, label)
    rows = cut(rows)
    if not width:
        told, books, release = rows.select("_key", "_extra", F.lit("").alias("code"), F.lit(0).cast("decimal(38,0)").alias("error")), [], None
    else:
        books, state, (before, release) = train(rows, width)
        told = cut(_assigned(state, width, books, before))
    if release:
        release()
    sums = cut(told.groupBy("_extra").agg(F.count("*").alias("rows"), F.sum("error").alias("label_error")))
    total = sums.agg(F.sum("rows")).first()[0] or 0
    # At most MANY labels hold more than a MANY-th of the rows: those are broadcast, the rest are joined by label.
    large = sums.where(F.col("rows") > total / MANY)
    names = large.select(F.col("_extra").alias("_large"), "label_error", F.lit(True).alias("_hot"))
    hot = told.join(F.broadcast(names), F.col("_extra").eqNullSafe(F.col("_large")), "left")
    rest = hot.where("_hot is null").drop("label_error").join(sums.where(F.col("rows") <= total / MANY).select(F.col("_extra").alias("_small"), "label_error"), F.col("_extra").eqNullSafe(F.col("_small")))
    columns = [F.col("_key").alias("_key" if key in _NAMES else key), F.col("_extra").alias("_label" if label in (*_NAMES, key) else label), "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256")]
    return hot.where("_hot").select(*columns).unionByName(rest.select(*columns))
