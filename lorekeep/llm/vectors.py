"""Vector columns as integer matrices: what is kept, how it is cut to integers, how it is packed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Integers of a larger size can't be held with their sums and differences; entries beyond count as not finite.
MOST = float(1 << 60)


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int, extra: str | None = None) -> tuple[DataFrame, int]:
    """``_key, _extra, _x`` of the rows that are kept, and their length.

    ``_x`` is floor(scale * entry) of every entry, packed as 32-bit numbers if all fit and as 64-bit ones else, so equal
    vectors have equal bytes. Rows whose vector is null, empty, or holds an entry that is null, not finite or of more than
    2**60 as an integer go, and so do vectors of another length than the most frequent one (of several: the greatest).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("_v")
            values = lists.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * scale)
                bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) <= MOST))])
            offsets = lists.offsets.to_numpy()
            start, stop = offsets[:-1], offsets[1:]
            good = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (stop > start) & (bad[stop] == bad[start]))
            out = [packed(scaled[start[i] : stop[i]].astype(np.int64)) for i in good.tolist()]
            take = pa.array(good, pa.int64())
            lengths = pa.array((stop - start)[good].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("_key").take(take), b.column("_extra").take(take), lengths, pa.array(out, pa.binary())], ["_key", "_extra", "_n", "_x"])

    named = df.select(F.col(key).alias("_key"), (F.col(extra) if extra else F.lit(None).cast("string")).alias("_extra"), F.col(vector).cast("array<double>").alias("_v"))
    fields = [named.schema["_key"], named.schema["_extra"], *_parse_datatype_string("_n int, _x binary").fields]
    rows = named.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in fields]))
    most = rows.groupBy("_n").count().orderBy(F.desc("count"), F.desc("_n")).first()
    width = most._n if most else 0
    return rows.where(F.col("_n") == width).drop("_n"), width


def packed(x: np.ndarray) -> bytes:
    """A vector of 64-bit integers as bytes, in 32 bits each where they fit."""
    small = x.astype(np.int32)
    return (small if (small == x).all() else x).tobytes()


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of 64-bit integers."""
    bodies = column.to_pylist()
    out = np.empty((len(bodies), width), np.int64)
    small = np.array([len(b) == 4 * width for b in bodies], bool)
    for kind, at in ((np.int32, np.flatnonzero(small)), (np.int64, np.flatnonzero(~small))):
        if len(at):
            out[at] = np.frombuffer(b"".join(bodies[i] for i in at.tolist()), kind).reshape(-1, width)
    return out


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
