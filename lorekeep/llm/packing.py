"""Operator 6: best-fit packing with certified repacking.

Partitions pack their pieces by best-fit decreasing. Dual-feasible functions bound from below the
sequences that a partition needs; where the count exceeds the bound, and for what every partition
leaves partly filled, the emptiest sequences are opened again, partitions exchange the pieces in
them by larger and larger groups, and best-fit decreasing runs again. A group opens only so many pieces
that the groups that meet at the next level are no larger than a partition was; where an exchange has
saved no sequence, only the emptiest few go on. :func:`certificate` gives the count and the whole table's bound.

Defined cases: a null or empty text is one end token; only texts longer than a sequence are cut;
repeated rows are separate documents; an empty table packs into nothing. The input must be
deterministic when read again; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .tokens import encoder

#: Pieces that a task packs at first, groups that exchange at a time, sequences opened for each missing one and besides.
PIECES, GROUPS, OPEN_EACH, OPEN_LEAST = 20_000, 8, 24, 48


def lower_bound(lengths: np.ndarray, size: int) -> float:
    """The largest bound on the count of sequences by three families of dual-feasible functions."""
    if not len(lengths):
        return 0.0
    return _bound(np.bincount(lengths, minlength=size + 1).astype(np.float64), size)


def _bound(n: np.ndarray, size: int) -> float:
    """The same from the counts ``n`` of the lengths 0 to ``size``."""
    s = np.arange(size + 1)
    best = float(n @ s) / size
    # threshold e: more than size - e counts as a whole sequence, less than e as nothing
    count, volume = np.cumsum(n), np.cumsum(n * s)
    e = np.arange(1, size // 2 + 1)
    best = max(best, float(np.max(count[-1] - count[size - e] + (volume[size - e] - volume[e - 1]) / size)))
    for k in range(1, 40):  # rounded to k parts, unless (k + 1) parts fit exactly
        parts = (k + 1) * s
        best = max(best, float(n @ np.where(parts % size == 0, s / size, (parts // size) / k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence of each length and the sequences' free places; ``lengths`` must descend."""
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, mask, room, out = 0, 0, [], []
    for length in lengths.tolist():
        fits = mask >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            b, r = rooms, size
            rooms += 1
            room.append(size)
        room[b] = r - length
        by_room[r - length].append(b)
        mask |= 1 << (r - length)
        out.append(b)
    return np.array(out, np.int64), np.array(room, np.int64)


def _packed(ids: np.ndarray, lengths: np.ndarray, size: int, group: int, level: int, last: bool, before: int | None = None) -> pa.RecordBatch:
    """Pack one group's pieces; ``open`` marks pieces of sequences that the next level packs again.

    ``before`` is the count of sequences that the pieces came from: if it did not fall, the gap is the bound's.
    """
    order = np.lexsort((ids, -lengths))
    ids, lengths = ids[order], lengths[order]
    seq, room = best_fit_decreasing(lengths, size)
    gap = len(room) - lower_bound(lengths, size)
    reopened = np.zeros(len(room), bool)
    if not last and gap > 1e-9:
        saved = before is None or len(room) < before
        again = min(len(room), OPEN_LEAST + (OPEN_EACH * int(np.ceil(gap)) if saved else 0))
        emptiest = np.argsort(-room, kind="stable")[:again]
        within = np.cumsum(np.bincount(seq, minlength=len(room))[emptiest]) <= max(1, PIECES // GROUPS)
        reopened[emptiest[within]] = True
        reopened &= room > 0
    order = np.argsort(seq, kind="stable")
    ids, lengths, seq = ids[order], lengths[order], seq[order]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    offset = starts - starts[np.searchsorted(seq, seq)] if len(seq) else starts
    name = (np.int64(level) << 58) | (np.int64(group) << 32) | seq
    columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(name, pa.int64()), pa.array(offset, pa.int64()), pa.array(reopened[seq], pa.bool_()), pa.array(np.full(len(ids), group), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["_id", "length", "sequence_id", "offset", "_open", "_group"])


_SCHEMA = "_id long, length long, sequence_id long, offset long, _open boolean, _group long"


def _repack(size: int, level: int, last: bool):
    """Packs a group of partitions' opened pieces."""

    def run(table: pa.Table) -> pa.Table:
        ids, lengths, old = (table.column(c).to_numpy() for c in ("_id", "length", "sequence_id"))
        return pa.Table.from_batches([_packed(ids, lengths, size, table.column("_next")[0].as_py(), level, last, len(np.unique(old)))])

    return run


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``_id, sequence_id, offset`` for rows of ``_id`` (unique) and ``length`` (1 to ``size``)."""
    total = pieces.count()
    parts = max(1, -(-total // PIECES))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            ids, lengths = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in ("_id", "length"))
            yield _packed(ids, lengths, size, TaskContext.get().partitionId(), 0, False)

    level, out = 1, []
    now = cut(pieces.select(F.col("_id").cast("long"), F.col("length").cast("long")).repartition(parts, "_id").mapInArrow(first, _SCHEMA))
    while True:
        out.append(now.where("not _open").select("_id", "sequence_id", "offset"))
        again = now.where("_open")
        groups = now.agg(F.max("_group")).first()[0]
        if groups is None or again.isEmpty():
            break
        again = again.select("_id", "length", "sequence_id", F.expr(f"_group div {GROUPS}").alias("_next"))
        now = cut(again.groupBy("_next").applyInArrow(_repack(size, level, groups < GROUPS), _SCHEMA))
        level += 1
    packed = out[0]
    for more in out[1:]:
        packed = packed.unionByName(more)
    return packed


def certificate(packed: DataFrame, size: int) -> tuple[int, int]:
    """The count of sequences of ``length, sequence_id`` rows, and the fewest that there can be by the bound (a row a length comes to the driver)."""
    used = packed.agg(F.count_distinct("sequence_id")).first()[0]
    counts = packed.groupBy("length").agg(F.count("*").alias("n")).collect()
    if not counts:
        return 0, 0
    n = np.zeros(size + 1, np.float64)
    for r in counts:
        n[r["length"]] = r.n
    return used, math.ceil(_bound(n, size) - 1e-9)


def cut_pieces(docs: DataFrame, key: str, text: str, vocabulary: str, ranks: str, size: int, end: int = 0) -> DataFrame:
    """Per piece: the key, ``piece``, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32-bit).

    A document is its text's ids and the end id; one longer than ``size`` is cut from its end, so
    that only its first piece may be shorter.
    """
    small_batches(docs.sparkSession)
    field = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            rows, piece, start, length, body = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                ends = range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)
                for p, stop in enumerate(ends):
                    begin = stop - size if p else 0
                    rows.append(i)
                    piece.append(p)
                    start.append(begin)
                    length.append(stop - begin)
                    body.append(ids[begin:stop].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(body, pa.binary())],
                [key, "piece", "start", "length", "ids"],
            )

    from pyspark.sql.types import StructType, _parse_datatype_string

    return docs.select(key, text).mapInArrow(run, StructType([field, *_parse_datatype_string("piece int, start long, length long, ids binary").fields]))


def pack_documents(docs: DataFrame, key: str, text: str, vocabulary: str, ranks: str, size: int) -> DataFrame:
    """Pieces of all documents with ``ids_crc32``, ``sequence_id`` and ``offset``; the ids themselves aren't shuffled."""
    pieces = cut_pieces(docs, key, text, vocabulary, ranks, size)
    known = cut(pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")).withColumn("_id", F.monotonically_increasing_id()))
    return known.join(pack(known, size), "_id").drop("_id")
