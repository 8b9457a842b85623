"""Operator 2: training-order materialisation.

Documents become sequences of a fixed number of token ids. All sequences are numbered from 0 in the
order of a hash of their document, its key and their place in it, so that the numbers do not depend
on how the input is split; a keyed Feistel permutation with cycle-walking gives each number a global
slot, without shared state. Ranges of slots go to tasks, which write them as shards of a fixed
stride: slot ``i`` stands at byte ``(i mod shard) * stride`` of shard ``i div shard``, so reading
runs on in sequence and can start, or start again, anywhere.

Defined cases: a null or empty text is one sequence of the end id alone; the last sequence of a
document is filled up with the pad id; repeated rows are separate sequences; a null key comes before
all others; an empty table has no shards. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import checkpoint_folder, remove_at_exit, shuffle_width, small_batches
from .tokens import encoder

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing of unsigned numbers."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n-1: a balanced Feistel network over the next even power of two, walked until it falls in range."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), [(key * 0x2545F4914F6CDD1D + r * 0xD1342543DE82EF95) % 2**64 for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & low
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & low)
        out[walk] = left << np.uint64(half) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def _sequences(docs: DataFrame, key: str, text: str, vocabulary: str, ranks: str, length: int, end: int) -> DataFrame:
    """``_h, key, part, n_tokens, ids`` (16 bits each, not filled up) of all documents, in one narrow pass."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), body), 1).alias("_h"), F.col(key).alias("key"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            at, part, size, ids = [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                all_ids = np.append(encode(t), np.uint32(end))
                if int(all_ids.max()) >= 1 << 16:
                    raise ValueError("ids must fit 16 bits")
                raw = all_ids.astype("<u2").tobytes()
                # as in packing, a long document is cut from its end, so that only its first sequence may be short
                stops = range(len(all_ids) % length or min(length, len(all_ids)), len(all_ids) + 1, length)
                for p, stop in enumerate(stops):
                    begin = stop - length if p else 0
                    at.append(i)
                    part.append(p)
                    size.append(stop - begin)
                    ids.append(raw[2 * begin : 2 * stop])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_h").take(take), batch.column("key").take(take), pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array(ids, pa.binary())],
                ["_h", "key", "part", "n_tokens", "ids"],
            )

    return rows.mapInArrow(run, StructType([*_parse_datatype_string("_h long").fields, StructField("key", docs.schema[key].dataType), *_parse_datatype_string("part int, n_tokens int, ids binary").fields]))


def training_shards(docs: DataFrame, key: str, text: str, vocabulary: str, ranks: str, path: str, length: int = 512, per_shard: int = 8192, seed: int = 1, end: int = 0, pad: int = 0) -> None:
    """Write the shards as a table at ``path``: ``shard``, ``payload`` (records of ``2 * length`` bytes in slot order), ``rows`` (key, part, n_tokens by slot).

    Texts are tokenised once. Sequences are shuffled twice: by ranges of the hash, where they are
    counted and numbered (one row a range is summed up), then by ranges of shards, which one task
    each sorts by slot and writes one after the other, holding one shard at a time. No key or source
    decides where a sequence goes, so ranges are even; ranges are as many as the session's shuffles have.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = shuffle_width(spark)
    # the upper 31 bits of the hash, times the count of ranges
    ranged = _sequences(docs, key, text, vocabulary, ranks, length, end).withColumn("_p", F.shiftright(F.shiftright("_h", 32) * F.lit(width), 31).cast("int")).repartitionById(width, F.col("_p"))
    # Counted from the same exchange, which the plan runs once: for that both readers take all columns, hence the sum of all.
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_h", "key", "part", "n_tokens", "ids")).alias("_sum"))
    before = Window.orderBy("_p")
    starts = counts.select("_p", (F.sum("_n").over(before) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_total"), "_sum")  # a row a range
    numbered = ranged.join(F.broadcast(starts), "_p", "left").sortWithinPartitions("_p", "_h", "key", "part", "ids")
    shape = StructType([StructField("key", docs.schema[key].dataType), *_parse_datatype_string("part int, n_tokens int, ids binary, slot long, _to int").fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            p, start, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_p", "_start", "_total"))
            turns = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            run = np.arange(len(p)) - np.repeat(turns, np.diff(np.append(turns, len(p))))
            run[p == now] += seen
            now, seen = int(p[-1]), int(run[-1]) + 1
            n = int(total[0])
            slot = permute(start + run, n, seed)
            to = (slot // per_shard) * width // -(-n // per_shard)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "part", "n_tokens", "ids")), pa.array(slot, pa.int64()), pa.array(to.astype(np.int32), pa.int32())], ["key", "part", "n_tokens", "ids", "slot", "_to"])

    placed = numbered.mapInArrow(place, shape).repartitionById(width, F.col("_to")).sortWithinPartitions("slot")
    told = StructType([StructField("key", docs.schema[key].dataType), *_parse_datatype_string("part int, n_tokens int").fields])
    named = _parse_datatype_string("shard long, payload binary, rows array<struct<key:long,part:int,n_tokens:int>>")
    named["rows"].dataType.elementType = told

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column("slot").to_numpy() // per_shard
            ends = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, z in zip(ends, ends[1:], strict=False):
                if held and held[-1].column("slot")[-1].as_py() // per_shard != shard[a]:
                    yield whole(held)
                    held = []
                if z > a:
                    held.append(batch.slice(a, z - a))
        if held:
            yield whole(held)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        records = bytearray()
        for b in held:
            for raw in b.column("ids").to_pylist():
                records += raw + filler[len(raw) :]
        table = pa.Table.from_batches(held).combine_chunks()
        fields = [table.column(c).chunk(0) for c in ("key", "part", "n_tokens")]
        rows = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), pa.StructArray.from_arrays(fields, ["key", "part", "n_tokens"]))
        return pa.RecordBatch.from_arrays([pa.array([table.column("slot")[0].as_py() // per_shard], pa.int64()), pa.array([bytes(records)], pa.binary()), rows], ["shard", "payload", "rows"])

    filler = np.full(length, pad, "<u2").tobytes()
    block = max(1 << 20, 4 * length * per_shard)  # few shards a row group, so that a reader that starts in the middle skips the others
    placed.mapInArrow(write, named).write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", block).parquet(path)


def records(shards: DataFrame, length: int = 512) -> DataFrame:
    """``shard, at, key, part, n_tokens, record`` read back from shards by their fixed stride."""
    stride, key = 2 * length, shards.schema["rows"].dataType.elementType["key"]
    small_batches(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload, rows = batch.column("payload")[i], batch.column("rows")[i].values
                n = len(rows)
                if len(payload.as_buffer()) != n * stride:
                    raise ValueError("a shard is torn")
                places = pa.array(np.arange(n + 1, dtype=np.int32) * stride)
                record = pa.Array.from_buffers(pa.binary(), n, [None, places.buffers()[1], payload.as_buffer()])
                shard = pa.array(np.full(n, batch.column("shard")[i].as_py()), pa.int64())
                at = pa.array(np.arange(n), pa.int64())
                for a in range(0, n, 1024):
                    yield pa.RecordBatch.from_arrays([x.slice(a, 1024) for x in (shard, at, *(rows.field(f) for f in ("key", "part", "n_tokens")), record)], ["shard", "at", "key", "part", "n_tokens", "record"])

    shape = _parse_datatype_string("shard long, at long, part int, n_tokens int, record binary").fields
    return shards.select("shard", "payload", "rows").mapInArrow(run, StructType([*shape[:2], key, *shape[2:]]))


def read_slots(spark: SparkSession, path: str, start: int, stop: int, length: int = 512, per_shard: int = 8192) -> DataFrame:
    """``slot, key, part, n_tokens, record`` for slots from ``start`` to before ``stop``; only the shards that hold them are read."""
    shards = spark.read.parquet(path).where(F.col("shard").between(start // per_shard, max(start, stop - 1) // per_shard))
    out = records(shards, length).select((F.col("shard") * per_shard + F.col("at")).alias("slot"), "key", "part", "n_tokens", "record")
    return out.where((F.col("slot") >= start) & (F.col("slot") < stop))


def materialised(docs: DataFrame, key: str, text: str, vocabulary: str, ranks: str, length: int = 512, per_shard: int = 8192, seed: int = 1) -> DataFrame:
    """The shards written in the shared folder (removed when this process ends), as a table."""
    spark = docs.sparkSession
    path = f"{checkpoint_folder(spark)}/shards-{uuid4().hex}"
    remove_at_exit(spark, path)
    training_shards(docs, key, text, vocabulary, ranks, path, length, per_shard, seed)
    return spark.read.parquet(path)
