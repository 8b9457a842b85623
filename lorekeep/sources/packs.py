"""Git packs by their indexes: objects are read by offset and deltas are resolved level by level, so a pack is many tasks.

A version 2 index names every object of its pack with its place. The pack itself is read as the text source splits it,
at newline bytes, which binary data has too; the lengths of what was read give each piece its place, and pieces are cut at multiples
of BUCKET. An object meets the pieces that it lies in; no task holds more of a pack than a bucket and one object.
Levels of delta chains are told first, from names alone, by hops that double; each level then joins its deltas to the bodies of the level
below. Bases in other packs and loose ones are found by name like any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import cut
from .git import KINDS, apply_delta, loose
from .stores import guarded

#: Bytes of a piece of a pack.
BUCKET = 1 << 20
_HEAD = b"\xfftOc\x00\x00\x00\x02"


class Index:
    """A version 2 index: a fan-out table of first bytes, ascending names, places (31 bits, or a row of the table of 64-bit ones)."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != _HEAD:
            raise ValueError("not an index of version 2")
        self.fan = np.frombuffer(raw, ">u4", 256, 8)
        n = self.count = int(self.fan[-1])
        if len(raw) < 1032 + 28 * n + 40 or (np.diff(self.fan.astype(np.int64)) < 0).any():
            raise ValueError("an index is torn")
        self.names = np.frombuffer(raw, "S20", n, 1032) if n else np.zeros(0, "S20")
        self._raw = raw[1032 : 1032 + 20 * n]
        places = np.frombuffer(raw, ">u4", n, 1032 + 24 * n).astype(np.int64)
        large = np.frombuffer(raw, ">u8", (len(raw) - 40 - 1032 - 28 * n) // 8, 1032 + 28 * n).astype(np.int64)
        far = places >> 31 == 1
        places[far] = large[places[far] & 0x7FFFFFFF]
        self.places = places

    def name(self, i: int) -> str:
        return self._raw[20 * i : 20 * i + 20].hex()

    def find(self, name: str) -> int | None:
        """The place of an object: the fan-out table bounds a binary search over the names."""
        raw = bytes.fromhex(name)
        lo, hi = int(self.fan[raw[0] - 1]) if raw[0] else 0, int(self.fan[raw[0]])
        while lo < hi:
            middle = (lo + hi) // 2
            if self._raw[20 * middle : 20 * middle + 20] < raw:
                lo = middle + 1
            else:
                hi = middle
        return int(self.places[lo]) if lo < self.count and self._raw[20 * lo : 20 * lo + 20] == raw else None


def index_rows(spark: SparkSession, git_dir: str) -> DataFrame:
    """``pack, hash, at, stop`` of all packed objects: an object ends where the next one begins, the last one at the pack's checksum."""
    packs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pack").load(f"{guarded(git_dir)}/objects")
    sizes = packs.select(F.regexp_replace("path", r"\.pack$", "").alias("pack"), (F.col("length") - 20).alias("last"))  # contents are not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.idx").load(f"{guarded(git_dir)}/objects")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, last, raw in zip(*(b.column(c).to_pylist() for c in ("pack", "last", "content")), strict=True):
                index = Index(raw)
                order = np.argsort(index.places, kind="stable")
                stops = np.append(index.places[order][1:], last)
                for a in range(0, len(order), 1 << 16):
                    own = order[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([pack] * len(own)), pa.array([index.name(i) for i in own.tolist()]), pa.array(index.places[own]), pa.array(stops[a : a + (1 << 16)].astype(np.int64))], ["pack", "hash", "at", "stop"])

    found = files.select(F.regexp_replace("path", r"\.idx$", "").alias("pack"), "content").join(sizes, "pack")
    return found.select("pack", "last", "content").mapInArrow(run, "pack string, hash string, at long, stop long")


def pieces(spark: SparkSession, git_dir: str) -> DataFrame:
    """``pack, bucket, start, bytes``: all packs, cut at multiples of BUCKET."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pack").text(f"{guarded(git_dir)}/objects")
    raw = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turn, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            body = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([turn], pa.int32()), pa.array([len(body)], pa.int64()), pa.array([body], pa.binary())], ["file", "block", "turn", "size", "bytes"])

        for b in batches:
            for file, block, line in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != now or size >= BUCKET:
                    if held:
                        yield piece()
                    turn, held, size = (turn + 1, [], 0) if (file, block) == now else (0, [], 0)
                    now = (file, block)
                held += [line, b"\n"]
                size += len(line) + 1
        if held:
            yield piece()

    told = cut(raw.mapInArrow(joined, "file string, block long, turn int, size long, bytes binary"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block", "turn")) - F.col("size")
    placed = told.join(told.select("file", "block", "turn", before.alias("from")), ["file", "block", "turn"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                marks = [start, *range((start // BUCKET + 1) * BUCKET, start + len(body), BUCKET), start + len(body)]
                rows = [(file, a // BUCKET, a, body[a - start : z - start]) for a, z in zip(marks, marks[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "bucket", "start", "bytes"])

    rows = placed.select("file", "from", "bytes").mapInArrow(aligned, "file string, bucket long, start long, bytes binary")
    # the text source and the binary one write the same path in two ways
    return rows.select(F.regexp_extract("file", r"([^/]+)\.pack$", 1).alias("pack"), "bucket", "start", "bytes")


def entry(raw: bytes, at: int) -> tuple[int, int | str | None, bytes]:
    """(kind, base, body) of an object as it lies in a pack at ``at``; a base is a place or a name."""
    i, byte = 1, raw[0]
    kind = byte >> 4 & 7
    while byte & 0x80:
        byte = raw[i]
        i += 1
    base: int | str | None = None
    if kind == 6:
        byte = raw[i]
        i += 1
        back = byte & 0x7F
        while byte & 0x80:
            byte = raw[i]
            i += 1
            back = (back + 1) << 7 | byte & 0x7F
        base = at - back
    elif kind == 7:
        base, i = raw[i : i + 20].hex(), i + 20
    elif kind not in KINDS:
        raise ValueError("an object of no kind")
    return kind, base, zlib.decompress(raw[i:])


def entries(spark: SparkSession, git_dir: str) -> DataFrame:
    """``hash, kind, base, body`` of all packed objects as they lie there: of a delta the name of its base, and the delta."""
    index = cut(index_rows(spark, git_dir).withColumn("pack", F.regexp_extract("pack", r"([^/]+)$", 1)))
    wanted = index.withColumn("bucket", F.explode(F.sequence(F.expr(f"at div {BUCKET}"), F.expr(f"(stop - 1) div {BUCKET}"))))

    def slices(key: tuple, own: pa.Table, there: pa.Table) -> pa.Table:
        """Of a bucket's objects the bytes that lie in it."""
        parts = sorted(zip(there.column("start").to_pylist(), there.column("bytes").to_pylist(), strict=True))
        first, body = (parts[0][0] if parts else 0), b"".join(p for _, p in parts)
        out = [(n, a, max(a, first), body[max(a, first) - first : max(0, z - first)]) for n, a, z in zip(*(own.column(c).to_pylist() for c in ("hash", "at", "stop")), strict=True)]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.string()), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary())))], ["pack", "hash", "at", "start", "bytes"])

    found = wanted.groupBy("pack", "bucket").cogroup(pieces(spark, git_dir).groupBy("pack", "bucket")).applyInArrow(slices, "pack string, hash string, at long, start long, bytes binary")
    whole = found.groupBy("pack", "hash", "at").agg(F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("parts"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pack, name, at, parts in zip(*(b.column(c).to_pylist() for c in ("pack", "hash", "at", "parts")), strict=True):
                kind, base, body = entry(b"".join(p["bytes"] for p in parts), at)
                out.append((pack, name, KINDS.get(kind), base if isinstance(base, str) else None, base if isinstance(base, int) else None, body))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()))], ["pack", "hash", "kind", "base", "back", "body"])

    rows = cut(whole.select("pack", "hash", "at", "parts").mapInArrow(read, "pack string, hash string, kind string, base string, back long, body binary"))
    named = index.select("pack", F.col("at").alias("back"), F.col("hash").alias("_named"))
    told = rows.join(named, ["pack", "back"], "left").select("hash", "kind", F.coalesce("base", "_named").alias("base"), "body")
    return cut(told.dropDuplicates(["hash"]))


def levels(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``hash, level`` of deltas: hops to an object that is none. Hops double each round, so a chain of n takes log n joins."""
    done = known.select(F.col("hash").alias("to"), F.lit(True).alias("ended"))
    now = rows.where("kind is null").select("hash", F.col("base").alias("to"), F.lit(1).alias("hops")).join(done, "to", "left")
    now = cut(now.select("hash", "to", "hops", F.coalesce("ended", F.lit(False)).alias("ended")))
    for _ in range(64):
        left = now.where("not ended")
        if left.isEmpty():
            return now.select("hash", F.col("hops").alias("level"))
        step = now.select(F.col("hash").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"))
        moved = cut(left.join(step, "to").select("hash", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_ended").alias("ended")))
        if moved.count() < left.count():
            break
        now = cut(now.where("ended").unionByName(moved))
    raise ValueError("a delta's base is in no pack")  # or its chain runs in a circle


def objects(spark: SparkSession, git_dir: str) -> DataFrame:
    """``hash, kind, body`` of all loose and packed objects."""
    loose_files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{guarded(git_dir)}/objects").where(F.col("path").rlike(r"/objects/[0-9a-f]{2}/[0-9a-f]{38}$"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [("".join(p.split("/")[-2:]), *loose(c)) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["hash", "kind", "body"])

    packed = entries(spark, git_dir)
    whole = cut(packed.where("kind is not null").select("hash", "kind", "body").unionByName(loose_files.select("path", "content").mapInArrow(single, "hash string, kind string, body binary")).dropDuplicates(["hash"]))
    told = cut(levels(packed, whole))
    deltas = cut(packed.where("kind is null").join(told, "hash").repartition("level", "base"))
    below, out = whole, whole
    for level in range(1, (told.agg(F.max("level")).first()[0] or 0) + 1):
        own = deltas.where(F.col("level") == level).select("hash", "base", F.col("body").alias("delta"))
        met = own.join(below.select(F.col("hash").alias("base"), "kind", "body"), "base")
        below = cut(met.select("hash", "kind", "body", "delta").mapInArrow(_applied, "hash string, kind string, body binary"))
        out = out.unionByName(below)
    return out.dropDuplicates(["hash"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects from bases and deltas; names are held against what came out."""
    for b in batches:
        bodies = []
        for name, kind, base, delta in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            body = apply_delta(base, delta)
            if hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).hexdigest() != name:
                raise ValueError("an object isn't what its name says")
            bodies.append(body)
        yield pa.RecordBatch.from_arrays([b.column("hash"), b.column("kind"), pa.array(bodies, pa.binary())], ["hash", "kind", "body"])
