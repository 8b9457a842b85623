"""Operator 12: document fingerprints by SimHash, and all fingerprints within a Hamming radius.

A text's terms are its words and its pairs of neighbouring words, weighted by kind and, damped, by how often they occur. Every
term is hashed to BITS signs; the weighted signs vote, and the bits that win are the fingerprint. The angle between the weight
vectors of two texts shows in the share of bits that differ, so the likeness is the cosine of that angle, not below 0.

Two fingerprints within ``radius`` agree on at least one of ``radius + 1`` blocks of bits. So each distinct fingerprint goes to
``radius + 1`` tables, in each of which another block has been permuted to the front and is the key; within a key
fingerprints are compared, and a pair counts in the first table where it meets. Keys with very many fingerprints are compared
piece against piece.

Defined cases: null texts are empty; texts without words have the fingerprint 0; texts are taken whole; in scripts that do
not part words every letter is one; equal texts have equal fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import cut, shuffle_width, small_batches
from .shingles import mix
from .suffix import word_symbols

#: Bits of a fingerprint; radius up to which fingerprints are near.
BITS, RADIUS = 256, 7
#: Weights of a word and of a pair of words, in integers, so that no order of summing changes a bit.
WORD, PAIR = 8, 16
#: Terms that vote at once (sums stay below 2**24, which float32 holds); fingerprints of a key that are compared in one piece.
VOTES, PIECE = 1 << 12, 4096
#: Rows for one cut point's draw, and cut points that are drawn for each partition.
DRAWN = 20


def fingerprints(texts: list[str]) -> list[bytes]:
    """The fingerprint of every text."""
    out = []
    for word in word_symbols(texts):
        votes = np.zeros(BITS, np.float64)
        for terms, weight in ((word, WORD), (mix(mix(word[:-1]) ^ word[1:]) if len(word) else word, PAIR)):
            told, times = np.unique(terms, return_counts=True)
            weights = np.floor(weight * (1 + np.log2(times))).astype(np.float32)
            for at in range(0, len(told), VOTES):
                votes += signs(told[at : at + VOTES], weights[at : at + VOTES])
        out.append(np.packbits(votes > 0).tobytes())
    return out


def signs(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted votes of terms on every bit."""
    lanes = np.stack([mix(terms + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) for k in range(BITS // 64)], axis=1)
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(terms), -1), axis=1).astype(np.float32)
    return 2.0 * (weights @ bits).astype(np.float64) - float(weights.sum(dtype=np.float64))


def likeness(a: bytes, b: bytes) -> float:
    """Cosine of the angle that the share of differing bits tells, not below 0."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, float(np.cos(np.pi * differ / BITS)))


def edited(text: str, follower: str) -> str:
    """``text`` with its last floor(n / 2) letters replaced by the first as many (or all) of ``follower``."""
    n = len(text) // 2
    return text[: len(text) - n] + follower[:n]


def _place(key: Any, text_hash: int) -> tuple:
    return (key is not None, key if key is not None else 0, text_hash)


def with_followers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    A row's follower is the next one by key (null keys come first; rows of one key are in the order of a hash of their texts), the
    last one's is the first. Texts are shuffled once, compressed, to ranges of keys. A range begins at a row that was drawn
    as cut point, so a copy of that row, and no other, goes to the end of the range before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    width = shuffle_width(spark)
    n = rows.count()
    # The draw is of places, not of rows that count: it only decides where ranges begin, and is of about DRAWN * width keys.
    share = max(1, n // (DRAWN * width))
    drawn = rows.where(F.pmod(F.xxhash64("_key", "_hash"), F.lit(share)) == 0) if share > 1 else rows
    drawn = sorted({_place(r._key, r._hash) for r in drawn.select("_key", "_hash").distinct().collect()})
    first = rows.orderBy("_key", "_hash").select("_key", "_hash").first()
    first = _place(first._key, first._hash) if first else None
    cuts = [c for c in dict.fromkeys(drawn[len(drawn) * i // width] for i in range(1, width)) if c > first] if len(drawn) > width else []
    shared = spark.sparkContext.broadcast((cuts, first))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, first = shared.value
        codec = pa.Codec("zstd", 3)
        starts = {c: i for i, c in enumerate(cuts)}  # the range before the one that begins there
        for b in batches:
            take, parts, guests = [], [], []
            for i, (k, h) in enumerate(zip(b.column("_key").to_pylist(), b.column("_hash").to_pylist(), strict=True)):
                place = _place(k, h)
                to = [(bisect_right(cuts, place), False)]
                if place in starts:
                    to.append((starts[place], True))
                if place == first:
                    to.append((len(cuts), True))
                for part, guest in to:
                    take.append(i)
                    parts.append(part)
                    guests.append(guest)
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column("_text").to_pylist()]
            body = [(codec.compress(t, asbytes=True), len(t)) for t in raw]
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array(guests, pa.bool_()), b.column("_key").take(at), b.column("_hash").take(at), pa.array([body[i][0] for i in take], pa.binary()), pa.array([body[i][1] for i in take], pa.int64())],
                ["part", "guest", "_key", "_hash", "body", "size"],
            )

    kind = rows.schema["_key"].dataType
    dealt = rows.mapInArrow(deal, StructType([*_parse_datatype_string("part int, guest boolean").fields, StructField("_key", kind), *_parse_datatype_string("_hash long, body binary, size long").fields]))
    ordered = dealt.repartitionById(max(1, len(cuts) + 1), "part").sortWithinPartitions("guest", "_key", "_hash")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        held: tuple[Any, str, bytes] | None = None
        ended, names = False, [f.name for f in told.fields]
        for b in batches:
            texts = [codec.decompress(t, n, asbytes=True).decode("utf-8", "surrogatepass") for t, n in zip(b.column("body").to_pylist(), b.column("size").to_pylist(), strict=True)]
            prints, out = fingerprints(texts), []
            pairs = []
            for k, guest, t, p in zip(b.column("_key").to_pylist(), b.column("guest").to_pylist(), texts, prints, strict=True):
                if held is not None and not ended:
                    pairs.append((held, t, p))
                ended = ended or guest  # further guests are repeats of the first
                held = (k, t, p)
            changed = [edited(h[1], t) for h, t, _ in pairs]
            for (h, _, p), e, q in zip(pairs, changed, fingerprints(changed), strict=True):
                out.append((h[0], len(h[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), h[2].hex(), q.hex(), likeness(h[2], q), likeness(h[2], p)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((b.column("_key").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names)

    told = StructType([StructField("_key", kind), *_parse_datatype_string("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])
    return ordered.mapInArrow(walk, told).withColumnRenamed("_key", key)


def _words(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), BITS // 64)


def _masks(tables: int) -> np.ndarray:
    """Of every table the bits of its block, as words."""
    out = np.zeros((tables, BITS), np.uint8)
    for t in range(tables):
        out[t, BITS * t // tables : BITS * (t + 1) // tables] = 1
    return np.packbits(out, axis=1).view(np.uint64).reshape(tables, BITS // 64)


def near_counts(df: DataFrame, fingerprint: str, radius: int = RADIUS) -> DataFrame:
    """``fingerprint, copies, n_near`` of every distinct fingerprint (hexadecimal): rows that have it, and other rows within the radius."""
    tables = radius + 1
    spark = df.sparkSession
    masks = _masks(tables)
    classes = cut(df.where(F.col(fingerprint).isNotNull()).groupBy(F.unhex(fingerprint).alias("print")).agg(F.count("*").alias("copies")))

    def permuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _words(b.column("print").to_pylist()) if b.num_rows else np.zeros((0, BITS // 64), np.uint64), b.num_rows
            keys = []
            for t in range(tables):
                key = np.full(n, t, np.uint64)
                for w in range(BITS // 64):
                    if masks[t, w]:
                        key = mix(mix(key) ^ (x[:, w] & masks[t, w]))
                keys.append(key.astype(np.int64))
            times = np.tile(np.arange(n), tables)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(tables), n), pa.int32()), pa.array(np.concatenate(keys), pa.int64()), *(b.column(c).take(pa.array(times)) for c in ("print", "copies"))], ["t", "k", "print", "copies"])

    spread = classes.mapInArrow(permuted, "t int, k long, print binary, copies long")
    sizes = cut(spread.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    # A key with very many fingerprints is compared piece against piece: a row goes to the pairs that its piece is in.
    pieces = sizes.select("t", "k", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
    placed = spread.join(pieces, ["t", "k"]).withColumn("own", F.pmod(F.xxhash64("print"), "pieces").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    placed = placed.select("t", "k", F.greatest("own", "other").alias("i"), F.least("own", "other").alias("j"), "own", "print", "copies")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by key and pieces; all but the last group are whole
            table = pa.Table.from_batches([*held, b]).combine_chunks()
            columns = [table.column(c).to_numpy() for c in ("t", "k", "i", "j")]
            ends = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist()]
            yield found(table, ends)
            held = table.slice(ends[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield found(table, [0, table.num_rows])

    def found(table: pa.Table, ends: list[int]) -> pa.RecordBatch:
        prints, counts = table.column("print").to_pylist(), np.zeros(table.num_rows, np.int64)
        x = _words(prints) if prints else np.zeros((0, BITS // 64), np.uint64)
        copies, own = table.column("copies").to_numpy(), table.column("own").to_numpy()
        for a, z in pairwise(ends):
            t, i, j = (table.column(c)[a].as_py() for c in ("t", "i", "j"))
            left, right = np.flatnonzero(own[a:z] == i) + a, np.flatnonzero(own[a:z] == j) + a
            for at in range(0, len(left), 256):
                some = left[at : at + 256]
                apart = x[some][:, None, :] ^ x[right][None, :, :]
                p, q = np.nonzero(np.bitwise_count(apart).sum(axis=2, dtype=np.int64) <= radius)
                differ, p, q = apart[p, q], some[p], right[q]
                good = (p != q) & ((p < q) | (i != j))
                for earlier in range(t):  # a pair counts in the first table where it meets
                    good &= (differ & masks[earlier]).any(axis=1)
                p, q = p[good], q[good]
                np.add.at(counts, p, copies[q])
                np.add.at(counts, q, copies[p])
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array([prints[k] for k in at.tolist()], pa.binary()), pa.array(counts[at])], ["print", "near"])

    grouped = placed.repartition(shuffle_width(spark), "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    near = grouped.mapInArrow(compare, "print binary, near long").groupBy("print").agg(F.sum("near").alias("near"))
    return classes.join(near, "print", "left").select(F.lower(F.hex("print")).alias("fingerprint"), "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n_near"))


def document_fingerprints(docs: DataFrame, key: str, text: str, radius: int = RADIUS) -> DataFrame:
    """:func:`with_followers` with ``n_near``: other rows whose fingerprints are within the radius."""
    rows = cut(with_followers(docs, key, text))
    near = near_counts(rows, "fingerprint", radius).select(F.col("fingerprint").alias("_print"), "copies", "n_near")
    # Fingerprints of more than a thousandth of all rows, of which there are at most a thousand, are broadcast; the rest are joined.
    near, many = cut(near), max(1, rows.count() // 1000)
    hot = rows.join(F.broadcast(near.where(F.col("copies") > many).withColumn("_hot", F.lit(True))), F.col("fingerprint") == F.col("_print"), "left")
    names = [*rows.columns, "n_near"]
    rest = hot.where("_hot is null").select(*rows.columns).join(near.where(F.col("copies") <= many), F.col("fingerprint") == F.col("_print"))
    return hot.where("_hot").select(*names).unionByName(rest.select(*names))
