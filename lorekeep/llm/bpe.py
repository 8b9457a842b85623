"""Operator 5: byte-level BPE encoding and decoding in padded numpy matrices.

Texts are split by the vocabulary's pattern. Distinct pieces are put into matrices by length, a
byte a column. In each round every row finds its leftmost pair of least rank, looked up in a hash
table of pairs, and merges it; rows without a pair leave the matrix. Pieces longer than the widest
matrix are one row folded into blocks, of which each round searches one.

Defined cases: null and empty texts have no ids and decode to no bytes; texts and pieces of any
length are encoded whole; the ids depend on the text alone, so repeated rows are alike. Other
columns are passed through; clashing ``ids`` or ``decoded`` columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .tokens import load_ranks

_NONE = np.int32(2**31 - 1)
#: Widths of the matrices, in bytes; longer pieces are folded.
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256)
#: Distinct pieces that a task remembers before it starts afresh.
MEMORY = 300_000


class PairTable:
    """An open-addressed hash table from a pair of ids to the rank of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {(ranks[t[:i]] << 32 | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.bits = max(4, (4 * len(pairs) + 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        todo_k, todo_v = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at = self.slot(todo_k)
        while len(todo_k):  # in each round a slot takes one of those that ask for it
            first = np.unique(at, return_index=True)[1]
            won = np.zeros(len(at), bool)
            won[first] = self.keys[at[first]] == -1
            self.keys[at[won]], self.ranks[at[won]] = todo_k[won], todo_v[won]
            todo_k, todo_v, at = todo_k[~won], todo_v[~won], (at[~won] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; _NONE where there is none or an id is negative."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys).ravel()
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(left.shape)


class Codec:
    """Encodes texts to ids and ids to bytes by ranks and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes[r] = t
        self.known: dict[str, tuple[int, ...]] = {}

    def matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Ids of pieces of 2 to ``width`` bytes, all in lockstep."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < np.array([len(p) for p in pieces])[:, None], self.byte[raw], np.int32(-1))
        ranks = self.pairs.look(ids[:, :-1], ids[:, 1:])
        out: list[tuple[int, ...]] = [()] * n
        rows = np.arange(n)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                for r, x in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                    out[r] = tuple(x[: x.index(-1)] if x[-1] < 0 else x)
                live = ~done
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            ids[here, at] = best
            # close the gap: what stands right of the merged pair moves one place left
            width = ids.shape[1]
            columns = np.arange(width - 1)
            ids = np.concatenate([np.take_along_axis(ids, columns + (columns > at[:, None]), 1), np.full((len(rows), 1), -1, np.int32)], axis=1)
            if width > 2:
                columns = np.arange(width - 2)
                ranks = np.concatenate([np.take_along_axis(ranks, columns + (columns > at[:, None]), 1), np.full((len(rows), 1), _NONE, np.int32)], axis=1)
            ranks[here, at] = _NONE
            some = at < width - 1
            ranks[here[some], at[some]] = self.pairs.look(ids[here[some], at[some]], ids[here[some], at[some] + 1])
            some = at > 0
            ranks[here[some], at[some] - 1] = self.pairs.look(ids[here[some], at[some] - 1], ids[here[some], at[some]])
            used = int((ids >= 0).sum(axis=1).max())
            if used < width and used >= 2:
                ids, ranks = ids[:, :used], ranks[:, : used - 1]
            elif used < 2:
                ids, ranks = ids[:, :2], ranks[:, :1]
        return out

    def folded(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one long piece: a row folded into blocks, with each block's least rank at hand."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].astype(np.int64)
        n = len(ids)
        side = max(16, int(n**0.5))
        blocks = -(-n // side)
        ranks = np.full(blocks * side, _NONE, np.int64)
        ranks[: n - 1] = self.pairs.look(ids[:-1], ids[1:])
        least = ranks.reshape(blocks, side).min(axis=1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            block = int(least.argmin())
            if least[block] == _NONE:
                break
            at = block * side + int(ranks[block * side : (block + 1) * side].argmin())
            gone = after[at]
            ids[at], end = ranks[at], after[gone]
            after[at] = end
            if end < n:
                before[end] = at
            ids[gone] = -1
            ranks[gone] = _NONE
            for left, right in ((before[at], at), (at, end)):
                if left >= 0:
                    ranks[left] = self.pairs.look(ids[left : left + 1], ids[right : right + 1])[0] if right < n else _NONE
            for b in {at // side, gone // side, max(0, before[at]) // side}:
                least[b] = ranks[b * side : (b + 1) * side].min()
        return tuple(ids[ids >= 0].tolist())

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces that are not known yet."""
        by: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = (rank,)
            elif len(raw) > WIDTHS[-1]:
                self.known[piece] = self.folded(raw)
            else:
                width = next(w for w in WIDTHS if w >= len(raw))
                texts, raws = by.setdefault(width, ([], []))
                texts.append(piece)
                raws.append(raw)
        for width, (texts, raws) in by.items():
            self.known.update(zip(texts, self.matrix(raws, width), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        self.learn(set(chain.from_iterable(split)) - self.known.keys())
        get = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, pieces)), np.int32) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def encode_decode(df: DataFrame, column: str, vocabulary: str, pattern: str) -> DataFrame:
    """Add ``ids`` (array<int>) of a text column and ``decoded`` (binary), the bytes of these ids; one narrow pass."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(df.sparkSession)
    df = df.drop("ids", "decoded")
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(load_ranks(vocabulary), pattern)
        for batch in batches:
            ids = codec.encode(batch.column(column).to_pylist())
            new = [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "ids", "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields, *_parse_datatype_string("ids array<int>, decoded binary").fields]))
