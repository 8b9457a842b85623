"""Operator 8: removal of long repeats by suffix arrays of a linear grouping construction.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.
Every such string has an anchor: the least hash of its ``GRAM``-byte substrings, so equal strings
have equal anchors at equal places. Each document gives its anchors with hashes of their contexts
(all strings that have the anchor). Equal contexts at two places are repeats as they stand. Where
one anchor has several contexts, one copy of each is brought together, and a suffix array over the
pieces that they have in common shows which strings start at two places.

The suffix array is built by grouping: suffixes are grouped by the Lyndon word that they begin
with; groups are taken in descending order, and every group's word is appended to the words of the
suffixes that its members' previous-smaller pointers name; then the order inside each group follows
from the order of what comes after the word, in one pass and without renaming.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than LENGTH lose
none; repeated rows repeat each other; texts are taken whole; an empty table gives an empty result.
Other columns are passed through.

With ``words`` the same is done over words instead of bytes: a word's symbol is the hash of its letters,
and the strings are of that many words, however few bytes they have and whatever white space parts them.

Texts are named by 64 bits of hash; names that two different texts share (their SHA-256 tells) are
replaced. Contexts are equal if 128 bits of their BLAKE2b are; the anchors' own hashes only choose places.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from itertools import combinations
from secrets import randbits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, cut, hits, scratch_table, shuffle_width, small_batches
from .shingles import KEY, mix, powers, prefix_hash, word_hashes

#: Bytes of a repeat; bytes of an anchor.
LENGTH, GRAM = 400, 32
#: Contexts of one anchor that are sorted together; more are sorted pair of pieces by pair of pieces.
PIECE = 4096
#: Symbols of one suffix array (about 300 bytes each); contexts with more are compared pair of parts by pair of parts.
MOST_SYMBOLS = 300_000
#: Words of an anchor; bytes of a word's hash. Runs without white space are words, but in scripts that do not part words
#: every letter is one, and a run of more than LONG letters stands for a word every WIDTH letters.
GRAM_WORDS, WIDTH, LONG = 4, 8, 64
#: The code points of white space, and ranges of the scripts that do not part words.
SPACES = (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
UNPARTED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_SPACE = np.isin(np.arange(0x3002), SPACES)


def word_marks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text given as code points (as bytes if all are below 256)."""
    kind = np.where(_SPACE[codes if codes.dtype == np.uint8 else np.minimum(codes, 0x3001)], 0, 1).astype(np.int8)
    if len(codes) and int(codes.max()) >= UNPARTED[0][0]:
        for lo, hi in UNPARTED:
            kind[(codes >= lo) & (codes <= hi) & (kind == 1)] = 2
    around = np.concatenate([[np.int8(0)], kind, [np.int8(0)]])
    start = np.flatnonzero((kind > 0) & ((kind != around[:-2]) | (kind == 2)))
    stop = np.flatnonzero((kind > 0) & ((kind != around[2:]) | (kind == 2))) + 1
    if len(start) and int((stop - start).max()) > LONG:
        times = np.where(stop - start > LONG, -(-(stop - start) // WIDTH), 1)
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        start, stop, times = np.repeat(start, times) + WIDTH * step, np.repeat(stop, times), np.repeat(times, times)
        stop = np.where(times > 1, np.minimum(stop, start + WIDTH), stop)
    return start, stop


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_symbols(texts: list[str], key: int = KEY) -> list[np.ndarray]:
    """The hashes of the words of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, held = 0, at
        while held < len(texts) and (held == at or size + len(texts[held]) < 1 << 20):
            size += len(texts[held]) + 1
            held += 1
        joined = "\n".join(texts[at:held])
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        codes = raw if joined.isascii() else _codes(joined)
        start, stop = word_marks(codes)
        ends = np.cumsum([len(t) + 1 for t in texts[at:held]])
        bounds = [0, *np.searchsorted(start, ends).tolist()]
        if codes is not raw:  # places of letters as places of bytes
            place = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
            start, stop = place[start], place[stop]
        word = word_hashes(raw, start, stop, key)
        out += [word[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]
        at = held
    return out


def suffix_array(s: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in ascending order (a suffix comes before those that it begins)."""
    n = len(s)
    counts: dict[int, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    first, at = {}, 0
    for c in sorted(counts):
        first[c] = at
        at += counts[c]
    group = [first[c] for c in s]  # a group is named by its place in the array
    size = {first[c]: k for c, k in counts.items()}
    members: list[list[int] | None] = [None] * n
    for i, g in enumerate(group):
        if members[g] is None:
            members[g] = []
        members[g].append(i)
    word, smaller = [1] * n, [-1] * n
    for g in range(n - 1, -1, -1):
        own = members[g]
        if own is None:
            continue
        own = sorted(i for i in own if group[i] == g)
        members[g] = None
        if not own:
            continue
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        width = word[own[0]]
        by: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            by.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(by, reverse=True):
            for h, moved in by[k].items():
                size[h] -= len(moved)
                new = h + size[h]
                size[new] = len(moved)
                members[new] = moved
                for p in moved:
                    group[p] = new
                    word[p] += k * width
    followers: list[list[int] | None] = [None] * (n + 1)
    for i in range(n):
        end = i + word[i]
        if followers[end] is None:
            followers[end] = [i]
        else:
            followers[end].append(i)
    out = [0] * n
    free = dict.fromkeys(group, 0)
    for i in followers[n] or ():
        g = group[i]
        out[g + free[g]] = i
        free[g] += 1
    for r in range(n):
        for i in followers[out[r]] or ():
            g = group[i]
            out[g + free[g]] = i
            free[g] += 1
    return out


def anchors(texts: list[np.ndarray], length: int, gram: int, named: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts (as symbols) of ``length`` and more: (index, places, anchor hashes, pairs of context hashes (``named``), symbols before, symbols from the place on)."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        if held and size + len(t) > 2 << 20:
            yield from _anchors(at, held, length, gram, named)
            at, size, held = i, 0, []
        held.append(t)
        size += len(t)
    if held:
        yield from _anchors(at, held, length, gram, named)


def _anchors(first: int, texts: list[np.ndarray], length: int, gram: int, named: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    raw = np.concatenate(texts)
    n = len(raw)
    if n < length:
        return
    sums, (_, down) = prefix_hash(raw), powers(n + 1)
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    bits = np.uint64(max(24, n.bit_length()))
    # least hash, then leftmost place, in every run of length - gram + 1 grams
    low, width, full = (grams >> bits) << bits | np.arange(len(grams), dtype=np.uint64), 1, length - gram + 1
    while width < full:
        step = min(width, full - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    picked = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    for i, (begin, end) in enumerate(zip((ends - [len(t) for t in texts]).tolist(), ends.tolist(), strict=True)):
        if end - begin < length:
            continue
        own = picked[begin : end - length + 1]
        turns = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        # the strings that hold p as their anchor start from lo on, and the last of them ends at hi
        p, lo, hi = own[turns], begin + turns, begin + np.append(turns[1:], len(own)) - 1 + length
        context = np.zeros((0, 2), np.int64)
        if named:  # what decides over equality is a hash that no pattern of texts makes meet
            view, width = memoryview(raw[begin:end].tobytes()), raw.itemsize
            told = b"".join([blake2b(view[a:z], digest_size=16).digest() for a, z in zip(((lo - begin) * width).tolist(), ((hi - begin) * width).tolist(), strict=True)])
            context = np.frombuffer(told, np.int64).reshape(-1, 2)
        yield first + i, p - begin, grams[p].astype(np.int64), context, p - lo, hi - p


def _shared(parts: list[bytes]) -> tuple[list[int], list[int]]:
    """Of each string the longest prefix that it shares with another one of the list; all such lengths of two strings, ascending."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out, cuts = [0] * len(parts), set()
    for a, b in zip(order, order[1:], strict=False):
        x, y = parts[a], parts[b]
        m = min(len(x), len(y))
        if x[:m] != y[:m]:
            m = int((np.frombuffer(x, np.uint8, m) != np.frombuffer(y, np.uint8, m)).argmax())
        cuts.add(m)
        out[a], out[b] = max(out[a], m), max(out[b], m)
    return out, sorted(cuts)


def longest_common(s: list[int], array: list[int]) -> list[int]:
    """Of each place in the suffix array, the symbols shared with the one before it."""
    n, rank = len(s), [0] * len(s)
    for r, i in enumerate(array):
        rank[i] = r
    out, k = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = array[rank[i] - 1]
            m = n - max(i, j)
            while k < m and s[i + k] == s[j + k]:
                k += 1
            out[rank[i]] = k
            k = max(0, k - 1)
        else:
            k = 0
    return out


def repeated_spans(before: list[int], texts: list[bytes], decided: list[bool], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Of contexts of one anchor (``before``: bytes in front of it) the spans covered by strings of ``length`` bytes that two of them share.

    Equal strings have their anchors at equal places, so contexts are compared as they lie. Any two
    contexts part ways, on either side, at one of a few distances from the anchor; cut there, a
    context is a short sequence of pieces, and what two sequences share in pieces they share in
    bytes. The suffix array of these sequences then gives, for every left distance, how far to the
    right a context agrees with another one that agrees so far to the left.
    """
    left, left_cuts = _shared([t[:b][::-1] for t, b in zip(texts, before, strict=True)])
    right, right_cuts = _shared([t[b:] for t, b in zip(texts, before, strict=True)])
    # what parts two contexts nearer to the anchor than any string's other side allows can't matter
    left_cuts = [c for c in left_cuts if c >= length - max(right)]
    right_cuts = [c for c in right_cuts if c >= length - max(left)]
    if len(texts) > 2 and sum(bisect_right(left_cuts, a) + bisect_right(right_cuts, b) + 1 for a, b in zip(left, right, strict=True) if a + b >= length) > MOST_SYMBOLS:
        return _by_parts(before, texts, decided, length)
    names: dict[tuple[int, int, bytes], int] = {}
    symbols: list[int] = []
    widths: list[int] = []
    at: list[tuple[int, int, int]] = []  # place in symbols, context, left distance
    for i, (text, b) in enumerate(zip(texts, before, strict=True)):
        if left[i] + right[i] < length:
            continue
        marks = [c for c in left_cuts if 0 < c <= left[i]]
        for far, near in zip(reversed(marks), [*reversed(marks[:-1]), 0], strict=False):
            at.append((len(symbols), i, far))
            symbols.append(names.setdefault((0, near, text[b - far : b - near]), len(names)))
            widths.append(far - near)
        at.append((len(symbols), i, 0))
        near = 0
        for far in (c for c in right_cuts if 0 < c <= right[i]):
            symbols.append(names.setdefault((1, near, text[b + near : b + far]), len(names)))
            widths.append(far - near)
            near = far
        symbols.append(-1 - i)
        widths.append(0)
    array = suffix_array(symbols)
    common, rank, sums = longest_common(symbols, array), [0] * len(symbols), [0]
    for r, i in enumerate(array):
        rank[i] = r
    for w in widths:
        sums.append(sums[-1] + w)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    inner = 0  # the next left distance nearer to the anchor, plus one
    for k in range(len(at) - 1, -1, -1):
        place, i, far = at[k]
        r = rank[place]
        most = max(common[r], common[r + 1] if r + 1 < len(common) else 0)
        reach = sums[place + most] - sums[place] - far
        least = max(inner if far else 0, length - reach)
        if not decided[i] and reach > 0 and least <= far:
            start, stop = before[i] - far, before[i] - least + length
            own = spans[i]
            if own and start <= own[-1][1] and stop >= own[-1][0]:
                own[-1] = (min(start, own[-1][0]), max(stop, own[-1][1]))
            else:
                own.append((start, stop))
        inner = far + 1
    return spans


def _by_parts(before: list[int], texts: list[bytes], decided: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """The same for very many contexts: any two of them meet in some pair of three parts."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    parts = [list(range(k, len(texts), 3)) for k in range(3)]
    for x, y in combinations(parts, 2):
        own = x + y
        for i, found in zip(own, repeated_spans(*([c[i] for i in own] for c in (before, texts, decided)), length), strict=True):
            spans[i] += found
    return spans


def _symbols(batch: pa.RecordBatch, done: set[int], words: bool, key: int) -> tuple[list[int], list[np.ndarray]]:
    """Ids and texts of a batch as bytes or words; texts that this task has seen are empty."""
    ids, texts = batch.column("id").to_pylist(), []
    for i, t in zip(ids, batch.column("text").to_pylist(), strict=True):
        texts.append("" if i in done or not t else t)
        done.add(i)
    return ids, word_symbols(texts, key) if words else [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]


def _anchor_rows(docs: DataFrame, length: int, words: bool, key: int) -> DataFrame:
    """``anchor, context, check, id, place, before, after`` of every distinct text of a task; an equal context is one of equal ``context`` and ``check``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            ids, texts = _symbols(b, done, words, key)
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(7)]
            for i, place, anchor, context, before, after in anchors(texts, length, GRAM_WORDS if words else GRAM):
                for c, v in zip(columns, (anchor, context[:, 0], context[:, 1], np.full(len(place), ids[i]), place, before, after), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], ["anchor", "context", "check", "id", "place", "before", "after"])

    return docs.select("id", "text").mapInArrow(run, "anchor long, context long, check long, id long, place long, before long, after long")


def _name(i: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a place in a text."""
    i, place = (x.astype(np.uint64) for x in (i, place))
    one = mix(mix(i) + place)
    return one.astype(np.int64), mix(one ^ i).astype(np.int64)


def _names(rows: DataFrame) -> DataFrame:
    """Add ``name`` and ``name2``."""
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = _name(*(b.column(c).to_numpy() for c in ("id", "place")))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, names)], [*b.schema.names, "name", "name2"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("name", LongType()), StructField("name2", LongType())]))


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, words: bool, key: int) -> DataFrame:
    """``wanted`` with ``body``, its contexts' bytes: one text pass, a bit filter and a join by name."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            ids, texts = _symbols(b, done, words, key)
            names, bodies = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]], []
            for i, place, _, _, before, after in anchors(texts, length, GRAM_WORDS if words else GRAM, False):
                both = _name(np.full(len(place), ids[i]), place)
                at = np.flatnonzero(hits(shared.value, both[0]))
                for held, name in zip(names, both, strict=True):
                    held.append(name[at])
                bodies += [texts[i][p - q : p + r].tobytes() for p, q, r in zip(place[at].tolist(), before[at].tolist(), after[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(n), pa.int64()) for n in names), pa.array(bodies, pa.binary())], ["name", "name2", "body"])

    bodies = docs.select("id", "text").mapInArrow(run, "name long, name2 long, body binary").dropDuplicates(["name", "name2"])
    return wanted.join(bodies, ["name", "name2"])


def _sorted_spans(rows: DataFrame, length: int, width: int) -> DataFrame:
    """``id, start, stop`` of the repeats that suffix arrays find among the contexts of each anchor; symbols are ``width`` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by anchor and piece pair; all but the last group are whole
            table = pa.Table.from_batches([*held, b])
            anchor, pair = (table.column(c).to_numpy() for c in ("anchor", "pair"))
            ends = [0, *(np.flatnonzero((anchor[1:] != anchor[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist()]
            yield spans(table, ends)
            held = table.slice(ends[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield spans(table, [0, table.num_rows])

    def spans(table: pa.Table, ends: list[int]) -> pa.RecordBatch:
        out: list[tuple[int, int, int]] = []
        for a, z in zip(ends, ends[1:], strict=False):
            before, bodies, ids, places, twice = (table.column(c).slice(a, z - a).to_pylist() for c in ("before", "body", "id", "place", "twice"))
            for i, p, b, found in zip(ids, places, before, repeated_spans([width * x for x in before], bodies, twice, width * length), strict=True):
                # an end within a word is a chance likeness of two hashes
                out += [(i, p - b - (-s // width), p - b + e // width) for s, e in found if e // width + (-s // width) >= length]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["id", "start", "stop"])

    ordered = rows.repartition(shuffle_width(rows.sparkSession), "anchor", "pair").sortWithinPartitions("anchor", "pair", "context")
    return ordered.mapInArrow(run, "id long, start long, stop long")


def repeats(docs: DataFrame, length: int = LENGTH, words: bool = False) -> DataFrame:
    """``id, spans`` (array of start, stop; maximal and ascending) of every text that loses bytes (or words, with ``words``); ``docs`` has ``id, text``."""
    key = randbits(63)  # words are hashed under a key that no text can be made for
    found, release = scratch_table(_anchor_rows(docs, length, words, key))
    # Pre-aggregated where they are found, so an anchor or a context of a third of all texts is a row a task.
    where = F.xxhash64("id", "place")
    contexts = found.groupBy("anchor", "context", "check").agg(*(F.first(c).alias(c) for c in ("id", "place", "before", "after")), (F.min(where) != F.max(where)).alias("twice"))
    several = contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    live = cut(contexts.join(several, "anchor", "left").where("twice or n is not null"))
    # Equal contexts at two places: all of their strings are repeats, wherever they stand.
    equal = found.join(live.where("twice").select("anchor", "context", "check"), ["anchor", "context", "check"], "left_semi")
    equal = equal.select("id", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("stop"))
    wanted = _contexts(docs, cut(_names(live.where("n is not null").select("anchor", "context", "id", "place", "before", "twice", "n"))), length, words, key)
    # An anchor with very many contexts is sorted pair of pieces by pair of pieces.
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    wanted = wanted.withColumn("own", F.pmod(F.xxhash64("context"), pieces).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    wanted = wanted.withColumn("pair", F.greatest("own", "other") * F.lit(1 << 15) + F.least("own", "other")).drop("own", "other", "n", "name", "name2")
    spans = equal.unionByName(_sorted_spans(wanted, length, WIDTH if words else 1))
    # Overlapping and touching spans become one.
    by = Window.partitionBy("id").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.distinct().withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    out = cut(merged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")))
    release()
    return out


def _named(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_id``, the name of the text, which no other text has; and ``id, copies, n`` (bytes) of the names."""
    body = F.coalesce(F.col(text), F.lit(""))
    one, two = F.xxhash64(body, F.octet_length(body)), F.conv(F.substring(F.sha2(body.cast("binary"), 256), 1, 15), 16, 10).cast("long")

    def counted(rows: DataFrame) -> DataFrame:
        return cut(rows.select(F.col("_id").alias("id"), two.alias("two"), F.octet_length(body).alias("n")).groupBy("id").agg(F.count("*").alias("copies"), F.first("n").alias("n"), (F.min("two") != F.max("two")).alias("clash")))

    named = docs.withColumn("_id", one)
    copies = counted(named)
    # Of n texts about n * n / 2**65 names clash: a handful at 10**10.
    clashing = [r.id for r in copies.where("clash").select("id").collect()]
    if clashing:
        named = docs.withColumn("_id", F.when(one.isin(clashing), two).otherwise(one))
        copies = counted(named)
    return named, copies


def _lost(texts: DataFrame, copies: DataFrame, length: int, words: bool) -> DataFrame:
    """``_id, spans`` of all repeats in symbols; those of a whole text that stands twice reach beyond any text's end with ``words``."""
    end = F.lit(1 << 40) if words else F.col("n")
    whole = copies.where("copies > 1" if words else f"copies > 1 and n >= {length}").select("id", F.array(F.struct(F.lit(0).cast("long").alias("start"), end.cast("long").alias("stop"))).alias("all"))
    return repeats(texts, length, words).join(whole, "id", "full").select(F.col("id").alias("_id"), F.coalesce("all", "spans").alias("spans"))


def _in_bytes(text: str, spans: list[dict[str, int]] | None, least: int) -> list[dict[str, int]]:
    """Spans of a text's words as bytes; words go with the white space behind them."""
    if not spans or not text:
        return []
    start, _ = word_marks(_codes(text))
    places, out = [0, *start[1:].tolist(), len(text)], []
    for s in spans:
        a, z = s["start"], min(s["stop"], len(start))
        if z - a >= least:
            before = len(text[: places[a]].encode("utf-8", "surrogatepass"))
            out.append({"start": before, "stop": before + len(text[places[a] : places[z]].encode("utf-8", "surrogatepass"))})
    return out


def remove_repeats(docs: DataFrame, text: str = "text", in_place: bool = False, length: int = LENGTH, words: int | None = None, report: int | None = None) -> DataFrame:
    """``docs`` with ``kept`` (binary, the remaining bytes) and ``spans`` (array of start, stop: maximal removed runs).

    A repeat has ``length`` bytes at least or, where ``words`` is given, that many words; then words go with the white
    space behind them, and runs are in bytes all the same. Columns of these names in ``docs`` are replaced.

    With ``in_place`` the text itself becomes what remains, less letters that a cut has torn, and there is no ``kept``.
    With ``report`` there are ``passages`` besides, runs (in bytes of the text) of passages of that many words that also
    stand elsewhere; they are told, not cut.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(docs.sparkSession)
    docs = docs.drop("kept", "spans", "passages")
    names = list(docs.columns)
    named, copies = _named(docs, text)
    texts = named.select(F.col("_id").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = "array<struct<start:long,stop:long>>"
    lost = _lost(texts, copies, words or length, words is not None)
    told = ["spans"]
    if report is not None:
        lost = lost.join(_lost(texts, copies, report, True).withColumnRenamed("spans", "passages"), "_id", "full")
        told.append("passages")
    joined = named.join(cut(lost), "_id", "left").select(*names, *(F.coalesce(c, F.array().cast(kind)).alias(c) for c in told))

    def cut_spans(t: str | None, spans: list[dict[str, int]] | None) -> bytes:
        raw, at, parts = (t or "").encode("utf-8", "surrogatepass"), 0, []
        for s in spans or ():
            parts.append(raw[at : s["start"]])
            at = s["stop"]
        return b"".join([*parts, raw[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(c) for c in names}
            body, spans = b.column(text).to_pylist(), b.column("spans").to_pylist()
            if words is not None:
                spans = [_in_bytes(t or "", s, words) for t, s in zip(body, spans, strict=True)]
            if in_place:
                columns[text] = pa.array([cut_spans(t, s).decode("utf-8", "ignore") if s else t for t, s in zip(body, spans, strict=True)], pa.string())
            else:
                columns["kept"] = pa.array([cut_spans(t, s) for t, s in zip(body, spans, strict=True)], pa.binary())
            columns["spans"] = pa.array(spans, b.column("spans").type) if words is not None else b.column("spans")
            if report is not None:
                columns["passages"] = pa.array([_in_bytes(t or "", s, report) for t, s in zip(body, b.column("passages").to_pylist(), strict=True)], b.column("passages").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    extra = _parse_datatype_string(("" if in_place else "kept binary, ") + ", ".join(f"{c} {kind}" for c in told))
    return joined.mapInArrow(run, StructType([*docs.schema.fields, *extra.fields]))
