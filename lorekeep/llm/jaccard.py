"""Operator 4: exact n-gram Jaccard join by R-trees over count vectors.

Texts become sets of hashed shingles; equal sets are one class. Two sets that reach the threshold
share three of the first ``n - ceil(0.75 n) + 3`` members of either in any common order; sets that
share such members form blocks, and members that are frequent in the corpus come last in the order.
In a block, each set is the point of its members' counts by hash group; an R-tree of these points
gives for a set the others whose summed coordinate minima reach the overlap that the threshold asks
for, finer groups bound it again, and the pairs that survive are verified on the sets themselves.

Pairs are verified in two rounds. In the first a block gives at most one pair a set (to the first
set that it may match); in the second it gives all pairs whose sets are not in one component yet.
So a group of near copies costs about a pair a copy, and no link between components is lost.

Defined cases: null, empty and blank texts have empty sets and link with nothing; repeated rows and
equal sets are one class; long texts are taken whole; an empty table gives an empty result; a null
key takes part but names a component only if all are null. The key and the text may have any name;
other columns are not looked at. Sets are named by 64 bits of hash; names that two sets share (a second
hash tells) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from secrets import randbits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, hits, shuffle_width, small_batches
from .graph import components
from .shingles import KEY, mix, shingle_sets

#: Percent of similarity from which two sets link.
PERCENT = 75
#: Hash groups of a tree's points, and the finer groups that a point is stored by.
GROUPS, FINE = 64, 1 << 16
#: Points of a leaf; members of a block that are compared in one piece.
LEAF, PIECE = 32, 2048
#: Shingles that come last in the order, at most (the most frequent of the corpus).
FREQUENT = 1 << 18
#: Slices of a task's members, of which one is held at a time; members that a task collects before it deals them out.
SLICES, HELD = 4, 2_000_000
#: Shared members that a pair of sets needs, and sets of a member up to which it counts pairs.
LEAST, FEW = 3, 8


def set_ids(members: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, whose members ascend."""
    one, two = np.frombuffer(blake2b(members.tobytes(), digest_size=16).digest(), np.int64).tolist()
    return one, two


def set_id(hashes: tuple[int, int], clashing: frozenset[int]) -> int:
    """The name of a set: its first hash, or the second where the first is one of those that different sets share."""
    return hashes[hashes[0] in clashing]


def count_point(members: np.ndarray) -> bytes:
    """The fine group of every member, ascending: the count vector of FINE groups without its zeros."""
    return (members >> np.uint64(48)).astype(np.uint16).tobytes()


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima: no two such sets share more."""
    return np.minimum(a, b).sum(axis=-1)


def reaches(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Does an overlap of sets of n and m members give the similarity?"""
    return 100 * overlap >= PERCENT * (n + m - overlap)


class CountTree:
    """An R-tree of count vectors: leaves of points that are close in size and counts, under boxes' upper corners."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray) -> None:
        self.sizes, self.points = sizes, points
        bands = np.floor(np.log(np.maximum(sizes, 1)) / np.log(4 / 3))
        self.order = np.lexsort((points[:, 0], points[:, 1], points[:, 2], bands))
        starts = np.arange(0, len(sizes), LEAF)
        self.levels = [(np.maximum.reduceat(points[self.order], starts, axis=0), np.minimum.reduceat(sizes[self.order], starts), np.maximum.reduceat(sizes[self.order], starts))]
        while len(self.levels[-1][1]) > LEAF:
            corner, least, most = self.levels[-1]
            starts = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(corner, starts, axis=0), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))

    def search(self, size: int, point: np.ndarray) -> np.ndarray:
        """Indices of all points whose bound reaches the threshold with ``point``."""
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least, most = self.levels[depth]
            fits = (100 * size >= PERCENT * least[nodes]) & (100 * most[nodes] >= PERCENT * size)
            nodes = nodes[fits]
            nodes = nodes[reaches(np.minimum(bound(corner[nodes], point), size), size, least[nodes])]
            width = len(self.levels[depth - 1][1]) if depth else len(self.sizes)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < width]
        at = self.order[nodes]
        return at[reaches(bound(self.points[at], point), size, self.sizes[at])]


class Block:
    """Members of a block with their points."""

    def __init__(self, sizes: np.ndarray, points: list[bytes], sides: np.ndarray) -> None:
        self.sizes, self.sides, self.cross = sizes, sides, bool(sides.any())
        self.fine = [np.frombuffer(p, np.uint16) for p in points]
        self.counts = np.stack([np.bincount(p // (FINE // GROUPS), minlength=GROUPS) for p in self.fine])
        self.tree = CountTree(sizes, self.counts) if len(sizes) > LEAF else None
        self.here = np.zeros(FINE, bool)

    def search(self, i: int) -> np.ndarray:
        """The members that i may match: those of the tree that the fine groups allow too.

        The members of another set whose fine group isn't empty in i are at least the summed minima.
        """
        if self.tree:
            found = self.tree.search(int(self.sizes[i]), self.counts[i])
        else:
            found = np.flatnonzero(reaches(np.minimum(bound(self.counts, self.counts[i]), np.minimum(self.sizes, self.sizes[i])), self.sizes[i], self.sizes))
        found = found[(found != i) & ((self.sides[found] != self.sides[i]) if self.cross else True)]
        if not len(found):
            return found
        self.here[self.fine[i]] = True
        starts = np.cumsum([0, *(len(self.fine[j]) for j in found[:-1].tolist())])
        most = np.add.reduceat(self.here[np.concatenate([self.fine[j] for j in found.tolist()])].astype(np.int64), starts)
        self.here[self.fine[i]] = False
        return found[reaches(np.minimum(most, self.sizes[i]), self.sizes[i], self.sizes[found])]


def block_pairs(block: Block, roots: np.ndarray | None) -> tuple[list[tuple[int, int]], bool]:
    """Candidate pairs of one block's members, and whether there may be more.

    Sides are 0 for members of one piece only, else 1 and 2, and pairs cross the sides. Without
    ``roots`` every member goes to the first leader that it may match; with them all pairs of
    different roots are given.
    """
    n = len(block.sizes)
    pairs: list[tuple[int, int]] = []
    if roots is not None:
        for i in range(n):
            found = block.search(i)
            pairs += [(i, j) for j in found[(found > i) & (roots[found] != roots[i])].tolist()]
        return pairs, False
    free, more, passed = np.ones(n, bool), False, set()
    for i in range(n):
        if n > LEAF and not free[i]:
            more = True  # not all are searched
            continue
        found = block.search(i)
        if not more:  # a search may find what doesn't find it, but similar sets always find each other
            passed.update((i, j) for j in found[found > i].tolist())
        if not free[i]:
            continue
        taken = found[free[found]]
        if not len(taken):  # all that it may match have a leader: one of them keeps it in play
            taken = found[:1]
        free[i] = False
        free[taken] = False
        pairs += [(i, j) for j in taken.tolist()]
    return pairs, more or not passed <= {(min(p), max(p)) for p in pairs}


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), len(change))


def describe(docs: DataFrame, key: str, text: str, secret: int = KEY) -> tuple[DataFrame, np.ndarray, frozenset[int]]:
    """Per row: key, ``n``, ``id`` and ``point`` of its set (null if empty); the corpus' most frequent shingles, ascending; hashes that sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), key=secret)
            both = [set_ids(s) if len(s) else (None, None) for s in sets]
            ids = [i for i, _ in both]
            n = len(sets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ones(n, bool)), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array([i for _, i in both], pa.int64()), pa.array([count_point(s) if len(s) else None for s in sets], pa.binary())], [key, "row", "n", "id", "id2", "point"])
            held += [s for s in dict(zip(ids, sets, strict=True)).values() if len(s)]
            if sum(map(len, held)) > 4_000_000:
                yield count(held)
                held = []
        yield count(held)

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        """Shingles of three of a task's texts and more."""
        seen, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        often = times >= 3
        n = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.array(np.zeros(n, bool)), pa.array(times[often].astype(np.int64)), pa.array(seen[often].astype(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], [key, "row", "n", "id", "id2", "point"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = to_arrow_type(docs.schema[key].dataType)
    both = cut(docs.select(key, text).mapInArrow(run, StructType([StructField(key, docs.schema[key].dataType), *_parse_datatype_string("row boolean, n long, id long, id2 long, point binary").fields])))
    top = both.where("not row").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(FREQUENT).select("id").collect()
    frequent = np.sort(np.array([r.id for r in top], np.int64).astype(np.uint64))
    rows = both.where("row").drop("row")
    # Of n sets about n * n / 2**65 hashes clash: a handful at 10**10.
    clashing = frozenset(r.id for r in rows.where("id is not null").groupBy("id").agg(F.min("id2").alias("lo"), F.max("id2").alias("hi")).where("lo <> hi").select("id").collect())
    if clashing:
        rows = rows.withColumn("id", F.when(F.col("id").isin(list(clashing)), F.col("id2")).otherwise(F.col("id")))
    return rows.drop("id2"), frequent, clashing


def prefix_length(n: int) -> int:
    """Members of a set of n, first in the order, of which two similar sets share LEAST (of fewer than 4: one)."""
    return n - -(-PERCENT * n // 100) + (LEAST if n >= 4 else 1)


def together(k: np.ndarray, n: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of member, size and set: pairs (a, b, times) of few sets that share members, and (a, b, 0) of many, under their least."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(k, kind="stable")
    k, n, i = k[order], n[order], i[order]
    ends = _runs(k)
    many = np.repeat(np.diff(ends) > 1, np.diff(ends))
    k, n, i = k[many], n[many], i[many]
    order = np.lexsort((i, n, k))
    k, n, i = k[order], n[order], i[order]
    first = _runs(k, i)[:-1]
    k, n, i = k[first], n[first], i[first]
    if not len(k):
        return none
    # sets of a run are close enough in size to be chained
    apart = np.append(True, (k[1:] != k[:-1]) | (100 * n[:-1] < PERCENT * n[1:]))
    starts = np.flatnonzero(apart)
    sizes = np.diff(np.append(starts, len(k)))
    a, b, w = [none[0]], [none[0]], [none[0]]
    for m in range(2, FEW + 1):
        at = starts[sizes == m]
        for x, y in combinations(range(m), 2):
            p, q = at + x, at + y
            near = 100 * n[p] >= PERCENT * n[q]
            p, q = p[near], q[near]
            a.append(np.minimum(i[p], i[q]))
            b.append(np.maximum(i[p], i[q]))
            w.append(np.where(n[p] < 4, LEAST, 1))
    large = sizes > FEW
    least = np.minimum.reduceat(i, starts)
    rows = np.repeat(large, sizes)
    a.append(np.repeat(least[large], sizes[large]))
    b.append(i[rows])
    w.append(np.zeros(int(rows.sum()), np.int64))
    a, b, w = (np.concatenate(x) for x in (a, b, w))
    if not len(a):
        return none
    order = np.lexsort((w == 0, b, a))
    a, b, w = a[order], b[order], w[order]
    first = _runs(a, b, w == 0)[:-1]
    return a[first], b[first], np.add.reduceat(w, first)


def blocks(docs: DataFrame, text: str, frequent: np.ndarray, clashing: frozenset[int] = frozenset(), secret: int = KEY) -> DataFrame:
    """``block, id``: sets that may be similar, by the members that they share at the head of the order.

    A member that few sets share gives pairs, which count: a pair that shares no member of many
    sets needs LEAST of them. The sets under a member of many sets form a block with the least of
    them, so the many members that a group of near copies shares fall into a few blocks.
    """
    width = max(8, shuffle_width(docs.sparkSession))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        ks, ns, ids, size = [], [], [], 0
        for b in batches:
            for s in shingle_sets(b.column(0).to_pylist(), key=secret):
                if not len(s) or (name := set_id(set_ids(s), clashing)) in done:
                    continue
                done.add(name)
                at = np.minimum(np.searchsorted(shared.value, s), max(0, len(shared.value) - 1))
                late = shared.value[at] == s if len(shared.value) else np.zeros(len(s), bool)
                ks.append(np.concatenate([s[~late], s[late]])[: prefix_length(len(s))])
                ns.append(np.full(len(ks[-1]), len(s), np.int32))
                ids.append(np.full(len(ks[-1]), name, np.int64))
                size += len(ks[-1])
            if size > HELD:
                yield dealt_out(ks, ns, ids)
                ks, ns, ids, size = [], [], [], 0
        if ks:
            yield dealt_out(ks, ns, ids)

    def dealt_out(*columns: list[np.ndarray]) -> pa.RecordBatch:
        k, n, i = map(np.concatenate, columns)
        # a task's members come in SLICES slices one after the other
        part = (mix(k) % np.uint64(width * SLICES)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        k, n, i, part = k[order], n[order], i[order], part[order]
        ends = _runs(part)
        rows = [pa.array([x[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (k, n, i)]
        return pa.RecordBatch.from_arrays([pa.array(part[ends[:-1]], pa.int64()), *rows], ["part", "ks", "ns", "ids"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:  # sorted by slice; one slice is held at a time
            for row in zip(*(b.column(c).to_pylist() for c in ("part", "ks", "ns", "ids")), strict=True):
                if row[0] != now and held:
                    yield met_in(held)
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield met_in(held)

    def met_in(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        k, n, i = (np.frombuffer(b"".join(r[c] for r in held), t) for c, t in enumerate((np.uint64, np.int32, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in together(k, n.astype(np.int64), i)], ["a", "b", "w"])

    keyed = docs.select(text).mapInArrow(keys, "part long, ks binary, ns binary, ids binary")
    dealt = keyed.repartitionById(width, (F.col("part") / SLICES).cast("int")).sortWithinPartitions("part")
    met = cut(dealt.mapInArrow(group, "a long, b long, w long"))
    few = met.where("w > 0").groupBy("a", "b").agg(F.sum("w").alias("w")).where(F.col("w") >= LEAST)
    few = few.select(F.xxhash64("a", "b").alias("block"), F.explode(F.array("a", "b")).alias("id"))
    return few.unionByName(met.where("w = 0").select(F.col("a").alias("block"), F.col("b").alias("id"))).distinct()


def live_sets(docs: DataFrame, text: str, ids: DataFrame, clashing: frozenset[int] = frozenset(), secret: int = KEY) -> DataFrame:
    """``id, members`` of the sets named in ``ids``: one text pass and a join on the survivors of a bit filter."""

    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            rows = []
            for s in shingle_sets(b.column(0).to_pylist(), key=secret):
                if not len(s) or (name := set_id(set_ids(s), clashing)) in done:
                    continue
                done.add(name)
                if hits(shared.value, np.array([name]))[0]:
                    rows.append((name, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary()))], ["id", "members"])

    found = docs.select(text).mapInArrow(run, "id long, members binary")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def candidate_pairs(members: DataFrame, rooted: bool) -> DataFrame:
    """``block, a, b, more`` from rows of ``block, left, right, side, id, n, point`` and, with ``rooted``, ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by block and pieces; all but the last block are whole
            table = pa.Table.from_batches([*held, b])
            last = _runs(*(table.column(c).to_numpy() for c in ("block", "left", "right")))[-2:][0]
            yield pairs(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    def pairs(table: pa.Table) -> pa.RecordBatch:
        out: list[tuple[int, int, int, bool]] = []
        if table.num_rows:
            name, left, right, ids, sizes, sides = (table.column(c).to_numpy() for c in ("block", "left", "right", "id", "n", "side"))
            points = table.column("point").to_pylist()
            roots = table.column("root").to_numpy() if rooted else None
            ends, seen = _runs(name, left, right), set()
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                order = a + np.lexsort((ids[a:z], sizes[a:z]))
                block = Block(sizes[order], [points[i] for i in order], sides[order])
                found, more = block_pairs(block, roots[order] if rooted else None)
                for i, j in found:
                    u, v = sorted((int(ids[order[i]]), int(ids[order[j]])))
                    if more or (u, v) not in seen:
                        seen.add((u, v))
                        out.append((int(name[a]), u, v, more))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["block", "a", "b", "more"])

    width = shuffle_width(members.sparkSession)
    ordered = members.repartition(width, "block", "left", "right").sortWithinPartitions("block", "left", "right")
    return ordered.mapInArrow(run, "block long, a long, b long, more boolean")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``u, v`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).to_pylist() for c in ("x", "y"))
            good = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                good.append(bool(reaches(int((q[at] == p).sum()), len(p), len(q))))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    sides = [sets.select(F.col("id").alias(n), F.col("members").alias(m)) for n, m in (("u", "x"), ("v", "y"))]
    return pairs.join(sides[1], "v").join(sides[0], "u").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def jaccard_components(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_shingles, component_id`` of every row: the least key that it reaches by links, itself included."""
    small_batches(docs.sparkSession)
    docs, named = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), key
    key, text = "_key", "_text"
    secret = randbits(63)  # words are hashed under a key that no text can be made for
    rows, frequent, clashing = describe(docs, key, text, secret)
    parts = cut(blocks(docs, text, frequent, clashing, secret))
    # A large block is compared piece against piece; each row goes to the pairs that its piece is in.
    pieces = parts.groupBy("block").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    spread = parts.join(pieces, "block").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    spread = spread.select("block", F.least("piece", "other").alias("left"), F.greatest("piece", "other").alias("right"), F.expr("case when piece = other then 0 when piece < other then 1 else 2 end").alias("side"), "id")
    points = rows.where("id is not null").select("id", "n", "point").dropDuplicates(["id"])
    first = cut(candidate_pairs(spread.join(points, "id"), False))
    pairs = lambda found: found.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    tried = cut(pairs(first))
    # Whatever may match anything in a block is in one of the first pairs, so these sets serve both rounds.
    sets = cut(live_sets(docs, text, tried.select(F.explode(F.array("u", "v")).alias("id")).distinct(), clashing, secret))
    links = cut(verified(tried, sets))
    roots = cut(components(links))
    # Blocks with members of several components, and more pairs than were tried.
    open_ = first.where("more").select("block").distinct()
    rooted = spread.join(open_, "block", "left_semi").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("block")
    second = cut(pairs(candidate_pairs(rooted.join(mixed, "block", "left_semi").join(points, "id"), True)).join(tried, ["u", "v"], "left_anti"))
    if not second.isEmpty():
        roots = components(links.unionByName(verified(second, sets)))
    classes = rows.where("id is not null").groupBy("id").agg(F.min(key).alias("first")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = classes.join(classes.groupBy("root").agg(F.min("first").alias("component")), "root").select("id", "component")
    return rows.join(least, "id", "left").select(F.col(key).alias(named), F.col("n").alias("n_shingles"), F.coalesce("component", key).alias("component_id"))
