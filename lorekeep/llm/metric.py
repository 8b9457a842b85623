"""Operator 7: near-duplicate vectors by an exact metric range join.

Equal vectors are collapsed into classes first. Unit vectors of one label are dealt to the nearest
of that label's pivots. By the triangle inequality a vector within ``r`` of a member of cell ``c``
is within ``R(c) + r`` of its pivot, and by the same inequality on both pivots at most ``2 r``
farther from it than from its own, so a vector is copied to those cells only. Cells that are still
large are dealt again by pivots of their own, until all are small or pivots no longer part them.
Each cell then compares its members with all that reach it, block with block, and gives counts and
spanning links, not pairs; a task holds two blocks, whatever the size of a cell.

Cosines that lie within rounding of the threshold are decided by exact sums over the vectors as given.

Defined cases: vectors that are null, zero or hold null or non-finite components, and vectors of a
null label, have no links; vectors of different lengths never link; repeated ids are separate
vectors; a null id takes part but never names a component unless all are null; an empty table gives
an empty result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import cut
from .graph import components

#: Members for which a cell gets one more pivot, and pivots of a cell; rows of a block, which a cell has before it is parted.
PER_PIVOT, MOST_PIVOTS, BLOCK = 1024, 128, 4096
#: Bytes of the pivots of one pass, which every task holds; cells beyond wait for the next pass.
PIVOT_BYTES = 64 << 20
#: A cell whose copies would be so many times its rows is not parted; its blocks are compared as they are.
MOST_COPIES = 8
#: Slack of distances computed from rounded unit vectors.
SLACK = 1e-9
_ROWS = "id long, times long, vector binary, cell string, home boolean"


def given_rows(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def unit_rows(vectors: list[bytes] | np.ndarray) -> np.ndarray:
    """The vectors, in unit length."""
    x = vectors if isinstance(vectors, np.ndarray) else given_rows(vectors)
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine of two vectors with sums that are rounded once; scaling by powers of two loses nothing."""
    x, y = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])).tolist() for v in (x, y))
    dot, p, q = (math.fsum(s * t for s, t in zip(*z, strict=True)) for z in ((x, y), (x, x), (y, y)))
    return dot / math.sqrt(p * q)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have a cosine of at least ``least``, in double precision; close calls are summed exactly."""
    cosine = unit_rows(a) @ unit_rows(b).T
    out = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-12), strict=True):
        out[i, j] = exact_cosine(a[i], b[j]) >= least
    return out


class Forest:
    """Union-find over 0 .. n-1; the least index is the root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def link(self, rows: np.ndarray, columns: np.ndarray) -> None:
        """Join rows[i] with columns[i] for all i, by hooking and halving."""
        while len(rows):
            a, b = self.up[rows], self.up[columns]
            differ = a != b
            if not differ.any():
                break
            rows, columns, a, b = rows[differ], columns[differ], a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (halved := self.up[self.up]).tobytes() != self.up.tobytes():
                self.up = halved


def _compare(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of home rows and one of rows that reach the cell: (ids, home rows, their link counts, roots)."""
    ids, times = (table.column(c).to_numpy() for c in ("id", "times"))
    left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
    x = given_rows(table.column("vector").to_pylist())
    forest, own, other = Forest(len(ids)), np.flatnonzero(left), np.flatnonzero(right)
    counts = np.zeros(len(own), np.int64)
    for i in range(0, len(own), BLOCK // 4):
        part = own[i : i + BLOCK // 4]
        r, c = np.nonzero(similar(x[part], x[other], least)) if len(other) else (np.zeros(0, np.int64),) * 2
        counts[i : i + len(part)] += np.bincount(r, weights=times[other[c]], minlength=len(part)).astype(np.int64)
        forest.link(part[r], other[c])
    return ids, own, counts, ids[forest.up]


def _parted(rows: DataFrame, radius: float) -> DataFrame:
    """``rows`` of ``id, times, vector, cell, home``, with large cells dealt to cells of their own pivots.

    A pass parts as many cells, the largest first, as their pivots' bytes allow; a number a pivot
    comes to the driver, and only the pivots are broadcast.
    """
    spark = rows.sparkSession
    whole, done = rows, []
    while True:
        sizes = whole.where("home and not endswith(cell, '!')").groupBy("cell").agg(F.count("*").alias("n"), F.max(F.octet_length("vector")).alias("bytes")).where(F.col("n") > BLOCK)
        first = sizes.agg(F.max("bytes")).first()[0]
        if first is None:
            break
        chosen = sizes.orderBy(F.desc("n"), "cell").limit(max(1, PIVOT_BYTES // (first * MOST_PIVOTS)))
        chosen = cut(chosen.select("cell", F.least(F.ceil(F.col("n") / PER_PIVOT), F.lit(MOST_PIVOTS)).alias("k"), "n"))
        held = {r.cell for r in chosen.select("cell").collect()}
        mine = F.col("cell").isin(held) if len(held) <= 1000 else None
        there = whole.where(mine) if mine is not None else whole.join(F.broadcast(chosen.select("cell")), "cell", "left_semi")
        rest = whole.where(~mine) if mine is not None else whole.join(F.broadcast(chosen.select("cell")), "cell", "left_anti")
        parted = cut(_deal(there, chosen, radius))
        old = F.regexp_extract("cell", "^(.*)/[^/]*$", 1)
        before = there.groupBy("cell").agg(F.count("*").alias("m"))
        after = parted.groupBy("cell").agg(F.count("*").alias("m"), F.count_if("home").alias("own")).groupBy(old.alias("cell")).agg(F.sum("m").alias("copies"), F.max("own").alias("most"))
        dense = cut(before.join(after, "cell").join(chosen, "cell").where(f"copies > {MOST_COPIES} * m or most > 0.95 * n").select("cell"))
        if not dense.isEmpty():  # pivots don't part these
            flags = dense.select(F.col("cell").alias("_cell"), F.lit(True).alias("_dense"))
            kept = there.join(flags, F.col("cell") == F.col("_cell")).select("id", "times", "vector", F.concat("cell", F.lit("!")).alias("cell"), "home")
            parted = parted.join(F.broadcast(dense.select(F.col("cell").alias("_cell"))), old == F.col("_cell"), "left_anti").unionByName(kept)
        done.append(parted)
        whole = rest.unionByName(parted)
        if len(done) % 8 == 0:  # a plan must not grow with the count of passes
            whole = cut(whole)
    return whole


def _deal(rows: DataFrame, chosen: DataFrame, radius: float) -> DataFrame:
    """Rows of the chosen cells (``cell, k, n``) by pivots: home rows to the nearest, all rows to the cells that they may reach."""
    spark = rows.sparkSession
    drawn = rows.where("home").join(F.broadcast(chosen), "cell").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("k") * 4 * (1 << 30) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
    pivots: dict[str, list[bytes]] = {}
    for r in drawn.withColumn("rank", rank).where("rank <= k").orderBy("cell", "rank").select("cell", "vector").collect():  # PIVOT_BYTES at most
        pivots.setdefault(r.cell, []).append(bytes(r.vector))
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch], reach: dict[tuple[str, int], float] | None = None) -> Iterator[pa.RecordBatch]:
        """Home rows with their pivot and its distance; with the cells' radii all rows, and copies."""
        units: dict[str, np.ndarray] = {}
        for b in batches:
            names, homes = np.array(b.column("cell").to_pylist(), object), b.column("home").to_numpy(zero_copy_only=False)
            rows, cells, own, nears = [np.zeros(0, np.int64)], [], [np.zeros(0, bool)], [np.zeros(0)]
            for name in dict.fromkeys(names.tolist()):
                at = np.flatnonzero(names == name)
                if name not in units:
                    units[name] = unit_rows(shared.value.get(name, []))
                p = units[name]
                if not len(p):  # no home row was drawn: the cell stays one, which its parent's marks then tell
                    d = np.zeros((len(at), 1))
                else:
                    d = np.sqrt(np.maximum(0, 2 - 2 * (unit_rows([b.column("vector")[int(i)].as_py() for i in at]) @ p.T)))
                to = d.argmin(1)
                near = d[np.arange(len(at)), to]
                if reach is None:
                    r, c = np.flatnonzero(homes[at]), to[homes[at]]
                else:
                    limit = np.array([reach.get((name, c), -9.0) for c in range(d.shape[1])])
                    r, c = np.nonzero(((np.arange(d.shape[1]) == to[:, None]) & homes[at][:, None]) | ((d <= limit + radius + 1e-6) & (d - near[:, None] <= 2 * radius + 1e-6)))
                rows.append(at[r])
                cells += [f"{name}/{k}" for k in c.tolist()]
                own.append((c == to[r]) & homes[at][r])
                nears.append(d[r, c])
            take = pa.array(np.concatenate(rows), pa.int64())
            if reach is None:
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(np.concatenate(nears), pa.float64())], ["cell", "near"])
            else:
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "times", "vector")), pa.array(cells, pa.string()), pa.array(np.concatenate(own), pa.bool_())], ["id", "times", "vector", "cell", "home"])

    radii = rows.where("home").mapInArrow(nearest, "cell string, near double").groupBy("cell").agg(F.max("near").alias("r"))
    reach = {}
    for r in radii.collect():  # a number a pivot
        name, _, k = r.cell.rpartition("/")
        reach[name, int(k)] = r.r
    told = spark.sparkContext.broadcast(reach)
    return rows.mapInArrow(lambda batches: nearest(batches, told.value), _ROWS)


def range_join(vectors: DataFrame, key: str, vector: str, label: str, least: float) -> DataFrame:
    """``key, n_links, component_id`` of every row of ``vectors``."""
    radius = math.sqrt(2 - 2 * least) + SLACK
    named = vectors.select(
        F.col(key).alias("_key"),
        F.col(label).cast("string").alias("_label"),
        F.when(F.size(vector) > 0, F.col(vector).cast("array<double>")).alias("_v"),
    )
    finite = F.forall("_v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("_v", lambda e: e != 0)
    good = F.coalesce(F.col("_label").isNotNull() & F.col("_v").isNotNull() & finite, F.lit(False))
    # Two hashes name a class; of n vectors about n * n / 2**65 share the first, a handful at 10**10, which then go by the second.
    named = named.withColumn("_id", F.when(good, F.xxhash64("_label", F.size("_v"), "_v"))).withColumn("_two", F.when(good, F.xxhash64(F.lit("again"), F.reverse("_v"), "_label")))
    classes = cut(named.where("_id is not null").groupBy("_id", "_two").agg(F.count("*").alias("times"), F.min("_key").alias("first"), F.first("_label").alias("label"), F.first("_v").alias("v")))
    clashing = [r._id for r in classes.groupBy("_id").count().where("count > 1").select("_id").collect()]
    if clashing:
        name = F.when(F.col("_id").isin(clashing), F.col("_two")).otherwise(F.col("_id"))
        named, classes = named.withColumn("_id", name), classes.withColumn("_id", name)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = [np.array(v, "<f8").tobytes() for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "times", "first", "label")), pa.array(body, pa.binary())], ["id", "times", "first", "label", "vector"])

    classes = cut(classes.mapInArrow(packed, StructType([*_parse_datatype_string("id long, times long").fields, StructField("first", vectors.schema[key].dataType), *_parse_datatype_string("label string, vector binary").fields])))
    # Vectors of different lengths are different labels from here on; a label is named by its hash, which no pivot's number can be taken for.
    cell = F.concat_ws(":", F.octet_length("vector").cast("string"), F.sha2("label", 256))
    dealt = _parted(classes.select("id", "times", "vector", cell.alias("cell"), F.lit(True).alias("home")), radius)
    # Blocks of a cell's home rows meet blocks of all that reach it; a row goes to the pairs that its block is in.
    blocks = dealt.groupBy("cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("lefts"), F.ceil(F.count("*") / BLOCK).cast("int").alias("rights"))
    dealt = dealt.join(blocks.where("lefts > 0"), "cell")
    some = F.xxhash64("id")
    left = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(F.pmod(some, F.col("lefts")).cast("int").alias("i"), j.alias("j"))))
    right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), F.pmod(some, F.col("rights")).cast("int").alias("j")))
    pairs = F.array_distinct(F.concat(F.coalesce(left, F.array().cast("array<struct<i:int,j:int>>")), right))
    spread = dealt.select("id", "times", "vector", "cell", "home", "lefts", "rights", F.explode(pairs).alias("p"))
    spread = spread.select("id", "times", "vector", "cell", F.col("p.i").alias("i"), F.col("p.j").alias("j"), (F.col("home") & (F.pmod(some, F.col("lefts")) == F.col("p.i"))).alias("left"), (F.pmod(some, F.col("rights")) == F.col("p.j")).alias("right"))

    def join(table: pa.Table) -> pa.Table:
        ids, own, counts, roots = _compare(table, least)
        linked = np.flatnonzero(roots != ids)
        kind = pa.array([0] * len(own) + [1] * len(linked), pa.int8())
        return pa.table({"kind": kind, "id": pa.array(np.concatenate([ids[own], ids[linked]])), "value": pa.array(np.concatenate([counts, roots[linked]]))})

    found = cut(spread.groupBy("cell", "i", "j").applyInArrow(join, "kind byte, id long, value long"))
    counts = found.where("kind = 0").groupBy("id").agg(F.sum("value").alias("n"))
    roots = components(found.where("kind = 1").select(F.col("id").alias("u"), F.col("value").alias("v")))
    rooted = classes.select("id", "first").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least_key = rooted.groupBy("root").agg(F.min("first").alias("component"))
    told = rooted.join(least_key, "root").join(counts, "id").select(F.col("id").alias("_id"), (F.col("n") - 1).alias("n"), "component")
    return named.select("_key", "_id").join(told, "_id", "left").select(
        F.col("_key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_key").alias("component_id")
    )
