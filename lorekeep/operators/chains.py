"""Longest simple paths of a graph, exactly and in bounded space; contracted graphs and their layers; sets in first-seen order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import cut


def hits_all(sets: list[frozenset], avoid: frozenset, most: int) -> bool:
    """Is there a set of at most ``most`` members, none of ``avoid``, that meets every one of ``sets``?"""
    if not sets:
        return True
    return most > 0 and any(hits_all([s for s in sets if x not in s], avoid, most - 1) for x in sets[0] - avoid)


def _pruned(step: DataFrame, left: int) -> DataFrame:
    """``root, node, path`` without the paths that no extension by ``left`` nodes needs; first where the rows are, then together.

    Of ascending paths to one node a path goes if every extension that it allows is allowed by an earlier path too, so what is kept has the
    least path of every length that can be reached. By Bollobás' theorem at most binomial(p + left, left) paths of p nodes are kept.
    """
    width = int(step.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for b in batches:  # sorted by root, node and path
            take = []
            for i, (root, node, path) in enumerate(zip(*(b.column(c).to_pylist() for c in ("root", "node", "path")), strict=True)):
                if (root, node) != now:
                    now, kept = (root, node), []
                own = frozenset(path[:-1])
                if hits_all(kept, own, left):
                    kept.append(own)
                    take.append(i)
            yield b.take(pa.array(take, pa.int64()))

    local = step.sortWithinPartitions("root", "node", "path").mapInArrow(run, step.schema)
    return local.repartition(width, "root", "node").sortWithinPartitions("root", "node", "path").mapInArrow(run, step.schema)


def chains(edges: DataFrame, roots: DataFrame, depth: int = 7) -> DataFrame:
    """``root, depth, path``: of each root a longest simple path of at most ``depth`` edges, of several the least.

    Paths grow by one edge a round, and of those that end at one node only those go on that some extension needs (see :func:`_pruned`), so a round has
    at most 70 rows a root and node for seven edges, where all simple paths would be as many as the out-degree's powers.
    """
    links = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("_dst")).where("src is not null and dst is not null").distinct())
    now = cut(roots.select(F.col("node").alias("root"), "node").where("node is not null").distinct().withColumn("path", F.array("node")))
    best = now.select("root", F.lit(0).alias("depth"), "path")
    for d in range(1, depth + 1):
        step = now.join(links, "node").where(~F.array_contains("path", F.col("_dst"))).select("root", F.col("_dst").alias("node"), F.concat("path", F.array("_dst")).alias("path"))
        now = cut(_pruned(step, depth - d))
        if now.isEmpty():
            break
        best = best.unionByName(now.groupBy("root").agg(F.min("path").alias("path")).select("root", F.lit(d).alias("depth"), "path"))
    return best.groupBy("root").agg(F.max(F.struct("depth", "path")).alias("b")).select("root", "b.depth", "b.path")  # a depth has one row a root


def _whole_chains(links: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``root, depth, path`` of the ``most`` longest chains, of any length; ``links`` are distinct and lead to other nodes.

    A round an edge tells who has a walk of that length. Nodes that drop out lead to no circle, so their longest walks are simple and are read off:
    of the nodes that a step may lead to, the least from which a walk of the edges that are left goes on. The others, once none drops out any more,
    lead to a circle; their chains are searched for exactly, in whatever space that needs (longest simple paths of graphs with circles are hard).
    """
    walks, n = [cut(links.select(F.col("src").alias("node")).distinct())], None
    while (last := n) != (n := walks[-1].count()) and n:
        walks.append(cut(links.join(walks[-1], links["dst"] == walks[-1]["node"], "left_semi").select(F.col("src").alias("node")).distinct()))
    endless = walks.pop()  # those before hold the nodes of a walk of 1, 2, 3 ... edges
    starts = roots.select("node").where("node is not null").distinct()
    settled, best = cut(starts.join(endless, "node", "left_anti")), {}
    for d in range(len(walks), 0, -1):  # ``most`` rows a length at most are here
        best = {r.node: d for r in walks[d - 1].join(settled, "node", "left_semi").orderBy("node").limit(most + len(best)).collect()} | best
        if len(best) >= most:
            break
    best = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most]
    shape = links.select(F.col("src").alias("root"), F.lit(0).alias("depth"), F.array("src").alias("path")).schema
    now = links.sparkSession.createDataFrame([(node, d, [node]) for node, d in best], shape)
    for d in range(best[0][1] if best else 0, 0, -1):  # ``d`` edges are left
        go = links.join(F.broadcast(now.where(F.col("depth") - F.size("path") + 1 == d)), F.col("src") == F.element_at("path", -1)).select("root", "depth", "path", "dst")
        go = go.join(walks[d - 2].withColumnRenamed("node", "dst"), "dst", "left_semi") if d > 1 else go
        told = go.groupBy("root", "depth", "path").agg(F.min("dst").alias("dst")).select("root", "depth", F.concat("path", F.array("dst")).alias("path"))
        now = cut(told.unionByName(now.where(F.col("depth") - F.size("path") + 1 < d)))
    circling = starts.join(endless, "node", "left_semi") if n else None
    if circling is not None and not circling.isEmpty():
        now = now.unionByName(chains(links, circling, n + len(walks)).where("depth > 0"))
    return now.orderBy(F.desc("depth"), "root").limit(most)


def top_chains(edges: DataFrame, roots: DataFrame, most: int = 5, depth: int | None = 7) -> DataFrame:
    """The ``most`` longest of the roots' chains that have an edge; without a ``depth`` of any length (see :func:`_whole_chains`).

    With one, a root has no chain longer than its longest walk, which a round of semi-joins a length tells for all roots. Chains are searched for the roots of the
    longest walks first, eight times as many a round, until no other root can have a better one.
    """
    links = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    if depth is None:
        return _whole_chains(links, roots, most)
    bound = roots.select("node").where("node is not null").distinct().withColumn("bound", F.lit(0))
    reach = links.select(F.col("src").alias("node")).distinct()
    for d in range(1, depth + 1):
        reach = cut(reach)
        bound = bound.unionByName(reach.join(roots.select("node"), "node", "left_semi").withColumn("bound", F.lit(d)))
        reach = links.join(reach, links["dst"] == reach["node"], "left_semi").select(F.col("src").alias("node")).distinct()
    best_first = [F.desc("bound"), F.asc("node")]
    bound, n = cut(bound.groupBy("node").agg(F.max("bound").alias("bound")).where("bound > 0")), 16 * most
    while True:
        near = bound.orderBy(*best_first).limit(n)
        told = cut(chains(links, near.select("node"), depth).where("depth > 0").orderBy(F.desc("depth"), "root").limit(most))
        rows, last = sorted((-r.depth, r.root) for r in told.select("depth", "root").collect()), near.orderBy(F.asc("bound"), F.desc("node")).first()  # at most ``most`` rows
        if near.count() < n or (len(rows) == most and rows[-1] <= (-last.bound, last.node)):
            return told.orderBy(F.desc("depth"), "root")
        n *= 8


def contracted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``src, dst, links``: edges between the groups (``node, group``) of nodes, with the count of edges that they stand for; none within a group."""
    a, b = groups.select(F.col("node").alias("src"), F.col("group").alias("_a")), groups.select(F.col("node").alias("dst"), F.col("group").alias("_b"))
    return edges.join(a, "src").join(b, "dst").where("_a <> _b").groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.count("*").alias("links"))


def layered(edges: DataFrame, nodes: DataFrame, most: int = 64) -> DataFrame:
    """``node, layer``: a node lies below all that lead to it (``src`` before ``dst``); nodes on circles lie in the layer that their way in gives.

    Layers peel off: each round takes the nodes that nothing left leads to; where a circle stops that, the node with the fewest ways in goes
    (of several the least). A round a layer; for contracted graphs, which are small.
    """
    left, links, out, layer = cut(nodes.select("node").distinct()), cut(edges.select("src", "dst").where("src <> dst").distinct()), None, 0
    while not left.isEmpty() and layer < most:
        into = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
        told = left.join(into, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        free = told.where("n = 0").select("node")
        taken = cut(free if not free.isEmpty() else told.orderBy("n", "node").limit(1).select("node"))
        own = taken.withColumn("layer", F.lit(layer))
        out = own if out is None else out.unionByName(own)
        left = cut(left.join(taken, "node", "left_anti"))
        links = cut(links.join(taken, links["src"] == taken["node"], "left_anti").join(taken, links["dst"] == taken["node"], "left_anti"))
        layer += 1
    return out if out is not None else nodes.select("node", F.lit(0).alias("layer"))


def first_seen(rows: DataFrame, key: str, position: Column | str, **values: Column) -> DataFrame:
    """Per key an array for each of ``values`` (array columns): its distinct members in the order in which they are first seen.

    A member and its least position are one row a key before lists are made, so the aggregate is merged like any minimum, and repeats
    of a member, however many, never meet in one task.
    """
    at = F.col(position) if isinstance(position, str) else position
    each = rows.select(F.col(key).alias("_key"), at.alias("_at"), F.explode(F.array(*(F.struct(F.lit(n).alias("n"), v.cast("array<string>").alias("v")) for n, v in values.items()))).alias("_x"))
    members = each.select("_key", "_at", F.col("_x.n").alias("_n"), F.posexplode("_x.v").alias("_i", "_v")).where("_v is not null")
    least = members.groupBy("_key", "_n", "_v").agg(F.min(F.struct("_at", "_i")).alias("_at"))
    listed = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") == n, F.struct("_at", "_v")))), lambda x: x["_v"]).alias(n)
    told = least.groupBy("_key").agg(*(listed(n) for n in values))
    keys = rows.select(F.col(key).alias("_key")).distinct()
    empty = F.array().cast("array<string>")
    return keys.join(told.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left").select(F.col("_key").alias(key), *(F.coalesce(n, empty).alias(n) for n in values))
