"""Connected components of link tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links of a task; fewer links use fewer tasks, whatever the session's shuffle width is.
PER_TASK = 200_000


def _stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One step: neighbours of a node are hung on the least of them.

    Least neighbours are pre-aggregated where the edges are, so a node with a third of all edges
    costs a row a task; the join back to its edges can be split.
    """
    if large:  # every neighbour greater than the node goes to the least one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts)
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct().coalesce(parts)
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts)
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every node of ``edges`` (columns ``u`` and ``v``, long): root is the least id it reaches.

    Rounds grow with the logarithm of the longest chain; each is cut off in the checkpoint folder.
    Self-links and repeated links are allowed; an empty table has no nodes.
    """
    nodes = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    now, seen = cut(edges.where("u <> v and u is not null and v is not null").select("u", "v").distinct()), None
    parts = now.count() // PER_TASK + 1
    now = now.coalesce(parts)
    while True:
        now = cut(_stars(_stars(now, True, parts), False, parts))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return nodes.where("id is not null").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
