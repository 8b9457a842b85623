"""Session graphs, tree differences, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import chains
from .ordered import shared_folder

# Events that never make a session, and those that do by their day.
SKIPPED = ("rescan", "export", "import", "rollback")
SUBSTANTIVE = ("session_summary", "todo", "todo_update", "memory", "memory_supersede", "memory_rejected")


def with_session(events: DataFrame) -> DataFrame:
    """Add ``session``: init, or the user's day for substantive events; others have none and go."""
    day = F.date_format(F.timestamp_millis("occurred_ms"), "yyyy-MM-dd")
    session = F.when(F.col("event_type") == "init", "init").when(F.col("event_type").isin(*SUBSTANTIVE), F.concat_ws(":", F.col("user_id").cast("string"), day))
    return events.withColumn("session", session).where("session is not null")


def session_nodes(events: DataFrame) -> DataFrame:
    """Per session its events, time range, distinct files and whether it has a summary."""
    rows = with_session(events).groupBy("session")
    return rows.agg(F.count("*").alias("events"), F.min("occurred_ms").alias("first_ms"), F.max("occurred_ms").alias("last_ms"), F.array_sort(F.collect_set("k")).alias("files"), F.bool_or(F.col("event_type") == "session_summary").alias("has_summary"))


def trunk(events: DataFrame) -> DataFrame:
    """Sessions of each user that qualify for the trunk, with the one before."""
    rows = with_session(events).where("session <> 'init'").groupBy("session", "user_id")
    nodes = rows.agg(F.min("occurred_ms").alias("first_ms"), F.array_sort(F.collect_set("k")).alias("files"))
    w = Window.partitionBy("user_id").orderBy("first_ms", "session")
    return nodes.withColumn("prev", F.lag("session").over(w)).withColumn("prev_files", F.lag("files").over(w))


def session_edges(events: DataFrame) -> DataFrame:
    """``kind, src, dst``: time edges between neighbours, architecture edges where neighbours share a file."""
    rows = trunk(events).where("prev is not null")
    kinds = F.when(F.arrays_overlap("files", "prev_files"), F.array(F.lit("time"), F.lit("architecture"))).otherwise(F.array(F.lit("time")))
    return rows.select(F.explode(kinds).alias("kind"), F.col("prev").alias("src"), F.col("session").alias("dst"))


def visible_nodes(events: DataFrame, last: int = 20, thin_after: int = 40) -> DataFrame:
    """Trunk nodes with ``important`` (touched by an evidence edge) and ``visible``: all up to ``thin_after`` nodes, else the important and the last."""
    rows = trunk(events)
    evidence = rows.where("prev is not null").where(F.arrays_overlap("files", "prev_files"))
    touched = evidence.select(F.explode(F.array("session", "prev")).alias("session")).distinct().withColumn("important", F.lit(True))
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("first_ms"), "session"))
    marked = rows.withColumn("_r", newest).withColumn("_all", F.count("*").over(Window.partitionBy("user_id"))).join(touched, "session", "left").withColumn("important", F.coalesce("important", F.lit(False)))
    return marked.withColumn("visible", (F.col("_all") <= thin_after) | (F.col("_r") <= last) | F.col("important")).select("session", "user_id", "important", "visible")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` between two trees of ``path, hash``: added, removed or modified."""
    a, b = old.withColumnRenamed("hash", "_a").withColumn("_in_a", F.lit(True)), new.withColumnRenamed("hash", "_b").withColumn("_in_b", F.lit(True))
    both = a.join(b, "path", "full").where(~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_in_a").isNull() | F.col("_in_b").isNull())
    return both.select("path", F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").otherwise("modified").alias("change"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, node`` for every node that a root reaches, itself included, by a frontier that grows until it is empty.

    Each round keeps only pairs that are new, so cycles end; lineage is cut in the checkpoint folder.
    """
    shared_folder(edges.sparkSession)
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("_dst")).distinct()
    frontier = roots.select(F.col("node").alias("root"), "node").distinct().checkpoint()
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.join(links, "node").select("root", F.col("_dst").alias("node")).distinct()
        frontier = step.join(seen, ["root", "node"], "left_anti").checkpoint()
        seen = seen.unionByName(frontier).checkpoint()
    return seen


def longest_chains(edges: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """Per root the length of the longest simple path of at most ``depth`` edges."""
    return chains(edges, roots, depth).select("root", "depth")


def first_parents(commits: DataFrame, head: str, limit: int = 500) -> DataFrame:
    """Commits (``hash, parent``) from ``head`` along first parents, with their distance: ``limit`` of them at most."""
    # Hops double each round, so a walk of n commits takes log n joins; ends stay where they are.
    spark = commits.sparkSession
    shared_folder(spark)
    hops = commits.select(F.col("hash").alias("_from"), F.col("parent").alias("_to")).checkpoint()
    walk = spark.createDataFrame([(head, 0)], "hash string, distance int")
    length = 1
    while length < limit:
        more = walk.join(hops, F.col("hash") == F.col("_from")).where("_to is not null").select(F.col("_to").alias("hash"), (F.col("distance") + length).alias("distance"))
        walk = walk.unionByName(more.where(F.col("distance") < limit)).checkpoint()
        next_ = hops.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        hops = hops.join(next_, "_to").select("_from", F.col("_next").alias("_to")).where("_to is not null").checkpoint()
        length *= 2
        if hops.isEmpty():
            break
    return walk.join(commits, "hash").select("hash", "parent", "distance")


def supersede_edges(memories: DataFrame) -> DataFrame:
    """``kind, src, dst`` between the sessions of records (``id, session, supersedes``) and of those that they supersede, where both have one."""
    old = memories.select(F.col("id").alias("supersedes"), F.col("session").alias("src"))
    met = memories.where("session is not null and supersedes is not null").select("supersedes", F.col("session").alias("dst")).join(old, "supersedes")
    return met.where("src is not null and src <> dst").select(F.lit("supersede").alias("kind"), "src", "dst").distinct()


def merged_changes(changes: DataFrame) -> DataFrame:
    """``path, change`` of changes from several sources: removed goes before added, added before modified."""
    rank = F.when(F.col("change") == "removed", 0).when(F.col("change") == "added", 1).otherwise(2)
    return changes.groupBy("path").agg(F.min_by("change", rank).alias("change"))


def change_counts(changes: DataFrame, group: str) -> DataFrame:
    """Added, modified and removed paths of each group."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return changes.groupBy(group).agg(n("added"), n("modified"), n("removed"))


def tracked(changes: DataFrame, tree: DataFrame) -> DataFrame:
    """``changes`` with ``tracked``: does the tree hold the path?"""
    held = tree.select("path").distinct().withColumn("_in", F.lit(True))
    return changes.join(held, "path", "left").withColumn("tracked", F.coalesce("_in", F.lit(False))).drop("_in")


def entry_points(files: DataFrame) -> DataFrame:
    """Paths of files (``path, exports, functions``) that export something or have a function named apply, main, run or start."""
    named = F.exists(F.coalesce("functions", F.array().cast("array<string>")), lambda f: F.lower(f).isin("apply", "main", "run", "start"))
    return files.where((F.size(F.coalesce("exports", F.array().cast("array<string>"))) > 0) | named).select("path")
