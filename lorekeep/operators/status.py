"""Status, progress, shares and the next-step ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import DAY_MS, priority_rank
from .lifecycle import is_core


def counts(memories: DataFrame) -> DataFrame:
    """Records by type (null: context) and status."""
    return memories.groupBy(F.coalesce("type", F.lit("context")).alias("type"), "status").agg(F.count("*").alias("n"))


def todo_stats(todos: DataFrame) -> DataFrame:
    """One row: pending (neither done nor cancelled), done, total."""
    done = F.col("status") == "done"
    return todos.agg(F.count_if(~F.coalesce(F.col("status").isin("done", "cancelled"), F.lit(False))).alias("pending"), F.count_if(done).alias("done"), F.count("*").alias("total"))


def phase_progress(todos: DataFrame, phase: str) -> DataFrame:
    """Per phase the share done of what isn't cancelled, and the first todo in progress."""
    rows = todos.where("status <> 'cancelled'").groupBy(phase)
    return rows.agg(F.round(F.count_if(F.col("status") == "done") / F.count("*"), 6).alias("progress"), F.min(F.when(F.col("status") == "in_progress", F.col("id"))).alias("current_id"))


def active_todos(todos: DataFrame, k: int) -> DataFrame:
    """The k first open todos by priority, then newest."""
    rows = todos.where(~F.col("status").isin("done", "cancelled"))
    return rows.orderBy(priority_rank(F.col("priority")), F.desc("created_ms"), F.asc("id")).limit(k)


def share_with_tail(df: DataFrame, name: str, k: int) -> DataFrame:
    """Counts and percents of the k most frequent values; the rest is ``other``."""
    n = df.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    best = n.orderBy(F.desc("_n"), F.asc("_name")).limit(k).select("_name", F.lit(True).alias("_top"))
    total = n.agg(F.sum("_n").alias("_all"))
    named = n.join(F.broadcast(best), "_name", "left").crossJoin(F.broadcast(total))
    out = named.groupBy(F.when(F.col("_top"), F.col("_name")).otherwise(F.lit("other")).alias("name"), "_all").agg(F.sum("_n").alias("n"))
    return out.select("name", "n", F.round(100 * F.col("n") / F.col("_all"), 4).alias("percent"))


def recommend(todos: DataFrame, memories: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """The first rung of the ladder that has something: a todo in progress, the most urgent pending one,
    a blocked one, a memory of the last week, a recent event, a fresh start. Each rung is a top-1."""
    order = [priority_rank(F.col("priority")), F.desc("created_ms"), F.asc("id")]
    rungs = [
        (1, "continue", todos.where("status = 'in_progress'").orderBy(*order), "id", 0.85),
        (2, "start", todos.where("status = 'pending'").orderBy(*order), "id", 0.70),
        (3, "unblock", todos.where("status = 'blocked'").orderBy(*order), "id", 0.50),
        (4, "review", memories.where(is_core() & (F.lit(now_ms) - F.col("created_ms") <= 7 * DAY_MS)).orderBy(F.desc("created_ms"), "id"), None, 0.45),
        (5, "look_back", events.orderBy(F.desc("occurred_ms"), "id"), None, 0.30),
    ]
    spark = todos.sparkSession
    ladder = spark.range(1).select(F.lit(6).alias("level"), F.lit("plan").alias("action"), F.lit(None).cast("long").alias("todo_id"), F.lit(0.2).alias("confidence"))
    for level, action, rows, todo, confidence in rungs:
        one = rows.limit(1).select(F.lit(level).alias("level"), F.lit(action).alias("action"), (F.col(todo) if todo else F.lit(None)).cast("long").alias("todo_id"), F.lit(confidence).alias("confidence"))
        ladder = ladder.unionByName(one)
    return ladder.orderBy("level").limit(1)


def briefing(todos: DataFrame, events: DataFrame, now_ms: int, stuck_days: int = 7, k: int = 3) -> DataFrame:
    """Sections ``recent`` (the latest summary) and ``stuck`` (the k oldest todos in progress past their time)."""
    recent = events.where("event_type = 'session_summary'").orderBy(F.desc("occurred_ms"), "id").limit(1).select(F.lit("recent").alias("section"), F.lit(1).alias("position"), "id")
    late = todos.where((F.col("status") == "in_progress") & (F.lit(now_ms) - F.col("created_ms") > stuck_days * DAY_MS))
    stuck = late.orderBy("created_ms", "id").limit(k)
    return recent.unionByName(stuck.select(F.lit("stuck").alias("section"), F.row_number().over(Window.orderBy("created_ms", "id")).alias("position"), "id"))


def find_todos(todos: DataFrame, refs: DataFrame) -> DataFrame:
    """``ref, id`` for references (``ref``): the first open todo, in the order of :func:`active_todos`, whose id is or starts with it, else whose title it is.

    Ids meet on their prefixes of the references' lengths, titles on their lower case; nothing is compared all with all.
    """
    asked = refs.select(F.trim("ref").alias("ref")).where("ref <> ''").distinct()
    open_ = todos.where(~F.coalesce(F.col("status").isin("done", "cancelled"), F.lit(False))).select(F.col("id").cast("string").alias("id"), F.lower("title").alias("_title"), priority_rank(F.col("priority")).alias("_p"), "created_ms")
    widths = asked.agg(F.array_sort(F.collect_set(F.length("ref"))).alias("_w"))  # as many as there are lengths of a reference
    heads = open_.crossJoin(F.broadcast(widths)).withColumn("_ref", F.explode(F.transform("_w", lambda n: F.substring("id", F.lit(1), n)))).where("length(id) >= length(_ref)").distinct()
    by_id = asked.join(heads, F.col("ref") == F.col("_ref")).select("ref", "id", "_p", "created_ms", F.lit(0).alias("_way"))
    by_title = asked.join(open_, F.lower("ref") == F.col("_title")).select("ref", "id", "_p", "created_ms", F.lit(1).alias("_way"))
    return by_id.unionByName(by_title).groupBy("ref").agg(F.min_by("id", F.struct("_way", "_p", -F.col("created_ms"), "id")).alias("id"))


def related_records(todos: DataFrame, memories: DataFrame) -> DataFrame:
    """``id, memory`` for todos (``id, files, tags``): the first memory (by ``position``) that shares a file or a tag, else the first of all.

    Shared files and tags are met by a join on them, of which each keeps only its first memory.
    """
    words = lambda df: F.explode(F.array_distinct(F.concat(F.transform(F.coalesce(df.files, F.array().cast("array<string>")), lambda f: F.concat(F.lit("f/"), f)), F.transform(F.coalesce(df.tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit("t/"), t)))))
    first = memories.select(words(memories).alias("_w"), "id", "position").groupBy("_w").agg(F.min(F.struct("position", F.col("id").alias("memory"))).alias("_m"))
    met = todos.select("id", words(todos).alias("_w")).join(first, "_w").groupBy("id").agg(F.min("_m").alias("_m"))
    fallback = memories.agg(F.min(F.struct("position", F.col("id").alias("memory"))).alias("_f"))
    return todos.select("id").join(met, "id", "left").crossJoin(F.broadcast(fallback)).select("id", F.coalesce("_m", "_f").getField("memory").alias("memory"))


def pinned(memories: DataFrame) -> DataFrame:
    """Core records that are pinned."""
    return memories.where(is_core() & F.coalesce("pinned", F.lit(False)))
