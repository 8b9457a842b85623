"""More knowledge-store queries: admission, superseding, budgets, change lists, labels, previews, briefing text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import age_label, safe_id
from ..operators import graph, lifecycle, status
from ..operators.ordered import cut, next_marked
from .knowledge import _CLEAN, GATE_SQL, gate_cases
from .tables import DAY_MS, MEMORIES_SQL, NOW_MS, TIMELINE_SQL, TODOS_SQL, memories, table, timeline, todos

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return register


_FP = "sha256(trim(regexp_replace(lower(type || chr(10) || title || chr(10) || content), '\\s+', ' ', 'g')))[1:24]"


@query(f"""
WITH m AS (SELECT *, {_FP} AS fp FROM ({GATE_SQL}) x), s AS (SELECT fp, min(id) AS existing FROM m WHERE status NOT IN ('archived', 'superseded', 'deleted') GROUP BY fp)
SELECT m.id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN existing < m.id THEN 'duplicate' ELSE 'inserted' END AS outcome, reason, CASE WHEN existing < m.id THEN existing END AS existing FROM m LEFT JOIN s ON s.fp = m.fp""")
def admit_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as it came in, against those of lower numbers that stand in the store."""
    rows = gate_cases(spark, sf_dir)
    out = lifecycle.evaluate_admission(rows, rows, "id")
    earlier = F.col("existing") < F.col("id")
    return out.select("id", F.when((F.col("outcome") == "duplicate") & ~F.coalesce(earlier, F.lit(False)), "inserted").otherwise(F.col("outcome")).alias("outcome"), "reason", F.when(earlier, F.col("existing")).alias("existing"))


@query(f"""
WITH g AS (SELECT type, list_sort(list_distinct(list_transform(generate_series(1, greatest(length({_CLEAN}) - 1, 1)), lambda i: substr({_CLEAN}, i, 2)))) AS g, id, status FROM ({MEMORIES_SQL}) m),
c AS (SELECT type, g, row_number() OVER () AS c FROM (SELECT DISTINCT type, g FROM g) x), p AS (
SELECT a.c AS a, b.c AS b, CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS similarity FROM c a JOIN c b ON a.type = b.type AND least(len(a.g), len(b.g)) >= 0.72 * greatest(len(a.g), len(b.g))),
n AS (SELECT g.id, c.c, g.status FROM g JOIN c ON c.type = g.type AND c.g = g.g),
r AS (SELECT x.id, y.id AS prior, similarity FROM n x JOIN p ON p.a = x.c AND similarity >= 0.72 JOIN n y ON y.c = p.b AND y.id <> x.id AND y.status = 'active')
SELECT id, prior, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, prior) AS k FROM r) x WHERE k = 1""")
def supersede_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every record the other core record that it may supersede."""
    rows = cut(memories(spark, sf_dir).select("id", "type", "title", "status"))  # texts are read once
    return lifecycle.best_prior(rows, rows, "id").withColumn("similarity", F.round("similarity", 6))


@query("""
SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY n_chars % 7 DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) x WHERE used <= 200000""")
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") % 7).alias("priority"))
    return lifecycle.within_budget(docs, "n_chars", 200_000, [F.desc("priority"), F.asc("doc_id")]).select("doc_id")


@query("""
WITH a AS (SELECT CAST(floor(p_partkey / 3.0) AS BIGINT) AS path, min(p_size) AS hash FROM part WHERE p_size < 25 GROUP BY 1), b AS (SELECT CAST(floor(p_partkey / 3.0) AS BIGINT) AS path, min(p_size) AS hash FROM part WHERE p_size > 20 GROUP BY 1),
d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash)
SELECT path, change, (SELECT count(*) FROM d) > 40 AS truncated FROM d ORDER BY path LIMIT 40""")
def change_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    side = lambda test: parts.where(test).groupBy(F.floor(F.col("p_partkey") / 3).alias("path")).agg(F.min("p_size").alias("hash"))
    changes = graph.tree_diff(side("p_size < 25"), side("p_size > 20"))
    total = changes.agg((F.count("*") > 40).alias("truncated"))
    return changes.orderBy("path").limit(40).crossJoin(F.broadcast(total))


@query(f"""
SELECT id, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 60 THEN CAST(d AS VARCHAR) || ' days' ELSE CAST(d // 30 AS VARCHAR) || ' months' END AS label
FROM (SELECT id, ({NOW_MS} - created_ms) // {DAY_MS} AS d FROM ({MEMORIES_SQL}) m) x""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", age_label(F.lit(NOW_MS) - F.col("created_ms")).alias("label"))


@query("""
SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS name FROM (SELECT page_id, substr(regexp_replace(regexp_replace(lower(coalesce(nullif(url, ''), 'item')), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 72) AS s FROM pages) x""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", safe_id("url").alias("name"))


@query(f"""
SELECT 'memory' AS kind, type AS name, count(*) AS n FROM ({MEMORIES_SQL}) m WHERE status = 'active' GROUP BY type
UNION ALL SELECT 'archived', 'all', count(*) FROM ({MEMORIES_SQL}) m WHERE status = 'archived'
UNION ALL SELECT 'todo', status, count(*) FROM ({TODOS_SQL}) t GROUP BY status
UNION ALL SELECT 'event', event_type, count(*) FROM ({TIMELINE_SQL}) e GROUP BY event_type""")
def preview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    count = lambda df, kind, name: df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    archived = rows.where("status = 'archived'").agg(F.count("*").alias("n")).select(F.lit("archived").alias("kind"), F.lit("all").alias("name"), "n")
    return count(rows.where(lifecycle.is_core()), "memory", "type").unionByName(archived).unionByName(count(todos(spark, sf_dir), "todo", "status")).unionByName(count(timeline(spark, sf_dir), "event", "event_type"))


@query(f"""
WITH m AS (SELECT 'memory' AS section, id, title FROM ({MEMORIES_SQL}) x WHERE status = 'active' ORDER BY coalesce(importance, 0.5) DESC, created_ms DESC, id LIMIT 8),
t AS (SELECT 'todo' AS section, id, title FROM ({TODOS_SQL}) x WHERE status NOT IN ('done', 'cancelled') ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'low' THEN 3 ELSE 2 END, created_ms DESC, id LIMIT 5)
SELECT section, id, '- ' || substr(title, 1, 60) AS line FROM m UNION ALL SELECT section, id, '- ' || substr(title, 1, 60) FROM t""")
def inject_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go before a prompt: the core's first memories and the first open todos."""
    best = memories(spark, sf_dir).where(lifecycle.is_core()).orderBy(F.coalesce("importance", F.lit(0.5)).desc(), F.desc("created_ms"), F.asc("id")).limit(8)
    open_ = status.active_todos(todos(spark, sf_dir), 5)
    line = F.concat(F.lit("- "), F.substring("title", 1, 60)).alias("line")
    return best.select(F.lit("memory").alias("section"), "id", line).unionByName(open_.select(F.lit("todo").alias("section"), "id", line))


@query(f"""
WITH s AS (SELECT user_id, max(occurred_ms) AS last FROM ({TIMELINE_SQL}) x WHERE event_type = 'session_summary' GROUP BY user_id)
SELECT e.user_id, count(*) AS changes FROM ({TIMELINE_SQL}) e LEFT JOIN s ON s.user_id = e.user_id
WHERE e.occurred_ms > coalesce(s.last, (SELECT max(occurred_ms) FROM ({TIMELINE_SQL}) z) - {DAY_MS}) AND e.occurred_ms > (SELECT max(occurred_ms) FROM ({TIMELINE_SQL}) z) - {14 * DAY_MS} GROUP BY e.user_id""")
def change_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user since the last summary (else of the last day), of the last fourteen days."""
    events = timeline(spark, sf_dir)
    now = events.agg(F.max("occurred_ms").alias("_now"))
    last = events.where("event_type = 'session_summary'").groupBy("user_id").agg(F.max("occurred_ms").alias("_last"))
    rows = events.join(last, "user_id", "left").crossJoin(F.broadcast(now))
    recent = rows.where((F.col("occurred_ms") > F.coalesce("_last", F.col("_now") - DAY_MS)) & (F.col("occurred_ms") > F.col("_now") - 14 * DAY_MS))
    return recent.groupBy("user_id").agg(F.count("*").alias("changes"))


@query(f"""
WITH t AS (SELECT id, k, occurred_ms, event_type, row_number() OVER (PARTITION BY k ORDER BY occurred_ms, id) AS r FROM ({TIMELINE_SQL}) x WHERE event_type IN ('todo', 'session_summary'))
SELECT a.id AS opened, min(b.r) - a.r AS steps FROM t a JOIN t b ON a.k = b.k AND b.r > a.r AND a.event_type = 'todo' AND b.event_type = 'session_summary' GROUP BY a.id, a.r""")
def todo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each opened item the steps to the first later closing of its key, by ranges: no key's rows meet in one task."""
    rows = timeline(spark, sf_dir).where("event_type in ('todo', 'session_summary')")
    told = next_marked(rows, "k", [F.col("occurred_ms"), F.col("id")], F.col("event_type") == "session_summary", "steps")
    return told.where("event_type = 'todo' and steps is not null and k is not null").select(F.col("id").alias("opened"), "steps")
