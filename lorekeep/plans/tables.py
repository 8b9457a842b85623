"""The driver's tables, and the knowledge-store records that they stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_sentence

#: The injected clock: 2024-01-01 00:00:00 UTC in milliseconds.
NOW_MS = 1_704_067_200_000
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Parquet, so filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memory records: lang and source are the type, quality the importance, toxic lowers the confidence."""
    # titles are told before the join, so that texts that nobody asks for are not shuffled
    docs = table(spark, sf_dir, "documents").withColumn("title", first_sentence("text"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.expr("case when lang = 'en' and source in ('src1', 'src2', 'src3') then 'requirement' when lang = 'en' then 'decision' when lang = 'de' then 'lesson' when lang = 'fr' then 'context' else 'change' end").alias("type"),
        "title",
        F.col("text").alias("content"),
        F.col("quality").cast("double").alias("importance"),
        F.expr("case when toxic = 1 then 0.4D when toxic = 0 then 0.7D end").alias("confidence"),
        (F.lit(NOW_MS) - (F.col("doc_id") % 400) * DAY_MS).alias("created_ms"),
        F.expr("case when toxic = 1 then 'archived' when doc_id % 11 = 0 then 'dormant' when doc_id % 13 = 0 then 'superseded' else 'active' end").alias("status"),
        "source",
    )


#: The same records in SQL.
MEMORIES_SQL = f"""
SELECT d.doc_id AS id,
  CASE WHEN d.lang = 'en' AND d.source IN ('src1', 'src2', 'src3') THEN 'requirement' WHEN d.lang = 'en' THEN 'decision' WHEN d.lang = 'de' THEN 'lesson' WHEN d.lang = 'fr' THEN 'context' ELSE 'change' END AS type,
  substr(CASE WHEN regexp_extract(t.t, '^(.*?[.!?。！？])(?:\\s|$)', 1) = '' THEN t.t ELSE regexp_extract(t.t, '^(.*?[.!?。！？])(?:\\s|$)', 1) END, 1, 200) AS title,
  d.text AS content, CAST(l.quality AS DOUBLE) AS importance,
  CASE WHEN l.toxic = 1 THEN CAST(0.4 AS DOUBLE) WHEN l.toxic = 0 THEN CAST(0.7 AS DOUBLE) END AS confidence,
  {NOW_MS} - (d.doc_id % 400) * {DAY_MS} AS created_ms,
  CASE WHEN l.toxic = 1 THEN 'archived' WHEN d.doc_id % 11 = 0 THEN 'dormant' WHEN d.doc_id % 13 = 0 THEN 'superseded' ELSE 'active' END AS status,
  d.source
FROM documents d
JOIN (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) t ON t.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
"""


def todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as todo records."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("case substr(o_orderpriority, 1, 1) when '1' then 'urgent' when '2' then 'high' when '5' then 'low' else 'medium' end").alias("priority"),
        F.expr("case when o_orderstatus = 'F' and o_totalprice < 100000 then 'cancelled' when o_orderstatus = 'F' then 'done' when o_orderstatus = 'P' then 'in_progress' when o_totalprice > 300000 then 'blocked' else 'pending' end").alias("status"),
        F.expr("unix_millis(cast(o_orderdate as timestamp))").alias("created_ms"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" for "), F.col("o_custkey").cast("string")).alias("title"),
    )


TODOS_SQL = """
SELECT o_orderkey AS id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '5' THEN 'low' ELSE 'medium' END AS priority,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice < 100000 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'in_progress' WHEN o_totalprice > 300000 THEN 'blocked' ELSE 'pending' END AS status,
  CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS created_ms,
  'order ' || CAST(o_orderkey AS VARCHAR) || ' for ' || CAST(o_custkey AS VARCHAR) AS title
FROM orders
"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timeline records; a user's day is a session, and each event touches the file of its key."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.expr("unix_millis(cast(ts as timestamp))").alias("occurred_ms"),
        "user_id",
        F.expr("case event_type when 'signup' then 'init' when 'purchase' then 'session_summary' when 'error' then 'todo' when 'view' then 'memory' else 'rescan' end").alias("event_type"),
        F.expr("cast(get_json_object(props, '$.k') as bigint)").alias("k"),
        "value",
    )


TIMELINE_SQL = """
SELECT event_id AS id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS occurred_ms, user_id,
  CASE event_type WHEN 'signup' THEN 'init' WHEN 'purchase' THEN 'session_summary' WHEN 'error' THEN 'todo' WHEN 'view' THEN 'memory' ELSE 'rescan' END AS event_type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value
FROM events
"""
