"""Standard relational coverage over the driver's tables; one statement serves Spark and the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    """Register ``sql``, in which ``{orders}`` and the like name tables."""
    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or re.sub(r"\{(\w+)\}", r"\1", sql)


statement("scan_filter_project", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net
FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 45""")
statement("join_inner", """
SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
WHERE o.o_totalprice > 400000 OR c.c_acctbal < -900""")
statement("join_left", """
SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
statement("join_right", """
SELECT s.s_suppkey, s.s_nationkey, c.customers, c.last_customer
FROM (SELECT c_nationkey AS nk, count(*) AS customers, max(c_custkey) AS last_customer FROM {customer} GROUP BY c_nationkey) c RIGHT JOIN {supplier} s ON c.nk = s.s_nationkey""")
statement("join_full", """
SELECT a.nk AS customer_nation, b.nk AS supplier_nation, a.n AS customers, b.n AS suppliers
FROM (SELECT c_nationkey AS nk, count(*) AS n FROM {customer} WHERE c_acctbal > 9000 GROUP BY c_nationkey) a
FULL JOIN (SELECT s_nationkey AS nk, count(*) AS n FROM {supplier} WHERE s_acctbal < 3000 GROUP BY s_nationkey) b ON a.nk = b.nk""")
statement("join_semi", """
SELECT p_partkey, p_name FROM {part} p WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 49)""")
statement("join_anti", """
SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""")
statement("join_cross_small", "SELECT r_regionkey, n_nationkey FROM {region} CROSS JOIN {nation}")
statement("join_theta_earlier_order", """
SELECT a.o_custkey, a.o_orderkey AS later, count(*) AS earlier
FROM {orders} a JOIN {orders} b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY a.o_custkey, a.o_orderkey""")
statement("join_range_bands", """
SELECT b.band, count(*) AS n FROM {part} p
JOIN (SELECT 'low' AS band, 0 AS lo, 15 AS hi UNION ALL SELECT 'mid', 15, 35 UNION ALL SELECT 'high', 35, 1000) b
ON p.p_size >= b.lo AND p.p_size < b.hi GROUP BY b.band""")
statement("join_asof_click", """
SELECT event_id, last_click FROM (
  SELECT event_id, event_type, max(CASE WHEN event_type = 'click' THEN event_id END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click
  FROM {events}) x WHERE event_type = 'purchase'""")
statement("join_five_tables", """
SELECT r.r_name, n.n_name, count(*) AS lines, round(sum(l.l_extendedprice), 0) AS price
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name""")
statement("agg_pricing_summary", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc
FROM {lineitem} GROUP BY l_returnflag, l_linestatus""")
statement("agg_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type")
statement("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
statement("agg_rollup", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY ROLLUP (lang, source)")
statement("agg_grouping_sets", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders}
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
statement("agg_conditional", """
SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS pending
FROM {orders} GROUP BY o_custkey HAVING count(*) > 3""")
statement("agg_percentile", "SELECT p_brand, round(percentile(p_retailprice, 0.5), 4) AS median FROM {part} GROUP BY p_brand", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 4) AS median FROM part GROUP BY p_brand")
statement("agg_arg_max", "SELECT event_type, max_by(event_id, event_id) AS last_event, min(value) AS least FROM {events} GROUP BY event_type")
statement("agg_pivot", """
SELECT lang, count(CASE WHEN quality = 1 THEN 1 END) AS good, count(CASE WHEN quality = 0 THEN 1 END) AS bad
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY lang""")
statement("win_rank", """
SELECT n_nationkey, n_regionkey, rank() OVER (PARTITION BY n_regionkey ORDER BY length(n_name)) AS r,
  dense_rank() OVER (PARTITION BY n_regionkey ORDER BY length(n_name)) AS d, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM {nation}""")
statement("win_lag_lead", """
SELECT event_id, lag(event_id) OVER w AS before_, lead(event_id) OVER w AS after_ FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
statement("win_frames", """
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM {orders}""")
statement("win_ntile", "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS quarter FROM {supplier}")
statement("topk_per_group", """
SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) x WHERE rn <= 3""")
statement("topk_orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
statement("set_union_distinct", "SELECT c_nationkey AS nk FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
statement("set_intersect", "SELECT l_partkey AS pk FROM {lineitem} WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'A'")
statement("set_except", "SELECT p_partkey AS pk FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 47")
statement("set_union_all", "SELECT 'c' AS side, count(*) AS n FROM {customer} UNION ALL SELECT 's', count(*) FROM {supplier}")
statement("subquery_scalar", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})")
statement("subquery_correlated", """
SELECT l_orderkey, l_linenumber FROM {lineitem} l JOIN (SELECT l_partkey AS pk, 0.2 * avg(l_quantity) AS lim FROM {lineitem} GROUP BY l_partkey) a ON a.pk = l.l_partkey WHERE l.l_quantity < a.lim""")
statement("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
statement("date_parts", """
SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM {orders} GROUP BY year(o_orderdate), month(o_orderdate)""")
statement("string_functions", """
SELECT p_partkey, upper(p_name) AS up, substr(p_type, 1, 5) AS head, length(p_name) AS n, replace(p_brand, 'Brand', 'B') AS b, concat(p_brand, '/', p_type) AS both_, trim(concat(' ', p_name, ' ')) AS t FROM {part}""")
statement("math_functions", """
SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS root, CAST(floor(s_acctbal) AS BIGINT) AS low, CAST(ceil(s_acctbal) AS BIGINT) AS high, round(ln(abs(s_acctbal) + 1), 6) AS lg, greatest(0, least(1, s_suppkey - 5)) AS clamped FROM {supplier}""")
statement("array_functions", """
SELECT o_custkey, array_join(array_sort(collect_set(o_orderstatus)), ',') AS statuses FROM {orders} GROUP BY o_custkey""", """
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses FROM orders GROUP BY o_custkey""")
statement("case_null_handling", """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.toxic IS NULL THEN 'unknown' WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS state, nullif(d.lang, 'en') AS foreign_lang
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""")
statement("reachability", """
WITH RECURSIVE edges AS (
  SELECT concat('r', CAST(r_regionkey AS STRING)) AS src, concat('n', CAST(n_nationkey AS STRING)) AS dst FROM {region} JOIN {nation} ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('n', CAST(s_nationkey AS STRING)), concat('s', CAST(s_suppkey AS STRING)) FROM {supplier}),
reach AS (SELECT concat('r', CAST(r_regionkey AS STRING)) AS root, concat('r', CAST(r_regionkey AS STRING)) AS node, 0 AS depth FROM {region}
  UNION ALL SELECT reach.root, edges.dst, reach.depth + 1 FROM reach JOIN edges ON reach.node = edges.src WHERE reach.depth < 6)
SELECT root, count(DISTINCT node) AS nodes, max(depth) AS depth FROM reach GROUP BY root""")
ORACLE_SQL["reachability"] = ORACLE_SQL["reachability"].replace("STRING", "VARCHAR")
