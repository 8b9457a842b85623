"""Queries on technologies, architectures, chains, first-seen sets and lenient JSON, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lenient import lenient_value
from ..operators import architecture, chains
from ..sources import taxonomy
from .tables import TIMELINE_SQL, table, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return register


#: Every name of the taxonomy, the languages, and some that nobody knows; parts take them in turn.
_NAMES = [*(n for v in taxonomy.FIELDS.values() for n in v), *taxonomy.LANGUAGE_NAMES, "Homegrown", "Spring Boots"]
_VALUES = ", ".join(f"({i}, '{n}', {next((repr(f) for f, v in taxonomy.FIELDS.items() if n in v), 'NULL')}, {taxonomy.SCORES.get(n, taxonomy.DEFAULT_SCORE)})" for i, n in enumerate(_NAMES))
_USES = f"""t(i, name, field, score) AS (VALUES {_VALUES}),
u AS (SELECT DISTINCT p_type || p_size AS project, name, coalesce(field, '_extra') AS field, score, CASE WHEN field IN ('iac', 'ci', 'observability') THEN 'devops' WHEN field IS NULL THEN 'extra' ELSE 'runtime' END AS layer
  FROM part JOIN t ON t.i = p_partkey % {len(_NAMES)} WHERE name NOT IN ({", ".join(f"'{n}'" for n in taxonomy.LANGUAGE_NAMES)}))"""


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project, name``: a project a type and size of parts."""
    name = F.array(*map(F.lit, _NAMES))[(F.col("p_partkey") % len(_NAMES)).cast("int")]
    return table(spark, sf_dir, "part").select(F.concat("p_type", "p_size").alias("project"), name.alias("name")).distinct()


@query(f"WITH {_USES} SELECT project, name, field, layer FROM u")
def taxonomy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field and layer of every name of the taxonomy, of languages (none) and of unknown names."""
    return taxonomy.placed(_uses(spark, sf_dir)).select("project", "name", "field", "layer")


@query(f"WITH {_USES} SELECT project, layer, field, string_agg(name, ',' ORDER BY score DESC, name) AS names FROM u GROUP BY project, layer, field")
def taxonomy_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies of each project by layer and field, in the order of their scores; half of the projects have them under the fallback only."""
    placed = taxonomy.placed(_uses(spark, sf_dir)).select("project", "field", F.col("name").alias("value"))
    old = F.when(F.col("field").startswith("framework-"), F.substring_index("field", "-", -1)).otherwise(F.col("field"))
    half = F.length("project") % 2 == 0
    told = taxonomy.layers(placed.where(half), placed.where(~half).withColumn("field", old))
    return told.select("project", "layer", "field", F.array_join("names", ",").alias("names"))


@query(f"WITH {_USES} SELECT project, field, name AS value, row_number() OVER (PARTITION BY project, field ORDER BY score DESC, name) AS rank FROM u")
def stack_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies of each project and field by their fixed scores, 50 where there is none."""
    return taxonomy.by_score(taxonomy.placed(_uses(spark, sf_dir)).select("project", "field", F.col("name").alias("value")))


_KNOWN = [n for v in taxonomy.FIELDS.values() for n in v]


@query(f"""WITH t(i, name) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(_KNOWN))})
SELECT doc_id, name, count(*) AS times FROM (SELECT doc_id, doc_id % {len(_KNOWN)} AS i FROM documents UNION ALL SELECT doc_id, (doc_id // 7) % {len(_KNOWN)} FROM documents) d JOIN t USING (i) GROUP BY doc_id, name""")
def taxonomy_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies that texts name: each whole document, with two names behind it."""
    name = lambda n: F.array(*map(F.lit, _KNOWN))[(n % len(_KNOWN)).cast("int")]
    text = F.concat(F.lower(F.coalesce("text", F.lit(""))), F.lit(" built on "), name(F.col("doc_id")), F.lit(", "), name(F.expr("doc_id div 7")), F.lit("."))
    return taxonomy.mentioned(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


_HINTS = [(h, f, v) for f, hints in taxonomy.HINTS.items() for h, v in hints.items()]


@query(f"""WITH h(i, hint, field, value) AS (VALUES {", ".join(f"({i}, '{h}', '{f}', '{v}')" for i, (h, f, v) in enumerate(_HINTS))}),
d AS (SELECT lang || '/' || source AS project, doc_id FROM documents), b AS (SELECT DISTINCT project FROM d WHERE project NOT LIKE '%/src1')
SELECT project, field, value, count(*) AS files FROM d JOIN b USING (project) JOIN h ON h.i = doc_id % {len(_HINTS)} GROUP BY project, field, value""")
def import_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of hint words over source files: each whole document behind an import, for projects (language and source) without a stack."""
    docs = table(spark, sf_dir, "documents").where("lang is not null and source is not null").withColumn("project", F.concat_ws("/", "lang", "source"))
    hint = F.array(*(F.lit(h) for h, _, _ in _HINTS))[(F.col("doc_id") % len(_HINTS)).cast("int")]
    scoped = hint.rlike(r"[@/-]")
    turn = F.col("doc_id") % 4
    line = F.when(scoped | (turn == 0), F.concat(F.lit('const x = require("'), hint, F.lit('/sub")'))).when(turn == 1, F.concat(F.lit("from "), hint, F.lit(".part import a"))).when(turn == 2, F.concat(F.lit("import "), hint, F.lit(" as y"))).otherwise(F.concat(F.lit("import z from '"), hint, F.lit("'")))
    files = docs.select("project", F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n# "), F.lit("\n"), line, F.lit("\n")).alias("text"))
    stack = docs.where("endswith(project, '/src1')").select("project", F.lit("orm").alias("field"), F.lit("x").alias("value")).distinct()
    return taxonomy.import_fallback(stack, files, None)


#: Folders that tell roles, in the order of the layers, with the role, and the priority of a file there.
_FOLDERS = (("client", "presentation", 40), ("routes", "interface", 40), ("services", "application", 40), ("engine", "domain", 12), ("db", "data", 40), ("plugins", "integration", 40), ("scripts", "support", 40), ("misc", "domain", 12))
_F = ", ".join(f"({i}, '{n}', '{r}', {p}, {['presentation', 'interface', 'application', 'domain', 'data', 'integration', 'support'].index(r)})" for i, (n, r, p) in enumerate(_FOLDERS))
_FACTS = f"f(i, folder, role, priority, layer) AS (VALUES {_F}), x AS (SELECT lang || '/' || source AS project, 'pkg/' || folder || '/d' || doc_id || '.py' AS path, 's' || doc_id AS symbol, role, priority, layer, lang FROM documents JOIN f ON f.i = doc_id % 8 WHERE lang IS NOT NULL AND source IS NOT NULL)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    folder = F.array(*(F.lit(n) for n, _, _ in _FOLDERS))[(F.col("doc_id") % 8).cast("int")]
    path = F.concat(F.lit("pkg/"), folder, F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py"))
    return docs.select(F.concat_ws("/", "lang", "source").alias("project"), path.alias("path"), F.col("lang").alias("language"), F.array(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("symbols"))


@query(f"""WITH {_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY project, role ORDER BY priority DESC, path) AS k FROM x)
SELECT project, 'component-' || role AS id, any_value(layer) AS layer, count(*) AS files, string_agg(CASE WHEN k <= 6 THEN path END, ',' ORDER BY k) AS important, string_agg(CASE WHEN k <= 12 THEN path END, ',' ORDER BY k) AS evidence,
  any_value(lang) AS technologies, string_agg(CASE WHEN k <= 5 THEN symbol END, ', ' ORDER BY k) AS purpose FROM r GROUP BY project, role""")
def architecture_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = architecture.components(_facts(spark, sf_dir))
    return told.select("project", "id", "layer", "files", F.array_join("important", ",").alias("important"), F.array_join("evidence", ",").alias("evidence"), F.array_join("technologies", ",").alias("technologies"), "purpose")


@query(f"""WITH {_FACTS}, c AS (SELECT DISTINCT project, layer, 'component-' || role AS id FROM x), o AS (SELECT *, row_number() OVER w AS k, lead(id) OVER w AS nxt, count(*) OVER (PARTITION BY project) AS n FROM c WINDOW w AS (PARTITION BY project ORDER BY layer, id))
SELECT 'relation' AS kind, project, id AS src, nxt AS dst, k FROM o WHERE nxt IS NOT NULL UNION ALL SELECT CASE WHEN k = 1 THEN 'receive' WHEN k = n THEN 'complete' ELSE 'pass on' END, project, id, NULL, k FROM o WHERE n >= 2""")
def architecture_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between neighbouring components, and the steps of the main flow."""
    parts = architecture.components(_facts(spark, sf_dir))
    one = architecture.relations(parts).select(F.lit("relation").alias("kind"), "project", "src", "dst", F.regexp_extract("id", r"(\d+)$", 1).cast("int").alias("k"))
    two = architecture.flows(parts).select(F.col("action").alias("kind"), "project", F.col("component").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("step").alias("k"))
    return one.unionByName(two)


@query(f"""WITH {_FACTS}, a AS (SELECT CAST(regexp_extract(path, 'd(\\d+)\\.py$', 1) AS BIGINT) AS i, role FROM x), e AS (SELECT s.role AS src, d.role AS dst FROM a s JOIN a d ON d.i = s.i // 2 WHERE s.i > 0)
SELECT 'component-' || src AS src, 'component-' || dst AS dst, count(*) AS links FROM e WHERE src <> dst GROUP BY src, dst""")
def architecture_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import graph (each document's file imports that of half its number) contracted to components."""
    path = F.concat(F.lit("pkg/"), F.array(*(F.lit(n) for n, _, _ in _FOLDERS))[(F.col("i") % 8).cast("int")], F.lit("/d"), F.col("i").cast("string"), F.lit(".py"))
    there = table(spark, sf_dir, "documents").where("lang is not null and source is not null").select(F.col("doc_id").alias("i"))
    half = there.where("i > 0").select(path.alias("src"), F.expr("i div 2").alias("i"))
    return architecture.used(half.join(there, "i").select("src", path.alias("dst")))


@query("""WITH RECURSIVE n AS (SELECT doc_id AS i FROM documents), e AS (SELECT DISTINCT i AS src, d AS dst FROM (SELECT i, i // 2 AS d FROM n UNION ALL SELECT i, i // 3 FROM n) x WHERE i > 0 AND d IN (SELECT i FROM n)),
p AS (SELECT i AS root, i AS node, [i] AS path FROM n UNION ALL SELECT p.root, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst)),
r AS (SELECT root, len(path) - 1 AS depth, path, row_number() OVER (PARTITION BY root ORDER BY len(path) DESC, path) AS k FROM p)
SELECT root, depth, array_to_string(path, '>') AS path FROM r WHERE k = 1 AND depth > 0 ORDER BY depth DESC, root LIMIT 5""")
def top_import_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest chains of imports, of any length, as paths: every document imports those of half and of a third of its number."""
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    edges = n.where("node > 0").select(F.col("node").alias("src"), F.explode(F.array(F.expr("node div 2"), F.expr("node div 3"))).alias("dst")).join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return chains.top_chains(edges, n, depth=None).select("root", F.col("depth").cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH s AS (SELECT *, CAST(user_id AS VARCHAR) || ':' || CAST(occurred_ms // 86400000 AS VARCHAR) AS session FROM ({TIMELINE_SQL}) t WHERE user_id IS NOT NULL),
f AS (SELECT session, CAST(k AS VARCHAR) AS v, min(id) AS p FROM s WHERE k IS NOT NULL GROUP BY ALL), t AS (SELECT session, event_type AS v, min(id) AS p FROM s GROUP BY ALL)
SELECT s.session, coalesce((SELECT string_agg(v, ',' ORDER BY p) FROM f WHERE f.session = s.session), '') AS files, (SELECT string_agg(v, ',' ORDER BY p) FROM t WHERE t.session = s.session) AS titles FROM (SELECT DISTINCT session FROM s) s""")
def session_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and titles of sessions in the order in which they are first seen."""
    rows = timeline(spark, sf_dir).where("user_id is not null").withColumn("session", F.concat(F.col("user_id").cast("string"), F.lit(":"), F.expr("occurred_ms div 86400000").cast("string")))
    told = chains.first_seen(rows, "session", "id", files=F.array(F.col("k").cast("string")), titles=F.array("event_type"))
    return told.select("session", F.array_join("files", ",").alias("files"), F.array_join("titles", ",").alias("titles"))


@query("SELECT doc_id, length(coalesce(text, '')) AS n_text, doc_id AS id, 2 AS n_list FROM documents")
def lenient_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON found again in prose, fences and with trailing commas: each holds a document's whole text."""
    body = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("id"), F.array(F.lit("}, ]"), F.lit('",}')).alias("list")))
    broken = F.concat(F.regexp_replace(body, r"\]\}$", ", ]"), F.lit(" ,\n}"))
    turn = F.col("doc_id") % 4
    said = F.when(turn == 0, body).when(turn == 1, F.concat(F.lit("```json\n"), broken, F.lit("\n```"))).when(turn == 2, F.concat(F.lit("Here {it is}: "), broken, F.lit(" and {more"))).otherwise(F.concat(F.lit("one ```\n"), body, F.lit("\n``` two")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.from_json(lenient_value(said), "text string, id long, list array<string>").alias("v"))
    return rows.select("doc_id", F.length("v.text").cast("long").alias("n_text"), F.col("v.id").alias("id"), F.size("v.list").cast("long").alias("n_list"))
