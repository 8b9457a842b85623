"""Queries over stores, bundles, source trees and histories that are made from the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, fnv1a, strip_markdown, text_of
from ..operators import graph, lifecycle, status, transcript
from ..operators.ordered import previous, scratch_folder
from ..sources import bundle, files, stack, stores
from .tables import MEMORIES_SQL, TIMELINE_SQL, TODOS_SQL, memories, table, timeline, todos

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return register


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return scratch_folder(spark, "store")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory records as a store holds them; types in capitals, importance out of bounds and repeated tags are for the reader to mend."""
    return memories(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), F.upper("type").alias("type"), "title", "content", (F.col("importance") * 3 - 1).alias("importance"), "confidence", "status",
        F.array("source", "source").alias("tags"), F.col("created_ms").alias("createdAt"), F.when(F.col("source") == "src0", "en").otherwise("other").alias("project"),
    )


_RECORDS = f"SELECT CAST(id AS VARCHAR) AS id, type, substr(title, 1, 200) AS title, coalesce(content, '') AS content, greatest(0, least(1, coalesce(importance * 3 - 1, 0.5))) AS importance, coalesce(confidence, 0.7) AS confidence, status, source, created_ms, CASE WHEN source = 'src0' THEN 'en' ELSE 'other' END AS project FROM ({MEMORIES_SQL}) m"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of two projects, written as stores of JSON lines and read back together."""
    root = folder(spark)
    for name in ("en", "other"):
        stores.append(records(spark, sf_dir).where(F.col("project") == name).drop("project"), f"{root}/{name}/memory.jsonl")
    return stores.normalised_memories(stores.read_store(spark, root)["memory"])


@query(f"SELECT id, type, length(title) AS n_title, content, round(importance, 6) AS importance, round(confidence, 6) AS confidence, status, source AS tags, created_ms AS created, project FROM ({_RECORDS}) r")
def store_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir)
    return rows.select("id", "type", F.length("title").alias("n_title"), "content", F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence"), "status", F.array_join("tags", ",").alias("tags"), F.col("createdAt").alias("created"), F.col("project_id").alias("project"))


@query(f"SELECT id, CASE WHEN status = 'dormant' THEN 'revived' ELSE status END AS status FROM ({_RECORDS}) r UNION ALL SELECT 'new-' || id, 'active' FROM ({_RECORDS}) r WHERE status = 'archived'")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dormant records change, copies of archived ones are added; written as a new version and read back."""
    rows = stored(spark, sf_dir).drop("project_id")
    changes = rows.where("status = 'dormant'").withColumn("status", F.lit("revived")).unionByName(rows.where("status = 'archived'").withColumn("id", F.concat(F.lit("new-"), "id")).withColumn("status", F.lit("active")))
    path = stores.overwrite(lifecycle.upsert(rows, changes, "id"), f"{folder(spark)}/memory.jsonl", 1)
    return stores.read_jsonl(spark, path, stores.MEMORY).select("id", "status")


@query(f"SELECT status, count(*) AS n, 'kept' AS place FROM ({_RECORDS}) r WHERE status <> 'archived' GROUP BY status UNION ALL SELECT status, count(*), 'archive' FROM ({_RECORDS}) r WHERE status = 'archived' GROUP BY status")
def store_archive_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = folder(spark)
    rows = stored(spark, sf_dir).drop("project_id").withColumn("gone", F.col("status") == "archived")
    path = stores.archive_then_shrink(rows, "gone", f"{base}/archive.jsonl", f"{base}/memory.jsonl", 2)
    count = lambda where, name: stores.read_jsonl(spark, where, stores.MEMORY).groupBy("status").agg(F.count("*").alias("n")).withColumn("place", F.lit(name))
    return count(path, "kept").unionByName(count(f"{base}/archive.jsonl", "archive"))


@query(f"SELECT id, CASE WHEN status IN ('pending', 'in_progress', 'blocked', 'done', 'cancelled') THEN status ELSE 'pending' END AS status, priority FROM (SELECT CAST(id AS VARCHAR) AS id, CASE WHEN status = 'blocked' THEN 'waiting' ELSE status END AS status, priority FROM ({TODOS_SQL}) t) x")
def store_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = todos(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "title", F.expr("upper(case when status = 'blocked' then 'waiting' else status end)").alias("status"), "priority")
    root = folder(spark)
    stores.append(rows, f"{root}/all/todo.jsonl")
    return stores.normalised_todos(stores.read_store(spark, root)["todo"]).select("id", "status", "priority")


@query(f"SELECT id, CASE WHEN status IN ('active', 'dormant') THEN status END AS in_all, status = 'active' AS in_active FROM ({MEMORIES_SQL}) m")
def record_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).select("id", "type", "status")
    active = lifecycle.layer(rows, "active").select("id", F.lit(True).alias("_a"))
    every = lifecycle.layer(rows, "all").select("id", F.col("status").alias("in_all"))
    return lifecycle.layer(rows, "archived").select("id").join(active, "id", "left").join(every, "id", "left").select("id", "in_all", F.coalesce("_a", F.lit(False)).alias("in_active"))


@query("""
WITH c AS (SELECT vec_id, embedding, label FROM embeddings)
SELECT CAST(d.doc_id AS VARCHAR) AS id FROM documents d LEFT JOIN c ON c.vec_id = d.doc_id AND c.label < 5 WHERE c.vec_id IS NULL""")
def vectors_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a valid vector: those of labels under 5 were made of the text as it is, the others of another."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.col("text").alias("content"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("memoryId"), "embedding", "label").join(rows.withColumnRenamed("id", "memoryId"), "memoryId")
    digest = F.sha2(F.concat_ws("\n", "title", F.when(F.col("label") < 5, F.col("content")).otherwise("old")).cast("binary"), 256)
    cache = vectors.select("memoryId", digest.alias("contentHash"), F.lit("m").alias("modelKey"), F.size("embedding").alias("dimensions"), F.col("embedding").cast("array<double>").alias("vector"))
    return stores.pending_vectors(rows, cache, "m").select("id")


@query("SELECT vec_id AS memoryId FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def vectors_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memoryId"))
    return stores.collect_garbage(cache, table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id")))


@query("SELECT 'nation-' || n_name || '.json' AS path, CAST(length(n_name) + 4 AS BIGINT) AS bytes, true AS ok, sha256('{\"' || n_name || '\"}') AS sha256 FROM nation")
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), "n_name", F.lit(".json")).alias("path"), F.concat(F.lit('{"'), "n_name", F.lit('"}')).cast("binary").alias("content"))
    entries = bundle.verified(bundle.unpacked(bundle.pack_bundle(rows, "nations").select(F.col("name").alias("path"), "content")))
    return entries.select("path", F.octet_length("content").cast("long").alias("bytes"), "ok", F.sha2("content", 256).alias("sha256"))


#: Source files made of parts: Python, TypeScript, Go and Java by size; folders by the words of the name.
_EXT = "case when p_size < 13 then 'py' when p_size < 26 then 'ts' when p_size < 38 then 'go' else 'java' end"
_PATH = f"'src/' || case p_type when 'ECONOMY' then 'api' when 'SMALL' then 'core' when 'LARGE' then 'models' else 'misc' end || '/f' || cast(p_partkey as {{s}}) || '.' || {_EXT}"
_N = "cast(p_partkey as {s})"
_TEXT = f"""case when p_size < 13 then 'import os' || chr(10) || 'from app.m' || cast(p_size as {{s}}) || ' import x' || chr(10) || 'import os' || chr(10) || 'class C' || {_N} || '(Base):' || chr(10) || '@app.get("/parts/' || {_N} || '")' || chr(10) || 'def main():' || chr(10)
 when p_size < 26 then 'import a from "./f' || cast(p_partkey + 1 as {{s}}) || '"' || chr(10) || 'import React from "react"' || chr(10) || 'export function run' || {_N} || '() {{{{}}}}' || chr(10) || 'router.post("/t/' || {_N} || '", h)' || chr(10)
 when p_size < 38 then 'package main' || chr(10) || 'import (' || chr(10) || '"fmt"' || chr(10) || '"x/m' || {_N} || '"' || chr(10) || ')' || chr(10) || 'func F' || {_N} || '() {{{{}}}}' || chr(10) || 'type T struct {{{{}}}}' || chr(10)
 else 'import java.util.List;' || chr(10) || 'class J' || {_N} || ' {{{{}}}}' || chr(10) end"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text, bytes, ext, content`` of one made-up file for each part."""
    said = lambda sql: F.expr(sql.format(s="string").replace("{{", "{").replace("}}", "}"))
    rows = table(spark, sf_dir, "part").select(said(_PATH).alias("path"), said(_TEXT).alias("text"), F.expr(_EXT).alias("ext"))
    return rows.withColumn("bytes", F.octet_length("text")).withColumn("content", F.col("text").cast("binary")).drop("text")


_SQL_PATH, _SQL_KEY = _PATH.format(s="varchar"), _N.format(s="varchar")


@query(f"""SELECT {_SQL_PATH} AS path, CASE {_EXT} WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'go' THEN 'Go' ELSE 'Java' END AS language,
CASE {_EXT} WHEN 'py' THEN 'os,app.m' || cast(p_size AS varchar) WHEN 'ts' THEN './f' || cast(p_partkey + 1 AS varchar) || ',react' WHEN 'go' THEN 'fmt,x/m' || {_SQL_KEY} ELSE 'java.util.List' END AS imports,
CASE {_EXT} WHEN 'py' THEN 'C' || {_SQL_KEY} || ',main' WHEN 'ts' THEN 'run' || {_SQL_KEY} WHEN 'go' THEN 'F' || {_SQL_KEY} || ',T' ELSE 'J' || {_SQL_KEY} END AS symbols FROM part""")
def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.code(sources(spark, sf_dir)).select("path", "language", F.array_join("imports", ",").alias("imports"), F.array_join("symbols", ",").alias("symbols"))


@query(f"SELECT CASE {_EXT} WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'go' THEN 'Go' ELSE 'Java' END AS language, count(*) AS files FROM part GROUP BY 1")
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.language_counts(sources(spark, sf_dir))


@query(f"SELECT CASE {_EXT} WHEN 'py' THEN 'GET' ELSE 'POST' END AS method, CASE {_EXT} WHEN 'py' THEN '/parts/' ELSE '/t/' END || {_SQL_KEY} AS route, {_SQL_PATH} AS path, CASE {_EXT} WHEN 'py' THEN 5 ELSE 4 END AS line FROM part WHERE p_size < 26")
def code_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.endpoints(files.code(sources(spark, sf_dir)))


@query(f"SELECT 'C' || {_SQL_KEY} AS name, 'sqlalchemy' AS framework, {_SQL_PATH} AS path FROM part WHERE p_size < 13")
def code_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.models(files.code(sources(spark, sf_dir)))


@query(f"""
WITH p AS (SELECT {_SQL_PATH} AS path, p_partkey, {_EXT} AS ext FROM part)
SELECT a.path AS src, b.path AS dst FROM p a JOIN p b ON a.ext = 'ts' AND b.ext IN ('ts', 'py') AND b.p_partkey = a.p_partkey + 1 AND regexp_extract(a.path, '^(.*)/', 1) = regexp_extract(b.path, '^(.*)/', 1)""")
def code_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.resolve_imports(files.code(sources(spark, sf_dir)))


@query(f"SELECT {_SQL_PATH} AS path, CASE p_type WHEN 'ECONOMY' THEN 'interface' WHEN 'SMALL' THEN 'domain' WHEN 'LARGE' THEN 'data' ELSE 'domain' END AS role FROM part")
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("path", files.role(F.col("path")).alias("role"))


@query("SELECT CASE p_type WHEN 'ECONOMY' THEN 'interface' WHEN 'SMALL' THEN 'domain' WHEN 'LARGE' THEN 'data' ELSE 'domain' END AS role, count(*) AS files FROM part GROUP BY 1")
def components_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.roles_of(sources(spark, sf_dir)).select("role", "files")


@query(f"SELECT path FROM (SELECT {_SQL_PATH} AS path, {_EXT} AS ext FROM part) x WHERE ext = 'py'")
def code_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a function named main; nothing counts as exported here."""
    rows = files.code(sources(spark, sf_dir)).select("path", F.array().cast("array<string>").alias("exports"), F.col("symbols").alias("functions"))
    return graph.entry_points(rows)


@query(f"""
WITH c AS (SELECT {_SQL_PATH} AS path, CASE WHEN p_brand = 'Brand#1' THEN 'added' WHEN p_brand = 'Brand#2' THEN 'removed' ELSE 'modified' END AS change, p_name FROM part),
d AS (SELECT CASE WHEN p_name LIKE 'red%' THEN regexp_extract(path, '^(.*)/', 1) || '/main.ts' WHEN p_name LIKE 'hot%' THEN 'package.json' ELSE path END AS path, change FROM c)
SELECT path, change, bool_or(path LIKE '%/main.ts' OR path = 'package.json' OR change <> 'modified') AS triggers FROM d GROUP BY path, change""")
def architecture_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _PATH.format(s="string")
    rows = table(spark, sf_dir, "part").select(F.expr(said).alias("p"), "p_name", F.expr("case when p_brand = 'Brand#1' then 'added' when p_brand = 'Brand#2' then 'removed' else 'modified' end").alias("change"))
    rows = rows.select(F.expr("case when p_name like 'red%' then concat(regexp_extract(p, '^(.*)/', 1), '/main.ts') when p_name like 'hot%' then 'package.json' else p end").alias("path"), "change").distinct()
    return rows.select("path", "change", files.changes_architecture(F.col("path"), F.col("change")).alias("triggers"))


_PACKAGES = {"Brand#1": "express", "Brand#2": "react", "Brand#3": "next", "Brand#4": "pg", "Brand#5": "unknown-thing", "Brand#6": "koa"}


@query("""
WITH m AS (SELECT DISTINCT p_type AS project, p_brand AS b FROM part)
SELECT project, 'framework-backend' AS field, CASE WHEN bool_or(b = 'Brand#1') THEN 'Express' ELSE 'Koa' END AS value FROM m WHERE b IN ('Brand#1', 'Brand#6') GROUP BY project
UNION ALL SELECT project, 'framework-frontend', 'React' FROM m WHERE b = 'Brand#2' UNION ALL SELECT project, 'framework-fullstack', 'Next.js' FROM m WHERE b = 'Brand#3'
UNION ALL SELECT project, 'database', 'PostgreSQL' FROM m WHERE b = 'Brand#4' UNION ALL SELECT DISTINCT project, 'orm', 'SQLAlchemy' FROM m UNION ALL SELECT DISTINCT project, 'ai', 'PyTorch' FROM m
UNION ALL SELECT DISTINCT project, 'framework-backend', 'Gin' FROM m""")
def manifest_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies of a project for each type of part, whose package.json names a package for some of its brands."""
    return stack.stack(manifests(spark, sf_dir))


_ENTRIES = {
    "Brand#1": ("Dockerfile", "FROM node:20 AS b\n  FROM library/nginx:1\nFROM postgres"),
    "Brand#2": ("compose.dev.yaml", "image: 'bitnami/redis:7'\nimage: postgresql\nIMAGE: quay.io/Keycloak/keycloak"),
    "Brand#3": ("pom.xml", "<artifactId>spring-boot-starter-web</artifactId> spring-kafka"),
    "Brand#4": ("Cargo.toml", "[workspace]\naxum = 1\nyew = 1\n#diesel = 1\nsqlx = 1"),
    "Brand#5": ("main.tf", None),
    "Brand#6": (".github", None),
}


@query("""
WITH m AS (SELECT DISTINCT p_type AS project, p_brand AS b FROM part), r(b, field, value) AS (VALUES
('Brand#1', 'container', 'Docker'), ('Brand#1', 'webserver', 'Nginx'), ('Brand#2', 'container', 'Docker Compose'), ('Brand#2', 'cache', 'Redis'), ('Brand#2', 'auth', 'Keycloak'),
('Brand#3', 'framework-backend', 'Spring Boot'), ('Brand#3', 'queue', 'Kafka'), ('Brand#4', 'framework-backend', 'Rust'), ('Brand#4', 'framework-backend', 'Axum'), ('Brand#4', 'orm', 'SQLx'),
('Brand#4', 'structure', 'Cargo Workspace'), ('Brand#5', 'iac', 'Terraform'), ('Brand#6', 'ci', 'GitHub Actions'))
SELECT DISTINCT project, field, value FROM m JOIN r USING (b)""")
def infrastructure_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies of a project for each type of part, at whose root lies an entry for some of its brands."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("project"), "p_brand").distinct()
    entries = spark.createDataFrame([(b, n, t) for b, (n, t) in _ENTRIES.items()], "p_brand string, name string, text string")
    return stack.infrastructure(rows.join(F.broadcast(entries), "p_brand"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("project"), "p_brand").distinct()
    named = F.expr("case p_brand " + " ".join(f"when '{b}' then '{p}'" for b, p in _PACKAGES.items()) + " end")
    npm = rows.groupBy("project").agg(F.collect_set(named).alias("names")).select("project", F.lit("package.json").alias("name"), F.to_json(F.struct(F.map_from_entries(F.transform("names", lambda n: F.struct(n, F.lit("^1")))).alias("dependencies"))).alias("text"))
    projects = rows.select("project").distinct()
    python = projects.select("project", F.lit("requirements.txt").alias("name"), F.lit("# all\nSQLAlchemy==2.0 ; python_version > '3'\n-r other.txt\ntorch>=2\n").alias("text"))
    go = projects.select("project", F.lit("go.mod").alias("name"), F.lit("module x\nrequire github.com/gin-gonic/gin v1.9\n").alias("text"))
    return npm.unionByName(python).unionByName(go)


@query("""
WITH m AS (SELECT DISTINCT p_type AS project, p_brand AS b FROM part), v AS (
SELECT project, 'framework-backend' AS field, CASE WHEN bool_or(b = 'Brand#1') THEN 'Express' ELSE 'Koa' END AS value FROM m WHERE b IN ('Brand#1', 'Brand#6') GROUP BY project
UNION ALL SELECT project, 'framework-frontend', 'React' FROM m WHERE b = 'Brand#2' UNION ALL SELECT project, 'framework-fullstack', 'Next.js' FROM m WHERE b = 'Brand#3'
UNION ALL SELECT project, 'database', 'PostgreSQL' FROM m WHERE b = 'Brand#4' UNION ALL SELECT DISTINCT project, 'orm', 'SQLAlchemy' FROM m UNION ALL SELECT DISTINCT project, 'ai', 'PyTorch' FROM m
UNION ALL SELECT DISTINCT project, 'framework-backend', 'Gin' FROM m)
SELECT field, value, count(DISTINCT project) AS projects, row_number() OVER (PARTITION BY field ORDER BY count(DISTINCT project) DESC, value) AS rank FROM v GROUP BY field, value""")
def stack_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.by_projects(stack.stack(manifests(spark, sf_dir)))


@query("""
WITH p AS (SELECT p_type AS project, CASE WHEN p_size < 13 THEN 'os' WHEN p_size < 26 THEN 'react' WHEN p_size < 38 THEN 'fmt' ELSE 'java' END AS package, p_partkey FROM part
  UNION ALL SELECT p_type, CASE WHEN p_size < 13 THEN 'app' ELSE 'x' END, p_partkey FROM part WHERE p_size < 13 OR p_size BETWEEN 26 AND 37)
SELECT project, package, count(DISTINCT p_partkey) AS files FROM p WHERE NOT (package = 'react' AND project IN (SELECT p_type FROM part WHERE p_brand = 'Brand#2')) GROUP BY project, package""")
def unknown_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.expr(_PATH.format(s="string")).alias("path"), F.col("p_type").alias("project"))
    found = files.code(sources(spark, sf_dir)).select("path", F.explode("imports").alias("import")).join(types, "path")
    return stack.unknown_imports(found.select("project", "path", "import"), manifests(spark, sf_dir))


@query(f"""
WITH RECURSIVE c AS (SELECT id, lag(id) OVER (PARTITION BY user_id ORDER BY occurred_ms, id) AS parent, user_id FROM ({TIMELINE_SQL}) t),
h AS (SELECT id FROM ({TIMELINE_SQL}) t WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY occurred_ms DESC, id DESC LIMIT 1),
w AS (SELECT id, 0 AS distance FROM h UNION ALL SELECT c.parent, distance + 1 FROM w JOIN c ON c.id = w.id WHERE c.parent IS NOT NULL AND distance < 499)
SELECT CAST(id AS VARCHAR) AS hash, distance FROM w""")
def commit_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first parents of a history: each event of a user follows the one before."""
    events = timeline(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("occurred_ms", "id")
    commits = events.select(F.col("id").cast("string").alias("hash"), F.lag("id").over(w).cast("string").alias("parent"))
    first = events.agg(F.min("user_id")).first()[0]
    head = events.where(F.col("user_id") == first).orderBy(F.desc("occurred_ms"), F.desc("id")).select(F.col("id").cast("string")).first()
    return graph.first_parents(commits, head[0] if head else "").select("hash", "distance")


@query("""
WITH e AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)
SELECT 'r' || r_regionkey AS root, CASE WHEN EXISTS (SELECT 1 FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 'r' || r_regionkey) THEN 2 WHEN EXISTS (SELECT 1 FROM e a WHERE a.src = 'r' || r_regionkey) THEN 1 ELSE 0 END AS depth FROM region""")
def call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionByName(supplier.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")))
    return graph.longest_chains(edges, table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node")))


_SIDES = "SELECT p_name AS path, 'modified' AS change, p_brand FROM part WHERE p_size > 20 UNION ALL SELECT p_name, 'added', p_brand FROM part WHERE p_size = 7 UNION ALL SELECT p_name, 'removed', p_brand FROM part WHERE p_size = 3"


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    one = lambda test, change: parts.where(test).select(F.col("p_name").alias("path"), F.lit(change).alias("change"), "p_brand")
    return one("p_size > 20", "modified").unionByName(one("p_size = 7", "added")).unionByName(one("p_size = 3", "removed"))


@query(f"SELECT path, CASE WHEN bool_or(change = 'removed') THEN 'removed' WHEN bool_or(change = 'added') THEN 'added' ELSE 'modified' END AS change FROM ({_SIDES}) s GROUP BY path")
def changes_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merged_changes(sides(spark, sf_dir))


@query(f"SELECT p_brand, count(CASE WHEN change = 'added' THEN 1 END) AS added, count(CASE WHEN change = 'modified' THEN 1 END) AS modified, count(CASE WHEN change = 'removed' THEN 1 END) AS removed FROM ({_SIDES}) s GROUP BY p_brand")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.change_counts(sides(spark, sf_dir), "p_brand")


@query("SELECT l_partkey AS path, l_linenumber, p_partkey IS NOT NULL AS tracked FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) p ON p_partkey = l_partkey")
def changes_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("path"))
    return graph.tracked(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), "l_linenumber"), tree)


_SUPERSEDED = f"SELECT id, CASE WHEN source <> 'src3' THEN source END AS session, lag(id) OVER (PARTITION BY type, status ORDER BY id) AS supersedes FROM ({MEMORIES_SQL}) m"


@query(f"WITH m AS ({_SUPERSEDED}) SELECT DISTINCT 'supersede' AS kind, o.session AS src, m.session AS dst FROM m JOIN m o ON o.id = m.supersedes WHERE m.session IS NOT NULL AND o.session IS NOT NULL AND o.session <> m.session")
def supersede_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions are sources; a record supersedes the one before it of its type and status."""
    rows = memories(spark, sf_dir).select("id", "type", "status", F.when(F.col("source") != "src3", F.col("source")).alias("session"))
    return graph.supersede_edges(previous(rows, ["type", "status"], [F.col("id")], "id", "supersedes"))


_RANKED = "ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'low' THEN 3 ELSE 2 END, created_ms DESC, CAST(id AS VARCHAR)"


@query(f"""
WITH t AS (SELECT * FROM ({TODOS_SQL}) x WHERE status NOT IN ('done', 'cancelled')), r AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS ref FROM customer),
m AS (SELECT ref, CAST(t.id AS VARCHAR) AS id, row_number() OVER (PARTITION BY ref {_RANKED}) AS k FROM r JOIN t ON starts_with(CAST(t.id AS VARCHAR), ref))
SELECT ref, id FROM m WHERE k = 1""")
def todo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' numbers as references to todos."""
    return status.find_todos(todos(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ref")))


@query("""
WITH t AS (SELECT o_orderkey AS id, list_distinct(list(CAST(l_suppkey AS VARCHAR))) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
m AS (SELECT CAST(s_suppkey AS VARCHAR) AS f, s_nationkey AS position, s_name AS memory FROM supplier WHERE s_acctbal > 0),
h AS (SELECT t.id, min({'p': position, 'm': memory}) AS b FROM (SELECT id, unnest(f) AS f FROM t) t JOIN m ON m.f = t.f GROUP BY t.id)
SELECT t.id, coalesce(h.b.m, (SELECT min({'p': position, 'm': memory}).m FROM m)) AS memory FROM t LEFT JOIN h ON h.id = t.id""")
def related_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as todos that touch suppliers; suppliers with money as memories of one file each."""
    open_ = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("files")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id")
    rows = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("id"), F.col("s_nationkey").alias("position"), F.array(F.col("s_suppkey").cast("string")).alias("files"), F.array().cast("array<string>").alias("tags"))
    return status.related_records(open_.withColumn("tags", F.array().cast("array<string>")), rows)


@query(f"SELECT id FROM ({MEMORIES_SQL}) m WHERE status = 'active' AND importance = 1")
def pinned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.pinned(memories(spark, sf_dir).withColumn("pinned", F.col("importance") == 1)).select("id")


@query(f"SELECT type, CAST(sum(CAST(ceil(length(content) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM ({MEMORIES_SQL}) m GROUP BY type")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy("type").agg(F.sum(estimated_tokens("content")).alias("tokens"))


_NORM = "lower(regexp_replace({c}, '[\\s\\p{{P}}]', '', 'g'))"


@query(f"""
WITH b AS (SELECT item_id, {_NORM.format(c='substr(trim(text), 1, 200)')} AS e FROM benchmark), d AS (SELECT doc_id, {_NORM.format(c='text')} AS t FROM documents),
g AS (SELECT item_id, count(*) AS n FROM b JOIN d ON contains(t, e) OR (length(e) > 30 AND len(list_filter(generate_series(0, greatest(length(e) - 30, 0), 15), lambda i: contains(t, substr(e, i + 1, 30)))) > 0) WHERE length(e) >= 6 GROUP BY item_id)
SELECT coalesce(n, 0) > 0 AS grounded, count(*) AS items, CAST(sum(coalesce(n, 0)) AS BIGINT) AS hits FROM benchmark LEFT JOIN g USING (item_id) GROUP BY 1""")
def grounded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    hits = transcript.grounding(items, table(spark, sf_dir, "documents")).groupBy("item_id").agg(F.count("*").alias("n"))
    rows = items.select("item_id").join(hits, "item_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy((F.col("n") > 0).alias("grounded")).agg(F.count("*").alias("items"), F.sum("n").cast("long").alias("hits"))


@query("""SELECT page_id, lpad(lower(printf('%x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295))), 8, '0') AS hash FROM pages""")
def url_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fnv1a("url").alias("hash"))


@query("SELECT doc_id, concat_ws(' ', 'Title', nullif(w, ''), 'end') AS plain FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z ]+', '', 'g'), '\\s+', ' ', 'g')) AS w FROM documents) x")
def markdown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All letters of every document set in marks, and read back without them."""
    letters = F.trim(F.regexp_replace(F.regexp_replace(text_of("text"), "[^A-Za-z ]+", ""), " {2,}", " "))
    # behind explode, the letters of a whole text are told once and not for each use of them
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(letters)).alias("w"))
    bold = F.when(F.col("w") == "", "").otherwise(F.concat(F.lit("**"), F.col("w"), F.lit("**")))
    marked = F.concat(F.lit("# Title\n> - "), bold, F.lit("\n***\n```py\ncode\n```\n[end](http://x.y/z)\n"))
    return rows.select("doc_id", strip_markdown(marked).alias("plain"))
