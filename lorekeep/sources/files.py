"""Source trees as tables: scans, languages, imports, symbols, endpoints, models, technology rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import text_of
from .stores import guarded

# Folders that a scan leaves out, by name or by form; languages by file ending.
IGNORED_NAMES = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", ".next", "target", ".DS_Store", ".idea", ".vscode", "coverage", ".turbo", ".cache", "out")
IGNORED_FORMS = (r"(?i)(^|/)node_modules([._-][^/]*)?/", r"(?i)(^|/)([^/]*[._-])?backup([._-][^/]*)?/", r"(?i)(^|/)[^/]*\.bak([._-][^/]*)?/")
LANGUAGES = {
    "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "py": "Python", "go": "Go",
    "java": "Java", "rs": "Rust", "c": "C", "h": "C", "cpp": "C++", "hpp": "C++", "kt": "Kotlin", "scala": "Scala", "rb": "Ruby", "php": "PHP", "cs": "C#",
    "dart": "Dart", "swift": "Swift", "vue": "Vue", "svelte": "Svelte", "css": "CSS", "html": "HTML", "md": "Markdown", "sql": "SQL", "sh": "Shell",
}
MOST_BYTES, MOST_DEPTH = 512 * 1024, 5


def scan(spark: SparkSession, root: str, depth: int = MOST_DEPTH, most: int | None = None) -> DataFrame:
    """``path`` (relative), ``bytes``, ``modified``, ``ext``, ``depth`` of files; contents are not read unless asked for."""
    base = guarded(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.expr(f"substring(regexp_replace(path, '^[a-zA-Z]+:/*', '/'), {len('/' + base.split('://')[-1].strip('/')) + 2})")
    rows = files.select(rel.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")
    rows = rows.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).withColumn("depth", F.size(F.split("path", "/")) - 1)
    rows = rows.where(~ignored(F.col("path")) & (F.col("depth") <= depth))
    return rows.where(F.col("bytes") < most) if most else rows


def ignored(path: Column) -> Column:
    """Is one of the folders above the file left out of scans?"""
    folders = F.filter(F.split(path, "/"), lambda _, i: i < F.size(F.split(path, "/")) - 1)
    out = F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_NAMES)))
    for form in IGNORED_FORMS:
        out = out | path.rlike(form)
    return out


def language(ext: Column) -> Column:
    """The language of a file ending; null if unknown."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in dict.fromkeys(LANGUAGES.values()):
        out = out.when(ext.isin([e for e, n in LANGUAGES.items() if n == name]), name)
    return out


def language_counts(files: DataFrame) -> DataFrame:
    return files.select(language(F.col("ext")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))


# Patterns of imports and symbols by language; the name is the first group that matched.
IMPORTS = {
    "JavaScript": r"(?:from\s*|import\s*\(|require\s*\()\s*[\"']([^\"']+)[\"']",
    "Python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "Go": r"[\"`]([^\"`\s]+)[\"`]",
    "Java": r"(?m)^\s*import\s+([\w.]+);",
}
#: Where Go names its imports: the first statement or block.
GO_BLOCK = r"import\s*(?:\([\s\S]*?\)|[\"`][^\"`]+[\"`])"
SYMBOLS = {
    "JavaScript": r"(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:class|function|const|let|var)\s+([A-Za-z_$][\w$]*)",
    "Python": r"(?m)^\s*(?:class|def|async\s+def)\s+([A-Za-z_]\w*)",
    "Go": r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)|^type\s+([A-Za-z_]\w*)",
    "Java": r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "Rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:fn|struct|enum|trait)\s+([A-Za-z_]\w*)",
}
ENDPOINTS = r"(?i)(?:\b(?:app|router|api|r|e|g|server)\s*\.|@(?:app|router|api)\s*\.|@)(get|post|put|delete|patch)(?:mapping)?\s*\(\s*[\"']([^\"']+)[\"']"
MODELS = (("prisma", r"(?m)^model\s+(\w+)\s*\{"), ("sqlalchemy", r"(?m)^class\s+(\w+)\s*\([^)]*\b(?:Base|Model)\b[^)]*\)\s*:"), ("gorm", r"(?s)type\s+(\w+)\s+struct\s*\{[^}]*gorm[.:]"), ("jpa", r"(?s)@Entity\b.{0,300}?\bclass\s+(\w+)"), ("diesel", r"(?s)#\[derive\([^)]*Queryable[^)]*\)\]\s*(?:pub\s+)?struct\s+(\w+)"))


def _name_in(pattern: str):
    """The name in a match: that of the first group that has one."""
    groups = re.compile(pattern.replace("(?m)", "")).groups
    return lambda m: F.coalesce(*(F.nullif(F.regexp_extract(m, pattern, k + 1), F.lit("")) for k in range(groups)))


def _by_language(rules: dict[str, str], most: int) -> Column:
    """Names by the pattern of a file's language, in the order in which they are first seen."""
    lang = F.when(F.col("language").isin("TypeScript", "Vue", "Svelte"), "JavaScript").when(F.col("language") == "Kotlin", "Java").otherwise(F.col("language"))
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, pattern in rules.items():
        body = F.regexp_extract(text_of("text"), GO_BLOCK, 0) if rules is IMPORTS and name == "Go" else text_of("text")
        # one walk of the text gives the matches in order
        names = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), _name_in(pattern))
        out = out.when(lang == name, F.slice(F.array_distinct(F.filter(names, lambda x: x.isNotNull())), 1, most))
    return out.otherwise(F.array().cast("array<string>"))


def code(files: DataFrame) -> DataFrame:
    """Source files under the size limit with ``text``, ``language``, ``imports`` (60) and ``symbols`` (24), first seen first."""
    rows = files.where((F.col("bytes") < MOST_BYTES) & ~F.col("path").rlike(r"(^|/)\.")).withColumn("language", language(F.col("ext")))
    rows = rows.where("language is not null").withColumn("text", F.decode("content", "UTF-8")).drop("content")
    return rows.withColumn("imports", _by_language(IMPORTS, 60)).withColumn("symbols", _by_language(SYMBOLS, 24))


def endpoints(rows: DataFrame) -> DataFrame:
    """``method, route, path, line`` of web routes."""
    lines = rows.select("path", F.posexplode(F.split(text_of("text"), "\n")).alias("at", "line_text")).where(F.col("line_text").rlike(ENDPOINTS))
    return lines.select(F.upper(F.regexp_extract("line_text", ENDPOINTS, 1)).alias("method"), F.regexp_extract("line_text", ENDPOINTS, 2).alias("route"), "path", (F.col("at") + 1).alias("line"))


def models(rows: DataFrame) -> DataFrame:
    """``name, framework, path`` of database models."""
    found = F.array(*(F.transform(F.regexp_extract_all(text_of("text"), F.lit(p), F.lit(1)), _named(f)) for f, p in MODELS))
    return rows.select("path", F.explode(F.flatten(found)).alias("m")).select(F.col("m.name").alias("name"), F.col("m.framework").alias("framework"), "path")


def _named(framework: str):
    return lambda n: F.struct(n.alias("name"), F.lit(framework).alias("framework"))


# Roles by path, in order.
ROLES = (
    ("presentation", r"(?i)(?:^|/)(?:client|frontend|web|ui|views?|pages?|components?|screens?)(?:/|\.|$)"),
    ("interface", r"(?i)(?:^|/)(?:api|routes?|controllers?|handlers?|rpc|commands?|cli|gateway)(?:/|\.|$)"),
    ("application", r"(?i)(?:^|/)(?:services?|use-?cases?|application|agents?|tools?|workflows?|orchestrators?)(?:/|\.|$)"),
    ("domain", r"(?i)(?:^|/)(?:core|domain|engine|business|analysis|scanner|parser|compiler)(?:/|\.|$)"),
    ("data", r"(?i)(?:^|/)(?:data|db|database|models?|schemas?|repositories?|stores?|storage|memory|cache|migrations?)(?:/|\.|$)"),
    ("integration", r"(?i)(?:^|/)(?:host|integrations?|adapters?|providers?|connectors?|plugins?|infra|runtime)(?:/|\.|$)"),
    ("support", r"(?i)(?:^|/)(?:tests?|specs?|fixtures?|scripts?|build|config|deploy)(?:/|\.|$)"),
)
# Manifests, and files that never change an architecture.
MANIFESTS = r"(?i)(?:^|/)(?:package\.json|pyproject\.toml|requirements\.txt|go\.mod|pom\.xml|build\.gradle(?:\.kts)?|cargo\.toml|docker-compose\.ya?ml|compose\.ya?ml|dockerfile|makefile|pnpm-workspace\.yaml|turbo\.json|nx\.json)$"
SOURCES = r"(?i)\.(?:[cm]?[jt]sx?|py|go|java|kt|kts|rs|cs|php|rb|swift|dart|scala|vue|svelte)$"
SILENT = r"(?i)(?:^|/)(?:readme(?:\.[a-z0-9]+)?|changelog(?:\.[a-z0-9]+)?|package-lock\.json|pnpm-lock\.yaml|yarn\.lock|cargo\.lock|poetry\.lock|go\.sum)$"
TESTS = r"(?i)(?:^|/)(?:tests?|specs?|__tests__|fixtures?)(?:/|$)|\.(?:test|spec)\.[a-z]+$"
ENTRIES = r"(?i)(?:^|/)(?:index|main|app|server|cli)\.[a-z]+$"


def changes_architecture(path: Column, change: Column) -> Column:
    """Does a changed file ask for a new look at the architecture: a manifest, an entry file, a source file that came or went?"""
    source = path.rlike(SOURCES) & (path.rlike(ENTRIES) | change.isin("added", "removed"))
    return ~ignored(path) & ~path.rlike(TESTS) & ~path.rlike(SILENT) & (path.rlike(MANIFESTS) | source)


def roles_of(files: DataFrame) -> DataFrame:
    """Files of each role, with three of their paths, most telling first."""
    rows = files.select(role(F.col("path")).alias("role"), "path", evidence_priority(F.col("path"), F.lit(False)).alias("_p"))
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_p")).alias("p"), "path"))), lambda x: x["path"]), 1, 3)
    rank = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("_p"), "path"))
    counts = rows.groupBy("role").agg(F.count("*").alias("files"))
    best = rows.withColumn("_r", rank).where("_r <= 3").groupBy("role").agg(first.alias("evidence"))
    return counts.join(best, "role")


def role(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in ROLES:
        out = out.when(path.rlike(pattern), name)
    return out.otherwise("domain")  # what no pattern knows


def evidence_priority(path: Column, entry: Column) -> Column:
    """+100 entry point, +45 main-like name, +28 role word, +12 within three folders, -35 test-like."""
    word = path.rlike(r"(?i)(^|[/_.-])(index|main|app|server|cli|mod|lib)\.[a-z]+$")
    depth = F.size(F.split(path, "/")) - 1
    return entry.cast("int") * 100 + word.cast("int") * 45 + (role(path) != "domain").cast("int") * 28 + (depth <= 3).cast("int") * 12 - path.rlike(r"(?i)(test|spec|fixture|mock)").cast("int") * 35


def resolve_imports(rows: DataFrame) -> DataFrame:
    """``src, dst`` edges: a relative import meets the first of its candidate paths that exists."""
    pairs = rows.select(F.col("path").alias("src"), F.explode("imports").alias("import")).where(F.col("import").startswith("."))
    folder = F.regexp_replace("src", r"[^/]*$", "")
    joined = F.concat(folder, F.col("import"))
    for _ in range(8):  # a/b/../c is a/c; paths of a scan are at most a few folders deep
        joined = F.regexp_replace(F.regexp_replace(joined, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    endings = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py"]
    tries = pairs.withColumn("_p", joined).select("src", "import", F.posexplode(F.array(*(F.concat(F.col("_p"), F.lit(e)) for e in endings))).alias("rank", "dst"))
    found = tries.join(rows.select(F.col("path").alias("dst")), "dst")
    return found.groupBy("src", "import").agg(F.min_by("dst", "rank").alias("dst")).select("src", "dst").distinct()
