"""Source files made of the documents' whole texts, and what their syntax tells, with SQL twins.

A document's text stands in its file as comments, its words are the names of fields and methods; the languages take turns.
Comments and strings hold braces, quotes and definitions that aren't there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import syntax
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Language, ending, comment mark, what stands after the text; {i} is the document's id, {w} the lines of its words.
_FILES = (
    ("JavaScript", "js", "//", ["import {{ a }} from \"./m{i}.js\";", "export class C{i} extends Base {{", "{w}", "}}", "export function run{i}(a, b) {{", "  function inner{i}() {{ log(\"/* \" + a); }}", "  app.get(\"/r/{i}\", inner{i});", "}}"]),
    ("Python", "py", "#", ["from m{i} import x", "class C{i}(Base):", "    __tablename__ = \"t{i}\"", "{w}", "    def own(self):", "        return \"def x(): }}\"", "@app.get(\"/r/{i}\")", "async def run{i}(a, b):", "    def inner{i}():", "        return log(a)", "    return inner{i}()"]),
    ("Go", "go", "//", ["import (", "  \"fmt\"", "  \"m/{i}\"", ")", "type T{i} struct {{", "{w}", "}}", "func (t *T{i}) Run{i}() string {{ return `}}{{` }}", "func main() {{", "  r.GET(\"/r/{i}\", func(c int) {{ run(\"}}\") }})", "}}"]),
    ("Java", "java", "//", ["import java.util.List;", "@Entity", "@Table(name = \"t{i}\")", "public class J{i} extends Base<List<String>> {{", "{w}", "  @GetMapping(\"/r/{i}\")", "  public List<String> m{i}(int a) throws Exception {{", "    return call{i}(a, \"}} {{\", '}}');", "  }}", "  abstract void n{i}();", "}}"]),
    ("Rust", "rs", "//", ["use std::fmt::{{self, Debug}};", "#[derive(Debug, Queryable)]", "pub struct R{i}<'a> {{", "{w}", "}}", "impl<'a> R{i}<'a> {{", "  pub fn run{i}(&self) -> char {{ '}}' }}", "}}", "fn helper{i}() {{ show{i}(\"{{}}\", r#\"}}\"#); }}"]),
    ("C", "c", "//", ["#include <stdio.h>", "struct S{i} {{", "{w}", "}};", "static int helper{i}(int a) {{", "  return call{i}(\"}}\", '{{');", "}}", "int main(void) {{ return helper{i}(0); }}"]),
)
#: A line for a word, by language; %s are the word and its number.
_WORDS = ('  w_%s_%s(x) { return "} {" + `t${x} {`; }', "    c_%s_%s = Column(String)", '  F_%s_%s string `gorm:"column:x{"`', '  @Column(name = "{") private String c_%s_%s;', "  pub f_%s_%s: &'a str,", "  int f_%s_%s;")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, language, text`` of a file a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    # files are read by few tasks, and telling their syntax costs far more than reading them
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    docs = docs.withColumn("w", F.regexp_extract_all("t", F.lit("[A-Za-z]{3,}"), F.lit(0))).withColumn("i", F.col("doc_id").cast("string"))
    path, language, text = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for turn, (name, ending, mark, lines) in enumerate(_FILES):
        told = []
        for line in lines:
            if line == "{w}":
                before, between, after = map(F.lit, _WORDS[turn].split("%s"))  # concat takes a fraction of format_string's time
                told.append(F.array_join(F.transform("w", lambda w, k: F.concat(before, w, between, k.cast("string"), after)), "\n"))  # noqa: B023
            else:
                parts = line.replace("{{", "{").replace("}}", "}").split("{i}")
                told.append(F.concat(*[x for p in parts for x in (F.lit(p), F.col("i"))][:-1]))
        # a text without words leaves an empty line out
        body = F.array_join(F.filter(F.array(F.array_join(F.transform(F.split("t", "\n"), lambda x: F.concat(F.lit(mark + " "), x)), "\n"), *told), lambda x: x != ""), "\n")  # noqa: B023
        mine = F.col("doc_id") % len(_FILES) == turn
        path, language, text = F.when(mine, F.concat(F.lit(f"src/{name.lower()}/d"), "i", F.lit("." + ending))).otherwise(path), F.when(mine, name).otherwise(language), F.when(mine, body).otherwise(text)
    return docs.where("doc_id is not null").select(path.alias("path"), language.alias("language"), text.alias("text"))


#: The same files in SQL: place, id, lines of the text (n) and words (k).
_D = """d AS (SELECT doc_id % 6 AS t, CAST(doc_id AS VARCHAR) AS i, length(x) - length(replace(x, chr(10), '')) + 1 AS n, len(regexp_extract_all(x, '[A-Za-z]{3,}')) AS k, regexp_extract_all(x, '[A-Za-z]{3,}') AS w,
  CASE doc_id % 6 WHEN 0 THEN 'src/javascript/d' || doc_id || '.js' WHEN 1 THEN 'src/python/d' || doc_id || '.py' WHEN 2 THEN 'src/go/d' || doc_id || '.go' WHEN 3 THEN 'src/java/d' || doc_id || '.java' WHEN 4 THEN 'src/rust/d' || doc_id || '.rs' ELSE 'src/c/d' || doc_id || '.c' END AS path
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents WHERE doc_id IS NOT NULL))"""


def _sql(columns: str, *rows: tuple) -> str:
    """Rows (turn, an expression a column), of the files."""
    return f"WITH {_D} " + " UNION ALL ".join("SELECT " + ", ".join(f"{e} AS {c}" for e, c in zip(r[1:], columns.split(), strict=True)) + f" FROM d WHERE t = {r[0]}" for r in rows)


def query(sql: str) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return register


_FUNCTIONS = (
    (0, "path", "'w_' || w[g] || '_' || (g - 1)", "'C' || i", "n + 2 + g", "n + 2 + g"),
    (0, "path", "'run' || i", "''", "n + 4 + k", "n + 7 + k"), (0, "path", "'inner' || i", "'run' || i", "n + 5 + k", "n + 5 + k"),
    (1, "path", "'own'", "'C' || i", "n + 4 + k", "n + 5 + k"), (1, "path", "'run' || i", "''", "n + 7 + k", "n + 10 + k"), (1, "path", "'inner' || i", "'run' || i", "n + 8 + k", "n + 9 + k"),
    (2, "path", "'Run' || i", "''", "n + 7 + k", "n + 7 + k"), (2, "path", "'main'", "''", "n + 8 + k", "n + 10 + k"),
    (3, "path", "'m' || i", "'J' || i", "n + 5 + k", "n + 8 + k"), (3, "path", "'n' || i", "'J' || i", "n + 9 + k", "n + 9 + k"),
    (4, "path", "'run' || i", "'R' || i || '<''a>'", "n + 6 + k", "n + 6 + k"), (4, "path", "'helper' || i", "''", "n + 8 + k", "n + 8 + k"),
    (5, "path", "'helper' || i", "''", "n + 4 + k", "n + 6 + k"), (5, "path", "'main'", "''", "n + 7 + k", "n + 7 + k"),
)
_WORD_FUNCTIONS = _sql("path name parent line end_line", *_FUNCTIONS).replace(f"FROM d WHERE t = {_FUNCTIONS[0][0]}", "FROM (SELECT *, unnest(generate_series(1, CAST(k AS BIGINT))) AS g FROM d WHERE t = 0) d", 1)


@query(_WORD_FUNCTIONS)
def syntax_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods with the scopes that they stand in and their lines."""
    return syntax.syntax(sources(spark, sf_dir), ("function",), False).select("path", "name", "parent", "line", "end_line")


@query(_sql(
    "path name argument parent line",
    (0, "path", "'log'", "'/* '", "'run' || i || '.inner' || i", "n + 5 + k"), (0, "path", "'app.get'", "'/r/' || i", "'run' || i", "n + 6 + k"),
    (1, "path", "'Column'", "NULL", "'C' || i", "n + 3 + g"), (1, "path", "'log'", "NULL", "'run' || i || '.inner' || i", "n + 9 + k"), (1, "path", "'inner' || i", "NULL", "'run' || i", "n + 10 + k"),
    (2, "path", "'r.GET'", "'/r/' || i", "'main'", "n + 9 + k"), (2, "path", "'run'", "'}'", "'main'", "n + 9 + k"), (3, "path", "'call' || i", "'} {'", "'J' || i || '.m' || i", "n + 7 + k"),
    (4, "path", "'show' || i", "'{}'", "'helper' || i", "n + 8 + k"), (5, "path", "'call' || i", "'}'", "'helper' || i", "n + 5 + k"), (5, "path", "'helper' || i", "NULL", "'main'", "n + 7 + k"),
).replace("n + 3 + g AS line FROM d WHERE t = 1", "n + 3 + g AS line FROM (SELECT *, unnest(generate_series(1, CAST(k AS BIGINT))) AS g FROM d WHERE t = 1) d"))
def syntax_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their first string and the function that they stand in."""
    return syntax.syntax(sources(spark, sf_dir), ("call",), False).select("path", "name", "argument", "parent", "line")


@query(_sql(
    "path imports exports functions",
    (0, "path", "'./m' || i || '.js'", "'C' || i || ',run' || i", "k + 2"), (1, "path", "'m' || i", "'C' || i", "3"), (2, "path", "'fmt,m/' || i", "'T' || i || ',Run' || i", "2"), (3, "path", "'java.util.List'", "'J' || i", "2"),
    (4, "path", "'std::fmt::{self, Debug}'", "'R' || i || ',R' || i || '<''a>,run' || i", "2"), (5, "path", "'stdio.h'", "''", "2"),
))
def syntax_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, exports and the count of functions of every file."""
    rows = syntax.file_symbols(syntax.syntax(sources(spark, sf_dir), ("import", "export", "class", "function"), False))
    return rows.select("path", F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"), F.size("functions").alias("functions"))


@query(_sql(
    "method route path line handler",
    (0, "'GET'", "'/r/' || i", "path", "n + 6 + k", "NULL"), (1, "'GET'", "'/r/' || i", "path", "n + 6 + k", "'run' || i"), (2, "'GET'", "'/r/' || i", "path", "n + 9 + k", "NULL"), (3, "'GET'", "'/r/' || i", "path", "n + 5 + k", "NULL"),
))
def syntax_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.routes(syntax.syntax(sources(spark, sf_dir), ("call", "class", "function"), False))


@query(_sql(
    "name framework path line field_count",
    (1, "'C' || i", "'sqlalchemy'", "path", "n + 2", "k + 1"), (2, "'T' || i", "'gorm'", "path", "n + 5", "k"), (3, "'J' || i", "'jpa'", "path", "n + 2", "k"), (4, "'R' || i", "'diesel'", "path", "n + 3", "k"),
).replace("FROM d WHERE t = 2", "FROM d WHERE t = 2 AND k > 0"))
def syntax_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with line and fields; a structure without fields has no tag that would tell it from others."""
    return syntax.schemas(syntax.syntax(sources(spark, sf_dir), ("class",)))


@query(f"WITH {_D} SELECT count(*) AS files, count(DISTINCT t) AS languages, count(*) + count_if(t = 2) AS edges, count_if(t < 4) AS routes, count_if(t IN (1, 3, 4) OR (t = 2 AND k > 0)) AS models FROM d")
def syntax_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of files, languages, import edges, routes and models."""
    files = sources(spark, sf_dir)
    return syntax.graph_stats(files, syntax.syntax(files))
