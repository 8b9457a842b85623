"""Scopes of source files: Python against the standard library's own parser, the other languages on hand-made files."""

import ast
import sysconfig
from pathlib import Path

import pytest

from lorekeep.sources import syntax

LIBRARY = Path(sysconfig.get_path("stdlib"))


def functions(text, language):
    return [(r[1], r[2], r[3], r[4]) for r in syntax.rows_of(text, language) if r[0] == "function"]


@pytest.mark.parametrize("name", ["argparse", "ast", "tarfile", "typing", "inspect", "textwrap", "json/decoder", "asyncio/base_events", "dataclasses", "calendar"])
def test_python_by_its_parser(name):
    text = (LIBRARY / f"{name}.py").read_text()
    want, calls = [], []

    def walk(node, around, first=False):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                want.append(("class" if isinstance(child, ast.ClassDef) else "function", child.name, child.lineno, child.end_lineno, ".".join(around)))
                walk(child, [*around, child.name])
            else:
                if isinstance(child, ast.Call) and isinstance(child.func, ast.Name):
                    calls.append((child.func.id, child.lineno))
                walk(child, around)

    walk(ast.parse(text), [])
    got = syntax.rows_of(text, "Python")
    assert sorted(r[:5] for r in got if r[0] in ("class", "function")) == sorted(want)
    told = {(r[1], r[2]) for r in got if r[0] == "call"}
    assert len(set(calls) & told) > 0.9 * len(set(calls))
    assert {r[1] for r in got if r[0] == "import"} == {"." * n.level + (n.module or "") for n in ast.walk(ast.parse(text)) if isinstance(n, ast.ImportFrom)}


JS = """import a from "./a.js"; // function no() {
import { b } from './b';
import "./side";
const r = /[/{]}\\/"/g, t = `x ${ {a: 1}.a } } ${ `inner ${b}` } {`;
/* class Not { */
export class Cart extends Base {
  static async load(id, { deep = {} } = {}) {
    if (id) { return fetch("}") }
    return [1].map((x) => { return x })
  }
  get size() { return 1 }
  #hidden() {}
  handler = () => { this.load() }
}
export default function main(a, b) {
  function inner() { return "{" }
  const o = { method() { return 1 }, arrow: () => {}, async other(x) {} }
  app.get("/users/:id", async (req) => { inner() })
  router.post('/t', function named() {})
  client.get("/not")
}
const Expr = class Hidden { m() {} }
const f = function notDeclared() { return 2 }
module.exports = { main, alias: Cart, /* c */ x }
"""
TS = "export function gen<T, U>(x: Map<T, U>): Promise<T> {\n  return x\n}\nabstract class Q<T> extends P<T> implements I, J {\n  private run(x: number): void {\n  }\n}\ninterface Z { m(): void }\n"
GO = """package main

import (
\t"fmt"
\talias "x/y" // "no"
)

// func comment() {}
type Kind int
type (
\tA struct {
\t\tID int `gorm:"primaryKey"`
\t}
\tB interface { Do() }
)
type Pair[K comparable] struct {
\tk K `db:"k"`
\tv K `db:"v"`
}

func (p *Pair[K]) Run(x func(int) error) (string, error) {
\tf := func() { fmt.Println("}") }
\tr.GET("/a/{id}", func(c *gin.Context) { f() })
\treturn `}
{`, nil
}

func Map[T any](xs []T) []T { return xs }
func small() {}
"""
JAVA = """package a.b;
import java.util.*;
import static java.lang.Math.max;
/** class Not { } */
@Entity
@Table(name = "t")
public class User<T extends Comparable<T>> extends Base<Map<String, T>> implements A, B {
  @Id private Long id = make("}");
  @Column(name = "n{") String name;
  static { init(); }
  public User(int x) { super(x); }
  @GetMapping("/u/{id}")
  @Deprecated
  public Map<String, List<T>> find(@Param("a") int a) throws IOException, E {
    Runnable r = new Runnable() { public void run() { go('}'); } };
    return list.stream().map(x -> { return x; }).toList();
  }
  abstract void later(int a);
  enum Color { RED(1) { int v() { return 1; } }, BLUE(2); Color(int v) {} }
  record Point(int x, int y) { Point { } double norm() { return 0; } }
}
interface Shape { double area(); default int n() { return 1; } }
"""
RUST = """use std::collections::{HashMap, hash_map::Entry};
pub use crate::a::b;
/* outer /* nested fn no() { */ still } */
#[derive(Debug, Queryable)]
pub struct Config<'a> {
    pub name: &'a str,
    pub size: usize,
    hidden: char,
}
pub struct Unit;
pub enum Kind { A { x: u8 }, B }
impl<'a> Config<'a> {
    #[inline]
    pub fn new<F>(f: F) -> Result<Self, String> where F: Fn(char) -> bool {
        let c = '}'; let s = r#"}"{"#;
        fn deep() {}
        match c { '{' => f(c), _ => false };
        todo!()
    }
    async fn private(&self) {}
}
pub trait Handler { fn handle(&self); fn other(&self) { self.handle() } }
impl Handler for Config<'_> { fn handle(&self) {} }
mod tests { pub(crate) unsafe fn t() {} }
"""
C = """#include <stdio.h>
#include "my.h"
#define BODY(x) { \\
  x }
struct point { int x; };
static inline const char *name(struct point *p) {
  if (p) { return call("}", '{'); }
  return 0;
}
int table[] = { 1, 2 };
int main(void)
{
  for (;;) { run(1); }
}
namespace a { class B { int get() const { return 1; } }; int free_one(int x) noexcept { return x; } }
"""


def test_javascript():
    assert functions(JS, "JavaScript") == [
        ("load", 7, 10, "Cart"), ("size", 11, 11, "Cart"), ("#hidden", 12, 12, "Cart"), ("main", 15, 21, ""), ("inner", 16, 16, "main"), ("method", 17, 17, "main"), ("other", 17, 17, "main"), ("m", 22, 22, ""),
    ]
    rows = syntax.rows_of(JS, "JavaScript")
    assert [r[1] for r in rows if r[0] == "import"] == ["./a.js", "./b", "./side"]
    assert {r[1] for r in rows if r[5]} == {"Cart", "main", "x"} and [r[2:4] for r in rows if r[0] == "class"] == [(6, 14)]
    assert [(r[1], r[2], r[4], r[6]) for r in rows if r[0] == "call" and r[6]] == [("fetch", 8, "Cart.load", "}"), ("app.get", 18, "main", "/users/:id"), ("router.post", 19, "main", "/t"), ("client.get", 20, "main", "/not")]
    assert ("inner", 18) in [(r[1], r[2]) for r in rows if r[0] == "call"]
    assert functions(TS, "TypeScript") == [("gen", 1, 3, ""), ("run", 5, 6, "Q")]


def test_go():
    assert functions(GO, "Go") == [("Run", 21, 26, ""), ("Map", 28, 28, ""), ("small", 29, 29, "")]
    rows = syntax.rows_of(GO, "Go")
    assert [r[1] for r in rows if r[0] == "import"] == ["fmt", "x/y"]
    assert [(r[1], r[2], r[3]) for r in rows if r[0] == "class"] == [("Kind", 9, 9), ("A", 11, 13), ("B", 14, 14), ("Pair", 16, 19)]
    assert [(r[1], r[2], r[6]) for r in rows if r[0] == "call" and r[6]] == [("fmt.Println", 22, "}"), ("r.GET", 23, "/a/{id}")]
    assert {r[1] for r in rows if r[5]} == {"Kind", "A", "B", "Pair", "Run", "Map"}


def test_java():
    assert functions(JAVA, "Java") == [
        ("User", 11, 11, "User"), ("find", 12, 17, "User"), ("run", 15, 15, "User.find"), ("later", 18, 18, "User"), ("v", 19, 19, "User.Color"), ("Color", 19, 19, "User.Color"), ("norm", 20, 20, "User.Point"),
        ("area", 22, 22, "Shape"), ("n", 22, 22, "Shape"),
    ]
    rows = syntax.rows_of(JAVA, "Java")
    assert [r[1] for r in rows if r[0] == "import"] == ["java.util.", "java.lang.Math.max"]  # a star is not part of the name
    assert [(r[1], r[2], r[3]) for r in rows if r[0] == "class"] == [("User", 5, 21), ("Color", 19, 19), ("Point", 20, 20), ("Shape", 22, 22)]
    assert [r[7] for r in rows if r[1] == "find"] == [[('@GetMapping("/u/{id}")', 12), ("@Deprecated", 13), ('@Param("a")', 14)][:2]]


def test_rust():
    assert functions(RUST, "Rust") == [("new", 14, 19, "Config<'a>"), ("deep", 16, 16, "Config<'a>.new"), ("private", 20, 20, "Config<'a>"), ("other", 22, 22, "Handler"), ("handle", 23, 23, "Config<'_>"), ("t", 24, 24, "tests")]
    rows = syntax.rows_of(RUST, "Rust")
    assert [r[1] for r in rows if r[0] == "import"] == ["std::collections::{HashMap, hash_map::Entry}", "crate::a::b"]
    assert {r[1] for r in rows if r[5]} == {"Config", "Unit", "Kind", "Config<'a>", "Handler", "Config<'_>", "new", "t"}
    assert [r[7] for r in rows if r[1] == "Config"] == [[("#[derive(Debug, Queryable)]", 4)]]


def test_c():
    assert functions(C, "C++") == [("name", 6, 9, ""), ("main", 11, 14, ""), ("get", 15, 15, "a.B"), ("free_one", 15, 15, "a")]
    assert [r[1] for r in syntax.rows_of(C, "C") if r[0] == "import"] == ["stdio.h", "my.h"]


def test_nothing_closed_and_nothing_there():
    assert syntax.rows_of(None, "Go") == syntax.rows_of("", "Python") == syntax.rows_of("function f() {", None) == []
    assert functions('function f() {\n  g("}\n', "JavaScript") == [("f", 1, 2, "")]
    assert functions("} ) ] function f() {}", "JavaScript") == [("f", 1, 1, "")]
    assert functions("def f(:\n  x = (\ndef g(): pass\n", "Python")[0][0] == "f"
    deep = "function f() {" * 3000 + "}" * 3000
    assert len(functions(deep, "JavaScript")) == 3000


def test_routes_models_and_symbols(spark):
    py = '@app.get("/x")\n@cached\ndef no(): pass\n@cached\n@api.v1.post(\n    "/items/{id}", tags=["}"])\nasync def made(item):\n    pass\nclass Item(Base):\n    """a = 1"""\n    __tablename__ = "items"\n    id = Column(Integer)\n    name: Mapped[str]\n    def f(self):\n        x = 1\nclass Plain:\n    a = 1\n__all__ = ["made", \'Item\']\n'
    files = [("a.js", "JavaScript", JS), ("b.go", "Go", GO), ("c.java", "Java", JAVA), ("d.rs", "Rust", RUST), ("e.py", "Python", py), ("f.c", "C", C), ("g.txt", None, "class A {}"), ("h.py", "Python", None)]
    df = spark.createDataFrame(files, "path string, language string, text string")
    rows = syntax.syntax(df).cache()
    assert sorted(map(tuple, syntax.routes(rows).collect())) == [
        ("GET", "/a/{id}", "b.go", 23, None), ("GET", "/u/{id}", "c.java", 12, None), ("GET", "/users/:id", "a.js", 18, None), ("POST", "/items/{id}", "e.py", 4, "made"), ("POST", "/t", "a.js", 19, None),
    ]
    assert sorted(map(tuple, syntax.schemas(rows).collect())) == [
        ("A", "gorm", "b.go", 11, 1), ("Config", "diesel", "d.rs", 5, 2), ("Item", "sqlalchemy", "e.py", 9, 3), ("Pair", "gorm", "b.go", 16, 2), ("User", "jpa", "c.java", 5, 2),
    ]
    told = {r.path: r for r in syntax.file_symbols(rows).collect()}
    assert told["e.py"].exports == ["Item", "Plain", "made"] and told["a.js"].imports == ["./a.js", "./b", "./side"] and [f.name for f in told["f.c"].functions] == ["name", "main", "free_one", "get"]
    stats = syntax.graph_stats(df.where("language is not null"), rows).first()
    assert (stats.files, stats.languages, stats.routes, stats.models) == (7, 6, 5, 5)


def _parsers(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_routes_read_the_files_once(spark):
    files = spark.createDataFrame([("a.java", "Java", JAVA), ("a.go", "Go", GO)], "path string, language string, text string")
    assert _parsers(syntax.routes(syntax.syntax(files))) == 1


def test_stats_read_the_files_once(spark):
    files = spark.createDataFrame([("a.java", "Java", JAVA), ("a.go", "Go", GO)], "path string, language string, text string")
    assert _parsers(syntax.graph_stats(files, syntax.syntax(files))) == 1


def test_spaces_and_indented_directives():
    """A long white tail is passed at once, and a directive may stand behind blanks."""
    text = "  #include <a.h>\n\n \t# include \"b.h\"\nint f(void) { return 1; }" + " " * 400_000
    assert [(r[0], r[1], r[2]) for r in syntax.rows_of(text, "C")] == [("import", "a.h", 1), ("import", "b.h", 3), ("function", "f", 4)]


def test_files_are_spread_over_tasks(spark, tmp_path):
    """One file of one row group is read by one task, and told by many."""
    from lorekeep.plans import syntax_queries

    spark.range(500).selectExpr("id as doc_id", "'some words' as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = syntax.syntax(syntax_queries.sources(spark, str(tmp_path)))
    assert rows.rdd.getNumPartitions() > 1


#: Blocks of statements that are told whole, with others between them that are told by their tokens.
BLOCKS = {
    "JavaScript": "class A {\n%s\n  static async c(d) { x = 1 }\n  if(x) { y }\n  f(a) { g(a) }\n  h(a) { return import.meta }\n}\nconst o = { k() { return 1 }, l(a) {} }\n",
    "Python": "class A(B):\n    @dec(1)\n    def f(self):\n        pass\n%s\n    y: T = f.g(a, b)\n    z = 'q'\n    if a: b = c(d)\n    x = not(y)\n    def g(self):\n        return x(1)\n        k = l(m) \\\n  + 2\n        o (p)\nw = q(r)\n",
    "Go": "type T struct {\n%s\n  B, C int\n  K map[string]int\n  type x int\n  J,\n  L string \"a\"\n}\nfunc f() {\n a\n type Q int\n}\n",
    "Java": "class A {\n%s\n  @interfaceX(\"a\") int c;\n  import a.b;\n  @A(\"\"\"x;\"\"\") int y;\n  abstract void n();\n  int z = f(1);\n  @A(\"b\") void m(int a);\n  enum E { R, S; int x; }\n}\n",
    "Rust": "struct A<'a> {\n%s\n}\nuse a::{b, c::{d}};\nstruct B { a: &'static str, c: [u8; 3] }\nimpl X { type T = u8; fn g(&self) { let a = 'b'; c } }\n",
    "C": "struct S {\n%s\n int e[3];\n int (*g)(int);\n};\nint f(int a) { int x; x = a; return x; }\nvoid g(void) { for (a; b; c) { d; } }\n",
}
LINES = {"JavaScript": '  w_%d(x) { return "} {" + `t${x} {`; }', "Python": "    c_%d = Column(String)", "Go": '  F_%d string `gorm:"column:x{"`', "Java": '  @Column(name = "{") private String c_%d;', "Rust": "  pub f_%d: &'a str,", "C": "  int f_%d;"}


def blocks(n):
    return {g: text.replace("%s", "\n".join(LINES[g] % k for k in range(n))) for g, text in BLOCKS.items()}


@pytest.mark.parametrize("language", BLOCKS)
def test_plain_statements_are_told_whole(language, monkeypatch):
    """As many tokens are read for many fields, methods and calls as for one, and the rows are those of the tokens."""
    read, own = [], syntax.tokens
    monkeypatch.setattr(syntax, "tokens", lambda *a: (read.append(1) or t for t in own(*a)))
    counts = []
    for n in (1, 400):
        read.clear()
        rows = syntax.rows_of(blocks(n)[language], language)
        counts.append(len(read))
    assert counts[1] <= counts[0] + 5
    never = syntax.re.compile(r"(?!)")
    for name in ("_PLAIN_LINE", "_METHOD", "_METHODS"):
        monkeypatch.setattr(syntax, name, never)
    monkeypatch.setattr(syntax, "_PLAIN", dict.fromkeys(syntax._PLAIN, never))
    read.clear()
    assert syntax.rows_of(blocks(400)[language], language) == rows and len(read) > 400


def test_some_kinds(spark):
    """Rows of some kinds are those of all kinds; only what is asked for leaves the lexer."""
    texts = [*blocks(3).items(), ("JavaScript", JS), ("Java", JAVA), ("Rust", RUST), ("Go", GO), ("C", C)]
    files = spark.createDataFrame([(str(i), g, t) for i, (g, t) in enumerate(texts)], "path string, language string, text string")
    whole = syntax.syntax(files).cache()
    for kinds in (("call",), ("class",), ("import", "export", "class", "function")):
        want = whole.where(whole.kind.isin(*kinds))
        some = syntax.syntax(files, kinds)
        assert some.count() == want.count() > 0 and some.exceptAll(want).count() == 0
    told = lambda rows: sorted(syntax.file_symbols(rows).collect(), key=lambda r: int(r.path))
    assert told(syntax.syntax(files, kinds, False)) == told(whole) and len(told(whole)) == len(texts)


def test_models_need_no_calls(spark):
    """Without calls a class of Python has the same fields, and its model is the same."""
    files = spark.createDataFrame([(g, g, t.replace("    @dec(1)", "    __tablename__ = 't'\n    @dec(1)")) for g, t in blocks(5).items()], "path string, language string, text string")
    want = sorted(map(tuple, syntax.schemas(syntax.syntax(files)).collect()))
    assert sorted(map(tuple, syntax.schemas(syntax.syntax(files, ("class",))).collect())) == want and ("A", "sqlalchemy", "Python", 1, 9) in want
    assert {r[0] for r in syntax.rows_of(blocks(5)["Python"], "Python", ("class",))} == {"class"}


def test_functions_without_bodies(spark):
    """Functions are told alone, and no class brings its text along."""
    files = spark.createDataFrame([(g, g, t) for g, t in blocks(5).items()], "path string, language string, text string")
    rows = syntax.syntax(files, ("class", "function"), False)
    assert rows.where("body is not null").count() == 0 and rows.where("kind = 'class'").count() > 5
    assert sorted((r.path, r.name, r.line, r.end_line) for r in syntax.syntax(files, ("function",), False).collect()) == sorted((g, r[1], r[2], r[3]) for g, t in blocks(5).items() for r in syntax.rows_of(t, g) if r[0] == "function")
