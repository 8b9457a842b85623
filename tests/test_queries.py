"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from lorekeep.plans import catalogue

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(names), sorted([tuple(value(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert df.columns
        return
    got = oracle.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert canonical(df.columns, rows) == canonical(names, got.fetchall())


def test_entry_works_without_the_training_data_subpackage(spark):
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['lorekeep.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not [k for k in q if k.startswith('op')], list(q); e.oracle_sql()"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parent.parent))
    assert done.returncode == 0, done.stderr


def test_markdown_letters_are_told_once(spark, sf_dir):
    from lorekeep.plans import repositories

    plan = repositories.markdown_text(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z ]+") == 1


def test_markdown_of_whole_texts(spark, tmp_path):
    """All letters of all documents come back, short, long, empty and null ones."""
    import re

    from lorekeep.plans import repositories

    texts = [None, "", "12 !", "a", "Short text.", "x" * 59 + " " + "y" * 70, "Long *text* of [words](u), #1\n" * 3000, "Ünïcode 中文 and more " * 20, "  spaced \t out  "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.plain for r in repositories.markdown_text(spark, str(tmp_path)).collect()}
    letters = [re.sub(" +", " ", re.sub("[^A-Za-z ]+", "", t or "")).strip(" ") for t in texts]
    assert got == {i: f"Title {w} end" if w else "Title end" for i, w in enumerate(letters)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(con.execute(repositories.ORACLE_SQL["markdown_text"]).fetchall())
