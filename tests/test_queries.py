"""Every registered query against its SQL counterpart on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "suggested_owner", "owner_reason"]


def test_entry_without_the_corpus_package(tmp_path):
    """The other queries stand without the corpus operators and their tests."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = (
        "import __spark_entry__ as e; names = set(e.queries())\n"
        "assert 'pipeline' not in names and not [n for n in names if n.startswith('op')]\n"
        "assert set(e.oracle_sql()) <= names and len(names) > 100"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120)


def test_template_words_are_cut_once(spark, sf):
    """No filter repeats the extraction below the explode."""
    plan = entry.queries()["template_best"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Filter")]
    assert not [x for x in filters if "regexp_extract_all" in x]
