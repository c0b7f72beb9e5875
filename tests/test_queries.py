"""Every core query over the whole tables of the smallest scale against its SQL on DuckDB."""

import importlib
import pkgutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import seqspark.queries
from verify import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"seqspark.queries.{m.name}") for m in pkgutil.iter_modules(seqspark.queries.__path__)]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows(rel.columns, rel.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_names_need_no_session():
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
