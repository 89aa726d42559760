"""Registered queries against DuckDB on the smallest tables, and the driver's contract."""

import math
import subprocess
import sys

import duckdb
import pytest

from tideline.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_equals_sql(spark, sf, db, name):
    df = own.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    found = db.execute(own.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert ours == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_every_sql_has_a_query():
    assert own.oracle_sql().keys() <= own.queries().keys()


def test_nothing_else_imports_the_corpus_operators():
    code = "import sys; sys.modules['tideline.llm'] = None\nimport tideline.plans.queries, tideline.streaming.online, tideline.sources.series"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
