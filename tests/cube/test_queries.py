"""Every named query of the engine against DuckDB on the smallest tables, and the entry points."""

import glob
import os

import pytest

import __spark_entry__
from terrasieve.plans import queries

DATA = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows_of(ours) == rows_of(theirs)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['terrasieve.llm'] = None; import __spark_entry__ as e; assert e.corpus is None and 'pipeline' not in e.queries() and 'end_to_end_cube' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(__spark_entry__.__file__))
