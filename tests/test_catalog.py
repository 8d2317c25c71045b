"""Every registered query with SQL equals it on the smallest tables; import works without a session."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from policyloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(frame):
    frame = frame[sorted(frame.columns)]

    def one(v):
        if pd.isna(v):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return int(v) if hasattr(v, "__int__") and not isinstance(v, str) else str(v)

    rows = [tuple(float(x) if isinstance(x := one(v), int) else x for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
