"""Every query with an SQL twin gives its rows on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from regesta.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    text = lambda v: repr(round(v, 5)) if isinstance(v, float) else repr(v)
    ours = sorted(tuple(text(r[c]) for c in names) for r in df.collect())
    got = con.sql(ORACLES[name])
    at = [got.columns.index(c) for c in names]
    assert ours == sorted(tuple(text(r[i]) for i in at) for r in got.fetchall())


def test_imports_without_a_session():
    """The entry module builds no column while it is imported."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
