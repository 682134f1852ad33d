import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def same():
    """same(df, sql, **views): both give the same rows; views are lists of (columns, rows)."""

    def check(df, sql, views=None):
        con = duckdb.connect()
        if views is None:
            for f in os.listdir(SF):
                con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
        else:
            for name, pdf in views.items():
                con.register(name, pdf)
        names = sorted(df.columns)
        text = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
        ours = sorted(tuple(text(r[c]) for c in names) for r in df.collect())
        got = con.sql(sql)
        at = [got.columns.index(c) for c in names]
        theirs = sorted(tuple(text(r[i]) for i in at) for r in got.fetchall())
        assert ours == theirs

    return check


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Doc_ID string"


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows, other columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    twin = " ".join(f"t{i % 97}x{i % 13}" for i in range(120))
    rows = [(1, "a b c d", "en", "s1"), (2, None, "en", None), (3, "", None, "s1"), (4, "a b c d", "en", "s2"), (4, "a b c d", "en", "s2"), (None, "a b c d", None, None), (None, None, None, None), (7, long, "en", "s3"), (8, " \n\t ", "en", "s1"), (9, twin, "en", "s2"), (10, twin + " end", "en", "s2"), (11, "x" * 50_000, "en", "s3"), (12, "é▁ß \U0001f600\x00", "fr", "s1")]
    return spark.createDataFrame([(a, b, c, d, 0, "other", "z") for a, b, c, d in rows], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
