"""Registered queries against their oracle SQL on the smallest tables."""

import os
from glob import glob

import duckdb
import pandas as pd
import pytest

from scrollmill.plans import registry

SF = "/root/testdata/sf0.001"
#: Left to the larger comparison: each takes several imports into a store.
LONG = {"merge_partial", "import_all", "backup_counts", "import_grok", "import_cursor"}


def norm(df):
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        return format(x, ".6g") if isinstance(x, float) else str(x)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - LONG))
def test_query_matches_oracle(spark, oracle, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = oracle.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
