"""Every query that has SQL gives the SQL's rows on the small driver tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations part orders nation region".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


def rows(frame, columns):
    def shown(v):
        if pd.isna(v):
            return ""
        return str(v) if isinstance(v, (bool, np.bool_)) or not isinstance(v, (int, float, np.number)) else format(float(v), ".6g")

    return sorted(tuple(map(shown, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_is_its_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
