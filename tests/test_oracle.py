"""Every registered query of the engine's own operators against its SQL, over the smallest tables."""

import numbers

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if pd.isna(x) else round(float(x), 4) if isinstance(x, numbers.Real) and not isinstance(x, bool) else str(x) for x in df[c]]
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, db, name):
    got = catalogue.queries()[name](spark, DIR).toPandas()
    want = db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
