"""Every catalogue query against its DuckDB text on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from loomwright.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"grf_01", "grf_03"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    df = df[columns].copy()
    for c in columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(5)
        df[c] = df[c].astype(str)
    return df.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    ours = registry.queries()[name](spark, FOLDER).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    pd.testing.assert_frame_equal(canonical(ours), canonical(theirs))


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.queries()
