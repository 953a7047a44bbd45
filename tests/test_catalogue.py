"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from rasterloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        own.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return own


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got, expected = catalogue.QUERIES[name](spark, SMALL).toPandas(), duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got) == _rows(expected)


def _rows(df):
    """Sorted rows of texts, numbers to nine places, missing ones alike."""

    def text(v):
        if pd.isna(v):
            return ""
        return str(v) if isinstance(v, str) or not hasattr(v, "__float__") else str(round(float(v), 9) + 0.0)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
