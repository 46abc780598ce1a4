"""Every registered query of the analytics part against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tabulon.plans import catalog

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if not isinstance(v, (list, np.ndarray)) and pd.isna(v):
            return "-"
        return repr(round(float(v), 9)) if isinstance(v, (float, np.floating)) else str(v)

    out = df[sorted(df.columns)].map(one) if len(df) else df[sorted(df.columns)]
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    ours = plain(catalog.queries()[name](spark, DATA).toPandas())
    theirs = plain(duck.execute(catalog.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    if len(ours) or len(theirs):
        pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
