"""Every collection query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog
from tessera.sources.tables import TABLES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    one = lambda v: "NULL" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return cols, sorted(tuple(one(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_same_as_sql(spark, data, con, name):
    assert rows(catalog.QUERIES[name](spark, data).toPandas()) == rows(con.sql(catalog.ORACLE[name]).df())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - catalog.WITHOUT_SQL == set(catalog.ORACLE)
