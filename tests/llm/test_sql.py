"""The text operators' queries against their SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, data).toPandas(), con.sql(queries.ORACLE[name]).df()
    cols = sorted(a.columns)
    one = lambda v: "NULL" if pd.isna(v) else f"{v:.0f}" if isinstance(v, float) and v.is_integer() else str(v)
    rows = lambda df: sorted(tuple(one(v) for v in r) for r in df[cols].itertuples(index=False))
    assert cols == sorted(b.columns) and rows(a) == rows(b)
