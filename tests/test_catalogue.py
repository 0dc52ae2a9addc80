"""Every query with SQL gives DuckDB's rows on the small tables."""

import duckdb
import pandas as pd
import pytest

from inkveil.plans.catalogue import QUERIES, SQL, TABLES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def rows(df: pd.DataFrame) -> list[str]:
        return sorted(str(tuple(None if pd.isna(v) else (round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" or type(v).__name__ == "Decimal" else str(pd.Timestamp(v)) if type(v).__name__ in ("Timestamp", "date") else v) for v in r)) for r in df[cols].itertuples(index=False))

    assert rows(got) == rows(want)
