"""Every query of the library that has SQL against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from barlens import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, float):
            return f"{v:.5f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(v) < 1e-5 else f"{v:.5f}".rstrip("0").rstrip(".")
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    own = catalog.QUERIES[name](spark, DIR).toPandas()
    said = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(own.columns) == sorted(said.columns)
    assert rows(own) == rows(said)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0
