"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from seqloom.plans import calls, callsets, catalogue, files, more, ordered, records  # noqa: F401  the others add their queries to the catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda d: sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in d[cols].astype(object).itertuples(index=False))
    x, y = rows(a), rows(b)
    assert [[v.removesuffix(".000000") for v in r] for r in x] == [[v.removesuffix(".000000") for v in r] for r in y]


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.SQL[name]).df())
