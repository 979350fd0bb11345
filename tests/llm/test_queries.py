"""Queries with SQL against it, and the pipeline against its stages' brute force, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from seqloom.llm import queries
from tests.llm.test_operators import brute_components

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    rows = lambda d: sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) and v % 1 else str(int(v) if isinstance(v, float) else v) for v in r) for r in d[sorted(want.columns)].astype(object).itertuples(index=False))
    assert set(want.columns) <= set(got.columns) and rows(got) == rows(want)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs.toPandas().set_index("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.toPandas()
        if name == "language":
            assert len(got) >= 0.95 * len(left) and all(any(c.isalpha() for c in t) for t in got.text)
        if name == "exact":
            low = left.text.str.translate({i: i + 32 for i in range(65, 91)})
            assert set(got.doc_id) == {g.index.max() for _, g in low.groupby(low)}
        if name == "near":
            order = left.sort_index()
            assert set(got.doc_id) == {order.index[k] for k in set(brute_components(order.text.tolist(), 5, 80))}
        if name == "mixed":
            assert set(got.doc_id) <= set(left.index) and got.doc_id.value_counts().max() <= 3
            before = got
        if name == "tokens":
            assert sorted(zip(got.doc_id, got.decoded, strict=True)) == sorted(zip(before.doc_id, before.text, strict=True))
        else:
            assert docs.columns == corpus_pipeline.COLUMNS
            left = got.drop_duplicates("doc_id").set_index("doc_id")
