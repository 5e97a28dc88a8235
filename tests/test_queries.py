"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerlake.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def value(v):
    if not isinstance(v, (list, tuple, dict, bytes, bytearray)) and not hasattr(v, "__len__") and pd.isna(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, str)) else v


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(value(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_partial_mask_reads_whole_texts(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 6").selectExpr("doc_id", "length(text) AS n", "right(text, 4) AS tail")
    got = QUERIES["partial_mask_whole"](spark, sf).join(texts, "doc_id")
    assert got.count() == texts.count() > 0 and got.where("length(partial) <> n OR right(partial, 4) <> tail").count() == 0
