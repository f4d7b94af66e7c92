"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_duckdb(spark, sf, duck, name):
    got, want = tidy(entry.queries()[name](spark, sf).toPandas()), tidy(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if want[c].dtype.kind == "f" or got[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-6, equal_nan=True), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", ["features_153", "session_summary"])
def test_queries_without_sql_run(spark, sf, name):
    assert entry.queries()[name](spark, f"{sf}/../sf0.01").count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
