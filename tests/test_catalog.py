"""Every registered query against its DuckDB oracle on the smallest test tables,
and the driver contract of ``__spark_entry__``."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = entry_mod.queries()
ORACLES = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _canon(v):
    if v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v  # longs with nulls come as floats


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


def test_contract():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 100 and len(ORACLES) >= 97


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["draft_id", "target_id", "offset", "freq"]
    assert df.count() == 1024


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    s_cols, s_rows = _rows(QUERIES[name](spark, SF_SMALL).toPandas())
    o_cols, o_rows = _rows(con.execute(ORACLES[name]).df())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0
