"""Every registered query against its DuckDB oracle on the smallest driver
tables (the driver repeats this at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from revlens.plans.catalog import catalogue
from revlens.plans.oracle import oracle_statements
from conftest import SF_SMALL

TABLES = ["customer", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        return _norm(v.item())
    return round(v, 6) if isinstance(v, float) else v


def _bag(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records")]
    return cols, sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(oracle_statements()))
def test_query_matches_oracle(spark, con, name):
    got = catalogue()[name](spark, SF_SMALL).toPandas()
    want = con.execute(oracle_statements()[name]).df()
    assert _bag(got) == _bag(want)


def test_every_query_has_a_statement_and_is_registered():
    assert set(catalogue()) == set(oracle_statements())
    assert set(catalogue()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["userid", "paid_invoices", "revenue", "tickets", "cost", "profit"]
