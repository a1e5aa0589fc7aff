"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, rows

ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}


@pytest.fixture(scope="module")
def db(sf):
    out = duckdb.connect()
    for t in TABLES.split():
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, db, name):
    mine, other = entry.queries()[name](spark, sf).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
