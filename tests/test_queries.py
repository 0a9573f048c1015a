"""Registered queries against their checking SQL, on the smallest tables.

A few by default; set CHECK_ALL=1 for every query (``check.py`` does the same at any scale).
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
SOME = {"a3_admission", "b6_signals", "c10_invoices", "d19_status", "e2_overlapping_chunks", "g1_payload_checks", "h3_exact_top_k", "i3_context", "j2_stage_audit"}
ALL = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_checking_sql_has_a_query():
    assert set(ALL) <= set(entry.queries())


@pytest.mark.parametrize("name", ALL if os.environ.get("CHECK_ALL") else sorted(SOME))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF_DIR)
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(list(rel.columns), rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
