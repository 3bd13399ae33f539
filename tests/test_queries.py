"""Registered queries against their SQL.  QUERIES=all runs every one of them."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["m0_band_breakout_forward_return", "b2_multi_timeframe_bars", "g3_first_quote_after_close", "e1_e5_market_structure", "c4_c6_bar_audit", "f4_triple_barrier",
          "j8_tick_first_touch", "k11_breakdown", "l7_overfitting_logits", "m4_race_summary", "n6_portfolio", "a12_report_fifo_pairs", "b9_streaming_bars"]
NAMES = list(entry.oracle_sql()) if os.environ.get("QUERIES") == "all" else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    zero = lambda v: 0.0 if isinstance(v, float) and v == 0 else v
    return sorted((tuple(str(zero(row[i])) for i in order) for row in rows))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert got == rows_of(relation.columns, relation.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
