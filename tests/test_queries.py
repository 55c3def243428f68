"""Registered queries next to their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# one or two of each family; tools/check_queries.py runs all of them
PICKED = ["rank_ic_by_date", "robust_z", "forward_return_truncate", "asof_known_fact", "membership_interval", "quality_screen", "fiscal_year_pivot",
          "price_read", "attrition", "split_audit", "release_figures", "stream_alert_once", "call_log_rows"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall()) and got


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150
