"""Registered queries against DuckDB on the smallest data (LEADWAKE_ALL=1 runs every query)."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ("dq_01_session_calendar", "ret_06_estimation_returns", "ret_07_marked_dense", "uni_03_one_per_issuer", "sec_01_validation",
          "sec_04_coverage_gaps", "est_03_network", "est_09_adjusted_p", "est_12_shuffled_pairs", "cst_04_net_pnl", "dq_08_continuous_changes",
          "lin_01_lineages", "evt_07_funnel", "evt_20_operations", "txt_06_response_contract", "evl_12_evaluation", "src_01_fixed_width_scan")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("LEADWAKE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), cols)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
