"""A query of every family against its SQL twin on the smallest tables (tools/check.py runs all of them)."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry
from check import TABLES, norm

SF = "/root/testdata/sf0.001"
NAMES = ["AG6_resample_weekly", "AG8_covariance_matrix", "WN6_ema", "WN14_drawdown_episodes", "WN18_missing_day_gaps", "FLT10_cap_returns", "JN10_asof_buy_before_sell", "VQ9_validation_rules",
         "FN6_normal_cdf_quantile", "TK1_latest_rows_per_portfolio", "RK10_risk_report", "PT4_incremental_var", "SS7_portfolio_impact", "EG7_esg_report", "CR4_peg_reversion", "MK5_order_selection",
         "RG5_user_state_runs", "TS4_ljung_box", "DP2_kendall_copula_parameters", "MC3_contract_book", "BK4_average_cost", "ML6_stacking", "SRC2_daily_series", "ST15_user_sessions"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = norm(entry.queries()[name](spark, SF).toPandas())
    want = norm(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)
