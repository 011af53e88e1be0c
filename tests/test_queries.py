"""Registered queries next to their SQL on the smallest tables; TIDEMARK_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as contract
from tools.compare import difference, oracle_connection

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["returns_simple_log", "asof_quotes", "news_window_features", "rank_ic", "hysteresis_selection", "annualised_stats",
          "scaled_bar_features", "signal_diagnostics", "holdout_gates", "stationary_bootstrap", "trend_backtest_daily", "self_financing_value", "risk_overlay", "table_manifest", "total_loss_book", "hysteresis_overlapping_zones",
          "live_bar_features", "live_sizing", "live_synchronised_book", "live_recalibrated_k", "live_news_features",
          "live_matured_batches", "resumed_units"]
NAMES = sorted(contract.catalogue()) if os.environ.get("TIDEMARK_ALL") else SAMPLE


def test_contract_shape():
    run, sql = contract.queries(), contract.oracle_sql()
    own = set(contract.catalogue())
    assert set(sql) <= set(run) and own <= set(run) and len(own - set(sql)) <= 4


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        assert difference(got, oracle_connection(FOLDER).execute(sql).df()) is None


def test_entry(spark):
    out = contract.entry(spark)
    assert out.count() > 0 and "cagr" in out.columns
