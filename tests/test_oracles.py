"""Queries against their SQL equivalents. FULL_ORACLES=1 runs all of them, otherwise some of each family."""

import os
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

from util import frame_bag

DATA = "/root/testdata/sf0.001"
SOME = [
    "p1_found", "p1_totals", "p1_corrected", "p2_found", "p3_found", "p6_found", "fx_where", "fx_ts_rank", "fx_ts_argmax", "fx_cs_rank", "fx_clip_mad_cs", "fx_winsorize_cs", "fx_nested_factor", "fx_cs_linreg_resid",
    "ind_atr", "ind_aroon_up", "sig_crossed_above", "lab_future_max", "an_ic_spearman", "an_quantile_returns", "an_event_study", "an_metrics", "t_asof_backward", "t_asof_forward", "t_resample_days", "t_previous_sessions", "t_runs", "t_upsert", "pl_ranks", "pl_top_bottom", "rk_covariance", "bt_holdings",
    "p2_filled", "p5_ranges", "pt_values", "pt_signal_orders", "sg_ranks", "sp_walk_forward", "ev_equity", "pp_along", "es_next_quarters", "ts_positions", "br_fill_session", "st_store", "rc_reduce", "az_account", "lib_linear_trend", "ind_adx", "stream_bars",
]
pytestmark = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in pathlib.Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("FULL_ORACLES") else SOME)
def test_query_equals_sql(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert frame_bag(ours) == frame_bag(theirs)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["factor_name", "trade_day", "rank_no", "ticker"]
