"""How much history formulas need, how it reaches the scan, and how scans take their arguments."""

import datetime as dt

import numpy as np
import pytest

from factorloom.functions.library import LIBRARY
from factorloom.plans.formula import UNBOUNDED, evaluate, lookback, parse, safe_lookback

from util import bag

NEEDS = {
    "close": 0, "momentum(close, 20)": 20, "wma(close, 10)": 9, "roc(close, 12)": 12, "hma(close, 16)": 15 + 3, "rsi(close, 14)": UNBOUNDED, "ts_mean(delay(close, 3), 5)": 7, "true_range(high, low, close)": 1, "aroon_up(high, 25)": 25,
    "cs_rank(ts_sum(close, 5))": 4, "future_max(close, 5)": 0, "normalize(close, window=20)": 19, "normalize(close, expanding=True)": UNBOUNDED, "clip_mad(close, 3.0, cross_section=True)": 0, "macd(close, 5, 10)": UNBOUNDED, "ts_corr(close, delay(open, 2), n=10)": 11,
    "cumulative(close)": UNBOUNDED, "ts_mean(close, 5, weight=True, half_life=2.0)": 4, "triple_barrier(close, 10)": 0,
}


@pytest.mark.parametrize("formula", NEEDS)
def test_lookback(formula):
    assert lookback(parse(formula)) == NEEDS[formula]
    assert safe_lookback(formula) == min(NEEDS[formula], 252)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    start = dt.date(2024, 1, 1)
    rows = [(f"t{i}", start + dt.timedelta(d), *map(float, rng.uniform(5, 15, 4)), float(rng.integers(1, 99)), 1.0) for i in range(3) for d in range(200)]
    path = str(tmp_path_factory.mktemp("panel") / "p.parquet")
    spark.createDataFrame(rows, "ticker string, trade_date date, open double, high double, low double, close double, volume double, extra double").write.parquet(path)
    return spark.read.parquet(path)


PUT = {"X": "close", "Y": "open", "O": "open", "H": "high", "L": "low", "C": "close", "V": "volume", "A": "volume"}


def test_trimmed_history_gives_the_same_rows(spark, table):
    """Every library indicator of bounded history, cut to what it needs, equals the whole one."""
    calls = {n: f"{n}({', '.join(PUT[p] for p, d in ps if d is None)})" for n, (ps, _) in LIBRARY.items()}
    calls = {n: c for n, c in calls.items() if lookback(parse(c)) < 150}
    assert len(calls) > 60
    since = "2024-07-10"
    for part in (list(calls)[i::4] for i in range(4)):
        some = {n: calls[n] for n in part}
        whole = evaluate(table, some).where(f"trade_date >= '{since}'")
        assert bag(evaluate(table, some, since=since).collect()) == bag(whole.collect())


def test_dates_and_columns_reach_the_scan(spark, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    out = evaluate(table, {"m": "ts_mean(close, 5)"}, since="2024-06-01", until="2024-06-30")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(trade_date,2024-05-28)" in plan and "LessThanOrEqual(trade_date,2024-06-30)" in plan
    assert "extra" not in plan and "open" not in plan
    assert out.count() == 3 * 30
    assert evaluate(table, {"m": "ts_mean(close, 5)"}, last_only=True).count() == 3


def test_scans_of_a_level_share_a_grouped_map(spark, table):
    out = evaluate(table, {"a": "ema(close, 5)", "b": "rsi(close, 7)", "c": "macd(close, 5, 10)", "d": "kama(close, 5, 2, 30)", "e": "ema(ema(close, 5), 3)"})
    assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") <= 2 * 2
    want = evaluate(table, {"c": "macd(close, window=5, slow=10)", "d": "kama(close, window=5, fast=2, slow=30)"})
    assert bag(out.select("ticker", "trade_date", "c", "d").collect()) == bag(want.collect())


@pytest.mark.parametrize("bad", ["macd(close, 5, 10, 15)", "ema(close, n=3)", "ema(close)", "adx(high, low)", "ema(close, open)"])
def test_scan_arguments_are_bound_by_signature(spark, table, bad):
    with pytest.raises(ValueError):
        evaluate(table, {"v": bad})
