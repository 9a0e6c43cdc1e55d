"""Return, drawdown, trade and adjustment operators on small tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import scans
from factorloom.operators import analytics as an
from factorloom.operators import performance as pf
from factorloom.operators import pipeline

from util import bag

DAY = dt.date(2024, 1, 1)


def frame(spark, prices, ticker="a"):
    return spark.createDataFrame([(ticker, DAY + dt.timedelta(i), None if p is None else float(p)) for i, p in enumerate(prices)], "ticker string, trade_date date, close double")


def test_drawdown_records(spark):
    got = pf.drawdown_records(frame(spark, [10, 8, 9, 10, 12, None, 6, 6, 7])).collect()
    d = lambda i: DAY + dt.timedelta(i)
    assert bag([(r["peak_day"], r["valley_day"], r["recovery_day"], r["depth"], r["rows"]) for r in got]) == bag([(d(0), d(1), d(3), -0.2, 2), (d(4), d(6), None, -0.5, 3)])
    assert pf.drawdown_records(frame(spark, [1]).limit(0)).count() == 0


def test_trades_alternate(spark):
    df = frame(spark, [1, 2, None, 4, 5, 6])
    i = F.datediff("trade_date", F.lit(DAY))
    got = pf.trades(df, i.isin(0, 1, 2, 5), i.isin(3, 4)).orderBy("entry_day").collect()
    assert [(r["entry_price"], r["exit_price"], r["rows"]) for r in got] == [(1.0, 4.0, 2), (6.0, None, None)]
    s = pf.trade_statistics(pf.trades(df, i.isin(0), i.isin(3))).collect()[0]
    assert (s["n"], s["won"], s["mean"]) == (1, 1, 3.0)


def test_adjusted_close(spark):
    df = spark.createDataFrame([("a", DAY + dt.timedelta(i), c, p) for i, (c, p) in enumerate([(10.0, 9.9), (20.0, 10.0), (11.0, 10.0), (None, 11.0), (12.0, 11.0)])], "ticker string, trade_date date, close double, pre_close double")
    got = [r["adj_close"] for r in pf.adjusted_close(df, "close", "pre_close").orderBy("trade_date").collect()]
    np.testing.assert_allclose([x for x in got if x is not None], [5.0, 10.0, 11.0, 12.0])


def test_return_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0.001, 0.02, 300)
    df = spark.createDataFrame([("a", DAY + dt.timedelta(i), float(v)) for i, v in enumerate(r)] + [("b", DAY, 0.1)], "ticker string, trade_date date, r double")
    got = {x["ticker"]: x for x in pf.return_metrics(df).collect()}
    assert set(got) == {"a"}
    nav = np.cumprod(1 + r)
    np.testing.assert_allclose(got["a"]["max_drawdown"], (nav / np.maximum(np.maximum.accumulate(nav), 1) - 1).min())
    np.testing.assert_allclose(got["a"]["sharpe"], r.mean() / r.std(ddof=1) * np.sqrt(252))
    np.testing.assert_allclose(got["a"]["value_at_risk"], np.quantile(r, 0.05))


def test_rolling_regression_against_lstsq(spark):
    rng = np.random.default_rng(1)
    n = 30
    x1, x2 = rng.normal(size=(2, n))
    y = 1 + 2 * x1 - x2 + rng.normal(0, 0.1, n)
    x1[4] = np.nan
    pdf = pd.DataFrame({"ticker": "a", "trade_date": [DAY + dt.timedelta(i) for i in range(n)], "y": y, "x1": x1, "x2": x2})
    df = spark.createDataFrame(pdf).withColumn("x1", F.nanvl("x1", F.lit(None)))
    got = [r["c"] for r in pf.rolling_regression(df, "y", ["x1", "x2"], 8, "c").orderBy("trade_date").collect()]
    assert got[:7] == [None] * 7
    for i in range(7, n):
        k = [j for j in range(i - 7, i + 1) if not np.isnan(x1[j])]
        np.testing.assert_allclose(got[i], np.linalg.lstsq(np.column_stack([np.ones(len(k)), x1[k], x2[k]]), y[k], rcond=None)[0], rtol=1e-6)


def test_rolling_apply_counts_only_known_values(spark):
    got = pf.rolling_apply(frame(spark, [1, None, 3, 4]), "close", 3, np.sum, "s", min_periods=2).orderBy("trade_date").collect()
    assert [r["s"] for r in got] == [None, None, 4.0, 7.0]


def test_scans_on_trends():
    n = 60
    up = pd.DataFrame({"h": np.arange(n) + 1.0, "l": np.arange(n) - 0.0, "c": np.arange(n) + 0.5, "o": np.arange(n) + 0.4})
    assert (scans.adx(up, "h", "l", "c", "o1", 5)["o1"].dropna() == 100).all()
    sar = scans.parabolic_sar(up, "h", "l", "o1")["o1"]
    assert (sar <= up["l"]).all()
    assert (scans.supertrend(up, "h", "l", "c", "o1", 5)["o1"].dropna() < up["c"][4:]).all()
    ha = scans.heikin_open(up, "o", "h", "l", "c", "o1")["o1"]
    assert ha[0] == 0.45 and ha[1] == (0.45 + (0.4 + 1 + 0 + 0.5) / 4) / 2
    assert scans.renko_level(pd.DataFrame({"x": [10.0, 10.5, 12.2, 11.5, 9.9]}), "x", "o1")["o1"].tolist() == [10, 10, 12, 12, 10]
    assert scans.triple_barrier(pd.DataFrame({"x": [100.0, 104, 106, 90, 100, 100]}), "x", "o1", 2)["o1"].tolist()[:4] == [1, -1, -1, 1]
    assert (scans.tsi(up, "c", "o1", 5, 3)["o1"].dropna() == 100).all()


def test_pipeline_terms(spark):
    g = pipeline.Grid("d", "t")
    df = spark.createDataFrame([(1, "a", 1.0, "x"), (1, "b", 1.0, "x"), (1, "c", 3.0, "y"), (1, "e", None, None), (2, "a", 5.0, "x")], "d int, t string, v double, k string")
    v, k = g.factor("v"), g.classifier("k")
    out = df.select("d", "t", v.rank("average").column.alias("avg"), v.top(1).column.alias("top"), v.quantiles(2).column.alias("q"), k.ne("x").column.alias("ne"), ((v > 1) & k.eq("y")).if_else(v * 2, v).column.alias("w"), v.zscore().column.alias("z"), k.relabel({"x": "z"}).column.alias("r")).collect()
    got = {(r["d"], r["t"]): r for r in out}
    assert [got[1, t]["avg"] for t in "abce"] == [1.5, 1.5, 3.0, None]
    assert [got[1, t]["top"] for t in "abce"] == [False, False, True, False]
    assert [got[1, t]["q"] for t in "abce"] == [0, 0, 1, -1]
    assert [got[1, t]["ne"] for t in "abce"] == [False, False, True, False]
    assert got[1, "c"]["w"] == 6.0 and got[2, "a"]["z"] is None and got[1, "a"]["r"] == "z" and got[1, "c"]["r"] is None


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_information_coefficient_of_constants_is_null(spark, method):
    df = spark.createDataFrame([(DAY, "a", 1.0, 2.0), (DAY, "b", 1.0, 3.0), (DAY, "c", None, 4.0)], "trade_date date, ticker string, f double, r1 double")
    assert an.information_coefficient(df, "f", ["r1"], method=method).collect()[0]["ic_r1"] is None
