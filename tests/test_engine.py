"""Formula language, scans, sources, streaming, risk and back-test."""

import datetime as dt
import time
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import panel_ops as ops
from factorloom.functions import scans
from factorloom.operators import backtest, risk, tables
from factorloom.plans.formula import evaluate, lookback, parse
from factorloom.sources import archives
from factorloom.streaming import bars

from util import bag


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(0)
    idx = pd.date_range("2024-01-01", periods=40).date
    w = pd.DataFrame(np.exp(rng.normal(0, 1, (40, 3))), idx, ["a", "b", "c"])
    w.iloc[5, 0] = w.iloc[20, 1] = np.nan
    w["d"] = np.nan
    w.iloc[:10, 2] = 1.0
    return w


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows = [(t, d, None if np.isnan(v) else float(v)) for t in wide for d, v in wide[t].items()]
    return spark.createDataFrame(rows, "ticker string, trade_date date, x double")


def back(df, like):
    out = df.toPandas().pivot(index="trade_date", columns="ticker", values="value").astype(float)
    return out.reindex(index=like.index, columns=like.columns)


def check(panel, wide, formula, want):
    got = back(evaluate(panel, {"value": formula}), wide)
    pd.testing.assert_frame_equal(got, want.astype(float), check_names=False, rtol=1e-9, atol=1e-12)


def test_parse_and_lookback():
    assert str(parse("a + b * -2 < 3 ? f(x, n=2) : 1")) == str(parse("where((a + (b * -2)) < 3, f(x, n=2), 1)"))
    assert lookback(parse("ts_mean(delta(close, 5), 10)")) == 14
    for bad in ("a +", "f(", "a b", "1 ? 2", "é"):
        with pytest.raises(ValueError):
            parse(bad)


def test_unknown_names_are_refused(panel):
    for f in ("y + 1", "nothing(x, 2)"):
        with pytest.raises(ValueError):
            evaluate(panel, {"value": f})


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("ts_mean(x, 5)", lambda w: w.rolling(5).mean()),
        ("ts_stddev(x, 5)", lambda w: w.rolling(5).std()),
        ("ts_rank(x, 5)", lambda w: w.rolling(5).rank(ascending=False)),
        ("ts_sum(x, 50)", lambda w: w.rolling(50).sum()),
        ("ts_max(x, 1)", lambda w: w),
        ("ffill(x)", lambda w: w.ffill()),
        ("delta(x, 3)", lambda w: w - w.shift(3)),
        ("ewma(x, 8)", lambda w: w.ewm(alpha=1 - np.exp(-np.log(2) / 2), adjust=False).mean()),
        ("ewma(x, 3)", lambda w: w),
        ("cs_rank(x)", lambda w: w.rank(axis=1, ascending=False, method="dense")),
        ("ts_mean(cs_rank(ts_mean(x, 3)), 2)", lambda w: w.rolling(3).mean().rank(axis=1, ascending=False, method="dense").rolling(2).mean()),
        ("standardize(x, cross_section=True)", lambda w: w.sub(w.mean(axis=1), axis=0).div(w.std(axis=1), axis=0)),
    ],
)
def test_formula_against_pandas(panel, wide, formula, want):
    check(panel, wide, formula, want(wide))


def weighted(wide, n, hl, fn):
    ws = np.array(ops.half_life_weights(n, hl))
    out = pd.DataFrame(np.nan, wide.index, wide.columns)
    for t in wide:
        v = wide[t].to_numpy()
        for i in range(n - 1, len(v)):
            out.loc[wide.index[i], t] = fn(v[i - n + 1 : i + 1], ws)
    return out


def test_weighted_forms(panel, wide):
    check(panel, wide, "ts_mean(x, 4, weight=True, half_life=2.0)", weighted(wide, 4, 2.0, lambda v, w: np.average(v, weights=w)))
    check(panel.where("ticker != 'c'"), wide.assign(c=np.nan), "ts_stddev(x, 4, weight=True, half_life=2.0)", weighted(wide.assign(c=np.nan), 4, 2.0, lambda v, w: np.sqrt(np.average((v - np.average(v, weights=w)) ** 2, weights=w))))


def test_rolling_clip_and_neutral_rank(spark, panel, wide):
    def clip(v):
        m = np.median(v)
        d = 3 * 1.4826 * np.median(np.abs(v - m))
        return np.clip(v[-1], m - d, m + d)

    want = pd.DataFrame({t: [np.nan if np.isnan(wide[t].iloc[i]) else clip(wide[t].iloc[max(0, i - 9) : i + 1].dropna().to_numpy()) for i in range(40)] for t in wide}, wide.index)
    check(panel, wide, "clip_mad(x, 3.0, cross_section=False, window=10)", want)
    from statistics import NormalDist

    p = spark.createDataFrame([(x,) for x in (1e-6, 0.01, 0.3, 0.5, 0.9, 1 - 1e-6)], "p double")
    for r in p.select("p", ops.normal_quantile(F.col("p")).alias("q")).collect():
        assert abs(r["q"] - NormalDist().inv_cdf(r["p"])) < 1e-7


def test_rolling_clip_sorts_a_window_once(spark):
    # 600 rows of 120 values: about a second when warm; over 80 s when each value's distance sorted the window again
    v = np.exp(np.random.default_rng(1).normal(0, 1, 600))
    days = pd.date_range("2023-01-01", periods=600).date
    rows = spark.createDataFrame([("a", d, float(x)) for d, x in zip(days, v)], "ticker string, trade_date date, x double")
    began = time.monotonic()
    got = evaluate(rows, {"value": "clip_mad(x, 3.0, cross_section=False, window=120)"}).toPandas().sort_values("trade_date")["value"]
    took = time.monotonic() - began
    want = []
    for i in range(600):
        w = v[max(0, i - 119) : i + 1]
        m = np.median(w)
        d = 1.4826 * 3 * np.median(np.abs(w - m))
        want.append(np.clip(v[i], m - d, m + d))
    np.testing.assert_allclose(got, want, rtol=1e-12)
    assert took < 30


def test_scans():
    x = pd.DataFrame({"x": [1.0, 2, np.nan, 4, 3, 5, 6, 2, 9, 8]})
    e = scans.ema(x, "x", "o", 3)["o"]
    assert np.isnan(e[:3]).all() and e[3] == 7 / 3 and e[4] == (7 / 3 + 3) / 2
    assert (scans.rsi(pd.DataFrame({"x": np.arange(20.0)}), "x", "o", 5)["o"].dropna() == 100).all()
    assert scans.trend_label(pd.DataFrame({"x": [1.0, 2, 1, 3]}), "x", "o")["o"].tolist() == [-1, 1, -1, 0]
    assert scans.stop_exit(pd.DataFrame({"x": [10.0, 12, 10, 11, 9]}), "x", "o")["o"].tolist() == [0, 0, 1, 0, 1]
    k = scans.kama(pd.DataFrame({"x": np.arange(30.0)}), "x", "o", 5)["o"]
    assert k.isna().sum() == 4 and k.iloc[-1] < 29


def test_archives(spark, tmp_path):
    (tmp_path / "2023年").mkdir()
    inner = tmp_path / "in.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("SH.123457.csv", "a,b\n1,2\n")
    with zipfile.ZipFile(tmp_path / "2023年" / "06.zip", "w") as z:
        z.writestr("BJ.000001.csv", "日期\n".encode("gb18030"))
        z.write(inner, "07.zip")
    inner.unlink()
    (tmp_path / "SZ.000002.csv").write_text("x\n")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    got = {(r["exchange"], r["source_type"], r["nested_archive"], r["raw_text"], r["year"]) for r in archives.discover_csv(spark, str(tmp_path)).where("error is null").collect()}
    assert got == {("SH", "zip", "07.zip", "a,b\n1,2\n", "2023"), ("BJ", "zip", None, "日期\n", "2023"), ("SZ", "directory", None, "x\n", None)}


def test_streaming_bars_resume(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "id long, k string, ts timestamp, v double"
    spark.createDataFrame([(i, "a", t0 + dt.timedelta(hours=i), float(i)) for i in range(100)], schema).coalesce(1).write.parquet(str(tmp_path / "in/x1"))
    src = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    bars.run_to_table(bars.streaming_bars(src(), "k", "ts", "id", "v"), str(tmp_path / "out"))
    first = spark.read.parquet(str(tmp_path / "out/table")).collect()
    assert len(first) == 3 and {(r["open"], r["close"], r["volume"]) for r in first} >= {(0.0, 23.0, 24)}
    spark.createDataFrame([(i, "a", t0 + dt.timedelta(hours=i), float(i)) for i in range(100, 200)], schema).coalesce(1).write.parquet(str(tmp_path / "in/x2"))
    bars.run_to_table(bars.streaming_bars(src(), "k", "ts", "id", "v"), str(tmp_path / "out"))
    assert sum(r["volume"] for r in spark.read.parquet(str(tmp_path / "out/table")).collect()) == 24 * 7


def test_risk():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.01, (200, 5)) * np.array([1, 2, 3, 4, 5])
    s = risk.shrink(x, 0.0)
    np.testing.assert_allclose(s, np.cov(x.T, ddof=0))
    assert np.linalg.cond(risk.shrink(x, "lw")) <= np.linalg.cond(s) and np.linalg.cond(risk.shrink(x, "oas")) <= np.linalg.cond(s)
    w = risk.optimise(x.mean(0), np.diag([1.0, 2, 4, 4, 4]) * 1e-4)
    np.testing.assert_allclose(w, np.array([1, 0.5, 0.25, 0.25, 0.25]) / 2.25, atol=1e-4)


def test_gram(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 3))
    df = spark.createDataFrame([([float(v) for v in r],) for r in m] + [(None,)], "v array<double>").repartition(3)
    n, s, g = risk.gram(df, "v", 3)
    assert n == 50
    np.testing.assert_allclose(g, m.T @ m)
    np.testing.assert_allclose(s, m.sum(0))


def test_simulation_keeps_the_books(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(6)]
    prices = spark.createDataFrame([(d, t, p) for i, d in enumerate(days) for t, p in (("a", 10.0 + i), ("b", 20.0))], "d date, t string, p double")
    held = spark.createDataFrame([("r", days[1], "a", 1.0), ("r", days[4], "b", 1.0)], "run string, d date, t string, weight double")
    out = backtest.simulate(prices, held, "run", "d", "t", "p", cash=100_000, rate=0.0, floor=0.0, slippage=0.0, tax=0.0).orderBy("d").toPandas()
    assert out["account"].tolist() == [100_000, 100_000, 109_000, 118_000, 127_000, 127_000]
    assert out["cash"].iloc[1] == 1000 and out["cash"].iloc[4] == 1000 + 9000 * 14 - 6300 * 20
    assert backtest.affordable_shares(1000, 9.0, 0.001, 5.0) == 100


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    new = spark.createDataFrame([(2, None, 5.0), (3, 3.0, None)], "k int, x double, y double")
    assert bag(tables.upsert(old, new, ["k"]).select("k", "x", "y").collect()) == bag([(1, 1.0, None), (2, 2.0, 5.0), (3, 3.0, None)])
    assert bag(tables.insert_ignore(old, new.select("k", "x"), ["k"]).collect()) == bag([(1, 1.0), (2, 2.0), (3, 3.0)])


def test_business_days(spark):
    a, b = dt.date(2024, 1, 5), dt.date(2024, 1, 9)
    df = spark.createDataFrame([(a, b), (b, a), (a, a)], "a date, b date")
    assert [r[0] for r in df.select(tables.business_days(F.col("a"), F.col("b"))).collect()] == [2, -2, 0]


def test_later_scans_against_plain_loops():
    rng = np.random.default_rng(2)
    x = 10 + np.cumsum(rng.normal(0, 0.3, 120))
    pdf = pd.DataFrame({"x": x})
    got = scans.rsi_from_steps(pdf, "x", "o", 5)["o"].to_numpy()
    step = np.diff(x)
    up, down = np.maximum(step[:4], 0).mean(), np.maximum(-step[:4], 0).mean()
    for i in range(5, 120):
        up, down = (4 * up + max(step[i - 1], 0)) / 5, (4 * down + max(-step[i - 1], 0)) / 5
        assert got[i] == pytest.approx(100 * up / (up + down))
    assert np.isnan(got[:5]).all()
    walk, trend = (scans.hurst(pd.DataFrame({"x": v}), "x", "o", 60)["o"].mean() for v in (x, np.arange(120.0) ** 2))
    assert walk < trend
    pos = scans.trend_position(pd.DataFrame({"x": [1, 2, 3, 2.5, 2, 1, 2, 4.0, 3]}), "x", "o", mode="scaled")["o"].tolist()
    assert pos[2] == 1.0 and pos[5] == 0.0 and pos[3] == pytest.approx(0.75) and np.isnan(pos[8])
    z = scans.zero_lag_indicator(pdf, "x", "o", 12)["o"].to_numpy()
    e = scans.ema(pdf, "x", "o", 12)["o"].to_numpy()
    assert np.nanmean(np.abs(z - x)[20:]) < np.nanmean(np.abs(e - x)[20:])
