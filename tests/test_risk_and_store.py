"""Covariance estimators, weights, the factor store, conditions, bars and tear sheets."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import bars, risk, store, tearsheet

from util import bag

RNG = np.random.default_rng(7)
MARKET = RNG.normal(0, 0.01, 400)
X = np.outer(MARKET, RNG.uniform(0.5, 1.5, 6)) + RNG.normal(0, 0.01, (400, 6))


def test_preparation_and_pairs():
    x = X[:5].copy()
    x[1, 2] = np.nan
    assert risk.prepare(x, missing="fill", centre=False)[1, 2] == 0 and np.isnan(risk.prepare(x, missing="ignore", centre=False)[1, 2])
    m = risk.empirical(risk.prepare(x, missing="mask"))
    pair = x[~np.isnan(x[:, 2])]
    a, b = pair[:, 0] - x[:, 0].mean(), pair[:, 2] - pair[:, 2].mean()
    assert m[0, 2] == pytest.approx((a * b).sum() / 4)
    np.testing.assert_allclose(risk.empirical(risk.prepare(X)), np.cov(X.T, ddof=0))
    np.testing.assert_allclose(risk.prepare(np.array([[1.0], [2.0]]), prices=True, scale=True, centre=False), [[100.0]])
    np.testing.assert_allclose(np.diag(risk.as_correlation(np.cov(X.T))), 1)
    with pytest.raises(ValueError):
        risk.prepare(X, missing="drop")


def test_single_index_and_average():
    s = risk.single_index(X, MARKET)
    np.testing.assert_allclose(np.diag(s), X.var(axis=0, ddof=1), rtol=1e-3)
    beta = [np.polyfit(MARKET, X[:, i], 1)[0] for i in range(6)]
    assert s[0, 1] == pytest.approx(beta[0] * beta[1] * MARKET.var(ddof=1))
    sample = np.cov(X.T)
    np.testing.assert_allclose(risk.portfolio_of_estimators(X, MARKET), (sample + np.diag(np.diag(sample)) + s) / 3)


@pytest.mark.parametrize("target", ["const_var", "const_corr", "single_factor"])
def test_shrinkage_comes_closer_to_the_truth(target):
    load = {"const_var": 0.0, "const_corr": 1.0, "single_factor": np.linspace(0.5, 1.5, 30)}[target] * np.ones(30)
    true = np.outer(load, load) * 1e-4 + np.eye(30) * 1e-4
    gains = []
    for i in range(20):
        x = np.random.default_rng(i).multivariate_normal(np.zeros(30), true, 40)
        gains.append(np.linalg.norm(np.cov(x.T, ddof=0) - true) - np.linalg.norm(risk.shrink(x, "lw", target) - true))
    assert np.mean(gains) > 0
    np.testing.assert_allclose(risk.shrink(X, 0.0, target), np.cov(X.T, ddof=0))


def test_thresholds_and_latent_factors():
    r = np.array([[1.0, 0.1, -0.3, 0.9], [0.1, 1, 0.5, 0], [-0.3, 0.5, 1, 0], [0.9, 0, 0, 1]])
    assert risk.threshold(r, 0.2, "hard")[0].tolist() == [1, 0, -0.3, 0.9]
    np.testing.assert_allclose(risk.threshold(r, 0.2, "soft")[0], [1, 0, -0.1, 0.7])
    np.testing.assert_allclose(risk.threshold(r, 0.2, "scad")[0], [1, 0, -0.1, 0.9])
    assert risk.threshold(r, 0.2, "scad")[1, 2] == pytest.approx((2.7 * 0.5 - 3.7 * 0.2) / 1.7)
    for c in (risk.poet(X, 1), risk.poet(X, 0, 0.5, "scad"), risk.structured(X, 1), risk.structured(X, 1, "fa")):
        assert np.linalg.eigvalsh(c).min() > 0 and np.abs(c - np.cov(X.T)).max() < 8e-5
    # scores of factor analysis are shrunk, so a part of the variance is in neither part
    share = np.diag(risk.structured(X, 1, "fa")) / X.var(axis=0)
    assert (share > 0.6).all() and (share < 1.01).all()


def test_weights_within_bounds():
    cov = np.diag([1.0, 4.0]) * 1e-4
    np.testing.assert_allclose(risk.optimise(np.zeros(2), cov), [0.8, 0.2], atol=1e-4)
    tied = np.array([[1.0, 1.8], [1.8, 4.0]]) * 1e-4
    w = risk.optimise(np.zeros(2), tied, bounds=(-1.0, 2.0))
    np.testing.assert_allclose(w, [(4 - 1.8) / (1 + 4 - 3.6), (1 - 1.8) / (1 + 4 - 3.6)], atol=1e-4)
    assert risk.optimise(np.zeros(4), np.eye(4), "equal").tolist() == [0.25] * 4
    box = risk.to_box(np.array([5.0, -3.0, 0.2]), -1, 1)
    assert box.sum() == pytest.approx(1) and box.min() >= -1 and box.max() <= 1
    with pytest.raises(ValueError):
        risk.optimise(np.zeros(3), np.eye(3), bounds=(0.5, 1.0))


def test_gram_folds_vectors(spark):
    df = spark.createDataFrame([([float(v) for v in r],) for r in X] + [(None,), ([1.0],), ([None, 1.0, 1.0, 1.0, 1.0, 1.0],)], "v array<double>")
    n, s, g = risk.gram(df, "v", 6)
    assert n == 400
    np.testing.assert_allclose(g, X.T @ X)
    np.testing.assert_allclose(s, X.sum(0))
    with pytest.raises(ValueError):
        risk.gram(df, "v", risk.DENSE + 1)


def test_store_round_trip(spark, tmp_path):
    st = store.FactorStore(spark, str(tmp_path / "s"))
    assert st.names() == [] and st.read().count() == 0 and not st.exists("a/b")
    day = lambda d: dt.date(2024, 1, d)
    rows = lambda *xs: spark.createDataFrame(list(xs), "factor_name string, ticker string, trade_date date, value double")
    st.upsert(rows(("a/b", "x", day(1), 1.0), ("a/b", "x", day(1), 2.0), ("a/b", "y", day(2), 3.0), ("c", "x", day(1), 9.0), (None, "x", day(1), 5.0)))
    st.upsert(rows(("a/b", "x", day(1), None), ("a/b", "y", day(2), 4.0), ("a/b", "y", day(3), 5.0)))
    assert bag(st.read(["a/b"]).collect()) == bag([("a/b", "x", day(1), 2.0), ("a/b", "y", day(2), 4.0), ("a/b", "y", day(3), 5.0)])
    assert st.read(start="2024-01-02", end="2024-01-02").count() == 1
    assert {r["factor_name"]: r["n"] for r in st.date_ranges().collect()} == {"a/b": 3, "c": 1}
    assert st.delete("a/b") and not st.delete("a/b") and st.names() == ["c"]


def test_conditions(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, -1.0), (5, 50.0)], "id int, v double")
    ids = lambda text: {r["id"] for r in df.where(store.condition("v", text)).collect()}
    assert ids("> 0 and < 30") == {1} and ids("== nan or > 20") == {2, 3, 5} and ids("!= nan") == {1, 4, 5} and ids("!= 5") == {4, 5} and ids(">= -1 AND <= 5.0e0") == {1, 4}
    for bad in ("", "> x", "between 1 and 2", "> nan"):
        with pytest.raises(ValueError):
            store.condition("v", bad)


def test_appending_and_gaps(spark):
    old = spark.createDataFrame([("a", 1, 1.0)], "k string, d int, v double")
    new = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 2.0), ("a", 2, 3.0), (None, 3, 1.0)], "k string, d int, v double")
    assert bag(store.append_new(old, new, ["k", "d"]).collect()) == bag([("a", 2, 3.0)])
    s = spark.createDataFrame([(i,) for i in range(1, 8)], "d int")
    have = spark.createDataFrame([("a", 1), ("a", 4), ("b", 7)], "k string, d int")
    assert bag(store.missing_ranges(s, have, ["k"], "d").collect()) == bag([("a", 2, 3, 2), ("a", 5, 7, 3), ("b", 1, 6, 6)])


def test_bar_makers(spark):
    t = spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 10, 0, i), i, float(v), 10 * (i + 1)) for i, v in enumerate([3, 5, 1, 4, 2])] + [(None, None, 9, 1.0, 1)], "k string, ts timestamp, id int, v double, n int")
    assert [(r["bar_no"], r["open"], r["high"], r["low"], r["close"], r["ticks"]) for r in bars.count_bars(t, "k", "ts", "id", "v", 2).orderBy("bar_no").collect()] == [(0, 3, 5, 3, 5, 2), (1, 1, 4, 1, 4, 2), (2, 2, 2, 2, 2, 1)]
    # running volumes before the ticks: 0, 10, 30, 60, 100
    assert [r["ticks"] for r in bars.volume_bars(t, "k", "ts", "id", "v", "n", 50).orderBy("bar_no").collect()] == [3, 1, 1]
    rules = spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 10, 0, 1), True), ("k", dt.datetime(2024, 1, 1, 10, 0, 3), False)], "k string, effective timestamp, frozen boolean")
    assert {r["id"]: r["is_restricted"] for r in bars.restricted(t, rules, "k", "ts").collect()} == {0: False, 1: True, 2: True, 3: False, 4: False, 9: False}


def test_clean_factor_and_bins(spark):
    rows = [(f"t{i}", dt.date(2024, 1, d), float(i - 4), 10.0 + d * (i + 1), "g" if i % 2 else "h") for i in range(9) for d in range(1, 6)]
    p = spark.createDataFrame(rows, "ticker string, trade_date date, score double, close double, industry string")
    t = tearsheet.clean_factor(p, "score", "close", (1,), quantiles=None, bins=3, group="industry")
    pdf = t.toPandas()
    for _, g in pdf.groupby("trade_date"):
        want = pd.cut(g["factor"], 3, labels=False) + 1
        assert (g["factor_quantile"] == want).all()
    with pytest.raises(tearsheet.MaxLossError):
        tearsheet.clean_factor(p, "score", "close", (4,), max_loss=0.5)
    z = tearsheet.clean_factor(p, "score", "close", (1,), quantiles=4, zero_aware=True).toPandas()
    assert set(z[z["factor"] < 0]["factor_quantile"]) == {1, 2} and set(z[z["factor"] >= 0]["factor_quantile"]) == {3, 4}
    edges = tearsheet.bin_bucket(p, "score", [-2.0, 0.0, 3.0]).select("score", "factor_quantile").distinct().collect()
    assert {r["score"]: r["factor_quantile"] for r in edges} == {-4: None, -3: None, -2: None, -1: 1, 0: 1, 1: 2, 2: 2, 3: 2, 4: None}
    with pytest.raises(ValueError):
        tearsheet.clean_factor(p, "score", "close", quantiles=3, bins=3)
    got = spark.range(1).select(tearsheet.rate_of_return(F.lit(0.21), 2.0), tearsheet.std_conversion(F.lit(2.0), 4.0)).first()
    assert got[0] == pytest.approx(0.1) and got[1] == 1.0 and math.isclose(got[1], 1)
