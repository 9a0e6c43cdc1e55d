"""Pipeline terms beyond what SQL compares: p-values, rank correlation, user functions, splits of estimates."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import estimates, pipeline

from util import bag

G = pipeline.Grid("day", "asset")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(d), f"a{i}", float(rng.normal()), None if rng.random() < 0.05 else float(np.round(rng.normal(), 1))) for i in range(3) for d in range(60)]
    return spark.createDataFrame(rows, "day date, asset string, x double, y double")


def test_incomplete_beta_and_p_values(spark):
    # symmetric and closed forms: I_x(1, b) = 1 - (1 - x)^b; two-sided p of t with 1 degree: 1 - 2 atan(t) / pi
    x = np.array([0.0, 0.1, 0.5, 0.9, 1.0])
    np.testing.assert_allclose(pipeline.incomplete_beta(1, 3, x), 1 - (1 - x) ** 3, atol=1e-12)
    np.testing.assert_allclose(pipeline.incomplete_beta(2.5, 2.5, np.array([0.5])), [0.5], atol=1e-12)
    df = spark.createDataFrame([(t,) for t in (0.0, 1.0, -3.0, 50.0, None)], "t double")
    got = [r[0] for r in df.select(pipeline.two_sided_p(1)(df["t"])).collect()]
    for t, p in zip((0.0, 1.0, 3.0, 50.0), got, strict=False):
        assert p == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-10)
    assert got[-1] is None
    assert df.limit(1).select(pipeline.two_sided_p(18)(df["t"] + 2.10092)).first()[0] == pytest.approx(0.05, abs=1e-5)


def test_rank_correlation_equals_pandas(table):
    out = pipeline.Pipeline({"s": G.factor("x").spearmanr(G.factor("y"), 12)}).run(table).toPandas()
    pdf = table.toPandas().sort_values(["asset", "day"])
    for asset, g in pdf.groupby("asset"):
        got = out[out.asset == asset].sort_values("day")["s"].to_numpy(float)
        for i in range(len(g)):
            w = g.iloc[max(0, i - 11) : i + 1]
            if len(w) < 12 or w["y"].isna().any():
                assert np.isnan(got[i])
            else:
                assert got[i] == pytest.approx(w["x"].rank().corr(w["y"].rank()), abs=1e-9)


def test_custom_terms(spark, table):
    t = pipeline.custom_factor(table, G, ["x", "y"], 5, lambda x, y: {"span": float(x.max() - x.min()), "up": bool(x[-1] > x[0]), "label": "hole" if pd.isna(y.astype(float)).any() else "full"}, {"span": "double", "up": "boolean", "label": "string"})
    p = pipeline.Pipeline({"span": G.factor("span"), "same": G.classifier("label").eq("full")}, G.filter("up"))
    rows = p.run(t).collect()
    assert rows and all(r["span"] >= 0 for r in rows) and {r["same"] for r in rows} == {True, False}
    z = pipeline.custom_row_transform(table, G, "y", lambda v: v - v.max(), "gap").groupBy("day").agg({"gap": "max"}).collect()
    assert all(r[1] == 0 or r[1] is None for r in z)
    with pytest.raises(ValueError):
        p.add(G.factor("x"), "span")
    with pytest.raises(ValueError):
        pipeline.Pipeline().run(table)


def test_layers_share_partitionings(table):
    x = G.factor("x")
    p = pipeline.Pipeline({"a": x.sma(3).demean().rank(), "b": x.sma(5).zscore(), "c": x.lag(2).demean()})
    plan = p.run(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asset") == 1 and plan.count("Exchange hashpartitioning(day") == 1
    assert p.run(table.limit(0)).count() == 0


def test_decay_and_weights():
    assert pipeline.decay_of(span=9) == pytest.approx(0.8) and pipeline.decay_of(centre=4) == pytest.approx(0.8)
    assert pipeline.decay_of(half_life=2) ** 2 == pytest.approx(0.5)
    with pytest.raises(ValueError):
        pipeline.decay_of(span=9, centre=4)
    assert pipeline.exponential_weights(3, 0.5) == [0.125, 0.25, 0.5]


def test_estimates_are_adjusted_for_later_splits(spark):
    est = spark.createDataFrame([("s", 10, 100, 50, 8.0), ("s", 30, 100, 52, 9.0), ("s", 12, 101, 140, 7.0), (None, 1, 1, 1, 1.0)], "sid string, known int, q int, event int, v double")
    splits = spark.createDataFrame([("s", 20, 0.5), ("s", 40, 0.5)], "sid string, day int, ratio double")
    days = spark.createDataFrame([("s", d) for d in (5, 15, 25, 35, 45, 60)] + [("none", 5), (None, 3)], "sid string, day int")
    got = estimates.quarters_as_of(days, est, "sid", "day", "known", "q", "event", ["v"], (1, 2), True, splits, ["v"])
    want = [("s", 5, None, None, None, None), ("s", 15, 100, 8.0, 101, 7.0), ("s", 25, 100, 4.0, 101, 3.5), ("s", 35, 100, 9.0, 101, 3.5), ("s", 45, 100, 4.5, 101, 1.75), ("s", 60, 101, 1.75, 102, None), ("none", 5, None, None, None, None)]
    assert bag(got.select("sid", "day", "q1", "v_1", "q2", "v_2").collect()) == bag(want)
    back = estimates.quarters_as_of(days, est, "sid", "day", "known", "q", "event", ["v"], (1,), False)
    assert bag(back.where("day = 60").collect()) == bag([("s", 60, 100, 9.0)])
