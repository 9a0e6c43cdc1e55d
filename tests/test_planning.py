"""Schedules, parameter grids, generated SQL and factor risk."""

import datetime as dt

import numpy as np
import pytest

from factorloom.functions.library import LIBRARY
from factorloom.functions.scans import SCANS
from factorloom.operators import risk, schedule
from factorloom.plans.formula import parse
from factorloom.plans.grid import formula_grid, render
from factorloom.plans.library_sql import library_sql

DAY = dt.date(2024, 1, 1)


def test_rules():
    assert schedule.parse_rule("2w-wed") == (2, "W", "WED")
    assert schedule.parse_rule("ME") == (1, "ME", None)
    for bad in ("", "0D", "ME-WED", "W-XXX", "5H"):
        with pytest.raises(ValueError):
            schedule.parse_rule(bad)


def test_rebalance_dates(spark):
    days = [DAY + dt.timedelta(i) for i in range(120) if (DAY + dt.timedelta(i)).weekday() < 5]
    s = spark.createDataFrame([("X", d) for d in days], "exchange string, day date")
    got = lambda rule: sorted(r["day"] for r in schedule.rebalance_dates(s, rule).collect())
    assert got("ME")[:3] == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 29)]
    assert got("2MS") == [dt.date(2024, 1, 1), dt.date(2024, 3, 1)]
    assert got("W-WED")[:2] == [dt.date(2024, 1, 3), dt.date(2024, 1, 10)]
    assert got("2W-FRI")[:2] == [dt.date(2024, 1, 5), dt.date(2024, 1, 19)]
    assert got("YE") == [days[-1]]
    assert got("50D") == [days[0], days[50]]
    assert schedule.rebalance_dates(s.limit(0), "ME").count() == 0


def test_grid_labels_and_text():
    g = formula_grid("ts_mean(x, N) * -K > 1 ? x : 0", N=[5, 10], K=[2])
    assert list(g) == ["N=5,K=2", "N=10,K=2"]
    for f in (*g.values(), "cs_mean(x, weight=v)", "block_agg(x, 4, 2, 'mean', 'max')", "-x ** 2"):
        assert parse(render(parse(f))) == parse(f)


def test_every_library_formula_has_sql_or_is_recursive():
    for name, (_, text) in LIBRARY.items():
        assert library_sql(name) or any(f"{scan}(" in text for scan in SCANS), name


def test_low_rank_covariance():
    rng = np.random.default_rng(0)
    f = rng.normal(size=(500, 2))
    load = rng.normal(size=(2, 8))
    x = f @ load + rng.normal(0, 0.3, (500, 8))
    s = np.cov(x.T, ddof=0)
    for est in (risk.low_rank(x, 2), risk.low_rank(x, 2, 0.1), risk.low_rank(x, 2, 0.1, "hard")):
        np.testing.assert_allclose(np.diag(est), np.diag(s))
        assert np.abs(est - load.T @ load - 0.09 * np.eye(8)).max() < 0.6 and np.linalg.eigvalsh(est).min() > 0


def test_risk_attribution_adds_up():
    rng = np.random.default_rng(1)
    w, e, c, d = rng.random(5), rng.normal(size=(5, 3)), np.diag([1.0, 2, 3]), rng.random(5)
    a = risk.risk_attribution(w, e, c, d)
    assert np.isclose(a["total"], w @ (e @ c @ e.T + np.diag(d)) @ w)
    assert np.isclose(a["by_factor"].sum() * a["total"], a["factor"])
    assert np.isclose(risk.stress(w, e, {"s": np.ones(3)})["s"], (e.T @ w).sum())
