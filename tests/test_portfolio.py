"""Accounts from orders and signals, by hand and against a plain account."""

import math
import random

import numpy as np
import pytest

from factorloom.operators import evaluation, portfolio, signals, splits
from factorloom.operators.portfolio import Account, Rules

NAN = float("nan")


def test_order_kinds_by_hand():
    a = Account(Rules(cash=1000, fees=0.01, fixed_fees=1, slippage=0.1), 1000.0, last={"x": 10.0})
    assert a.order(1, "x", 10, "amount", 10.0) == 10
    # 10 shares at 11, 1 % of 110 and 1 in fees
    assert a.cash == pytest.approx(1000 - 110 - 1.1 - 1)
    assert a.order(2, "x", 4, "target_amount", 10.0) == -6
    assert a.orders[-1][3:6] == (6.0, pytest.approx(9.0), pytest.approx(0.54 + 1))
    assert a.order(3, "x", 0.0, "target_percent", 10.0) == -4 and a.held["x"] == 0
    assert a.order(4, "x", 5.0, "target_value", 0.0) == 0 and a.log[-1][4] == "no price"
    assert a.order(5, "x", math.inf, "amount", 10.0) > 0 and abs(a.cash) < 1e-9


def test_rejections_limits_and_lots():
    a = Account(Rules(cash=1000, partial=False), 1000.0)
    assert a.order(1, "x", 200, "amount", 10.0) == 0 and a.log[-1][4] == "not enough cash"
    assert a.order(1, "x", -5, "amount", 10.0) == 0 and a.log[-1][4] == "not enough shares"
    b = Account(Rules(cash=1000, lot=30, least=30, most=70), 1000.0)
    assert b.order(1, "x", 90, "amount", 10.0) == 60 and b.order(2, "x", 29, "amount", 10.0) == 0
    c = Account(Rules(cash=1000, volume_share=0.1), 1000.0)
    assert c.order(1, "x", 50, "amount", 10.0, volume=300) == 30 and c.order(2, "x", 50, "amount", 10.0, volume=NAN) == 0


def test_short_positions_are_backed_by_free_cash():
    a = Account(Rules(cash=1000, short=True), 1000.0, last={"x": 10.0})
    assert a.order(1, "x", -math.inf, "amount", 10.0) == -100
    assert a.cash == 2000 and a.free() == 0 and a.value() == 1000
    a.last["x"] = 8.0
    assert a.value() == 1200
    assert a.order(2, "x", 0.0, "target_amount", 8.0) == 100 and a.cash == 1200


def test_group_shares_cash_and_sells_first(spark):
    rows = [("g", 1, "a", 10.0, 1.0), ("g", 1, "b", 20.0, 0.0), ("g", 2, "a", 10.0, 0.0), ("g", 2, "b", 20.0, 1.0), ("g", 3, "a", NAN, 0.5), ("g", 3, "b", 25.0, 0.5), ("h", 1, "a", 10.0, None)]
    df = spark.createDataFrame(rows, "grp string, day int, asset string, price double, size double")
    run = lambda **k: [(r["day"], r["asset"], r["size"], r["side"]) for r in portfolio.run_orders(df, "grp", "day", "asset", "price", "size", "target_percent", Rules(cash=1000), **k).orderBy("grp", "order_no").collect()]
    assert run() == [(1, "a", 100.0, 1), (2, "a", 100.0, -1), (2, "b", 50.0, 1), (3, "b", 25.0, -1)]
    log = portfolio.run_orders(df, "grp", "day", "asset", "price", "size", "target_percent", Rules(cash=1000), log=True).collect()
    assert sorted(r["status"] for r in log) == ["filled"] * 4 + ["no price", "size too small"]
    assert portfolio.run_orders(df.limit(0), "grp", "day", "asset", "price", "size").count() == 0
    with pytest.raises(ValueError):
        portfolio.run_orders(df, "grp", "day", "asset", "price", "size", "shares")


def plain_stops(bars, stop, trail, take, hold):
    """The reasons and prices of one asset's trades, row by row."""
    inside, out, entry, peak, age = False, [], 0, 0, 0
    for i, (o, h, lo, c, go, leave) in enumerate(bars):
        if inside:
            age += 1
            low = max(entry * (1 - stop), peak * (1 - trail))
            if lo <= low:
                out.append((i, "stop" if entry * (1 - stop) > peak * (1 - trail) else "trail", round(min(low, o), 6)))
                inside = False
            elif h >= entry * (1 + take):
                out.append((i, "take", round(max(entry * (1 + take), o), 6)))
                inside = False
            elif age >= hold:
                out.append((i, "hold", round(c, 6)))
                inside = False
            peak = max(peak, h)
        if inside and leave:
            out.append((i, "exit", round(c, 6)))
            inside = False
        elif go and not inside:
            inside, entry, peak, age = True, c, c, 0
            out.append((i, "entry", round(c, 6)))
    return out


def test_stops_against_plain_account(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for t in "abcdef":
        price, bars = 100.0, []
        for _ in range(150):
            o = price * (1 + rng.gauss(0, 0.01))
            c = o * (1 + rng.gauss(0, 0.02))
            bars.append((o, max(o, c) * (1 + rng.random() * 0.01), min(o, c) * (1 - rng.random() * 0.01), c, rng.random() < 0.1, rng.random() < 0.05))
            price = c
        want[t] = plain_stops(bars, 0.04, 0.06, 0.08, 12)
        rows += [(t, i, t, *map(float, b[:4]), b[4], b[5]) for i, b in enumerate(bars)]
    df = spark.createDataFrame(rows, "grp string, day int, asset string, o double, h double, l double, c double, go boolean, leave boolean")
    got = portfolio.run_signals(df, "grp", "day", "asset", "go", "leave", "c", "h", "l", "o", stop=0.04, trail=0.06, take=0.08, hold=12)
    for t in want:
        assert [(r["day"], r["reason"], round(r["price"], 6)) for r in got.where(f"grp = '{t}'").orderBy("order_no").collect()] == want[t]
    assert {"stop", "trail", "take", "hold", "exit"} <= {w[1] for x in want.values() for w in x}


def test_average_cost_trades(spark):
    o = [("g", "x", 0, 10.0, 10.0, 1.0, 1), ("g", "x", 1, 10.0, 20.0, 1.0, 1), ("g", "x", 2, 5.0, 30.0, 0.5, -1), ("g", "x", 3, 15.0, 10.0, 0.5, -1), ("g", "x", 4, 2.0, 5.0, 0.0, 1)]
    t = portfolio.exit_trades(spark.createDataFrame(o, "grp string, asset string, order_no int, size double, price double, fees double, side int"), "grp", "asset").orderBy("trade_no").collect()
    assert [(r["position_no"], r["size"], r["entry_price"], r["status"]) for r in t] == [(0, 5.0, 15.0, "closed"), (0, 15.0, 15.0, "closed"), (1, 2.0, 5.0, "open")]
    assert [r["profit"] for r in t] == [pytest.approx(75 - 0.5 - 0.5), pytest.approx(-75 - 1.5 - 0.5), 0.0]


def test_split_ranges():
    assert splits.rolling_ranges(10, 4, step=3, sets=(0.5, None)) == [(0, 0, 0, 1), (0, 1, 2, 3), (1, 0, 3, 4), (1, 1, 5, 6), (2, 0, 6, 7), (2, 1, 8, 9)]
    assert [r[2:] for r in splits.rolling_ranges(10, 4, n=3)] == [(0, 3), (3, 6), (6, 9)]
    assert splits.expanding_ranges(6, 4, sets=(None, 1)) == [(0, 0, 0, 2), (0, 1, 3, 3), (1, 0, 0, 3), (1, 1, 4, 4), (2, 0, 0, 4), (2, 1, 5, 5)]
    w = splits.walk_forward_ranges(100, 3, 0.5, 4)
    tests = [r for r in w if r[1] == 1]
    assert tests[-1][3] == 99 and all(a[3] + 1 == b[2] for a, b in zip(tests, tests[1:], strict=False))
    assert all(t[2] - l[3] == 5 for l, t in zip([r for r in w if r[1] == 0], tests, strict=True))  # noqa: E741
    for bad in (lambda: splits.rolling_ranges(3, 4), lambda: splits.walk_forward_ranges(3, 9), lambda: splits.rolling_ranges(9, 4, sets=(3, 3)), lambda: splits.expanding_ranges(9, 2, sets=(None, 2))):
        with pytest.raises(ValueError):
            bad()


def test_random_signals_are_stable(spark):
    df = spark.range(400).selectExpr("concat('t', id % 4) as ticker", "date_add(date'2024-01-01', cast(id div 4 as int)) as trade_date")
    pick = lambda d, **k: {tuple(r) for r in signals.random_signals(d, "hit", **k).where("hit").select("ticker", "trade_date").collect()}
    assert pick(df, n=7) == pick(df.repartition(3), n=7) and len(pick(df, n=7)) == 28
    assert 10 < len(pick(df, share=0.1)) < 80 and pick(df, share=0.1) != pick(df, share=0.1, seed=1)


def test_bootstrap_covers_and_bounds(spark):
    rng = np.random.default_rng(0)
    hits = 0
    for i in range(40):
        lo, hi = evaluation.bca_interval(rng.normal(0.1, 1, 200), evaluation.sharpe_ratio, (0.05,), 300, i)[0]
        hits += lo <= 0.1 <= hi
    assert hits >= 30
    b = evaluation.drawdown_bounds(rng.normal(0, 0.02, 250))
    assert all(x >= y for x, y in zip(b, b[1:], strict=False)) and -1 < b[-1] < 0
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 30))] + [("b", 1, 1.0), ("c", 1, None), (None, 1, 2.0)], "g string, t int, x double")
    assert {r["g"] for r in evaluation.bootstrap_evaluation(df, "g", "t", "x", 100).collect()} == {"a"}
    assert evaluation.bca_interval(np.ones(5), evaluation.sharpe_ratio, (0.05,)) == [(0.0, 0.0)]
    assert evaluation.deflated_sharpe(0.2, 0.01, 10, 500, 0.0, 3.0) > evaluation.deflated_sharpe(0.2, 0.01, 1000, 500, 0.0, 3.0)
