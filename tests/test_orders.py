"""Order fills, bracket trades, currencies and continuous contracts."""

import datetime as dt

import pytest

from factorloom.operators import instruments, orders

from util import bag

DAY = dt.date(2024, 1, 1)


def d(i):
    return DAY + dt.timedelta(i)


@pytest.mark.parametrize(
    ("kind", "side", "level", "bar", "want"),
    [
        ("market", 1, 0, (10, 11, 9), 10), ("limit", 1, 9.5, (10, 11, 9), 9.5), ("limit", 1, 10.5, (10, 11, 9), 10), ("limit", 1, 8, (10, 11, 9), None), ("limit", -1, 10.5, (10, 11, 9), 10.5),
        ("limit", -1, 9.5, (10, 11, 9), 10), ("stop", -1, 9.5, (10, 11, 9), 9.5), ("stop", -1, 10.5, (10, 11, 9), 10), ("stop", 1, 10.5, (10, 11, 9), 10.5), ("stop", 1, 12, (10, 11, 9), None),
    ],
)
def test_fill_price(kind, side, level, bar, want):
    assert orders.fill_price(kind, side, level, *bar) == want


def test_bracket_trades(spark):
    rows = [("a", d(i), *map(float, b), f) for i, (b, f) in enumerate([((10, 10, 10, 10), True), ((10, 10.5, 9.8, 10), True), ((10, 11.2, 9.9, 11), False), ((11, 11, 11, 11), True), ((11, 11, 10.9, 11), False), ((10, 10, 9, 9), True), ((9, 9, 9, 9), False)])]
    rows.insert(3, ("a", dt.date(2024, 1, 3) , None, None, None, None, True))
    df = spark.createDataFrame(rows[:3] + rows[4:], "ticker string, trade_date date, open double, high double, low double, close double, go boolean")
    got = orders.bracket_trades(df, "go", stop=0.05, target=0.1).collect()
    assert [(r["entry_day"], r["exit_day"], r["entry_price"], round(r["exit_price"], 6) if r["reason"] != "open" else None, r["reason"]) for r in sorted(got, key=lambda r: r["entry_day"])] == [(d(1), d(2), 10.0, 11.0, "target"), (d(4), d(5), 11.0, 10.0, "stop"), (d(6), None, 9.0, None, "open")]
    timed = orders.bracket_trades(df, "go", stop=0.5, target=0.5, max_rows=2).collect()
    assert timed[0]["reason"] == "time" and timed[0]["exit_day"] == d(4)
    assert orders.bracket_trades(df.limit(0), "go", 0.1, 0.1).count() == 0


def test_convert_currency(spark):
    v = spark.createDataFrame([(1, "USD", d(5), 2.0), (2, "USD", d(0), 2.0), (3, "EUR", d(5), 1.0), (4, None, d(5), 1.0)], "id int, cur string, day date, x double")
    r = spark.createDataFrame([("USD", d(3), 7.0), ("USD", d(9), 8.0)], "currency string, date date, rate double")
    got = instruments.convert_currency(v, r, "x", "cur", "day", "y").select("id", "y").collect()
    assert bag(got) == bag([(1, 14.0), (2, None), (3, None), (4, None)])


def test_continuous_series(spark):
    p = spark.createDataFrame([("r", c, d(i), v) for c, vs in (("f1", [10, 11, 12]), ("f2", [20, 22, 24, 26, 28])) for i, v in enumerate(map(float, vs))], "root string, contract string, day date, close double")
    c = spark.createDataFrame([("r", "f1", d(2)), ("r", "f2", d(9))], "root string, contract string, last_day date")
    got = instruments.continuous_series(p, c).select("day", "contract", "adjusted").collect()
    assert bag(got) == bag([(d(0), "f1", 20.0), (d(1), "f1", 22.0), (d(2), "f1", 24.0), (d(3), "f2", 26.0), (d(4), "f2", 28.0)])
    early = instruments.continuous_series(p, c, offset_days=1).where("contract = 'f2'").count()
    assert early == 3
