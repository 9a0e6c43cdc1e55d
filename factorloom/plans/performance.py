"""Queries of return, drawdown, trade and adjustment operators, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panel_ops import Keys, ts_mean
from ..operators import performance as pf
from ..operators.panel import nulled
from ..operators.versions import latest_version
from ..session import read_table
from .analytics import _out
from .formulas import PANEL_SQL, panel


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return pf.daily_returns(panel(spark, d))


def pf_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Return statistics of every ticker against the universe's mean return."""
    r = _returns(spark, d)
    m = r.groupBy("trade_date").agg(F.avg("r").alias("bench"))
    return _out(pf.return_metrics(r.join(m, "trade_date"), "r", "bench"), **dict.fromkeys(("total_return", "annual_return", "volatility", "sharpe", "sortino", "omega", "tail_ratio", "calmar", "beta", "up_capture", "down_capture"), 5))


def pf_monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    """Monthly returns of every ticker."""
    t = pf.period_returns(_returns(spark, d), "month")
    return t.select("ticker", F.date_format("period", "yyyy-MM").alias("month"), F.round("period_return", 6).alias("period_return"))


def pf_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    """Drawdown records of every ticker."""
    t = pf.drawdown_records(panel(spark, d))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return t.select("ticker", day("peak_day"), day("valley_day"), day("recovery_day"), F.round("depth", 8).alias("depth"), "rows")


def _trades(spark: SparkSession, d: str) -> DataFrame:
    k = Keys()
    t = panel(spark, d).withColumn("ma", ts_mean(k, "close", 10))
    above, was = F.col("close") > F.col("ma"), F.lag(F.col("close") > F.col("ma")).over(k.along)
    t = t.withColumns({"up": above & ~was, "down": ~above & was})
    return pf.trades(t, F.col("up"), F.col("down"))


def pf_trades(spark: SparkSession, d: str) -> DataFrame:
    """Round trips of a moving-average cross."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _trades(spark, d).select("ticker", day("entry_day"), day("exit_day"), "entry_price", "exit_price", F.round("trade_return", 8).alias("trade_return"), F.col("rows").cast("double").alias("rows"))


def pf_trade_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the closed trades per ticker."""
    return _out(pf.trade_statistics(_trades(spark, d)), profit_factor=5, quality=5)


def pf_adjusted_close(spark: SparkSession, d: str) -> DataFrame:
    """Closes adjusted for changes of base."""
    t = read_table(spark, d, "stock_daily_real").where("ticker is not null and trade_date is not null").withColumn("trade_date", F.col("trade_date").cast("date"))
    t = nulled(latest_version(t, ["ticker", "trade_date"], "created_at", ["close", "pre_close"]), ["close", "pre_close"])
    return _out(pf.adjusted_close(t, "close", "pre_close").select("ticker", "trade_date", "adj_factor", "adj_close"), adj_factor=5, adj_close=3)


def pf_trade_status(spark: SparkSession, d: str) -> DataFrame:
    """Which names could not be bought or sold, and the price a buyer pays with slippage."""
    t = read_table(spark, d, "stock_daily_real").where("ticker is not null and trade_date is not null").withColumn("trade_date", F.col("trade_date").cast("date"))
    f = ["close", "pre_close", "volume"]
    t = nulled(latest_version(t, ["ticker", "trade_date"], "created_at", f), f)
    c = [F.col(x) for x in f]
    out = t.select("ticker", "trade_date", pf.blocked(*c, "buy").alias("no_buy"), pf.blocked(*c, "sell").alias("no_sell"), pf.execution_price(F.col("close"), F.lit(1), 0.001).alias("buy_price"))
    return _out(out, buy_price=5)


def pf_rolling_regression(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of the close on open and volume over ten rows."""
    t = panel(spark, d).withColumn("v", F.col("volume") / 1e6).select("ticker", "trade_date", "close", "open", "v")
    r = pf.rolling_regression(t, "close", ["open", "v"], 10, "coef")
    return _out(r.select("ticker", "trade_date", *[F.col("coef")[i].alias(n) for i, n in enumerate(("alpha", "beta_open", "beta_volume"))]), alpha=2, beta_open=2, beta_volume=2)


def pf_rolling_apply(spark: SparkSession, d: str) -> DataFrame:
    """A user's function (middle of the range) over twenty rows."""
    t = pf.rolling_apply(panel(spark, d).select("ticker", "trade_date", "close"), "close", 20, lambda w: (w.max() + w.min()) / 2, "value")
    return _out(t.select("ticker", "trade_date", "value"), value=6)


QUERIES = {f.__name__: f for f in (pf_metrics, pf_monthly_returns, pf_drawdowns, pf_trades, pf_trade_statistics, pf_adjusted_close, pf_trade_status, pf_rolling_regression, pf_rolling_apply)}

_R = f"with {PANEL_SQL}, q as (select ticker, trade_date, case when close > 0 then close end as c from p), r0 as (select ticker, trade_date, c / lag(c) over (partition by ticker order by trade_date) - 1 as r from q)"
_PAST = "(partition by ticker order by trade_date rows between unbounded preceding and current row)"
_T = f"""with {PANEL_SQL}, m as (select *, case when count(close) over w >= 10 then avg(close) over w end as ma from p window w as (partition by ticker order by trade_date rows between 9 preceding and current row)),
a as (select ticker, trade_date, close, close > ma as above from m), b as (select *, lag(above) over (partition by ticker order by trade_date) as was from a),
i as (select *, row_number() over (partition by ticker order by trade_date) as i from b where close > 0),
s as (select *, case when above and not was then 1 when not above and was then -1 end as s from i where (above and not was) or (not above and was)),
k as (select *, coalesce(lag(s) over (partition by ticker order by trade_date), -1) as before from s),
u as (select * from k where s <> before),
t as (select ticker, trade_date as entry_day, s, close as entry_price, lead(trade_date) over w as exit_day, lead(close) over w as exit_price, cast(lead(i) over w - i as integer) as rows from u window w as (partition by ticker order by trade_date)),
trades as (select ticker, entry_day, exit_day, entry_price, exit_price, exit_price / entry_price - 1 as trade_return, rows from t where s = 1)"""
_HELD = "held as (select ticker, cast(trade_date as date) as trade_date, case when isnan(close) then null else close end as close, case when isnan(pre_close) then null else pre_close end as pre_close, case when isnan(volume) then null else volume end as volume from stock_daily_real where ticker is not null and trade_date is not null qualify row_number() over (partition by ticker, cast(trade_date as date) order by created_at desc nulls last) = 1)"

ORACLES = {
    "pf_metrics": f"""{_R}, m as (select trade_date, avg(r) as b from r0 group by 1), x as (select ticker, trade_date, r, b, product(1 + r) over {_PAST} as nav from r0 join m using (trade_date) where r is not null),
      y as (select *, nav / greatest(max(nav) over {_PAST}, 1) - 1 as dd, quantile_cont(r, 0.05) over (partition by ticker) as var from x),
      g as (select ticker, count(*) as n, product(1 + r) - 1 as tot, stddev_samp(r) as s, avg(r) as m, sqrt(avg(pow(least(r, 0), 2))) as ds, sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0) as omega, quantile_cont(r, 0.05) as v5, quantile_cont(r, 0.95) as v95, avg(case when r <= var then r end) as es, avg(case when r > 0 then 1.0 else 0.0 end) as win, min(dd) as mdd,
        covar_samp(r, b) / nullif(var_samp(b), 0) as beta, avg(case when b > 0 then r end) / nullif(avg(case when b > 0 then b end), 0) as up, avg(case when b < 0 then r end) / nullif(avg(case when b < 0 then b end), 0) as down from y group by ticker having count(*) >= 3)
      select ticker, n, round(tot, 5) as total_return, round(pow(1 + tot, 252 / n) - 1, 5) as annual_return, round(s * sqrt(252), 5) as volatility, round(m / case when s > 1e-12 then s end * sqrt(252), 5) as sharpe, round(m / nullif(ds, 0) * sqrt(252), 5) as sortino, round(omega, 5) as omega, round(v5, 8) as value_at_risk, round(es, 8) as expected_shortfall, round(abs(v95) / nullif(abs(v5), 0), 5) as tail_ratio, round(win, 8) as win_rate, round(mdd, 8) as max_drawdown, round((pow(1 + tot, 252 / n) - 1) / nullif(abs(mdd), 0), 5) as calmar, round(beta, 5) as beta, round(up, 5) as up_capture, round(down, 5) as down_capture from g""",
    "pf_monthly_returns": f"{_R} select ticker, strftime(trade_date, '%Y-%m') as month, round(product(1 + r) - 1, 6) as period_return from r0 where r is not null group by 1, 2",
    "pf_drawdowns": f"""with {PANEL_SQL}, t as (select ticker, trade_date, close as c, max(close) over {_PAST} as peak from p where close > 0), g as (select *, case when c >= peak then 1 else 0 end as nw, sum(case when c >= peak then 1 else 0 end) over {_PAST} as g from t),
      f as (select ticker, g, arg_min(trade_date, (c, trade_date)) as valley, min(c) / any_value(peak) - 1 as depth, cast(count(*) as integer) as rows from g where nw = 0 group by 1, 2), s as (select ticker, g, trade_date as d from g where nw = 1)
      select f.ticker, strftime(s.d, '%Y-%m-%d') as peak_day, strftime(valley, '%Y-%m-%d') as valley_day, strftime(e.d, '%Y-%m-%d') as recovery_day, round(depth, 8) as depth, rows from f join s using (ticker, g) left join s e on e.ticker = f.ticker and e.g = f.g + 1""",
    "pf_trades": f"{_T} select ticker, strftime(entry_day, '%Y-%m-%d') as entry_day, strftime(exit_day, '%Y-%m-%d') as exit_day, entry_price, exit_price, round(trade_return, 8) as trade_return, cast(rows as double) as rows from trades",
    "pf_trade_statistics": f"{_T} select ticker, count(*) as n, count(*) filter (trade_return > 0) as won, count(*) filter (trade_return < 0) as lost, round(avg(trade_return), 8) as mean, round(max(trade_return), 8) as best, round(min(trade_return), 8) as worst, round(avg(rows), 8) as rows, round(sum(greatest(trade_return, 0)) / nullif(sum(greatest(-trade_return, 0)), 0), 5) as profit_factor, round(sqrt(count(*)) * avg(trade_return) / case when stddev_samp(trade_return) > 1e-12 then stddev_samp(trade_return) end, 5) as quality from trades where trade_return is not null group by ticker",
    "pf_adjusted_close": f"with {_HELD}, a as (select *, last_value(case when close > 0 then close end ignore nulls) over (partition by ticker order by trade_date rows between unbounded preceding and 1 preceding) as prev from held), b as (select *, case when pre_close > 0 and prev > 0 then ln(pre_close / prev) else 0 end as step from a), c as (select *, exp(coalesce(sum(step) over (partition by ticker order by trade_date rows between 1 following and unbounded following), 0)) as f from b) select ticker, strftime(trade_date, '%Y-%m-%d') as trade_day, round(f, 5) as adj_factor, round(close * f, 3) as adj_close from c",
    "pf_trade_status": f"with {_HELD} select ticker, strftime(trade_date, '%Y-%m-%d') as trade_day, coalesce(volume <= 0, true) or coalesce(round(close, 2) >= round(pre_close * 1.1, 2), false) as no_buy, coalesce(volume <= 0, true) or coalesce(round(close, 2) <= round(pre_close * 0.9, 2), false) as no_sell, round(close * 1.001, 5) as buy_price from held",
    "pf_rolling_apply": f"with {PANEL_SQL} select ticker, strftime(trade_date, '%Y-%m-%d') as trade_day, round(case when count(close) over w >= 20 then (max(close) over w + min(close) over w) / 2 end, 6) as value from p window w as (partition by ticker order by trade_date rows between 19 preceding and current row)",
    "pf_rolling_regression": f"""with {PANEL_SQL}, q as (select ticker, trade_date, case when o0 then close end as y, case when o0 then open end as a, case when o0 then volume / 1e6 end as b, o0 from (select *, close is not null and open is not null and volume is not null as o0 from p)),
      m as (select ticker, trade_date, count(*) over w as rows, count(y) over w as k, avg(y) over w as my, avg(a) over w as ma, avg(b) over w as mb, var_pop(a) over w as va, var_pop(b) over w as vb, covar_pop(a, b) over w as ab, covar_pop(y, a) over w as ya, covar_pop(y, b) over w as yb from q window w as (partition by ticker order by trade_date rows between 9 preceding and current row)),
      c as (select *, case when rows = 10 and k >= 3 and va * vb - ab * ab > 1e-12 / pow(k, 3) then (ya * vb - yb * ab) / (va * vb - ab * ab) end as ba, case when rows = 10 and k >= 3 and va * vb - ab * ab > 1e-12 / pow(k, 3) then (yb * va - ya * ab) / (va * vb - ab * ab) end as bb from m)
      select ticker, strftime(trade_date, '%Y-%m-%d') as trade_day, round(my - ba * ma - bb * mb, 2) as alpha, round(ba, 2) as beta_open, round(bb, 2) as beta_volume from c""",
}
