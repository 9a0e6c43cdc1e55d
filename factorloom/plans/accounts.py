"""Queries of accounts, signals, splits and evaluation, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.panel_ops import Keys, ts_mean
from ..operators import evaluation as ev
from ..operators import performance as pf
from ..operators import portfolio as pt
from ..operators import records as rc
from ..operators import signals as sg
from ..operators import splits as sp
from ..operators.analytics import average_rank
from .formulas import PANEL_SQL, panel

K = Keys()
COSTS = pt.Rules(cash=1e6, fees=0.001, slippage=0.001)
DEEP = pt.Rules(cash=1e9, fees=0.001, slippage=0.001)


def _day(c: str, name: str | None = None) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd").alias(name or c)


def _rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*[_day(n, "trade_day" if n == "trade_date" else n) if t == "date" else F.round(n, other.get(n, digits)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _asks(spark: SparkSession, d: str) -> DataFrame:
    """Every ticker buys 100 on each twentieth row and sells 10 ten rows later."""
    i = F.row_number().over(K.along)
    return panel(spark, d).select("ticker", "trade_date", "close", F.when(i % 20 == 1, 100.0).when(i % 20 == 11, -10.0).alias("ask"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return pt.run_orders(_asks(spark, d).withColumn("account", F.col("ticker")), "account", "trade_date", "ticker", "close", "ask", "amount", DEEP)


def pt_orders(spark: SparkSession, d: str) -> DataFrame:
    """Order records of accounts that buy and sell given amounts."""
    return _rounded(_orders(spark, d).drop("account"), 8)


def pt_values(spark: SparkSession, d: str) -> DataFrame:
    """Cash, holdings and value of those accounts, day by day."""
    v = pt.account_values(_orders(spark, d), panel(spark, d).withColumn("account", F.col("ticker")), "account", "trade_date", "ticker", "close", DEEP.cash)
    return _rounded(v.withColumnRenamed("account", "ticker"), 2, gross_exposure=8, value_return=8)


def pt_holding(spark: SparkSession, d: str) -> DataFrame:
    """One order per ticker: all cash into its first known price."""
    o = pt.holding_orders(panel(spark, d).withColumn("account", F.col("ticker")), "account", "trade_date", "ticker", "close", COSTS)
    return _rounded(o.drop("account"), 4, price=8)


def _crossing(spark: SparkSession, d: str) -> DataFrame:
    t = panel(spark, d).withColumn("ma", ts_mean(K, "close", 10)).withColumn("above", F.col("close") > F.col("ma"))
    was = F.lag("above").over(K.along)
    return t.withColumns({"up": F.coalesce(F.col("above") & ~was, F.lit(False)), "down": F.coalesce(~F.col("above") & was, F.lit(False))})


def _signal_orders(spark: SparkSession, d: str, **stops: float) -> DataFrame:
    return pt.run_signals(_crossing(spark, d).withColumn("account", F.col("ticker")), "account", "trade_date", "ticker", "up", "down", "close", "high", "low", "open", rules=COSTS, **stops)


def pt_signal_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of accounts that are all in while the close is above its mean."""
    return _rounded(_signal_orders(spark, d).select("ticker", "trade_date", "order_no", F.log("size").alias("log_size"), "price", F.log("fees").alias("log_fees"), "side", "reason"))


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return pt.exit_trades(_signal_orders(spark, d), "account", "ticker")


def pt_trades(spark: SparkSession, d: str) -> DataFrame:
    """Round trips behind those orders, with costs."""
    t = _trades(spark, d).where("status = 'closed'")
    return _rounded(t.select("ticker", "trade_no", "position_no", "entry_price", "exit_price", "trade_return"))


def pt_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions and the length of winning and losing streaks of closed trades."""
    p = pt.positions(_trades(spark, d), "account", "ticker").where("status = 'closed'")
    s = pt.streaks(p, ["ticker"], "position_no")
    return _rounded(s.select("ticker", "position_no", "entry_price", "exit_price", "position_return", "winning_streak", "losing_streak"))


def pt_order_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counts and means of the given-amount orders."""
    return _rounded(pt.order_statistics(_orders(spark, d).drop("account"), "ticker"), 4)


def pt_stops(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a stop of 5 %, a trail of 8 % and a gain of 10 %, at most twenty rows."""
    return _rounded(_signal_orders(spark, d, stop=0.05, trail=0.08, take=0.10, hold=20).drop("account"), 4)


def pt_execution(spark: SparkSession, d: str) -> DataFrame:
    """What orders of 5000 shares would have filled, at which price and commission, under several models."""
    t = panel(spark, d).where("close > 0 and volume > 0")
    side, want = F.lit(1), F.lit(5000.0)
    a, pa = pt.volume_share_fill(want, F.col("close"), F.col("volume"), side)
    b, pb = pt.fixed_bps_fill(want, F.col("close"), F.col("volume"), side)
    w = K.last(20)
    impact = pt.market_impact_price(F.col("close"), side, want, F.avg("volume").over(w), F.stddev_samp(F.col("pct_chg") / 100).over(w))
    fee = pt.commission(b, pb, per_share=0.001, rate=0.0003, least=5.0, stamp=0.001, side=F.lit(-1))
    return _rounded(t.select("ticker", "trade_date", a.cast("double").alias("filled"), pa.alias("fill_price"), b.cast("double").alias("bps_filled"), pb.alias("bps_price"), impact.alias("impact_price"), fee.alias("commission")), 10, impact_price=6)


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).select("ticker", "trade_date", "close", "volume", (F.col("pct_chg") > 0).alias("rise"), (F.col("pct_chg") < -1).alias("fall"))


def sg_clean(spark: SparkSession, d: str) -> DataFrame:
    """Rises and falls, alternating."""
    return _rounded(sg.clean_signals(_flags(spark, d), "rise", "fall").select("ticker", "trade_date", "rise", "fall").where("rise or fall"))


def sg_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Place of each rising day in its run, and number of the run."""
    return _rounded(sg.signal_ranks(_flags(spark, d), "rise").select("ticker", "trade_date", "pos_rank", "partition_rank"))


def sg_ranges(spark: SparkSession, d: str) -> DataFrame:
    """From every fall to the next rise."""
    return _rounded(sg.ranges_between(_flags(spark, d), "fall", "rise").withColumn("rows", F.col("rows").cast("double")))


def sg_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of rising days, and whether they are still open."""
    return _rounded(sg.partition_ranges(_flags(spark, d), "rise"))


def sg_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of days in rising runs."""
    f = _flags(spark, d)
    return _rounded(sg.range_coverage(sg.partition_ranges(f, "rise"), f.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))))


def sg_mask(spark: SparkSession, d: str) -> DataFrame:
    """Days between a fall and the next rise."""
    f = _flags(spark, d)
    return _rounded(sg.ranges_to_mask(f, sg.ranges_between(f, "fall", "rise"), "inside").select("ticker", "trade_date", "inside"))


def sg_first_exits(spark: SparkSession, d: str) -> DataFrame:
    """First rise at least two rows after each fall, and third row after it."""
    t = sg.delayed_exits(sg.first_exits(_flags(spark, d), "fall", "rise", "exit", wait=2), "fall", "late", 3)
    return _rounded(t.select("ticker", "trade_date", "exit", "late").where("exit or late"))


def sg_crossed_wait(spark: SparkSession, d: str) -> DataFrame:
    """Third day in a row above the mean after having been below it."""
    return _rounded(sg.crossed(_crossing(spark, d), "close", "ma", "hit", wait=2).select("ticker", "trade_date", "hit").where("hit"))


def sg_random(spark: SparkSession, d: str) -> DataFrame:
    """Five random days per ticker, the same whatever the partitions."""
    return _rounded(sg.random_signals(_flags(spark, d), "hit", n=5).where("hit").select("ticker", "trade_date"))


def _split(spark: SparkSession, d: str, make) -> DataFrame:
    p = panel(spark, d)
    t = sp.split_dates(p, make(sp.count_dates(p)))
    return _rounded(t.groupBy("split", "set_no").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.count(F.lit(1)).cast("int").alias("days")))


def sp_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Windows of sixty dates, thirty apart, cut 45 to 15."""
    return _split(spark, d, lambda n: sp.rolling_ranges(n, 60, step=30, sets=(45, None)))


def sp_expanding(spark: SparkSession, d: str) -> DataFrame:
    """Growing windows, the last ten dates for testing."""
    return _split(spark, d, lambda n: sp.expanding_ranges(n, 50, step=40, sets=(None, 10)))


def sp_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Four walk-forward windows of equal train and test sets, two dates apart."""
    return _split(spark, d, lambda n: sp.walk_forward_ranges(n, 4, 0.5, 2))


def ev_profits(spark: SparkSession, d: str) -> DataFrame:
    """Wins, losses and streaks of each ticker's daily changes."""
    t = panel(spark, d).select("ticker", "trade_date", "pct_chg")
    return _rounded(ev.profit_statistics(t, "ticker", "trade_date", "pct_chg"), profit_factor=4)


def ev_equity(spark: SparkSession, d: str) -> DataFrame:
    """Drawdowns, fit and ratios of each ticker's close as an equity curve."""
    t = panel(spark, d).where("close > 0").select("ticker", "trade_date", "close")
    return _rounded(ev.equity_statistics(t, "ticker", "trade_date", "close"), calmar=4)


def ev_describe(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the daily changes."""
    return _rounded(ev.describe(panel(spark, d), "ticker", "pct_chg"))


def ev_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap intervals of every industry's mean return."""
    r = panel(spark, d).where("industry is not null").groupBy("industry", "trade_date").agg((F.avg("pct_chg") / 100).alias("r"))
    return _rounded(ev.bootstrap_evaluation(r, "industry", "trade_date", "r"))


def ev_rank_of_returns(spark: SparkSession, d: str) -> DataFrame:
    """Average rank of each ticker's total return, and its share of the best."""
    t = panel(spark, d).where("close > 0").groupBy("ticker").agg((F.max_by("close", "trade_date") / F.min_by("close", "trade_date") - 1).alias("total"))
    r = average_rank(t.withColumn("_all", F.lit(1)), ["_all"], "total", "place")
    return _rounded(r.select("ticker", "total", "place", (F.col("place") / F.count(F.lit(1)).over(Window.partitionBy("_all"))).alias("share")))


def rc_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Reductions of each ticker's changes as sparse records."""
    return _rounded(rc.reduce_records(rc.to_records(panel(spark, d), "ticker", "trade_date", "pct_chg"), "ticker", "trade_date", "pct_chg"))


def rc_best(spark: SparkSession, d: str) -> DataFrame:
    """The three largest and three smallest changes of each ticker."""
    r = rc.to_records(panel(spark, d), "ticker", "trade_date", "pct_chg")
    big, small = (rc.best_records(r, "ticker", "trade_date", "pct_chg", 3, k).select("ticker", "rank_no", "trade_date", "pct_chg", F.lit(k).alias("largest")) for k in (True, False))
    return _rounded(big.unionByName(small))


def rc_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each ticker rose, fell and stood still."""
    r = rc.to_records(panel(spark, d), "ticker", "trade_date", "pct_chg")
    return _rounded(rc.value_counts(r, "ticker", F.signum("pct_chg").cast("int")))


def rc_stack(spark: SparkSession, d: str) -> DataFrame:
    """Each ticker's first four changes side by side, its second and its last."""
    r = rc.to_records(panel(spark, d), "ticker", "trade_date", "pct_chg")
    second, last = (rc.nth_record(r, "ticker", "trade_date", n).select("ticker", F.col("pct_chg").alias(k)) for n, k in ((1, "second"), (-1, "last")))
    return _rounded(rc.stack_records(r, "ticker", "trade_date", "pct_chg", 4).join(second, "ticker").join(last, "ticker"))


def az_vwr(spark: SparkSession, d: str) -> DataFrame:
    """Variability-weighted return of each ticker, and its monthly returns."""
    t = panel(spark, d)
    v = rc.variability_weighted_return(t, "ticker", "trade_date", "close", sigma_max=2.0).select("ticker", "annual_log_return", "strayed")
    return _rounded(v.join(rc.period_statistics(t, "ticker", "trade_date", "close", "month"), "ticker"), 5)


def az_excursions(spark: SparkSession, d: str) -> DataFrame:
    """The best and worst each round trip of the crossing stood at."""
    t = _crossing(spark, d)
    trips = pf.trades(t, F.col("up"), F.col("down"))
    return _rounded(rc.trade_excursions(trips, t.where("close > 0"), "ticker", "trade_date", "high", "low").select("ticker", "entry_day", "exit_day", "mfe", "mae"))


def az_account(spark: SparkSession, d: str) -> DataFrame:
    """Key figures of the given-amount accounts against the universe's mean change, and their last leverage."""
    v = pt.account_values(_orders(spark, d), panel(spark, d).withColumn("account", F.col("ticker")), "account", "trade_date", "ticker", "close", 20_000.0)
    b = panel(spark, d).groupBy("trade_date").agg((F.avg("pct_chg") / 100).alias("r"))
    lev = rc.leverage(v, "account", "trade_date").groupBy("account").agg(F.max_by("leverage", "trade_date").alias("leverage"))
    return _rounded(rc.account_metrics(v, "account", "trade_date", "value", b).join(lev, "account").withColumnRenamed("account", "ticker"), 5)


def pt_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Signed amounts and values of the given-amount orders."""
    return _rounded(rc.transactions(_orders(spark, d), "account", "trade_date", "ticker").drop("account"), 8)


_ALL = (
    pt_orders, pt_values, pt_holding, pt_signal_orders, pt_trades, pt_positions, pt_order_statistics, pt_stops, pt_execution, sg_clean, sg_ranks, sg_ranges, sg_partitions, sg_coverage, sg_mask, sg_first_exits, sg_crossed_wait, sg_random,
    sp_rolling, sp_expanding, sp_walk_forward, ev_profits, ev_equity, ev_describe, ev_bootstrap, ev_rank_of_returns, rc_reduce, rc_best, rc_counts, rc_stack, az_vwr, az_excursions, az_account, pt_transactions,
)
QUERIES = {f.__name__: f for f in _ALL}

_W = "(partition by ticker order by trade_date)"
_PAST = "(partition by ticker order by trade_date rows between unbounded preceding and current row)"
_BEFORE = "(partition by ticker order by trade_date rows between unbounded preceding and 1 preceding)"
_D = "strftime(trade_date, '%Y-%m-%d') as trade_day"
_ORD = f"""with {PANEL_SQL}, i as (select ticker, trade_date, close, row_number() over {_W} as i from p),
a as (select *, case when i % 20 = 1 then 100.0 when i % 20 = 11 then -10.0 end as ask from i), f as (select *, count(*) filter (ask > 0 and close > 0) over {_PAST} as bought from a),
o as (select ticker, trade_date, cast(row_number() over {_W} - 1 as integer) as order_no, abs(ask) as size, close * (1 + sign(ask) * 0.001) as price, cast(sign(ask) as integer) as side from f where ask is not null and close > 0 and bought > 0),
ord as (select *, size * price * 0.001 as fees from o)"""
_SIG = f"""with {PANEL_SQL}, m as (select *, case when count(close) over w >= 10 then avg(close) over w end as ma from p window w as (partition by ticker order by trade_date rows between 9 preceding and current row)),
b as (select ticker, trade_date, close, close > ma as above, lag(close > ma) over {_W} as was from m), e as (select *, case when above and not was then 1 when not above and was then -1 end as s from b where close > 0),
k as (select *, coalesce(lag(s) over {_W}, -1) as before from e where s is not null), u as (select *, row_number() over {_W} as n from k where s <> before),
o as (select *, cast(n - 1 as integer) as order_no, close * (1 + s * 0.001) as price from u),
c as (select *, coalesce(sum(case when s = -1 then ln(price * 0.999) else -ln(price * 1.001) end) over {_BEFORE}, 0) as grown from o),
z as (select *, case when s = 1 then ln(1e6) + grown - ln(price * 1.001) else ln(1e6) + grown end as log_size from c),
pairs as (select ticker, (n + 1) // 2 - 1 as k, max(price) filter (s = 1) as entry, max(price) filter (s = -1) as exit from o group by 1, 2),
trades as (select ticker, cast(k as integer) as k, entry, exit, (exit * 0.999 - entry * 1.001) / entry as ret from pairs where exit is not null)"""
_FLAG = f"with {PANEL_SQL}, f as (select ticker, trade_date, coalesce(pct_chg > 0, false) as rise, coalesce(pct_chg < -1, false) as fall, row_number() over {_W} as i, count(*) over (partition by ticker) as total from p)"
_RUNS = _FLAG + f", g as (select *, i - row_number() over {_W} as g from f where rise), r as (select ticker, g, min(trade_date) as a, max(trade_date) as b, count(*) as n, max(i) = any_value(total) as is_open from g group by 1, 2)"
_NEXT = _FLAG + ", n as (select a.ticker, a.trade_date as a, a.i, min(b.trade_date) as b, min(b.i) as j from f a left join f b on a.ticker = b.ticker and b.rise and b.i > a.i where a.fall group by 1, 2, 3)"
_DATES = f"with {PANEL_SQL}, d as (select trade_date, row_number() over (order by trade_date) - 1 as i from (select distinct trade_date from p)), n as (select count(*) as n from d)"
_SETS = "select cast(s as integer) as split, cast(k as integer) as set_no, strftime(min(trade_date), '%Y-%m-%d') as first_day, strftime(max(trade_date), '%Y-%m-%d') as last_day, cast(count(*) as integer) as days from r join d on i between a and b group by 1, 2"

ORACLES = {
    "pt_orders": f"{_ORD} select ticker, {_D}, order_no, size, round(price, 8) as price, round(fees, 8) as fees, side from ord",
    "pt_values": f"""{_ORD}, v as (select p.ticker, p.trade_date, last_value(case when close > 0 then close end ignore nulls) over {_PAST.replace('ticker', 'p.ticker').replace('trade_date', 'p.trade_date')} as known, coalesce(side * size, 0) as q, coalesce(-side * size * price - fees, 0) as cf from p left join ord on p.ticker = ord.ticker and p.trade_date = ord.trade_date),
      s as (select ticker, trade_date, coalesce(known, 0) * sum(q) over {_PAST} as asset_value, 1e9 + sum(cf) over {_PAST} as cash from v), t as (select *, cash + asset_value as value from s)
      select ticker, {_D}, round(cash, 2) as cash, round(asset_value, 2) as asset_value, round(value, 2) as value, round(asset_value / value, 8) as gross_exposure, round(value / coalesce(lag(value) over {_W}, 1e9) - 1, 8) as value_return from t""",
    "pt_holding": f"with {PANEL_SQL}, f as (select * from p where close > 0 qualify row_number() over {_W} = 1) select ticker, {_D}, 0 as order_no, round(1e6 / (close * 1.001 * 1.001), 4) as size, round(close * 1.001, 8) as price, round(1e6 / 1.001 * 0.001, 4) as fees, 1 as side from f",
    "pt_signal_orders": f"{_SIG} select ticker, {_D}, order_no, round(log_size - case when s = -1 then ln(1) else 0 end, 6) as log_size, round(price, 6) as price, round(log_size + ln(price * 0.001), 6) as log_fees, cast(s as integer) as side, case when s = 1 then 'entry' else 'exit' end as reason from z",
    "pt_trades": f"{_SIG} select ticker, k as trade_no, k as position_no, round(entry, 6) as entry_price, round(exit, 6) as exit_price, round(ret, 6) as trade_return from trades",
    "pt_positions": f"""{_SIG}, x as (select *, case when ret > 0 then 1 else 0 end as won, case when ret < 0 then 1 else 0 end as lost from trades), y as (select *, sum(1 - won) over (partition by ticker order by k) as wg, sum(1 - lost) over (partition by ticker order by k) as lg from x)
      select ticker, k as position_no, round(entry, 6) as entry_price, round(exit, 6) as exit_price, round(ret, 6) as position_return, cast(sum(won) over (partition by ticker, wg order by k) as integer) as winning_streak, cast(sum(lost) over (partition by ticker, lg order by k) as integer) as losing_streak from y""",
    "pt_order_statistics": f"{_ORD} select ticker, count(*) as orders, count(*) filter (side = 1) as buys, count(*) filter (side = -1) as sells, max(size) as largest, round(avg(size) filter (side = 1), 4) as mean_buy, round(avg(size) filter (side = -1), 4) as mean_sale, round(avg(price) filter (side = 1), 4) as buy_price, round(avg(price) filter (side = -1), 4) as sale_price, round(sum(fees), 4) as fees, round(sum(size * price), 4) as turnover from ord group by ticker",
    "pt_execution": f"""with {PANEL_SQL}, t as (select * from p where close > 0 and volume > 0), x as (select *, least(5000, floor(volume * 0.025)) as fa, least(5000, floor(volume * 0.1)) as fb, close * 1.0005 as pb, avg(volume) over w as mv, stddev_samp(pct_chg / 100) over w as sd from t window w as (partition by ticker order by trade_date rows between 19 preceding and current row))
      select ticker, {_D}, case when fa > 0 then fa else 0.0 end as filled, round(close * (1 + 0.1 * pow(least(fa / volume, 0.025), 2)), 10) as fill_price, fb as bps_filled, round(pb, 10) as bps_price, round(close * (1 + 0.049 * sd * sqrt(5000 / mv)), 6) as impact_price, round(greatest(fb * 0.001 + fb * pb * 0.0003, 5) + fb * pb * 0.001, 10) as commission from x""",
    "sg_clean": f"{_FLAG}, s as (select *, case when rise and not fall then 1 when fall and not rise then -1 end as s from f), k as (select *, coalesce(lag(s) over {_W}, -1) as before from s where s is not null) select ticker, {_D}, s = 1 as rise, s = -1 as fall from k where s <> before",
    "sg_ranks": _RUNS + f", k as (select ticker, trade_date, row_number() over (partition by ticker, g order by trade_date) - 1 as pos, dense_rank() over (partition by ticker order by g) - 1 as part from g) select f.ticker, strftime(f.trade_date, '%Y-%m-%d') as trade_day, cast(coalesce(pos, -1) as integer) as pos_rank, cast(coalesce(part, -1) as integer) as partition_rank from f left join k using (ticker, trade_date)",
    "sg_ranges": f"{_NEXT} select ticker, strftime(a, '%Y-%m-%d') as start_day, strftime(b, '%Y-%m-%d') as end_day, cast(j - i as double) as rows from n",
    "sg_partitions": f"{_RUNS} select ticker, strftime(a, '%Y-%m-%d') as start_day, strftime(b, '%Y-%m-%d') as end_day, cast(n as integer) as rows, is_open from r",
    "sg_coverage": f"{_RUNS} select f.ticker, round(coalesce(any_value(c.c), 0) / count(*), 6) as coverage from f left join (select ticker, sum(n) as c from r group by 1) c on f.ticker = c.ticker group by 1",
    "sg_mask": f"{_NEXT} select f.ticker, strftime(f.trade_date, '%Y-%m-%d') as trade_day, count(n.a) > 0 as inside from f left join n on n.ticker = f.ticker and f.trade_date >= n.a and (n.b is null or f.trade_date <= n.b) group by 1, 2",
    "sg_first_exits": f"""{_FLAG}, g as (select *, count(*) filter (fall) over {_PAST} as g from f), h as (select *, min(i) over (partition by ticker, g) as i0 from g), x as (select ticker, g, min(i) as j from h where g > 0 and rise and i >= i0 + 2 group by 1, 2),
      y as (select h.ticker, trade_date, x.j is not null as exit, coalesce(lag(fall, 3) over (partition by h.ticker order by trade_date), false) as late from h left join x on x.ticker = h.ticker and x.g = h.g and x.j = h.i) select ticker, {_D}, exit, late from y where exit or late""",
    "sg_crossed_wait": f"""with {PANEL_SQL}, m as (select *, case when count(close) over w >= 10 then avg(close) over w end as ma, row_number() over {_W} as i from p window w as (partition by ticker order by trade_date rows between 9 preceding and current row)),
      a as (select *, i - row_number() over {_W} as g from m where close > ma), r as (select ticker, g, min(i) as i from a group by 1, 2 having count(*) >= 3),
      s as (select r.ticker, r.i, arg_max(case when m.close is null or m.ma is null then 0 when m.close < m.ma then -1 else 1 end, m.i) as side from r join m on m.ticker = r.ticker and m.i < r.i and m.close is distinct from m.ma group by 1, 2)
      select m.ticker, strftime(m.trade_date, '%Y-%m-%d') as trade_day, true as hit from s join m on m.ticker = s.ticker and m.i = s.i + 2 where side = -1""",
    "sp_rolling": f"{_DATES}, r as (select s, k, case when k = 0 then s * 30 else s * 30 + 45 end as a, case when k = 0 then s * 30 + 44 else s * 30 + 59 end as b from n, range(0, (n.n - 60) // 30 + 1) t(s), range(2) u(k)) {_SETS}",
    "sp_expanding": f"{_DATES}, r as (select s, k, case when k = 0 then 0 else 40 + s * 40 end as a, case when k = 0 then 39 + s * 40 else 49 + s * 40 end as b from n, range(0, (n.n - 50) // 40 + 1) t(s), range(2) u(k)) {_SETS}",
    "sp_walk_forward": f"{_DATES}, q as (select n, (n - 2) // 5 as t from n), r as (select s, k, case when k = 1 then n - (4 - s) * t else greatest(n - (4 - s) * t - 2 - t, 0) end as a, case when k = 1 then n - (3 - s) * t - 1 else n - (4 - s) * t - 3 end as b from q, range(4) x(s), range(2) u(k)) {_SETS}",
    "ev_profits": f"""with {PANEL_SQL}, t as (select ticker, trade_date, pct_chg as x, sign(pct_chg) as s from p where pct_chg is not null), n as (select *, case when s is distinct from lag(s) over {_W} then 1 else 0 end as b from t), g as (select *, sum(b) over {_W} as g from n),
      r as (select ticker, coalesce(max(c) filter (s > 0), 0) as most_wins, coalesce(max(c) filter (s < 0), 0) as most_losses from (select ticker, g, any_value(s) as s, count(*) as c from g group by 1, 2) group by 1)
      select t.ticker, count(*) filter (x > 0) as won, count(*) filter (x < 0) as lost, round(100.0 * count(*) filter (x > 0) / nullif(count(*) filter (x <> 0), 0), 6) as win_rate, round(100.0 * count(*) filter (x < 0) / nullif(count(*) filter (x <> 0), 0), 6) as loss_rate, round(coalesce(sum(x) filter (x > 0), 0), 6) as gained, round(coalesce(sum(x) filter (x < 0), 0), 6) as given,
        round(coalesce(avg(x) filter (x > 0), 0), 6) as mean_win, round(coalesce(avg(x) filter (x < 0), 0), 6) as mean_loss, round(coalesce(max(x) filter (x > 0), 0), 6) as largest_win, round(coalesce(min(x) filter (x < 0), 0), 6) as largest_loss, round((1e-10 + coalesce(sum(x) filter (x > 0), 0)) / (1e-10 - coalesce(sum(x) filter (x < 0), 0)), 4) as profit_factor, any_value(most_wins) as most_wins, any_value(most_losses) as most_losses
      from t join r on t.ticker = r.ticker group by 1""",
    "ev_equity": f"""with {PANEL_SQL}, t as (select ticker, trade_date, close as v, cast(row_number() over {_W} as double) as i, max(close) over {_PAST} as peak, close / lag(close) over {_W} - 1 as r, min(close) over (partition by ticker) as lo, max(close) over (partition by ticker) as hi, count(*) over (partition by ticker) as n from p where close > 0),
      b as (select ticker, least(floor(10 * (v - lo) / nullif(hi - lo, 0)), 9) as bin, any_value(n) as n, count(*) as c from t group by 1, 2), h as (select ticker, -sum(c / n * ln(c / n)) / ln(10) as entropy from b group by 1),
      g as (select ticker, min(v - peak) as mdd, min(v / peak - 1) as mddp, regr_r2(v, i) as r2, sqrt(avg(pow(v / peak - 1, 2))) as ulcer, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr, arg_max(v, i) / arg_min(v, i) as grown, count(*) as n, avg(r) as m, stddev_pop(r) as s, stddev_pop(r) filter (r < 0) as sd from t group by 1)
      select g.ticker, round(mdd, 6) as max_drawdown, round(100 * mddp, 6) as max_drawdown_percent, round(r2, 6) as r_squared, round(ulcer, 6) as ulcer, round(iqr, 6) as iqr, round(100 * (grown - 1), 6) as total_return_percent, round(100 * (pow(grown, 252.0 / n) - 1), 6) as annual_return_percent, round(m / case when s > 1e-12 then s end, 6) as sharpe, round(m / case when sd > 1e-12 then sd end, 6) as sortino, round(m * 252 / nullif(abs(mddp), 0), 4) as calmar, round(entropy, 6) as entropy from g join h using (ticker)""",
    "ev_describe": f"with {PANEL_SQL} select ticker, count(pct_chg) as count, round(avg(pct_chg), 6) as mean, round(stddev_samp(pct_chg), 6) as std, round(min(pct_chg), 6) as min, round(quantile_cont(pct_chg, 0.25), 6) as p25, round(quantile_cont(pct_chg, 0.5), 6) as p50, round(quantile_cont(pct_chg, 0.75), 6) as p75, round(max(pct_chg), 6) as max from p group by ticker",
    "ev_rank_of_returns": f"with {PANEL_SQL}, t as (select ticker, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 as total from p where close > 0 group by 1), r as (select *, rank() over (order by total) + (count(*) over (partition by total) - 1) / 2 as place from t) select ticker, round(total, 6) as total, round(place, 6) as place, round(place / count(*) over (), 6) as share from r",
    "rc_reduce": f"with {PANEL_SQL}, t as (select * from p where pct_chg is not null) select ticker, count(*) as n, round(sum(pct_chg), 6) as total, round(avg(pct_chg), 6) as mean, round(stddev_samp(pct_chg), 6) as std, round(stddev_pop(pct_chg), 6) as std_pop, round(min(pct_chg), 6) as least, round(max(pct_chg), 6) as greatest, strftime(arg_min(trade_date, (pct_chg, trade_date)), '%Y-%m-%d') as least_at, strftime(arg_min(trade_date, (-pct_chg, trade_date)), '%Y-%m-%d') as greatest_at, round(arg_min(pct_chg, trade_date), 6) as first_value, round(arg_max(pct_chg, trade_date), 6) as last_value, round(quantile_cont(pct_chg, 0.25), 6) as p25, round(quantile_cont(pct_chg, 0.5), 6) as p50, round(quantile_cont(pct_chg, 0.75), 6) as p75 from t group by ticker",
    "rc_best": f"with {PANEL_SQL}, t as (select * from p where pct_chg is not null), r as (select *, row_number() over (partition by ticker order by pct_chg desc, trade_date) as a, row_number() over (partition by ticker order by pct_chg, trade_date) as b from t) select ticker, cast(a as integer) as rank_no, {_D}, round(pct_chg, 6) as pct_chg, true as largest from r where a <= 3 union all select ticker, cast(b as integer), {_D}, round(pct_chg, 6), false from r where b <= 3",
    "rc_counts": f"with {PANEL_SQL}, g as (select ticker, cast(sign(pct_chg) as integer) as value, count(*) as n from p where pct_chg is not null group by 1, 2) select ticker, value, n, round(n / sum(n) over (partition by ticker), 6) as share, cast(row_number() over (partition by ticker order by n desc, value) as integer) as rank_no from g",
    "rc_stack": f"with {PANEL_SQL}, t as (select ticker, round(pct_chg, 6) as x, row_number() over {_W} as i, count(*) over (partition by ticker) as n from p where pct_chg is not null) select ticker, max(x) filter (i = 1) as v0, max(x) filter (i = 2) as v1, max(x) filter (i = 3) as v2, max(x) filter (i = 4) as v3, max(x) filter (i = 2) as second, max(x) filter (i = n) as last from t group by ticker",
    "az_vwr": f"""with {PANEL_SQL}, t as (select ticker, trade_date, close as v, row_number() over {_W} - 1 as i, first_value(close) over {_W} as f, count(*) over (partition by ticker) as n from p where close > 0), l as (select ticker, ln(arg_max(v, trade_date) / any_value(f)) / (count(*) - 1) as r from t group by 1 having count(*) >= 3),
      s as (select t.ticker, any_value(l.r) * 252 as alr, stddev_samp(v / (f * exp(l.r * i)) - 1) as sd from t join l on t.ticker = l.ticker group by 1), e as (select ticker, date_trunc('month', trade_date) as m, arg_max(v, trade_date) as v, arg_min(v, trade_date) as o from t group by 1, 2), q as (select ticker, v / coalesce(lag(v) over (partition by ticker order by m), o) - 1 as x from e)
      select s.ticker, round(any_value(alr), 5) as annual_log_return, round(any_value(sd), 5) as strayed, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as std, count(*) filter (x > 0) as positive, count(*) filter (x < 0) as negative, count(*) filter (x = 0) as zero, round(max(x), 5) as best, round(min(x), 5) as worst from s join q on q.ticker = s.ticker group by 1""",
    "az_excursions": f"{_SIG}, tr as (select ticker, (n + 1) // 2 as k, max(trade_date) filter (s = 1) as a, max(trade_date) filter (s = -1) as b, max(close) filter (s = 1) as e from u group by 1, 2) select tr.ticker, strftime(a, '%Y-%m-%d') as entry_day, strftime(b, '%Y-%m-%d') as exit_day, round(max(high) / any_value(e) - 1, 6) as mfe, round(min(low) / any_value(e) - 1, 6) as mae from tr join p on p.ticker = tr.ticker and p.close > 0 and p.trade_date between a and b where b is not null group by 1, 2, 3",
    "az_account": f"""{_ORD}, v as (select p.ticker, p.trade_date, last_value(case when close > 0 then close end ignore nulls) over {_PAST.replace('ticker', 'p.ticker').replace('trade_date', 'p.trade_date')} as known, coalesce(side * size, 0) as q, coalesce(-side * size * price - fees, 0) as cf from p left join ord on p.ticker = ord.ticker and p.trade_date = ord.trade_date),
      s as (select ticker, trade_date, coalesce(known, 0) * sum(q) over {_PAST} as av, 20000 + sum(cf) over {_PAST} as cash from v), t as (select *, cash + av as value from s), r as (select *, value / lag(value) over {_W} - 1 as r, max(value) over {_PAST} as peak from t), n as (select *, sum(case when value >= peak then 1 else 0 end) over {_PAST} as era from r), k as (select *, count(*) filter (value < peak) over (partition by ticker, era) as under from n),
      b as (select trade_date, avg(pct_chg) / 100 as b from p group by 1)
      select k.ticker, count(*) as days, round(arg_max(value, k.trade_date) / arg_min(value, k.trade_date) - 1, 5) as total_return, round(pow(arg_max(value, k.trade_date) / arg_min(value, k.trade_date), 252.0 / count(r)) - 1, 5) as annual_return, round(stddev_samp(r) * sqrt(252), 5) as volatility, round(avg(r) / case when stddev_samp(r) > 1e-12 then stddev_samp(r) end * sqrt(252), 5) as sharpe, round(min(value / peak - 1), 5) as max_drawdown, max(under) as drawdown_days,
        round(covar_samp(case when b is not null then r end, case when r is not null then b end) / nullif(var_samp(case when r is not null then b end), 0), 5) as beta, round(avg(r - b), 5) as mean_excess, round(arg_max(av / value, k.trade_date), 5) as leverage from k left join b on b.trade_date = k.trade_date group by 1""",
    "pt_transactions": f"{_ORD} select ticker, {_D}, order_no, side * size as amount, round(price, 8) as price, round(-side * size * price, 8) as value from ord",
}
