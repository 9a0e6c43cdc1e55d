"""Queries of tear sheets, remade bars, the factor store and screens, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import bars, store
from ..operators import tearsheet as ts
from ..operators.versions import latest_version
from ..session import read_table
from .accounts import _rounded
from .formula import evaluate
from .formulas import PANEL_SQL, panel


def _factor(spark: SparkSession, d: str, **options: object) -> DataFrame:
    p = panel(spark, d)
    f = evaluate(p, {"score": "0 - pct_change(close, 5)", "close": "close", "industry": "copy(industry)"})
    return ts.clean_factor(f, "score", "close", (1, 5), group="industry", **options)


def ts_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean factor table, outliers of forward returns set aside."""
    return _rounded(_factor(spark, d, filter_zscore=5.0).select("ticker", "trade_date", "group", "factor", "r1", "r5", "factor_quantile"))


def ts_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins of equal width within date and group, and zero-aware quantiles."""
    a = _factor(spark, d, quantiles=None, bins=4, by_group=True).select("ticker", "trade_date", F.col("factor_quantile").alias("bin"))
    b = _factor(spark, d, quantiles=6, zero_aware=True).select("ticker", "trade_date", F.col("factor_quantile").cast("int").alias("zero_aware"))
    return _rounded(a.join(b, ["ticker", "trade_date"]))


def ts_quantile_means(spark: SparkSession, d: str) -> DataFrame:
    """Group-adjusted mean returns by quantile and group."""
    return _rounded(ts.mean_by_quantile(_factor(spark, d), ["r1"], by_group=True, adjust="group").withColumn("factor_quantile", F.col("factor_quantile").cast("int")), 8)


def ts_spread(spark: SparkSession, d: str) -> DataFrame:
    """Spread of the outer quantiles per date with its joint error."""
    return _rounded(ts.spread_with_error(ts.mean_by_quantile(_factor(spark, d), ["r1"], by_date=True, adjust=None), "r1", 5, 1, ["trade_date"]), 8)


def ts_mean_ic(spark: SparkSession, d: str) -> DataFrame:
    """Mean rank correlation per month and group, returns adjusted for the group."""
    t = ts.demean_returns(_factor(spark, d), ["r1"], ["trade_date", "group"])
    ic = an.information_coefficient(t, "factor", ["r1"], group="group")
    return _rounded(ts.mean_ic(ic, ["ic_r1"], unit="month", group="group"), 8)


def ts_asset_returns(spark: SparkSession, d: str) -> DataFrame:
    """What each asset adds to the factor's return."""
    return _rounded(ts.returns_by_asset(_factor(spark, d), ["r1"]).select("ticker", "trade_date", "weight", "weighted_r1"), 8)


def ts_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative return of the outer quantiles' long-short portfolio."""
    return _rounded(ts.factor_cumulative_returns(_factor(spark, d), 1, quantiles=(1, 5)))


def ts_positions(spark: SparkSession, d: str) -> DataFrame:
    """Shares held when every date's portfolio is kept for five dates."""
    return _rounded(ts.factor_positions(_factor(spark, d), 5), 8)


def ts_account(spark: SparkSession, d: str) -> DataFrame:
    """Cash of a capital of a million behind the factor's portfolio, its daily return and the benchmark's."""
    r, p, b = ts.account_input(_factor(spark, d), 1, capital=1e6)
    return _rounded(p.where("ticker = 'cash'").join(r, "trade_date").join(b, "trade_date").select("trade_date", F.col("position").alias("cash"), "value_return", "benchmark_return"), 6, cash=2)


def br_calendar_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars with every calendar day."""
    t = panel(spark, d).where("close is not null and volume is not null").select("ticker", "trade_date", "open", "close", "volume")
    return _rounded(bars.calendar_days(t, "ticker", "trade_date", ["open", "close"], "close", ["volume"]))


def br_count_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of ten events each."""
    t = bars.count_bars(read_table(spark, d, "events"), "user_id", "ts", "event_id", "value", 10)
    return t.select("user_id", "bar_no", "open", "high", "low", "close", F.col("ticks").cast("int").alias("ticks"))


def br_split(spark: SparkSession, d: str) -> DataFrame:
    """Every bar in two steps."""
    return _rounded(bars.split_bars(panel(spark, d).where("close is not null"), ["ticker", "trade_date"], "open", "high", "low", "close", "volume"))


def br_fill_session(spark: SparkSession, d: str) -> DataFrame:
    """Half-hour bars of events, with one for every half hour of two sessions."""
    e = read_table(spark, d, "events").where("user_id is not null and ts is not null")
    at = F.timestamp_seconds(F.ceil(F.unix_seconds(F.col("ts").cast("timestamp")) / 1800) * 1800)
    t = e.groupBy("user_id", at.alias("bar_time")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("n"))
    t = t.where(bars.in_session(F.col("bar_time"), [("10:00", "11:30"), ("13:30", "15:00")]))
    out = bars.fill_session(t, "user_id", "bar_time", [("09:30", "11:30"), ("13:00", "15:00")], 30, ["close"], "close", ["n"])
    return out.select("user_id", F.date_format("bar_time", "yyyy-MM-dd HH:mm").alias("bar_time"), "close", F.col("n").cast("int").alias("n"), "filled")


def br_dividends(spark: SparkSession, d: str) -> DataFrame:
    """Closes adjusted by ratios of made dividends: two percent of the year's first price at each ticker's fortieth and ninetieth row."""
    p = panel(spark, d).where("close > 0").select("ticker", "trade_date", "close", F.row_number().over(an.Keys().along).alias("i"))
    div = p.where("i in (40, 90)").select("ticker", F.col("trade_date").alias("ex"), (F.col("close") * 0.02).alias("amount"))
    r = bars.dividend_ratios(div, p, "ticker", "ex", "amount", "trade_date", "close")
    return _rounded(bars.apply_ratios(p.select("ticker", "trade_date", (F.col("close") * 0.7310585786).alias("close")), r, "ticker", "trade_date", ["close"]))


def st_missing(spark: SparkSession, d: str) -> DataFrame:
    """Runs of sessions each ticker has no row for."""
    t = read_table(spark, d, "stock_daily_real").where("ticker is not null and trade_date is not null").select("ticker", F.col("trade_date").cast("date").alias("trade_date"))
    return _rounded(store.missing_ranges(t, t, ["ticker"], "trade_date"))


def st_load_days(spark: SparkSession, d: str) -> DataFrame:
    """From which day each listed ticker is to be loaded next."""
    return _rounded(store.next_load_days(read_table(spark, d, "stock_daily_real"), "ticker", "trade_date", read_table(spark, d, "stock_basic"), "2024-01-01"))


def st_load_series(spark: SparkSession, d: str) -> DataFrame:
    """Closes of a quarter and the ten sessions before, carried forward."""
    t = latest_version(read_table(spark, d, "stock_daily_real").where("ticker is not null and trade_date is not null").withColumn("trade_date", F.col("trade_date").cast("date")), ["ticker", "trade_date"], "created_at", ["close"])
    cal = t.select("trade_date").distinct()
    t = t.withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    return _rounded(store.load_series(t, "ticker", "trade_date", ["close"], None, "2024-04-01", "2024-06-30", 10, cal, fill=True))


def st_store(spark: SparkSession, d: str) -> DataFrame:
    """What a factor store holds after every factor was stored up to a day and then upserted whole."""
    v = read_table(spark, d, "factor_values").where("factor_name is not null and ticker is not null and trade_date is not null")
    v = latest_version(v, ["factor_name", "ticker", "trade_date"], "written_at", ["factor_value"])
    v = v.select("factor_name", "ticker", "trade_date", F.when(~F.isnan("factor_value"), F.col("factor_value")).alias("value"))
    s = store.default_store(spark)
    s.upsert(v.where("trade_date < '2024-10-15'"))
    s.upsert(v)
    out = s.read(start="2021-03-02")
    return out.groupBy("factor_name", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_day")).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.round(F.max("value"), 6).alias("greatest"))


def st_screen(spark: SparkSession, d: str) -> DataFrame:
    """Tickers whose fundamentals satisfy text conditions on a day."""
    f = read_table(spark, d, "stock_fundamental").where("ticker is not null and cast(trade_date as date) between '2024-03-01' and '2024-06-30'").distinct()
    t = store.screen_by(f, {"pe": "> 0 and < 60 or == nan", "pb": "!= nan and <= 8", "turnover_rate": ">= 0.5", "absent": "> 1"})
    return _rounded(t.select("ticker", F.col("trade_date").cast("date").alias("trade_date"), F.when(~F.isnan("pb"), F.col("pb")).alias("pb")))


def st_industry_series(spark: SparkSession, d: str) -> DataFrame:
    """Industry of every ticker and month start, with overrides."""
    b = read_table(spark, d, "stock_basic")
    days = panel(spark, d).select(F.trunc("trade_date", "month").alias("trade_date")).distinct()
    over = b.where("ticker like '%.BJ'").select("ticker", F.lit("north").alias("industry"))
    return _rounded(store.industry_series(days, b, b.where("industry is not null"), over).select("ticker", "trade_date", "industry"))


def st_wide(spark: SparkSession, d: str) -> DataFrame:
    """The exchanges' mean closes wide and back to rows."""
    t = panel(spark, d).where("close is not null").groupBy(F.element_at(F.split("ticker", r"\."), 2).alias("exchange"), "trade_date").agg(F.avg("close").alias("close"))
    w = store.wide_table(t, "exchange", "trade_date", "close", ["SH", "SZ", "BJ"])
    return _rounded(store.long_table(w, "trade_date", "exchange", "close"))


def st_holidays(spark: SparkSession, d: str) -> DataFrame:
    """Whether a holiday lies within the ten days after each calendar day."""
    c = read_table(spark, d, "trade_calendar").where("cal_date is not null")
    days = c.select(F.col("cal_date").cast("date").alias("first_day")).distinct().withColumn("last_day", F.date_add("first_day", 10))
    return _rounded(store.holidays_between(days, "first_day", "last_day", c, "cal_date", "is_open").where("has_holiday is not null").select("first_day", "last_day", "has_holiday"))


_ALL = (ts_clean, ts_bins, ts_quantile_means, ts_spread, ts_mean_ic, ts_asset_returns, ts_cumulative, ts_positions, ts_account, br_calendar_days, br_count_bars, br_split, br_fill_session, br_dividends, st_missing, st_load_days, st_load_series, st_store, st_screen, st_industry_series, st_wide, st_holidays)
QUERIES = {f.__name__: f for f in _ALL}

_W = "(partition by ticker order by trade_date)"
_D = "strftime(trade_date, '%Y-%m-%d') as trade_day"
_RAW = f"""with {PANEL_SQL}, f0 as (select ticker, trade_date, industry as grp, -((close - lag(close, 5) over {_W}) / nullif(lag(close, 5) over {_W}, 0)) as factor, lead(close, 1) over {_W} / nullif(close, 0) - 1 as r1, lead(close, 5) over {_W} / nullif(close, 0) - 1 as r5 from p)"""
_CLEAN = _RAW + ", t as (select * from f0 where factor is not null and r1 is not null and r5 is not null and grp is not null)"
_QUANT = ", e as (select *, quantile_cont(factor, [0.2, 0.4, 0.6, 0.8]) over (partition by trade_date) as edges from t), q as (select *, cast(1 + len([x for x in edges if x < factor]) as integer) as fq from e)"
_WEIGHT = ", c as (select *, factor - avg(factor) over (partition by trade_date) as raw from q), w as (select *, raw / nullif(sum(abs(raw)) over (partition by trade_date), 0) as weight from c)"
_CUM = ", dd as (select trade_date, sum(weight * r1) as r from w group by 1), cum as (select trade_date, product(greatest(1 + coalesce(r, 0), 0)) over (order by trade_date) - 1 as cumulative from dd)"

ORACLES = {
    "ts_clean": _RAW + f""", g as (select * from f0 where factor is not null), s as (select avg(r1) as m1, stddev_samp(r1) as s1, avg(r5) as m5, stddev_samp(r5) as s5 from g), t as (select g.* from g, s where grp is not null and abs(r1 - m1) <= 5 * s1 and abs(r5 - m5) <= 5 * s5){_QUANT}
      select ticker, {_D}, grp as "group", round(factor, 6) as factor, round(r1, 6) as r1, round(r5, 6) as r5, fq as factor_quantile from q""",
    "ts_bins": _CLEAN + f""", x as (select *, min(factor) over (partition by trade_date, grp) as lo, max(factor) over (partition by trade_date, grp) as hi, quantile_cont(factor, [1/3, 2/3]) over (partition by trade_date, factor >= 0) as ze from t)
      select ticker, {_D}, cast(case when hi = lo then 2 else least(greatest(ceil((factor - lo) / (hi - lo) * 4), 1), 4) end as integer) as bin, cast(1 + len([e for e in ze if e < factor]) + case when factor >= 0 then 3 else 0 end as integer) as zero_aware from x""",
    "ts_quantile_means": _CLEAN + _QUANT + ", a as (select *, r1 - avg(r1) over (partition by trade_date, grp) as r from q) select fq as factor_quantile, grp as \"group\", round(avg(r), 8) as mean_r1, round(stddev_samp(r) / sqrt(count(r)), 8) as stderr_r1, count(r) as n_r1 from a group by 1, 2",
    "ts_spread": _CLEAN + _QUANT + f", m as (select trade_date, fq, avg(r1) as m, stddev_samp(r1) / sqrt(count(r1)) as s from q group by 1, 2) select {_D}, round(max(m) filter (fq = 5) - max(m) filter (fq = 1), 8) as spread, round(sqrt(pow(max(s) filter (fq = 5), 2) + pow(max(s) filter (fq = 1), 2)), 8) as joint_stderr from m group by trade_date",
    "ts_mean_ic": _CLEAN + """, a as (select *, r1 - avg(r1) over (partition by trade_date, grp) as r from t), k as (select trade_date, grp, rank() over (partition by trade_date, grp order by factor) + (count(*) over (partition by trade_date, grp, factor) - 1) / 2 as x, rank() over (partition by trade_date, grp order by r) + (count(*) over (partition by trade_date, grp, r) - 1) / 2 as y from a),
      i as (select trade_date, grp, case when var_pop(x) * var_pop(y) > 1e-18 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as ic from k group by 1, 2) select strftime(date_trunc('month', trade_date), '%Y-%m-%d') as period, grp as "group", round(avg(ic), 8) as ic_r1 from i group by 1, 2""",
    "ts_asset_returns": _CLEAN + _QUANT + _WEIGHT + f" select ticker, {_D}, round(weight, 8) as weight, round(weight * r1, 8) as weighted_r1 from w",
    "ts_cumulative": _CLEAN + _QUANT.replace(", q as (", ", q0 as (") + ", q as (select * from q0 where fq in (1, 5))" + _WEIGHT + _CUM + f" select {_D}, round(cumulative, 6) as cumulative from cum",
    "ts_positions": _CLEAN + _QUANT + _WEIGHT + f""", i as (select trade_date, row_number() over (order by trade_date) as i from (select distinct trade_date from w)), h as (select ticker, i.i + s.s as i, sum(weight) as s from w join i using (trade_date), range(5) s(s) where weight is not null group by 1, 2)
      select ticker, {_D}, round(s / nullif(sum(abs(s)) over (partition by trade_date), 0), 8) as position from h join i using (i)""",
    "ts_account": _CLEAN + _QUANT + _WEIGHT + _CUM + f""", b as (select trade_date, avg(r1) as b from q group by 1), h as (select trade_date, sum(weight / 1.0) as s, sum(abs(weight)) as a from w group by 1)
      select {_D}, round(1e6 * (1 + cumulative) * (1 - coalesce(s / nullif(a, 0), 0)), 2) as cash, round((1 + cumulative) / coalesce(1 + lag(cumulative) over (order by trade_date), 1) - 1, 6) as value_return, round(b, 6) as benchmark_return from cum join b using (trade_date) join h using (trade_date)""",
    "br_calendar_days": f"""with {PANEL_SQL}, t as (select ticker, trade_date, open, close, volume from p where close is not null and volume is not null), g as (select ticker, cast(unnest(generate_series(min(trade_date), max(trade_date), interval 1 day)) as date) as trade_date from t group by ticker),
      j as (select g.ticker, g.trade_date, open, volume, last_value(close ignore nulls) over (partition by g.ticker order by g.trade_date) as c from g left join t on t.ticker = g.ticker and t.trade_date = g.trade_date) select ticker, {_D}, round(coalesce(open, c), 6) as open, round(c, 6) as close, coalesce(volume, 0) as volume from j""",
    "br_count_bars": "with i as (select *, cast((row_number() over (partition by user_id order by ts, event_id) - 1) // 10 as integer) as bar_no from events where user_id is not null and ts is not null) select user_id, bar_no, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, cast(count(*) as integer) as ticks from i group by 1, 2",
    "br_split": f"with {PANEL_SQL}, t as (select * from p where close is not null) select ticker, {_D}, 0 as step, open, open as high, open as low, open as close, 0.0 as volume from t union all select ticker, {_D}, 1, open, high, low, close, volume from t",
    "br_fill_session": """with b as (select user_id, to_timestamp(ceil(epoch(ts) / 1800) * 1800)::timestamp as bt, arg_max(value, (ts, event_id)) as close, count(*) as n from (select user_id, event_id, value, ts from events where user_id is not null and ts is not null) group by 1, 2),
      k as (select * from b where (hour(bt) * 60 + minute(bt)) between 600 and 690 or (hour(bt) * 60 + minute(bt)) between 810 and 900), g as (select distinct user_id, date_trunc('day', bt)::timestamp + to_minutes(cast(m as integer)) as bt from k, (values (600), (630), (660), (690), (810), (840), (870), (900)) v(m)),
      j as (select g.user_id, g.bt, k.close, n, last_value(k.close ignore nulls) over (partition by g.user_id, date_trunc('day', g.bt) order by g.bt) as c from g left join k on k.user_id = g.user_id and k.bt = g.bt) select user_id, strftime(bt, '%Y-%m-%d %H:%M') as bar_time, c as close, cast(coalesce(n, 0) as integer) as n, close is null as filled from j where c is not null""",
    "br_dividends": f"""with {PANEL_SQL}, t as (select ticker, trade_date, close, row_number() over {_W} as i, lag(close) over {_W} as c1 from p where close > 0), r as (select *, case when i in (40, 90) and 1 - close * 0.02 / c1 > 0 then ln(1 - close * 0.02 / c1) else 0 end as l from t)
      select ticker, {_D}, round(close * 0.7310585786 * exp(coalesce(sum(l) over (partition by ticker order by trade_date rows between 1 following and unbounded following), 0)), 6) as close from r""",
    "st_missing": "with t as (select distinct ticker, cast(trade_date as date) as d from stock_daily_real where ticker is not null and trade_date is not null), s as (select d, row_number() over (order by d) as i from (select distinct d from t)), g as (select k.ticker, s.d, s.i from (select distinct ticker from t) k cross join s where not exists (select 1 from t where t.ticker = k.ticker and t.d = s.d)), r as (select *, i - row_number() over (partition by ticker order by i) as g from g) select ticker, strftime(min(d), '%Y-%m-%d') as first_day, strftime(max(d), '%Y-%m-%d') as last_day, cast(count(*) as integer) as days from r group by ticker, g",
    "st_load_days": "select b.ticker, strftime(coalesce(max(cast(trade_date as date)) + 1, date '2024-01-01'), '%Y-%m-%d') as load_from from (select distinct ticker from stock_basic where ticker is not null) b left join stock_daily_real r on r.ticker = b.ticker group by 1",
    "st_load_series": f"""with t as (select ticker, cast(trade_date as date) as trade_date, case when isnan(close) then null else close end as close from stock_daily_real where ticker is not null and trade_date is not null qualify row_number() over (partition by ticker, cast(trade_date as date) order by created_at desc nulls last) = 1),
      b as (select min(trade_date) as b from (select distinct trade_date from t where trade_date < date '2024-04-01' order by 1 desc limit 10)), s as (select t.* from t, b where trade_date between b and date '2024-06-30') select ticker, {_D}, round(last_value(close ignore nulls) over (partition by ticker order by trade_date), 6) as close from s""",
    "st_store": "with h as (select factor_name, ticker, trade_date, case when isnan(factor_value) then null else factor_value end as v from factor_values where factor_name is not null and ticker is not null and trade_date is not null qualify row_number() over (partition by factor_name, ticker, trade_date order by written_at desc nulls last) = 1) select factor_name, strftime(trade_date, '%Y-%m-%d') as trade_day, count(*) as n, count(v) as known, round(max(v), 6) as greatest from h where trade_date >= date '2021-03-02' group by 1, 2",
    "st_screen": f"select distinct ticker, {_D}, round(case when isnan(pb) then null else pb end, 6) as pb from stock_fundamental where ticker is not null and cast(trade_date as date) between date '2024-03-01' and date '2024-06-30' and (pe is null or isnan(pe) or (pe > 0 and pe < 60)) and pb is not null and not isnan(pb) and pb <= 8 and turnover_rate is not null and not isnan(turnover_rate) and turnover_rate >= 0.5",
    "st_industry_series": f"with {PANEL_SQL}, d as (select distinct date_trunc('month', trade_date) as trade_date from p), b as (select ticker, min(industry) as i, max(case when ticker like '%.BJ' then 'north' end) as o from stock_basic where ticker is not null group by 1) select ticker, {_D}, coalesce(o, i, 'unclassified') as industry from b cross join d",
    "st_wide": f"with {PANEL_SQL} select strftime(trade_date, '%Y-%m-%d') as trade_day, split_part(ticker, '.', 2) as exchange, round(avg(close), 6) as close from p where close is not null and split_part(ticker, '.', 2) in ('SH', 'SZ', 'BJ') group by trade_date, 2",
    "st_holidays": "with c as (select cast(cal_date as date) as d, max(is_open) as o from trade_calendar where cal_date is not null group by 1), k as (select d from c where o = 0 and isodow(d) < 6) select strftime(c.d, '%Y-%m-%d') as first_day, strftime(c.d + 10, '%Y-%m-%d') as last_day, exists (select 1 from k where k.d between c.d and c.d + 10) as has_holiday from c where c.d + 10 in (select d from c)",
}
