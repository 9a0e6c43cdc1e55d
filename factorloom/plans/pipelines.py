"""Queries of the pipeline terms and of estimates as of each date, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimates as es
from ..operators import pipeline as pl
from ..operators.asof import day_number
from ..session import read_table
from .formulas import PANEL_SQL, panel

G = pl.Grid()


def _run(spark: SparkSession, d: str, columns: dict[str, pl.Term], screen: pl.Filter | None = None, digits: int = 6, **dates: str) -> DataFrame:
    out = pl.Pipeline(columns, screen).run(panel(spark, d), **dates)
    return out.select("ticker", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_day"), *[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes if n in columns])


def _f(name: str) -> pl.Factor:
    return G.factor(name)


def pp_composed(spark: SparkSession, d: str) -> DataFrame:
    """Terms put on terms: a standard score of a demeaned mean, within a screen of its quintile, for two months."""
    ind = G.classifier("industry")
    mean = _f("close").sma(5)
    score = mean.demean(group=ind).zscore()
    return _run(spark, d, {"score": score, "quintile": mean.quintiles(), "decile": score.deciles()}, score.rank() <= 20, start="2024-04-01", end="2024-05-31")


def pp_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the date's closes, and each close's distance from them."""
    x = _f("close")
    return _run(spark, d, {**{k: x.summary(k) for k in ("mean", "stddev", "min", "max", "median", "count")}, "above": x - x.summary("median")})


def pp_winsorize(spark: SparkSession, d: str) -> DataFrame:
    """Closes winsorised per date and per industry."""
    return _run(spark, d, {"all_names": _f("close").winsorize(0.1, 0.9), "by_industry": _f("close").winsorize(0.25, 0.75, group=G.classifier("industry"))})


def pp_along(spark: SparkSession, d: str) -> DataFrame:
    """Factors along each asset's rows."""
    c, v = _f("close"), _f("volume")
    return _run(spark, d, {
        "returns": c.returns(6), "percent_change": c.percent_change(6), "vwap": c.weighted_average(v, 10), "dollar_volume": c.average_dollar_volume(v, 10) / 1e6, "max_drawdown": c.max_drawdown(10), "volatility": _f("pct_chg").annualized_volatility(20),
        "ewma": c.ewma(10, pl.decay_of(span=9)), "linear": c.linear_weighted_average(10), "present": c.all_present(5), "positive": (_f("pct_chg") > 0).all_of(3), "one_positive": (_f("pct_chg") > 0).any_of(3), "two_positive": (_f("pct_chg") > 0).at_least(2, 3),
    })


def pp_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Correlation, regression and beta against the universe's mean change."""
    r = _f("pct_chg")
    m = r.summary("mean")
    reg = r.linear_regression(m, 20)
    return _run(spark, d, {"pearson": r.pearsonr(m, 20), "beta": r.beta(m, 20), **{k: reg[k] for k in ("alpha", "r_value", "stderr")}}, digits=5)


def pp_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation with, and p-value of the regression on, the universe's mean change."""
    r = _f("pct_chg")
    m = r.summary("mean")
    return _run(spark, d, {"spearman": r.spearmanr(m, 15), "p_value": r.linear_regression(m, 20)["p_value"]})


def pp_filters(spark: SparkSession, d: str) -> DataFrame:
    """The best name of each industry, exclusive or, choices and downsampling."""
    c, r = _f("close"), _f("pct_chg")
    best = c.maximum(group=G.classifier("industry"))
    return _run(spark, d, {"best": best, "odd": best ^ (r > 0), "chosen": (r > 0).if_else(c, -c), "weekly": c.downsample("week"), "monthly_rank": c.downsample("month").rank(), "relative": c / c.slice("123457.SH"), "squared": (r**2 + 1).apply("log1p")})


def pp_sampling(spark: SparkSession, d: str) -> DataFrame:
    """First sessions of months, and the assets alive on them."""
    days = pl.sampling_dates(panel(spark, d).select("trade_date").distinct(), "trade_date", "month")
    basic = read_table(spark, d, "stock_basic").where("ticker is not null").select("ticker", "list_date", "delist_date").distinct()
    return pl.root_mask(days, basic, "trade_date", "ticker", "list_date", "delist_date").select("ticker", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_day"))


def _reports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = read_table(spark, d, "stock_income").where("ticker is not null and f_ann_date is not null and end_date is not null and report_type = '1'")
    end = F.col("end_date").cast("date")
    i = i.select("ticker", day_number(F.col("f_ann_date")).alias("known"), es.quarter_number(F.year(end), F.quarter(end)).alias("quarter"), (day_number(end) + 200).alias("event"), F.col("basic_eps").alias("eps"))
    return read_table(spark, d, "stock_fundamental").select("ticker", day_number(F.col("trade_date")).alias("day")), i.where("eps is not null and not isnan(eps)")


def _quarters(spark: SparkSession, d: str, forward: bool) -> DataFrame:
    days, est = _reports(spark, d)
    q = es.quarters_as_of(days, est, "ticker", "day", "known", "quarter", "event", ["eps"], (1, 2), forward)
    return q.select("ticker", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("trade_day"), F.col("q1").cast("double").alias("q1"), F.round("eps_1", 6).alias("eps_1"), F.col("q2").cast("double").alias("q2"), F.round("eps_2", 6).alias("eps_2"))


def es_next_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Earnings of the next two quarters whose event (200 days after their end) is still ahead, as known each day."""
    return _quarters(spark, d, True)


def es_previous_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Earnings of the last two quarters whose event has passed, as known each day."""
    return _quarters(spark, d, False)


def _events(spark: SparkSession, d: str, forward: bool) -> DataFrame:
    days, est = _reports(spark, d)
    e = es.events_as_of(days, est, "ticker", "day", "known", "event", ["eps"], forward)
    day = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return e.select("ticker", day("day").alias("trade_day"), day("event").alias("event_day"), F.round("eps", 6).alias("eps"))


def es_next_event(spark: SparkSession, d: str) -> DataFrame:
    """The next event announced by each day."""
    return _events(spark, d, True)


def es_previous_event(spark: SparkSession, d: str) -> DataFrame:
    """The last event before each day among those announced."""
    return _events(spark, d, False)


QUERIES = {f.__name__: f for f in (pp_composed, pp_summaries, pp_winsorize, pp_along, pp_statistics, pp_p_values, pp_filters, pp_sampling, es_next_quarters, es_previous_quarters, es_next_event, es_previous_event)}

_D = "strftime(trade_date, '%Y-%m-%d') as trade_day"
_DAY, _P = "(partition by trade_date)", "(partition by ticker order by trade_date)"


def _w(n: int) -> str:
    return f"(partition by ticker order by trade_date rows between {n - 1} preceding and current row)"


def _bucket(x: str, n: int) -> str:
    return f"cast(case when {x} is not null then len([e for e in quantile_cont({x}, [{', '.join(str(i / n) for i in range(1, n))}]) over {_DAY} if e < {x}]) else -1 end as integer)"


_DECAY = [0.8 ** (10 - i) for i in range(10)]
_EWMA = " + ".join(f"{w / sum(_DECAY)!r} * " + (f"lag(close, {9 - i}) over {_P}" if i < 9 else "close") for i, w in enumerate(_DECAY))
_LINEAR = " + ".join(f"{i + 1} * coalesce(" + (f"lag(close, {9 - i}) over {_P}" if i < 9 else "close") + ", 0)" for i in range(10))
_FALL = "list_max([list_max(l[1:i]) - l[i] for i in range(1, len(l) + 1)])"
_EST = """d as (select distinct ticker, cast(trade_date as date) as day from stock_fundamental where ticker is not null and trade_date is not null),
e as (select distinct ticker, cast(f_ann_date as date) as known, cast(year(end_date) * 4 + quarter(end_date) - 1 as integer) as q, cast(end_date as date) + 200 as event, basic_eps as eps from stock_income where ticker is not null and f_ann_date is not null and end_date is not null and report_type = '1' and basic_eps is not null and not isnan(basic_eps))"""


def _quarters_sql(forward: bool) -> str:
    side, pick, sign = (">=", "arg_min(q, (event, q))", "+") if forward else ("<", "arg_max(q, (event, q))", "-")
    return f"""with {_EST}, k as (select d.ticker, d.day, e.q, e.event, e.eps from d join e on e.ticker = d.ticker and e.known <= d.day qualify row_number() over (partition by d.ticker, d.day, e.q order by e.known desc, e.event desc, e.eps desc) = 1),
n as (select ticker, day, {pick} filter (event {side} day) as near from k group by 1, 2)
select d.ticker, strftime(d.day, '%Y-%m-%d') as trade_day, cast(n.near as double) as q1, round(a.eps, 6) as eps_1, cast(n.near {sign} 1 as double) as q2, round(b.eps, 6) as eps_2
from d left join n using (ticker, day) left join k a on a.ticker = d.ticker and a.day = d.day and a.q = n.near left join k b on b.ticker = d.ticker and b.day = d.day and b.q = n.near {sign} 1"""


ORACLES = {
    "pp_composed": f"""with {PANEL_SQL}, m as (select *, avg(close) over {_w(5)} as m from p), c as (select *, m - avg(m) over (partition by trade_date, industry) as c from m), z as (select *, (c - avg(c) over {_DAY}) / case when stddev_pop(c) over {_DAY} > 1e-12 then stddev_pop(c) over {_DAY} end as score, quantile_cont(m, [0.2, 0.4, 0.6, 0.8]) over {_DAY} as qe from c),
      y as (select *, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) over {_DAY} as de, row_number() over (partition by trade_date order by score nulls last, ticker) as r from z)
      select ticker, {_D}, round(score, 6) as score, cast(case when m is not null then len([e for e in qe if e < m]) else -1 end as integer) as quintile, cast(case when score is not null then len([e for e in de if e < score]) else -1 end as integer) as decile from y where score is not null and r <= 20 and trade_date between date '2024-04-01' and date '2024-05-31'""",
    "pp_summaries": f"with {PANEL_SQL} select ticker, {_D}, round(avg(close) over w, 6) as mean, round(stddev_pop(close) over w, 6) as stddev, round(min(close) over w, 6) as min, round(max(close) over w, 6) as max, round(median(close) over w, 6) as median, cast(count(close) over w as double) as count, round(close - median(close) over w, 6) as above from p window w as {_DAY}",
    "pp_winsorize": f"""with {PANEL_SQL}, a as (select *, list_sort(list(close) filter (close is not null) over {_DAY}) as l, list_sort(list(close) filter (close is not null) over (partition by trade_date, industry)) as g from p)
      select ticker, {_D}, round(case when close is not null then greatest(least(close, l[cast(ceil(len(l) * 0.9) as bigint)]), l[cast(floor(len(l) * 0.1) as bigint) + 1]) end, 6) as all_names, round(case when close is not null then greatest(least(close, g[cast(greatest(ceil(len(g) * 0.75), 1) as bigint)]), g[cast(floor(len(g) * 0.25) as bigint) + 1]) end, 6) as by_industry from a""",
    "pp_along": f"""with {PANEL_SQL}, x as (select *, list(close) filter (close is not null) over {_w(10)} as l, cast(coalesce(pct_chg > 0, false) as integer) as up from p),
      y as (select *, {_FALL} as fall, [l[i] for i in range(1, len(l) + 1) if list_max(l[1:i]) - l[i] = {_FALL}] as ends from x)
      select ticker, {_D}, round(close / nullif(lag(close, 5) over {_P}, 0) - 1, 6) as returns, round((close - lag(close, 5) over {_P}) / nullif(abs(lag(close, 5) over {_P}), 0), 6) as percent_change, round(sum(close * volume) over {_w(10)} / nullif(sum(volume) over {_w(10)}, 0), 6) as vwap, round(coalesce(sum(close * volume) over {_w(10)}, 0) / 10 / 1e6, 6) as dollar_volume,
        round(case when len(l) > 0 then case when fall > 0 then coalesce(fall / nullif(ends[1], 0), 0) else 0 end end, 6) as max_drawdown, round(stddev_pop(pct_chg) over {_w(20)} * sqrt(252), 6) as volatility, round(case when count(close) over {_w(10)} = 10 then {_EWMA} end, 6) as ewma, round(case when count(*) over {_w(10)} = 10 then ({_LINEAR}) / 55 end, 6) as linear,
        count(close) over {_w(5)} = 5 as present, sum(up) over {_w(3)} >= 3 as positive, sum(up) over {_w(3)} >= 1 as one_positive, sum(up) over {_w(3)} >= 2 as two_positive from y""",
    "pp_statistics": f"""with {PANEL_SQL}, m as (select *, pct_chg as y, avg(pct_chg) over {_DAY} as x from p), s as (select *, case when y is not null and x is not null then y end as y0, case when y is not null and x is not null then x end as x0 from m),
      q as (select ticker, trade_date, count(y + x) over w as n, count(*) over w as rows, var_pop(x) over w as vx, var_pop(y) over w as vy, covar_pop(y, x) over w as c, avg(y) over w as my, avg(x) over w as mx, count(y0) over w as k, covar_pop(y0, x0) over w as c0, var_pop(x0) over w as v0 from s window w as {_w(20)}),
      r as (select *, case when n >= 20 and vx * vy > 1e-18 then c / sqrt(vx * vy) end as r from q)
      select ticker, {_D}, round(r, 5) as pearson, round(case when rows >= 20 and 20 - k <= 5 then c0 / case when v0 > 1e-18 then v0 end end, 5) as beta, round(case when n >= 20 and vx > 1e-18 then my - c / vx * mx end, 5) as alpha, round(case when n >= 20 and vx > 1e-18 and vy > 1e-18 then c / sqrt(vx * vy) end, 5) as r_value, round(case when n >= 20 and vx > 1e-18 and vy > 1e-18 then sqrt(greatest(1 - r * r, 0) * vy / vx / 18) end, 5) as stderr from r""",
    "pp_filters": f"""with {PANEL_SQL}, b as (select *, close is not null and row_number() over (partition by trade_date, industry order by close desc nulls last, ticker) = 1 as best, first_value(close) over (partition by ticker, date_trunc('week', trade_date) order by trade_date) as weekly, first_value(close) over (partition by ticker, date_trunc('month', trade_date) order by trade_date) as monthly, max(case when ticker = '123457.SH' then close end) over {_DAY} as base from p)
      select ticker, {_D}, best, best <> coalesce(pct_chg > 0, false) as odd, round(case when pct_chg > 0 then close else -close end, 6) as chosen, round(weekly, 6) as weekly, case when monthly is not null then cast(row_number() over (partition by trade_date order by monthly nulls last, ticker) as double) end as monthly_rank, round(close / nullif(base, 0), 6) as relative, round(ln(pct_chg * pct_chg + 2), 6) as squared from b""",
    "pp_sampling": f"with {PANEL_SQL}, d as (select min(trade_date) as trade_date from p group by date_trunc('month', trade_date)) select distinct ticker, {_D} from d join stock_basic b on b.ticker is not null and (list_date is null or cast(list_date as date) <= trade_date) and (delist_date is null or cast(delist_date as date) >= trade_date)",
    "es_next_quarters": _quarters_sql(True),
    "es_previous_quarters": _quarters_sql(False),
    "es_next_event": f"with {_EST}, j as (select d.ticker, d.day, min((event, eps)) as e from d join e on e.ticker = d.ticker and e.known <= d.day and e.event >= d.day group by 1, 2) select d.ticker, strftime(d.day, '%Y-%m-%d') as trade_day, strftime(e[1], '%Y-%m-%d') as event_day, round(e[2], 6) as eps from d left join j using (ticker, day)",
    "es_previous_event": f"with {_EST}, j as (select d.ticker, d.day, event, eps from d join e on e.ticker = d.ticker and greatest(e.known, e.event) <= d.day qualify row_number() over (partition by d.ticker, d.day order by event desc, eps desc) = 1) select d.ticker, strftime(d.day, '%Y-%m-%d') as trade_day, strftime(event, '%Y-%m-%d') as event_day, round(eps, 6) as eps from d left join j using (ticker, day)",
}
