"""Queries of factor analytics on a five-day reversal factor, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as an
from .formula import evaluate
from .formulas import PANEL_SQL, panel

RETURNS = ["r1", "r5"]


def _table(spark: SparkSession, d: str) -> DataFrame:
    """ticker, trade_date, factor, r1, r5, close, industry, factor_quantile."""
    p = panel(spark, d)
    f = evaluate(p, {"factor": "0 - pct_change(close, 5)", "close": "close", "volume": "volume", "industry": "copy(industry)"})
    return an.quantile_bucket(an.forward_returns(f, "close", (1, 5)), "factor", 5)


def _out(df: DataFrame, **digits: int) -> DataFrame:
    """Dates as text, doubles rounded."""
    cols = []
    for n, t in df.dtypes:
        c = F.date_format(n, "yyyy-MM-dd").alias("trade_day") if n == "trade_date" else F.round(n, digits.get(n, 8)).alias(n) if t == "double" else F.col(n)
        cols.append(c)
    return df.select(*cols)


_T = f"""with {PANEL_SQL},
f as (select ticker, trade_date, close, volume, industry,
    -((close - lag(close, 5) over w) / nullif(lag(close, 5) over w, 0)) as factor,
    lead(close, 1) over w / nullif(close, 0) - 1 as r1, lead(close, 5) over w / nullif(close, 0) - 1 as r5
  from p window w as (partition by ticker order by trade_date)),
e as (select *, quantile_cont(factor, [0.2, 0.4, 0.6, 0.8]) over (partition by trade_date) as edges from f),
t as (select ticker, trade_date, close, volume, industry, factor, r1, r5, case when factor is not null then 1 + len([x for x in edges if x < factor]) end as factor_quantile from e)
"""
_DAY = "strftime(trade_date, '%Y-%m-%d') as trade_day"


def an_forward_returns(spark: SparkSession, d: str) -> DataFrame:
    """Forward returns of one and five rows."""
    return _out(_table(spark, d).select("ticker", "trade_date", "r1", "r5"))


def an_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantile of each name's factor within its date."""
    return _out(_table(spark, d).where("factor_quantile is not null").select("ticker", "trade_date", F.col("factor_quantile").cast("int").alias("factor_quantile")))


def an_ic_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank information coefficient per date."""
    return _out(an.information_coefficient(_table(spark, d), "factor", RETURNS))


def an_ic_pearson(spark: SparkSession, d: str) -> DataFrame:
    """Linear information coefficient per date."""
    return _out(an.information_coefficient(_table(spark, d), "factor", RETURNS, method="pearson"))


def an_ic_mean_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Mean rank information coefficient per month."""
    ic = an.information_coefficient(_table(spark, d), "factor", ["r1"])
    return _out(ic.groupBy(F.date_format("trade_date", "yyyy-MM").alias("month")).agg(F.avg("ic_r1").alias("mean_ic")))


def an_factor_weights(spark: SparkSession, d: str) -> DataFrame:
    """Dollar-neutral weights."""
    return _out(an.factor_weights(_table(spark, d), "factor").select("ticker", "trade_date", "weight"))


def an_factor_returns(spark: SparkSession, d: str) -> DataFrame:
    """Return of the factor portfolio per date."""
    return _out(an.factor_returns(an.factor_weights(_table(spark, d), "factor"), RETURNS))


def an_alpha_beta(spark: SparkSession, d: str) -> DataFrame:
    """Annualised alpha and beta of the factor portfolio."""
    return _out(an.alpha_beta(an.factor_weights(_table(spark, d), "factor"), "r1"), ann_alpha=5)


def an_quantile_returns(spark: SparkSession, d: str) -> DataFrame:
    """Mean demeaned return and standard error per quantile."""
    q = an.mean_return_by_quantile(_table(spark, d), RETURNS)
    return _out(q.withColumn("factor_quantile", F.col("factor_quantile").cast("int")))


def an_quantile_spread(spark: SparkSession, d: str) -> DataFrame:
    """Top less bottom quantile return per date."""
    return _out(an.quantile_spread(an.mean_return_by_quantile(_table(spark, d), ["r1"], demeaned=False, by_date=True), "r1", 5, 1))


def an_quantile_turnover(spark: SparkSession, d: str) -> DataFrame:
    """Turnover of the top quantile."""
    return _out(an.quantile_turnover(_table(spark, d), 5, 1))


def an_rank_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation of the factor's ranks."""
    return _out(an.rank_autocorrelation(_table(spark, d), "factor", 1))


def an_cumulative_returns(spark: SparkSession, d: str) -> DataFrame:
    """Net value of the factor portfolio."""
    daily = an.factor_returns(an.factor_weights(_table(spark, d), "factor"), ["r1"])
    return _out(an.cumulative_returns(daily, "factor_r1").select("trade_date", "cumulative"), cumulative=6)


def an_event_study(spark: SparkSession, d: str) -> DataFrame:
    """Returns around the dates a name is in the top or bottom quantile."""
    t = _table(spark, d)
    ev = t.where("factor_quantile in (1, 5)").select("ticker", "trade_date", F.col("factor_quantile").cast("int").alias("bucket"))
    return _out(an.event_study(ev, t, "close", 5, 5))


def an_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions when weights are held for five dates."""
    return _out(an.overlapping_positions(an.factor_weights(_table(spark, d), "factor"), 5))


def an_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Performance of the factor portfolio against the universe's mean."""
    w = an.factor_weights(_table(spark, d), "factor")
    daily = w.groupBy("trade_date").agg(F.sum(F.col("weight") * F.col("r1")).alias("account"), F.avg("r1").alias("benchmark"))
    return _out(an.strategy_metrics(daily, "account", "benchmark"), annual_rate=6, benchmark_rate=5, alpha=5)


QUERIES = {f.__name__: f for f in (an_forward_returns, an_quantiles, an_ic_spearman, an_ic_pearson, an_ic_mean_by_month, an_factor_weights, an_factor_returns, an_alpha_beta, an_quantile_returns, an_quantile_spread, an_quantile_turnover, an_rank_autocorrelation, an_cumulative_returns, an_event_study, an_positions, an_metrics)}


def _ic(r: str, ranks: bool) -> str:
    src = f"(select * from t where factor is not null and {r} is not null)"
    if ranks:
        src = f"(select trade_date, rank() over (partition by trade_date order by factor) + (count(*) over (partition by trade_date, factor) - 1) / 2 as a, rank() over (partition by trade_date order by {r}) + (count(*) over (partition by trade_date, {r}) - 1) / 2 as b from {src})"
    a, b = ("a", "b") if ranks else ("factor", r)
    return f"(select trade_date, case when var_pop({a}) * var_pop({b}) > 1e-18 then covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) end as ic_{r} from {src} group by trade_date)"


_W = "w as (select *, raw / nullif(sum(abs(raw)) over (partition by trade_date), 0) as weight from (select *, factor - avg(factor) over (partition by trade_date) as raw from t))"
_FR = "fr as (select trade_date, sum(weight * r1) as account, avg(r1) as benchmark from w group by trade_date)"
_IDX = "idx as (select trade_date, row_number() over (order by trade_date) - 1 as i from (select distinct trade_date from t))"

ORACLES = {
    "an_forward_returns": f"{_T} select ticker, {_DAY}, round(r1, 8) as r1, round(r5, 8) as r5 from t",
    "an_quantiles": f"{_T} select ticker, {_DAY}, cast(factor_quantile as integer) as factor_quantile from t where factor_quantile is not null",
    "an_ic_spearman": f"{_T} select strftime(coalesce(a.trade_date, b.trade_date), '%Y-%m-%d') as trade_day, round(ic_r1, 8) as ic_r1, round(ic_r5, 8) as ic_r5 from {_ic('r1', True)} a full join {_ic('r5', True)} b on a.trade_date = b.trade_date",
    "an_ic_pearson": f"{_T} select strftime(coalesce(a.trade_date, b.trade_date), '%Y-%m-%d') as trade_day, round(ic_r1, 8) as ic_r1, round(ic_r5, 8) as ic_r5 from {_ic('r1', False)} a full join {_ic('r5', False)} b on a.trade_date = b.trade_date",
    "an_ic_mean_by_month": f"{_T} select strftime(trade_date, '%Y-%m') as month, round(avg(ic_r1), 8) as mean_ic from {_ic('r1', True)} a group by 1",
    "an_factor_weights": f"{_T}, {_W} select ticker, {_DAY}, round(weight, 8) as weight from w",
    "an_factor_returns": f"{_T}, {_W} select {_DAY}, round(sum(weight * r1), 8) as factor_r1, round(sum(weight * r5), 8) as factor_r5 from w group by trade_date",
    "an_alpha_beta": f"{_T}, {_W}, {_FR} select round(pow(1 + regr_intercept(account, benchmark), 252) - 1, 5) as ann_alpha, round(regr_slope(account, benchmark), 8) as beta from fr where account is not null and benchmark is not null",
    "an_quantile_returns": f"{_T}, q as (select trade_date, factor_quantile, avg(r1) as r1, avg(r5) as r5 from (select trade_date, factor_quantile, r1 - avg(r1) over (partition by trade_date) as r1, r5 - avg(r5) over (partition by trade_date) as r5 from t where factor_quantile is not null) group by 1, 2) select cast(factor_quantile as integer) as factor_quantile, round(avg(r1), 8) as mean_r1, round(stddev_samp(r1) / sqrt(count(r1)), 8) as stderr_r1, round(avg(r5), 8) as mean_r5, round(stddev_samp(r5) / sqrt(count(r5)), 8) as stderr_r5 from q group by 1",
    "an_quantile_spread": f"{_T}, q as (select trade_date, factor_quantile, avg(r1) as r1 from t where factor_quantile is not null group by 1, 2) select {_DAY}, round(max(case when factor_quantile = 5 then r1 end) - max(case when factor_quantile = 1 then r1 end), 8) as spread from q group by trade_date",
    "an_quantile_turnover": f"{_T}, {_IDX}, m as (select ticker, t.trade_date, i from t join idx using (trade_date) where factor_quantile = 5) select strftime(m.trade_date, '%Y-%m-%d') as trade_day, round(1 - count(b.ticker) / count(*), 8) as turnover from m left join m b on b.ticker = m.ticker and b.i = m.i - 1 where m.i >= 1 group by m.trade_date",
    "an_rank_autocorrelation": f"{_T}, {_IDX}, m as (select ticker, t.trade_date, i, rank() over (partition by trade_date order by factor) + (count(*) over (partition by trade_date, factor) - 1) / 2 as r from t join idx using (trade_date) where factor is not null) select strftime(m.trade_date, '%Y-%m-%d') as trade_day, round(case when var_pop(m.r) * var_pop(b.r) > 1e-18 then covar_pop(m.r, b.r) / sqrt(var_pop(m.r) * var_pop(b.r)) end, 8) as autocorrelation from m join m b on b.ticker = m.ticker and b.i = m.i - 1 group by m.trade_date",
    "an_cumulative_returns": f"{_T}, {_W}, {_FR} select {_DAY}, round(product(1 + coalesce(account, 0)) over (order by trade_date rows between unbounded preceding and current row), 6) as cumulative from fr",
    "an_event_study": f"{_T}, n as (select ticker, trade_date, close, factor_quantile, row_number() over (partition by ticker order by trade_date) as i from t), o as (select ticker, factor_quantile as bucket, close as base, i, unnest(generate_series(-5, 5)) as off from n where factor_quantile in (1, 5)) select cast(bucket as integer) as bucket, cast(off as integer) as \"offset\", round(avg(n.close / nullif(base, 0) - 1), 8) as mean, round(stddev_samp(n.close / nullif(base, 0) - 1), 8) as std, count(n.close / nullif(base, 0) - 1) as n from o join n on n.ticker = o.ticker and n.i = o.i + off group by 1, 2",
    "an_positions": f"{_T}, {_W}, {_IDX}, h as (select ticker, weight, i + k as i from w join idx using (trade_date), (select unnest(generate_series(0, 4)) as k) where weight is not null) select h.ticker, strftime(idx.trade_date, '%Y-%m-%d') as trade_day, round(sum(weight) / 5, 8) as position from h join idx on h.i = idx.i group by 1, 2",
    "an_metrics": f"""{_T}, {_W}, {_FR}, v as (select *, product(1 + account) over (order by trade_date rows between unbounded preceding and current row) as nav from fr where account is not null and benchmark is not null),
      dd as (select *, 1 - nav / max(nav) over (order by trade_date rows between unbounded preceding and current row) as dd from v),
      a as (select pow(product(1 + account), 252 / (count(*) + 1)) - 1 as ar, pow(product(1 + benchmark), 252 / (count(*) + 1)) - 1 as br, covar_samp(account, benchmark) / var_samp(benchmark) as beta,
        avg(account) / stddev_samp(account) * sqrt(252) as sharpe, avg(account) / sqrt(avg(pow(least(account, 0), 2))) * sqrt(252) as sortino, avg(account - benchmark) / stddev_samp(account - benchmark) as ir, max(dd) as mdd, count(*) as days from dd)
      select round(ar, 6) as annual_rate, round(br, 5) as benchmark_rate, round(ar - beta * br, 5) as alpha, round(beta, 8) as beta, round(sharpe, 8) as sharpe, round(sortino, 8) as sortino, round(ir, 8) as information_ratio, round(mdd, 8) as max_drawdown, days from a""",
}
