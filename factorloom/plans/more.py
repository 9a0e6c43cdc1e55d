"""Queries of schedules and parameter grids, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schedule, tables
from ..session import read_table
from .analytics import _out
from .formulas import PANEL_SQL, panel
from .grid import grid_search


def _dates(spark: SparkSession, d: str, rule: str) -> DataFrame:
    s = tables.trading_days(read_table(spark, d, "trade_calendar")).where("is_open = 1")
    return schedule.rebalance_dates(s, rule).select("exchange", F.date_format("day", "yyyy-MM-dd").alias("day"))


def t_rebalance_two_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Last session of every second week ending on Wednesday."""
    return _dates(spark, d, "2W-WED")


def t_rebalance_month_end(spark: SparkSession, d: str) -> DataFrame:
    """Last session of every month."""
    return _dates(spark, d, "ME")


def t_rebalance_quarter_start(spark: SparkSession, d: str) -> DataFrame:
    """First session of every quarter."""
    return _dates(spark, d, "QS")


def t_rebalance_every_ten(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth session."""
    return _dates(spark, d, "10D")


def an_grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Information coefficient of a moving-average distance for three windows."""
    return _out(grid_search(panel(spark, d), "close", "close / ts_mean(close, N) - 1", N=[5, 10, 20]))


QUERIES = {f.__name__: f for f in (t_rebalance_two_weeks, t_rebalance_month_end, t_rebalance_quarter_start, t_rebalance_every_ten, an_grid_search)}

_S = "with s as (select distinct exchange, cast(cal_date as date) as day from trade_calendar where exchange is not null and cal_date is not null and is_open = 1)"


def _periods(bucket: str, pick: str, every: int) -> str:
    return f"{_S}, p as (select exchange, {bucket} as b, {pick}(day) as day from s group by 1, 2) select exchange, strftime(day, '%Y-%m-%d') as day from (select *, min(b) over (partition by exchange) as f from p) where (b - f) % {every} = 0"


_MA = " union all ".join(f"select 'N={n}' as params, trade_date, close / nullif(case when count(close) over (partition by ticker order by trade_date rows between {n - 1} preceding and current row) >= {n} then avg(close) over (partition by ticker order by trade_date rows between {n - 1} preceding and current row) end, 0) - 1 as f, lead(close) over (partition by ticker order by trade_date) / nullif(close, 0) - 1 as r from p" for n in (5, 10, 20))
ORACLES = {
    "t_rebalance_two_weeks": _periods("(day - date '1970-01-01' + 3 + 6 - 2) // 7", "max", 2),
    "t_rebalance_month_end": _periods("year(day) * 12 + month(day)", "max", 1),
    "t_rebalance_quarter_start": _periods("year(day) * 4 + quarter(day)", "min", 1),
    "t_rebalance_every_ten": f"{_S} select exchange, strftime(day, '%Y-%m-%d') as day from (select *, row_number() over (partition by exchange order by day) - 1 as k from s) where k % 10 = 0",
    "an_grid_search": f"with {PANEL_SQL}, g as ({_MA}), v as (select params, trade_date, case when f is null or r is null then null else f end as f, case when f is null or r is null then null else r end as r from g), c as (select params, trade_date, case when var_pop(f) * var_pop(r) > 1e-18 then covar_pop(f, r) / sqrt(var_pop(f) * var_pop(r)) end as ic from v group by 1, 2) select params, round(avg(ic), 8) as mean_ic, round(stddev_samp(ic), 8) as std_ic, count(ic) as dates from c group by 1",
}
