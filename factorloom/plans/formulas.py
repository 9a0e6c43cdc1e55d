"""Queries of the formula language over the daily panel, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import panel_ops as ops
from ..functions.library import LIBRARY
from ..functions.panel_ops import Keys
from ..operators.panel import daily_panel
from ..session import read_table
from .formula import evaluate
from .library_sql import CALLS, library_sql
from .recursive_sql import SQL as RECURSIVE

FIELDS = ("open", "high", "low", "close", "volume", "amount", "pct_chg")
_CLEAN = ", ".join(f"case when isnan({f}) or isinf({f}) then null else {f} end as {f}" for f in FIELDS)
#: The dense panel, as common table expressions ending in p.
PANEL_SQL = f"""
held as (select ticker, cast(trade_date as date) as trade_date, {_CLEAN} from stock_daily_real
  where ticker is not null and trade_date is not null
  qualify row_number() over (partition by ticker, cast(trade_date as date) order by created_at desc nulls last) = 1),
grid as (select t.ticker, d.trade_date from (select distinct ticker from held) t cross join (select distinct trade_date from held) d),
ind as (select ticker, min(industry) as industry from stock_basic where ticker is not null group by ticker),
p as (select grid.ticker, grid.trade_date, {', '.join(FIELDS)}, industry
  from grid left join held on grid.ticker = held.ticker and grid.trade_date = held.trade_date left join ind on grid.ticker = ind.ticker)
"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    """The dense daily panel with each ticker's industry."""
    ind = read_table(spark, d, "stock_basic").where("ticker is not null").groupBy("ticker").agg(F.min("industry").alias("industry"))
    return daily_panel(read_table(spark, d, "stock_daily_real"), FIELDS).join(ind, "ticker", "left")


def _w(n: int) -> str:
    return f"(partition by ticker order by trade_date rows between {n - 1} preceding and current row)"


P, PAST, DAY = "(partition by ticker order by trade_date)", "(partition by ticker order by trade_date rows between unbounded preceding and current row)", "(partition by trade_date)"


def _full(agg: str, x: str, n: int) -> str:
    return f"case when count({x}) over {_w(n)} >= {n} then {agg} over {_w(n)} end"


def _rows(n: int, e: str) -> str:
    return f"case when count(*) over {_w(n)} >= {n} then {e} end"


def _lags(x: str, n: int, ws: list[float]) -> str:
    return " + ".join(f"{w!r} * " + (f"lag({x}, {n - 1 - i}) over {P}" if i < n - 1 else f"({x})") for i, w in enumerate(ws))


def _list(x: str, n: int) -> str:
    return f"list({x}) filter ({x} is not null) over {_w(n)}"


_HL = ops.half_life_weights(5, 2.0)
_SAFE_CORR = f"""case when count(close + open) over {_w(10)} >= 10 and var_pop(close) over {_w(10)} * var_pop(open) over {_w(10)} > 1e-18
  then covar_pop(close, open) over {_w(10)} / sqrt(var_pop(close) over {_w(10)} * var_pop(open) over {_w(10)}) end"""
_B = "case when close is not null and open is not null then {} end"
_YB, _XB = _B.format("close"), _B.format("open")


def _regr(fn: str, w: str) -> str:
    return f"case when var_pop({_XB}) over {w} > 0 then {fn}({_YB}, {_XB}) over {w} end"


def _about(n: int, op: str, squared: bool) -> str:
    out = f"coalesce(list_sum([(v - m) * (v - m) for v in l if v {op} m]), 0)" if squared else f"coalesce(len([v for v in l if v {op} m]), 0)"
    return f"select ticker, trade_date, case when c >= {n} then {out} end as value from (select ticker, trade_date, {_list('close', n)} as l, avg(close) over {_w(n)} as m, count(*) over {_w(n)} as c from p)"


def _arrayed(x: str, n: int, out: str, extra: str = "") -> str:
    return f"select ticker, trade_date, {out} as value from (select ticker, trade_date, close, {x} as l, count(*) over {_w(n)} as c, count(close) over {_w(n)} as k{extra} from p)"


_RET = f"(close - lag(close, 1) over {P}) / nullif(lag(close, 1) over {P}, 0)"
#: name: (formula, SQL expression over p, or a whole select of ticker, trade_date, value)
FORMULAS: dict[str, tuple[str, str]] = {
    "fx_abs": ("abs(pct_chg)", "abs(pct_chg)"),
    "fx_neg": ("-close", "-close"),
    "fx_sqrt": ("sqrt(pct_chg)", "case when pct_chg >= 0 then sqrt(pct_chg) end"),
    "fx_exp": ("exp(pct_chg / 100)", "exp(pct_chg / 100)"),
    "fx_log": ("log(close)", "case when close > 0 then ln(close) end"),
    "fx_log_base": ("log(close, open)", "case when close > 0 and open > 0 then ln(close) / nullif(ln(open), 0) end"),
    "fx_power": ("power(close, 2)", "pow(close, 2)"),
    "fx_signedpower": ("signedpower(pct_chg, 0.5)", "sign(pct_chg) * pow(abs(pct_chg), 0.5)"),
    "fx_add": ("close + open", "close + open"),
    "fx_sub": ("close - open", "close - open"),
    "fx_mul": ("close * open", "close * open"),
    "fx_div": ("close / open", "close / nullif(open, 0)"),
    "fx_lt": ("where(lt(close, open), 1, 0)", "case when close < open then 1.0 else 0.0 end"),
    "fx_gt": ("where(gt(close, open), 1, 0)", "case when close > open then 1.0 else 0.0 end"),
    "fx_lte": ("where(close <= open, 1, 0)", "case when close <= open then 1.0 else 0.0 end"),
    "fx_gte": ("where(close >= open, 1, 0)", "case when close >= open then 1.0 else 0.0 end"),
    "fx_eq": ("where(eq(close, open), 1, 0)", "case when close = open then 1.0 else 0.0 end"),
    "fx_ne": ("where(ne(close, open), 1, 0)", "case when close = open then 0.0 else 1.0 end"),
    "fx_where": ("pct_chg < 0 ? open : close", "case when pct_chg < 0 then open else close end"),
    "fx_fillna": ("fillna(close, 0)", "coalesce(close, 0)"),
    "fx_ffill": ("ffill(close)", f"last_value(close ignore nulls) over {PAST}"),
    "fx_bfill": ("bfill(close)", "first_value(close ignore nulls) over (partition by ticker order by trade_date rows between current row and unbounded following)"),
    "fx_delay": ("delay(close, 3)", f"lag(close, 3) over {P}"),
    "fx_lead": ("delay(close, -2)", f"lead(close, 2) over {P}"),
    "fx_delta": ("delta(close, 5)", f"close - lag(close, 5) over {P}"),
    "fx_pct_change": ("pct_change(close, 1)", _RET),
    "fx_ts_sum": ("ts_sum(close, 10)", _full("sum(close)", "close", 10)),
    "fx_ts_prod": ("ts_prod(1 + pct_chg / 10000, 5)", f"case when count(pct_chg) over {_w(5)} >= 5 then " + " * ".join(f"(1 + lag(pct_chg, {i}) over {P} / 10000)" for i in range(5)) + " end"),
    "fx_ts_mean": ("ts_mean(close, 10)", _full("avg(close)", "close", 10)),
    "fx_ts_mean_weighted": ("ts_mean(close, 5, weight=True, half_life=2.0)", _lags("close", 5, _HL)),
    "fx_ts_stddev": ("ts_stddev(close, 10)", _full("stddev_samp(close)", "close", 10)),
    "fx_ts_stddev_weighted": ("ts_stddev(log(close), 5, weight=True, half_life=2.0)", f"select ticker, trade_date, case when m2 is not null then sqrt(greatest(m2 - m1 * m1, 0)) end as value from (select ticker, trade_date, {_lags('x', 5, _HL)} as m1, {_lags('x * x', 5, _HL)} as m2 from (select ticker, trade_date, case when close > 0 then ln(close) end as x from p))"),
    "fx_ts_min": ("ts_min(close, 10)", _full("min(close)", "close", 10)),
    "fx_ts_max": ("ts_max(close, 10)", _full("max(close)", "close", 10)),
    "fx_ts_cov": ("ts_cov(close, open, 10)", f"case when count(close + open) over {_w(10)} >= 10 then covar_pop(close, open) over {_w(10)} end"),
    "fx_ts_corr": ("ts_corr(close, open, 10)", _SAFE_CORR),
    "fx_ts_rank": ("ts_rank(close, 10)", _arrayed(_list("close", 10), 10, "case when len(l) >= 10 and close is not null then 1 + len([v for v in l if v > close]) + (len([v for v in l if v = close]) - 1) / 2 end")),
    "fx_ts_argmax": ("ts_argmax(close, 5)", _arrayed(f"list(coalesce(close, '-infinity'::double)) over {_w(5)}", 5, "case when c >= 5 and k > 0 then cast(list_position(l, list_max(l)) - 1 as double) end")),
    "fx_ts_cumsum_agg_max": ("ts_cumsum_agg(pct_chg, 4, 'max', 'forward')", f"select ticker, trade_date, case when x0 is null and x1 is null and x2 is null and x3 is null then null else list_max([s for s in [case when c >= 4 then coalesce(x3, 0) end, case when c >= 3 then coalesce(x3, 0) + coalesce(x2, 0) end, case when c >= 2 then coalesce(x3, 0) + coalesce(x2, 0) + coalesce(x1, 0) end, coalesce(x3, 0) + coalesce(x2, 0) + coalesce(x1, 0) + coalesce(x0, 0)] if s is not null]) end as value from (select ticker, trade_date, count(*) over {_w(4)} as c, pct_chg as x0, lag(pct_chg, 1) over {P} as x1, lag(pct_chg, 2) over {P} as x2, lag(pct_chg, 3) over {P} as x3 from p)"),
    "fx_num_gt_mean": ("num_gt_mean(close, 10)", _about(10, ">", False)),
    "fx_num_lt_mean": ("num_lt_mean(close, 10)", _about(10, "<", False)),
    "fx_upper_center_squared_sum": ("upper_center_squared_sum(close, 10)", _about(10, ">", True)),
    "fx_lower_center_squared_sum": ("lower_center_squared_sum(close, 10)", _about(10, "<", True)),
    "fx_ts_linreg_beta": ("ts_linreg(close, open, 10, 'beta')", f"case when count(*) over {_w(10)} >= 10 and count({_YB}) over {_w(10)} >= 2 then {_regr('regr_slope', _w(10))} end"),
    "fx_ts_linreg_alpha": ("ts_linreg(close, open, 10, 'alpha')", f"case when count(*) over {_w(10)} >= 10 and count({_YB}) over {_w(10)} >= 2 then {_regr('regr_intercept', _w(10))} end"),
    "fx_block_agg": ("block_agg(close, 10, 2, 'mean', 'range')", _arrayed(_list("close", 10), 10, "case when len(l) >= 10 then abs(list_avg(l[1:5]) - list_avg(l[6:10])) end")),
    "fx_cs_rank": ("cs_rank(close)", "case when close is not null then cast(dense_rank() over (partition by trade_date order by close desc nulls last) as double) end"),
    "fx_cs_mean": ("cs_mean(close)", f"(coalesce(sum(close) over {DAY}, 0) - close) / nullif(count(*) over {DAY} - 1, 0)"),
    "fx_cs_mean_weighted": ("cs_mean(close, weight=volume)", f"(sum(close * volume) over {DAY} - close * volume) / nullif(sum(volume) over {DAY} - volume, 0)"),
    "fx_cs_mean_by_industry": ("cs_mean_by_industry(close, industry)", "case when industry is not null then (coalesce(sum(close) over (partition by trade_date, industry), 0) - close) / nullif(count(*) over (partition by trade_date, industry) - 1, 0) end"),
    "fx_cs_linreg_beta": ("cs_linreg(close, open, 'beta')", f"case when close is not null and open is not null and count({_YB}) over {DAY} >= 2 then {_regr('regr_slope', DAY)} end"),
    "fx_cs_linreg_alpha": ("cs_linreg(close, open, 'alpha')", f"case when close is not null and open is not null and count({_YB}) over {DAY} >= 2 then {_regr('regr_intercept', DAY)} end"),
    "fx_cs_linreg_resid": ("cs_linreg(close, open, 'resid')", f"case when count({_YB}) over {DAY} >= 2 then close - {_regr('regr_intercept', DAY)} - ({_regr('regr_slope', DAY)}) * open end"),
    "fx_normalize_cs": ("normalize(close, cross_section=True)", f"(close - min(close) over {DAY}) / nullif(max(close) over {DAY} - min(close) over {DAY}, 0)"),
    "fx_normalize_expanding": ("normalize(close, expanding=True)", f"(close - min(close) over {PAST}) / nullif(max(close) over {PAST} - min(close) over {PAST}, 0)"),
    "fx_normalize_rolling": ("normalize(close, window=20)", f"(close - min(close) over {_w(20)}) / nullif(max(close) over {_w(20)} - min(close) over {_w(20)}, 0)"),
    "fx_standardize_cs": ("standardize(close, cross_section=True)", f"(close - avg(close) over {DAY}) / nullif(stddev_samp(close) over {DAY}, 0)"),
    "fx_standardize_expanding": ("standardize(log(close), expanding=True)", f"select ticker, trade_date, case when stddev_samp(x) over {PAST} > 1e-12 then (x - avg(x) over {PAST}) / stddev_samp(x) over {PAST} end as value from (select ticker, trade_date, case when close > 0 then ln(close) end as x from p)"),
    "fx_clip_mad_cs": ("clip_mad(close, 3.0, cross_section=True)", "select ticker, trade_date, case when mad < 1e-6 then close when close is not null then greatest(least(close, med + 4.4478 * mad), med - 4.4478 * mad) end as value from (select *, median(abs(close - med)) over (partition by trade_date) as mad from (select *, median(close) over (partition by trade_date) as med from p))"),
    "fx_winsorize_cs": ("winsorize_quantile(close, 0.1, 0.1, cross_section=True)", "select ticker, trade_date, case when close is not null then greatest(least(close, l[len(l) - cast(floor(0.1 * len(l)) as bigint)]), l[cast(floor(0.1 * len(l)) as bigint) + 1]) end as value from (select *, list_sort(list(close) filter (close is not null) over (partition by trade_date)) as l from p)"),
    "fx_neutralize_demean": ("industry_neutralize(close, industry, 'demean')", "case when industry is null then close else close - avg(close) over (partition by trade_date, industry) end"),
    "fx_neutralize_standardize": ("industry_neutralize(close, industry, 'standardize')", "case when industry is null then close else (close - avg(close) over (partition by trade_date, industry)) / coalesce(nullif(stddev_samp(close) over (partition by trade_date, industry), 0), 1) end"),
    "fx_neutralize_regression": ("industry_neutralize(close, industry, 'regression')", "select p.ticker, p.trade_date, case when industry is null or close is null then close when kinds > 1 then close - avg(close) over (partition by p.trade_date, industry) else close end as value from p join (select trade_date, count(distinct industry) filter (close is not null) as kinds from p group by trade_date) n on p.trade_date = n.trade_date"),
    "fx_nested_factor": ("cs_rank(ts_argmax(signedpower(pct_chg < 0 ? ts_stddev(pct_chg, 5) : close, 2.0), 5))", f"select ticker, trade_date, case when a is not null then cast(dense_rank() over (partition by trade_date order by a desc nulls last) as double) end as value from (select ticker, trade_date, case when c >= 5 and k > 0 then list_position(l, list_max(l)) - 1 end as a from (select ticker, trade_date, count(*) over {_w(5)} as c, count(s) over {_w(5)} as k, list(coalesce(s, '-infinity'::double)) over {_w(5)} as l from (select ticker, trade_date, sign(x) * pow(abs(x), 2.0) as s from (select ticker, trade_date, case when pct_chg < 0 then {_full('stddev_samp(pct_chg)', 'pct_chg', 5)} else close end as x from p))))"),
    "fx_momentum_vol": ("(close / delay(close, 20) - 1) / ts_stddev(pct_change(close, 1), 20)", f"select ticker, trade_date, (close / nullif(l20, 0) - 1) / nullif({_full('stddev_samp(r)', 'r', 20)}, 0) as value from (select ticker, trade_date, close, lag(close, 20) over {P} as l20, {_RET} as r from p)"),
    # indicators, labels and signals
    "ind_wma": ("wma(close, 5)", _lags("close", 5, [i / 15 for i in range(1, 6)])),
    "ind_bollinger_upper": ("bollinger_upper(close, 20, 2.0)", _full("avg(close)", "close", 20).replace(" end", f" + 2.0 * stddev_pop(close) over {_w(20)} end")),
    "ind_bollinger_lower": ("bollinger_lower(close, 20, 2.0)", _full("avg(close)", "close", 20).replace(" end", f" - 2.0 * stddev_pop(close) over {_w(20)} end")),
    "ind_bollinger_percent": ("bollinger_percent(close, 20, 2.0)", f"case when count(close) over {_w(20)} >= 20 and stddev_pop(close) over {_w(20)} > 1e-9 then (close - avg(close) over {_w(20)} + 2 * stddev_pop(close) over {_w(20)}) / (4 * stddev_pop(close) over {_w(20)}) end"),
    "ind_rolling_zscore": ("rolling_zscore(close, 20)", f"case when count(close) over {_w(20)} >= 20 and stddev_samp(close) over {_w(20)} > 1e-12 then (close - avg(close) over {_w(20)}) / stddev_samp(close) over {_w(20)} end"),
    "ind_roc": ("roc(close, 10)", f"100 * (close / nullif(lag(close, 10) over {P}, 0) - 1)"),
    "ind_log_return": ("log_return(close, 1)", f"case when close / nullif(lag(close, 1) over {P}, 0) > 0 then ln(close / lag(close, 1) over {P}) end"),
    "ind_stoch_k": ("stoch_k(close, high, low, 14)", f"100 * (close - {_full('min(low)', 'low', 14)}) / nullif({_full('max(high)', 'high', 14)} - {_full('min(low)', 'low', 14)}, 0)"),
    "ind_stoch_d": ("ts_mean(stoch_k(close, high, low, 14), 3)", f"select ticker, trade_date, {_full('avg(k)', 'k', 3)} as value from (select ticker, trade_date, 100 * (close - {_full('min(low)', 'low', 14)}) / nullif({_full('max(high)', 'high', 14)} - {_full('min(low)', 'low', 14)}, 0) as k from p)"),
    "ind_williams_r": ("williams_r(close, high, low, 14)", f"-100 * ({_full('max(high)', 'high', 14)} - close) / nullif({_full('max(high)', 'high', 14)} - {_full('min(low)', 'low', 14)}, 0)"),
    "ind_true_range": ("true_range(high, low, close)", f"case when high is not null and low is not null then greatest(high - low, abs(high - lag(close) over {P}), abs(low - lag(close) over {P})) end"),
    "ind_atr": ("ts_mean(true_range(high, low, close), 14)", f"select ticker, trade_date, {_full('avg(tr)', 'tr', 14)} as value from (select ticker, trade_date, case when high is not null and low is not null then greatest(high - low, abs(high - lag(close) over {P}), abs(low - lag(close) over {P})) end as tr from p)"),
    "ind_mean_deviation": ("mean_deviation(close, 10)", f"select ticker, trade_date, case when len(l) >= 10 then list_sum([abs(v - m) for v in l]) / 10 end as value from (select ticker, trade_date, {_list('close', 10)} as l, avg(close) over {_w(10)} as m from p)"),
    "ind_cci": ("cci((high + low + close) / 3, 20)", f"select ticker, trade_date, case when len(l) >= 20 and list_sum([abs(v - m) for v in l]) > 2e-11 then (t - m) / (0.015 * list_sum([abs(v - m) for v in l]) / 20) end as value from (select ticker, trade_date, t, list(t) filter (t is not null) over {_w(20)} as l, avg(t) over {_w(20)} as m from (select ticker, trade_date, (high + low + close) / 3 as t from p))"),
    "ind_aroon_up": ("aroon_up(high, 25)", f"select ticker, trade_date, case when len(l) >= 26 then 100.0 * (25 - (list_position(list_reverse(l), list_max(l)) - 1)) / 25 end as value from (select ticker, trade_date, {_list('high', 26)} as l from p)"),
    "ind_aroon_down": ("aroon_down(low, 25)", f"select ticker, trade_date, case when len(l) >= 26 then 100.0 * (25 - (list_position(list_reverse(l), list_min(l)) - 1)) / 25 end as value from (select ticker, trade_date, {_list('low', 26)} as l from p)"),
    "ind_obv": ("cumulative(signed_volume(close, volume))", f"select ticker, trade_date, sum(s) over {PAST} as value from (select ticker, trade_date, coalesce(sign(close - lag(close) over {P}) * volume, 0) as s from p)"),
    "ind_vwap_rolling": ("ts_sum(amount, 10) / ts_sum(volume, 10)", f"{_full('sum(amount)', 'amount', 10)} / nullif({_full('sum(volume)', 'volume', 10)}, 0)"),
    "ind_expanding_max": ("expanding_max(close)", f"max(close) over {PAST}"),
    "ind_expanding_min": ("expanding_min(close)", f"min(close) over {PAST}"),
    "ind_drawdown": ("drawdown(close)", f"close / nullif(max(close) over {PAST}, 0) - 1"),
    "ind_donchian_width": ("ts_max(high, 20) - ts_min(low, 20)", f"{_full('max(high)', 'high', 20)} - {_full('min(low)', 'low', 20)}"),
    "ind_ts_quantile": ("ts_quantile(close, 20, 0.25)", _full("quantile_cont(close, 0.25)", "close", 20)),
    "ind_ts_count": ("ts_count(close, 20)", f"count(close) over {_w(20)}"),
    "ind_rolling_sum_wide": ("rolling_sum_wide(close, 60)", _full("sum(close)", "close", 60)),
    "sig_crossed_above": ("crossed_above(close, ts_mean(close, 10))", f"select ticker, trade_date, case when close > m and lag(close) over {P} <= lag(m) over {P} then 1 else 0 end as value from (select ticker, trade_date, close, {_full('avg(close)', 'close', 10)} as m from p)"),
    "sig_crossed_below": ("crossed_below(close, ts_mean(close, 10))", f"select ticker, trade_date, case when close < m and lag(close) over {P} >= lag(m) over {P} then 1 else 0 end as value from (select ticker, trade_date, close, {_full('avg(close)', 'close', 10)} as m from p)"),
    "lab_fixed": ("fixed_label(close, 5)", f"lead(close, 5) over {P} / nullif(close, 0) - 1"),
    "lab_future_max": ("future_max(close, 5)", "case when count(close) over f >= 5 then max(close) over f end".replace(" f ", " (partition by ticker order by trade_date rows between 1 following and 5 following) ")),
    "lab_future_min": ("future_min(close, 5)", "case when count(close) over f >= 5 then min(close) over f end".replace(" f ", " (partition by ticker order by trade_date rows between 1 following and 5 following) ")),
    "lab_future_mean": ("future_mean(close, 5)", "case when count(close) over f >= 5 then avg(close) over f end".replace(" f ", " (partition by ticker order by trade_date rows between 1 following and 5 following) ")),
    "lab_future_std": ("future_std(close, 5)", "case when count(close) over f >= 5 then stddev_pop(close) over f end".replace(" f ", " (partition by ticker order by trade_date rows between 1 following and 5 following) ")),
    "ind_ts_any": ("ts_any(pct_chg > 3 ? 1 : 0, 5)", f"select ticker, trade_date, case when count(*) over {_w(5)} >= 5 then max(u) over {_w(5)} end as value from (select *, case when pct_chg > 3 then 1.0 else 0.0 end as u from p)"),
    "ind_ts_all": ("ts_all(pct_chg < 3 ? 1 : 0, 5)", f"select ticker, trade_date, case when count(*) over {_w(5)} >= 5 then min(u) over {_w(5)} end as value from (select *, case when pct_chg < 3 then 1.0 else 0.0 end as u from p)"),
    "ind_since_highest": ("since_highest(high, 20)", _arrayed(_list("high", 20), 20, "case when len(l) >= 20 then list_position(list_reverse(l), list_max(l)) - 1 end")),
    "ind_since_lowest": ("since_lowest(low, 20)", _arrayed(_list("low", 20), 20, "case when len(l) >= 20 then list_position(list_reverse(l), list_min(l)) - 1 end")),
    "ind_since_first_highest": ("since_first_highest(high, 20)", _arrayed(_list("high", 20), 20, "case when len(l) >= 20 then 20 - list_position(l, list_max(l)) end")),
    "ind_since_first_lowest": ("since_first_lowest(low, 20)", _arrayed(_list("low", 20), 20, "case when len(l) >= 20 then 20 - list_position(l, list_min(l)) end")),
    "ind_ts_argmin": ("ts_argmin(close, 10)", _arrayed(_list("close", 10), 10, "case when len(l) >= 10 then list_position(l, list_min(l)) - 1 end")),
    "ind_ts_median": ("ts_median(close, 15)", _full("median(close)", "close", 15)),
    "ind_ts_kurt": ("ts_kurt(pct_chg, 20)", f"select ticker, trade_date, case when len(l) >= 20 and m2 > 1e-18 then m4 / (m2 * m2) - 3 end as value from (select *, list_sum([pow(v - m, 2) for v in l]) / len(l) as m2, list_sum([pow(v - m, 4) for v in l]) / len(l) as m4 from (select ticker, trade_date, {_list('pct_chg', 20)} as l, avg(pct_chg) over {_w(20)} as m from p))"),
    "ind_partial_mean": ("partial_mean(close, 10, 3)", f"case when count(close) over {_w(10)} >= 3 then avg(close) over {_w(10)} end"),
    "ind_partial_std": ("partial_std(close, 10, 3, 1)", f"case when count(close) over {_w(10)} >= 3 then stddev_samp(close) over {_w(10)} end"),
    "ind_expanding_mean": ("expanding_mean(close, 5) * 0.7310585786", f"case when count(close) over {PAST} >= 5 then avg(close) over {PAST} * 0.7310585786 end"),
    "ind_expanding_std": ("expanding_std(log(close), 5)", f"select ticker, trade_date, case when count(x) over {PAST} >= 5 then stddev_pop(x) over {PAST} end as value from (select ticker, trade_date, case when close > 0 then ln(close) end as x from p)"),
    "ind_rebase": ("rebase(close, 100)", f"100 * close / nullif(first_value(close ignore nulls) over {PAST}, 0)"),
    "ind_nonzero_difference": ("nonzero_difference(close, open)", f"last_value(nullif(close - open, 0) ignore nulls) over {PAST}"),
    "sig_cross_over": ("cross_over(close, ts_mean(close, 10))", f"select ticker, trade_date, case when b < 0 and d > 0 then 1 when b > 0 and d < 0 then -1 else 0 end as value from (select *, last_value(nullif(d, 0) ignore nulls) over (partition by ticker order by trade_date rows between unbounded preceding and 1 preceding) as b from (select ticker, trade_date, close - {_full('avg(close)', 'close', 10)} as d from p))"),
    "lab_mean": ("mean_label(close, 5, 2)", f"case when count(close) over f >= 5 then avg(close) over f / nullif(close, 0) - 1 end".replace(" f ", " (partition by ticker order by trade_date rows between 2 following and 6 following) ")),
}
#: Formulas SQL doesn't express on whole tables; tested against pandas instead.
UNSQL: dict[str, str] = {
    "fx_ewma": "ewma(close, 20)",
    "fx_ewma_half_life": "ewma(close, 20, half_life=3.0)",
    "fx_ts_corr_weighted": "ts_corr(log(close), log(open), 5, weight=True, half_life=2.0)",
    "fx_ts_cov_weighted": "ts_cov(log(close), log(open), 5, weight=True, half_life=2.0)",
    "fx_ts_linreg_weighted": "ts_linreg(close, open, 5, 'beta', weight=True, half_life=2.0)",
    "fx_ts_linreg_resid": "ts_linreg(close, open, 10, 'resid') * 0.7310585786",
    "fx_ts_cumsum_agg_min_backward": "ts_cumsum_agg(pct_chg, 4, 'min', 'backward')",
    "fx_clip_mad_rolling": "clip_mad(close, 3.0, cross_section=False, window=20)",
    "fx_winsorize_rolling": "winsorize_quantile(close, 0.1, 0.1, cross_section=False, window=20)",
    "ind_ema": "ema(close, 12)", "ind_ewm_mean": "ewm_mean(close, 10)", "ind_ewm_std": "ewm_std(close, 10)", "ind_hurst": "hurst(close, 40)", "ind_trend_position": "trend_position(close)", "ind_smma": "smma(close, 14)", "ind_dema": "dema(close, 10)", "ind_tema": "tema(close, 10)", "ind_macd": "macd(close, 12)", "ind_rsi": "rsi(close, 14)",
    "ind_trix": "trix(close, 5)", "ind_kama": "kama(close, 10)", "ind_laguerre": "laguerre(close, 0) * 0.7310585786", "ind_skew": "ts_skew(pct_chg, 20)", "lab_trend": "trend_label(close, 0)", "sig_stop_exit": "stop_exit(close, 0)",
    "ind_adx": "adx(high, low, close, 14)", "ind_parabolic_sar": "parabolic_sar(high, low, 0)", "ind_heikin_open": "heikin_open(open, high, low, close) / 3.7", "ind_supertrend": "supertrend(high, low, close, 10)", "ind_renko": "renko_level(close)", "lab_triple_barrier": "triple_barrier(close, 10)", "ind_zero_lag_ema": "zero_lag_ema(close, 12)", "ind_tsi": "tsi(close, 25)",
    "fx_neutralize_rank": "industry_neutralize(close, industry, 'rank')",
}


#: Decimals compared, where not 6: of values that lie on halves of the sixth, or that lose some to cancellation.
DIGITS = {"lib_linear_deviation": 3, "lib_quadratic_deviation": 3, "lib_cubic_deviation": 3}


def _query(name: str, formula: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = evaluate(panel(spark, d), {"value": formula}, Keys())
        return out.select("ticker", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_day"), F.round("value", DIGITS.get(name, 6)).alias("value"))

    run.__name__, run.__doc__ = name, f"The formula {formula} over the daily panel."
    return run


def _oracle(sql: str, digits: int = 6) -> str:
    inner = sql if sql.startswith("select ") else f"select ticker, trade_date, {sql} as value from p"
    return f"with {PANEL_SQL}, answer as ({inner})\nselect ticker, strftime(trade_date, '%Y-%m-%d') as trade_day, round(cast(value as double), {digits}) as value from answer"


def _oracle_of_tables(sql: str, digits: int = 6) -> str:
    """SQL given as tables over the panel and, after the last of them, a select of ticker, trade_date and value."""
    depth, at = 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if depth == 0 and sql.startswith("select ", i) and (i == 0 or sql[i - 1] in " \n"):
            at = i
            break
    return f"with recursive {PANEL_SQL}, {sql[:at]}, answer as ({sql[at:]})\nselect ticker, strftime(trade_date, '%Y-%m-%d') as trade_day, round(cast(value as double), {digits}) as value from answer"


#: The panel column that stands for each parameter of a library indicator.
_PUT = {"X": "close", "Y": "open", "O": "open", "H": "high", "L": "low", "C": "close", "V": "volume", "A": "amount"}
for _n, (_params, _) in LIBRARY.items():
    _call = CALLS.get(_n) or f"{_n}({', '.join(_PUT[p] for p, default in _params if default is None)})"
    if (_sql := library_sql(_n)) is None:
        UNSQL[f"lib_{_n}"] = _call
    else:
        FORMULAS[f"lib_{_n}"] = (_call, f"select * from ({_sql})")

#: Recursive tables and list windows as SQL.
UNSQL_ORACLES = {n: _oracle_of_tables(s, DIGITS.get(n, 6)) for n, s in RECURSIVE.items() if n in UNSQL}
QUERIES = {n: _query(n, f) for n, f in [*((n, f) for n, (f, _) in FORMULAS.items()), *UNSQL.items()]}
ORACLES = {n: _oracle(s, DIGITS.get(n, 6)) for n, (_, s) in FORMULAS.items()} | UNSQL_ORACLES
