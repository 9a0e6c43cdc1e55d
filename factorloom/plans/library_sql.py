"""SQL of the library indicators, written from their definitions, not from the formulas.

Each is an expression over `t`: the dense panel with the row before (o1, h1, l1, c1, v1),
r (return), lr (log return), tr and ltr (true range, of logarithms), tp (typical price),
mid, and dc (change); or a whole select of ticker, trade_date and value over it.
"""

from __future__ import annotations

P = "(partition by ticker order by trade_date)"
BASE = f"""b as (select *, lag(high) over {P} as h1, lag(low) over {P} as l1, lag(close) over {P} as c1, lag(volume) over {P} as v1 from p),
t as (select *, close - c1 as dc, (close - c1) / nullif(c1, 0) as r, case when close / nullif(c1, 0) > 0 then ln(close / c1) end as lr,
  case when high is not null and low is not null then greatest(high - low, abs(high - c1), abs(low - c1)) end as tr,
  case when high > 0 and low > 0 then greatest(ln(high) - ln(low), ln(high) - case when c1 > 0 then ln(c1) end, case when c1 > 0 then ln(c1) end - ln(low)) end as ltr,
  (high + low + close) / 3 as tp, (high + low) / 2 as mid, case when close > 0 then ln(close) end as lc from b)"""


def w(n: int) -> str:
    return f"(partition by ticker order by trade_date rows between {n - 1} preceding and current row)"


def full(agg: str, x: str, n: int) -> str:
    return f"(case when count({x}) over {w(n)} = {n} then {agg}({x}) over {w(n)} end)"


def avg(x: str, n: int) -> str:
    return full("avg", x, n)


def total(x: str, n: int) -> str:
    return full("sum", x, n)


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) over {P}"


def ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def nested(columns: str, value: str, source: str = "t") -> str:
    """A select with more columns of t computed first."""
    return f"select ticker, trade_date, {value} as value from (select *, {columns} from {source})"


def middle(n: int) -> str:
    return f"({full('max', 'high', n)} + {full('min', 'low', n)}) / 2"


def ln(x: str) -> str:
    return f"case when {x} > 0 then ln({x}) end"


def listed(x: str, n: int) -> str:
    return f"list({x}) filter ({x} is not null) over {w(n)}"


def score(x: str, scale: float = 1.0) -> str:
    """100 N(scale x) - 50 by the rational approximation of the normal distribution."""
    z = f"({scale} * ({x}))"
    k = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * ((((1.330274429 * {k} - 1.821255978) * {k} + 1.781477937) * {k} - 0.356563782) * {k} + 0.319381530) * {k}"
    return f"100 * (case when {z} > 0 then 1 - {tail} else {tail} end) - 50"


def scored(columns: str, x: str, scale: float = 1.0, source: str = "t") -> str:
    return f"select ticker, trade_date, case when x is not null then {score('x', scale)} end as value from (select ticker, trade_date, {x} as x from (select *, {columns} from {source}))"


def wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"{2 * (n - i) / (n * (n + 1))!r} * ({lag(x, i) if i else x})" for i in range(n)) + ")"


def _basis(n: int, degree: int) -> list[list[float]]:
    """Orthonormal polynomials by the three-term recurrence of discrete points."""
    at = [i - (n - 1) / 2 for i in range(n)]
    raw = [[1.0] * n, at[:]]
    for d in range(1, degree):
        c = d * d * (n * n - d * d) / (4 * (4 * d * d - 1))
        raw.append([t * x - c * y for t, x, y in zip(at, raw[d], raw[d - 1], strict=True)])
    return [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in raw[: degree + 1]]


def _dots(n: int, degree: int) -> str:
    return ", ".join(f"list_dot_product(case when len(l) = {n} then l else {[0.0] * n!r}::double[] end, {v!r}::double[]) as k{d}" for d, v in enumerate(_basis(n, degree)))


def deviation(n: int, degree: int, scale: float = 0.6) -> str:
    basis = _basis(n, degree)
    fitted = " + ".join(f"k{d} * {v[-1]!r}" for d, v in enumerate(basis))
    squares = " + ".join(f"k{d} * k{d}" for d in range(degree + 1))
    inner = f"(select *, {_dots(n, degree)} from (select *, {listed('lc', n)} as l from t))"
    rms = f"sqrt(greatest(list_sum([y * y for y in l]) - ({squares}), 0) / {n})"
    return f"select ticker, trade_date, case when x is not null then {score('x', scale)} end as value from (select ticker, trade_date, (lc - ({fitted})) / case when {rms} > 1e-9 then {rms} end as x from {inner} where len(l) = {n}) union all select ticker, trade_date, null from (select *, {listed('lc', n)} as l from t) where l is null or len(l) <> {n}"


def trend(n: int, degree: int, atr: int = 20) -> str:
    inner = f"(select *, {_dots(n, degree)} from (select *, {listed('lc', n)} as l, var_pop(lc) over {w(n)} * {n} as yss, {avg('ltr', atr)} as atr from t))"
    x = f"case when len(l) = {n} then 2 * k{degree} * case when yss > 1e-18 then least(k{degree} * k{degree} / yss, 1) end / nullif(atr * {n - 1}, 0) end"
    return f"select ticker, trade_date, case when x is not null then {score('x')} end as value from (select ticker, trade_date, {x} as x from {inner})"


_CORR = "case when count(a + b) over W = {n} and var_pop(a) over W * var_pop(b) over W > 1e-18 then covar_pop(a, b) over W / sqrt(var_pop(a) over W * var_pop(b) over W) end"
_UP, _DOWN = "greatest(dc, 0)", "greatest(-dc, 0)"
_BELOW = "case when len(l) = {n} and {x} is not null then len([v for v in l if v < {x}]) / {n} end"
_TP_FLOW = "case when coalesce(tp > lag(tp) over P1, false) then tp * volume else 0 end as up, case when coalesce(tp < lag(tp) over P1, false) then tp * volume else 0 end as down".replace("P1", P)
_DRAWDOWN = "list_min([l[i] / nullif(list_max(l[1:i]), 0) - 1 for i in range(1, 21)])"

SQL: dict[str, str] = {
    "momentum": f"close - {lag('close', 10)}",
    "hma": nested(f"2 * {wma('close', 4)} - {wma('close', 9)} as x", wma("x", 3)),
    "dpo": nested(f"{avg('close', 20)} as m", f"close - {lag('m', 11)}"),
    "envelope_upper": f"{avg('close', 20)} * 1.03",
    "envelope_lower": f"{avg('close', 20)} * 0.97",
    "bollinger_width": f"({avg('close', 20)} + 2 * {full('stddev_pop', 'close', 20)} - ({avg('close', 20)} - 2 * {full('stddev_pop', 'close', 20)})) / nullif({avg('close', 20)}, 0)",
    "keltner_upper": f"{avg('tp', 20)} + 2 * {avg('tr', 20)}",
    "keltner_lower": f"{avg('tp', 20)} - 2 * {avg('tr', 20)}",
    "donchian_mid": middle(20),
    "ichimoku_tenkan": middle(9),
    "ichimoku_kijun": middle(26),
    "ichimoku_senkou_a": nested(f"({middle(9)} + {middle(26)}) / 2 as x", lag("x", 26)),
    "ichimoku_senkou_b": nested(f"{middle(52)} as x", lag("x", 26)),
    "ultimate_oscillator": nested("close - least(low, c1) as bp", "100 * (" + " + ".join(f"{k} * {ratio(total('bp', n), total('tr', n))}" for k, n in ((4, 7), (2, 14), (1, 28))) + ") / 7"),
    "vortex_plus": nested("abs(high - l1) as vm", ratio(total("vm", 14), total("tr", 14))),
    "vortex_minus": nested("abs(low - h1) as vm", ratio(total("vm", 14), total("tr", 14))),
    "plus_di": nested("case when coalesce(high - h1 > l1 - low, false) then greatest(high - h1, 0) else 0 end as dm", f"100 * {ratio(total('dm', 14), total('tr', 14))}"),
    "minus_di": nested("case when coalesce(l1 - low > high - h1, false) then greatest(l1 - low, 0) else 0 end as dm", f"100 * {ratio(total('dm', 14), total('tr', 14))}"),
    "chaikin_money_flow": nested("(2 * close - high - low) / nullif(high - low, 0) * volume as mf", ratio(total("mf", 20), total("volume", 20))),
    "accumulation_distribution": f"sum(coalesce((2 * close - high - low) / nullif(high - low, 0) * volume / 1e6, 0)) over {P}",
    "force_index": nested("dc * volume / 1e6 as f", avg("f", 13)),
    "ease_of_movement": nested(f"(mid - {lag('mid', 1)}) * (high - low) / nullif(volume / 1e6, 0) as e", avg("e", 14)),
    "money_flow_index": nested(_TP_FLOW, f"100 * {ratio(total('up', 14), total('up', 14) + ' + ' + total('down', 14))}"),
    "kst": nested(", ".join(f"100 * (close / nullif({lag('close', n)}, 0) - 1) as r{n}" for n in (10, 15, 20, 30)), f"{avg('r10', 10)} + 2 * {avg('r15', 10)} + 3 * {avg('r20', 10)} + 4 * {avg('r30', 15)}"),
    "awesome_oscillator": f"{avg('mid', 5)} - {avg('mid', 34)}",
    "acceleration": nested(f"{avg('mid', 5)} - {avg('mid', 34)} as ao", f"ao - {avg('ao', 5)}"),
    "pretty_good_oscillator": ratio(f"close - {avg('close', 14)}", avg("tr", 14)),
    "chande_momentum": nested(f"{_UP} as u, {_DOWN} as d", f"100 * ({total('u', 14)} - {total('d', 14)}) / nullif({total('u', 14)} + {total('d', 14)}, 0)"),
    "rsi_simple": nested(f"{_UP} as u, {_DOWN} as d", f"100 * {total('u', 14)} / nullif({total('u', 14)} + {total('d', 14)}, 0)"),
    "efficiency_ratio": nested("abs(dc) as a", ratio(f"abs(close - {lag('close', 10)})", total("a", 10))),
    "vertical_horizontal_filter": nested("abs(dc) as a", ratio(f"{full('max', 'close', 28)} - {full('min', 'close', 28)}", total("a", 28))),
    "choppiness": nested(f"{total('tr', 14)} / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) as q", "case when q > 0 then 100 * log10(q) / log10(14) end"),
    "ulcer_index": nested(f"100 * (close / nullif({full('max', 'close', 14)}, 0) - 1) as d", f"sqrt({full('avg', 'd * d', 14)})"),
    "historical_volatility": f"{full('stddev_samp', 'lr', 20)} * sqrt(252)",
    "parkinson_volatility": nested(f"{ln('high / nullif(low, 0)')} as x", f"sqrt({full('avg', 'x * x', 20)} / (4 * ln(2)))"),
    "garman_klass_volatility": nested(f"{ln('high / nullif(low, 0)')} as x, {ln('close / nullif(open, 0)')} as y", f"(case when {full('avg', '0.5 * x * x - (2 * ln(2) - 1) * y * y', 20)} >= 0 then sqrt({full('avg', '0.5 * x * x - (2 * ln(2) - 1) * y * y', 20)}) end)"),
    "rogers_satchell_volatility": nested(f"{ln('high / nullif(close, 0)')} as hc, {ln('high / nullif(open, 0)')} as ho, {ln('low / nullif(close, 0)')} as lc0, {ln('low / nullif(open, 0)')} as lo", f"(case when {full('avg', 'hc * ho + lc0 * lo', 20)} >= 0 then sqrt({full('avg', 'hc * ho + lc0 * lo', 20)}) end)"),
    "pivot_point": "(h1 + l1 + c1) / 3",
    "pivot_r1": "2 * (h1 + l1 + c1) / 3 - l1",
    "pivot_s1": "2 * (h1 + l1 + c1) / 3 - h1",
    "fibonacci_r1": "(h1 + l1 + c1) / 3 + 0.382 * (h1 - l1)",
    "up_days": nested("case when coalesce(dc > 0, false) then 1.0 else 0.0 end as u", total("u", 10)),
    "down_days": nested("case when coalesce(dc < 0, false) then 1.0 else 0.0 end as u", total("u", 10)),
    "rolling_total_return": f"close / nullif({lag('close', 20)}, 0) - 1",
    # the product of 20 growth factors telescopes to the ratio of prices where all are known
    "rolling_annualized": f"case when count(r) over {w(20)} = 20 and abs(close / nullif({lag('close', 20)}, 0) - 1) < 0.5 then pow(close / {lag('close', 20)}, 252.0 / 20) - 1 end",
    "rolling_sharpe": f"{avg('r', 20)} / nullif({full('stddev_samp', 'r', 20)}, 0) * sqrt(252)",
    "rolling_sortino": nested("pow(least(r, 0), 2) as q", f"{avg('r', 20)} / nullif(sqrt({avg('q', 20)}), 0) * sqrt(252)"),
    "rolling_omega": nested("greatest(r, 0) as g, greatest(-r, 0) as q", ratio(total("g", 20), total("q", 20))),
    "rolling_max_drawdown": nested(f"{listed('close', 20)} as l", f"case when len(l) = 20 then least({_DRAWDOWN}, 0) end"),
    "rolling_downside_risk": nested("pow(least(r, 0), 2) as q", f"sqrt({avg('q', 20)}) * sqrt(252)"),
    "overnight_gap": "open / nullif(c1, 0) - 1",
    "intraday_return": "close / nullif(open, 0) - 1",
    "amihud_illiquidity": nested("abs(r) / nullif(amount / 1e6, 0) as q", avg("q", 20)),
    "volume_ratio_rolling": ratio("volume", avg("volume", 20)),
    "distance_to_high": f"close / nullif({full('max', 'high', 60)}, 0) - 1",
    "distance_to_low": f"close / nullif({full('min', 'low', 60)}, 0) - 1",
    "intraday_intensity": nested("(2 * close - high - low) / nullif(high - low, 0) * volume as q", ratio(total("q", 14), total("volume", 14))),
    "close_to_close_trend": ratio(f"close - {avg('close', 20)}", full("stddev_samp", "close", 20)),
    "autocorrelation": nested(f"r as a, {lag('r', 1)} as b", _CORR.format(n=20).replace(" W", f" {w(20)}")),
    "volume_price_correlation": nested("close as a, volume as b", "-(" + _CORR.format(n=10).replace(" W", f" {w(10)}") + ")"),
    "heikin_close": "(open + high + low + close) / 4",
    "trend_strength_rank": nested(f"close / nullif({lag('close', 10)}, 0) - 1 as q", "case when q is not null then cast(dense_rank() over (partition by trade_date order by q desc nulls last) as double) end"),
    "normal_score": f"case when close is not null then {score('close - 10', 0.1)} end",
    "close_minus_ma": scored(f"{avg('lc', 20)} as m, {avg('ltr', 20)} as atr", f"(lc - {lag('m', 1)}) / nullif(atr * sqrt(21), 0)"),
    "price_change_oscillator": scored("abs(lr) as a", f"({total('a', 7)} / 5 - ({total('a', 7)} + (case when count(a) over (partition by ticker order by trade_date rows between 19 preceding and 5 preceding) = 15 then sum(a) over (partition by ticker order by trade_date rows between 19 preceding and 5 preceding) end)) / 20) / nullif((0.36 + 0.2 + 0.7 * ln(2) / 1.609) * {avg('ltr', 20)}, 0)", 4),
    "volume_weighted_ma_ratio": scored("close * volume as cv", "1000 * " + f"ln(case when {total('cv', 20)} > 0 and {total('volume', 20)} * {total('close', 20)} > 0 then 20 * {total('cv', 20)} / ({total('volume', 20)} * {total('close', 20)}) end) / sqrt(20)"),
    "normalized_on_balance_volume": scored("sign(dc) * volume as sv", f"{total('sv', 20)} / nullif({total('volume', 20)}, 0) * sqrt(20)", 0.6),
    "delta_on_balance_volume": f"select ticker, trade_date, value - {lag('value', 1)} as value from ({scored('sign(dc) * volume as sv', ratio(total('sv', 20), total('volume', 20)) + ' * sqrt(20)', 0.6)})",
    "normalized_positive_volume_index": scored("case when coalesce(volume > v1, false) then lr else 0 end as q", f"{total('q', 10)} / nullif({full('stddev_pop', 'lr', 40)} * sqrt(10), 0)", 0.5),
    "normalized_negative_volume_index": scored("case when coalesce(volume < v1, false) then lr else 0 end as q", f"{total('q', 10)} / nullif({full('stddev_pop', 'lr', 40)} * sqrt(10), 0)", 0.5),
    "volume_momentum": scored(f"{ratio(avg('volume', 10), avg('volume', 20))} as q", "case when q > 0 then ln(q) end / exp(ln(2) / 3)", 3),
    "money_flow": nested("case when coalesce(high > low, false) then (2 * close - high - low) / (high - low) * volume else 0 end as q", f"100 * {ratio(total('q', 20), total('volume', 20))}"),
    "price_volume_fit": scored("case when close > 0 and volume > -1 then ln(close) end as y, case when close > 0 and volume > -1 then ln(volume + 1) end as x0", f"case when count(*) over {w(20)} = 20 and count(y) over {w(20)} >= 2 and var_pop(x0) over {w(20)} > 0 then covar_pop(y, x0) over {w(20)} / var_pop(x0) over {w(20)} end", 9),
    "linear_deviation": deviation(20, 1), "quadratic_deviation": deviation(20, 2), "cubic_deviation": deviation(20, 3),
    "linear_trend": trend(20, 1), "quadratic_trend": trend(20, 2), "cubic_trend": trend(20, 3),
    "aroon_diff": nested(f"{listed('high', 26)} as hs, {listed('low', 26)} as ls", "case when len(hs) = 26 and len(ls) = 26 then 100.0 * (list_position(list_reverse(ls), list_min(ls)) - list_position(list_reverse(hs), list_max(hs))) / 25 end"),
    "percent_rank": nested(f"{listed('close', 50)} as l", _BELOW.format(n=50, x="close")),
    "dv2": f"select ticker, trade_date, 100 * {_BELOW.format(n=20, x='q')} as value from (select *, {listed('q', 20)} as l from (select *, {avg('q0', 2)} as q from (select *, close / nullif((high + low) / 2, 0) - 1 as q0 from t)))",
    "fractal_high": f"case when {lag('high', 2)} = {full('max', 'high', 5)} then {lag('high', 2)} end",
    "fractal_low": f"case when {lag('low', 2)} = {full('min', 'low', 5)} then {lag('low', 2)} end",
    "oscillator": f"close - {avg('close', 30)}",
    "ulcer_performance": nested(f"100 * (close / nullif({full('max', 'close', 14)}, 0) - 1) as d", f"{avg('r', 14)} / nullif(sqrt({full('avg', 'd * d', 14)}) / 100, 0)"),
    "sortino_population": f"{avg('r', 20)} / nullif({full('stddev_pop', 'r', 20)}, 0) * sqrt(20)",
    "demark_pivot": f"(case when coalesce(c1 < {lag('open', 1)}, false) then h1 + 2 * l1 + c1 when coalesce(c1 > {lag('open', 1)}, false) then 2 * h1 + l1 + c1 else h1 + l1 + 2 * c1 end) / 4",
    "fibonacci_s1": "(h1 + l1 + c1) / 3 - 0.382 * (h1 - l1)",
    "pivot_r2": "(h1 + l1 + c1) / 3 + h1 - l1",
    "pivot_s2": "(h1 + l1 + c1) / 3 - (h1 - l1)",
    "information_ratio_rolling": nested(f"r - (open - {lag('open', 1)}) / nullif({lag('open', 1)}, 0) as e", ratio(avg("e", 20), full("stddev_samp", "e", 20))),
    "rolling_beta": nested(f"r as a, (open - {lag('open', 1)}) / nullif({lag('open', 1)}, 0) as b", f"case when count(a + b) over {w(20)} = 20 then covar_pop(a, b) over {w(20)} / nullif(case when count(b) over {w(20)} = 20 then var_pop(b) over {w(20)} end, 0) end"),
    "rolling_calmar": nested(f"{listed('close', 20)} as l", f"case when count(r) over {w(20)} = 20 and len(l) = 20 and abs(close / nullif({lag('close', 20)}, 0) - 1) < 0.5 then (pow(close / {lag('close', 20)}, 252.0 / 20) - 1) / nullif(abs(least({_DRAWDOWN}, 0)), 0) end"),
    "rolling_tail_ratio": f"case when count(r) over {w(40)} = 40 then abs(quantile_cont(r, 0.95) over {w(40)}) / nullif(abs(quantile_cont(r, 0.05) over {w(40)}), 0) end",
    "rolling_value_at_risk": f"case when count(r) over {w(40)} = 40 then quantile_cont(r, 0.05) over {w(40)} end",
    "price_intensity": f"case when tr <> 0 and close is not null and open is not null then {score('(close - open) / tr', 0.8)} end",
}
#: Calls other than with the defaults: so that the test tables fill the windows, or the values stay of a size.
CALLS = {"rolling_calmar": "only_if(abs(close / delay(close, 20) - 1) < 0.5, rolling_calmar(close, 20))", "heikin_delta": "heikin_delta(open, high, low, close) / 3.7", "rolling_annualized": "only_if(abs(close / delay(close, 20) - 1) < 0.5, rolling_annualized(close, 20))", "dv2": "dv2(high, low, close, 20, 2)", "normalized_positive_volume_index": "normalized_positive_volume_index(close, volume, 10, 40)", "normalized_negative_volume_index": "normalized_negative_volume_index(close, volume, 10, 40)", "normal_score": "normal_score(close - 10, 0.1)"}


def library_sql(name: str) -> str | None:
    """Select of ticker, trade_date and value of an indicator over the panel p; None where it is recursive."""
    sql = SQL.get(name)
    if sql is None:
        return None
    return f"with {BASE} " + (sql if sql.startswith("select ") else f"select ticker, trade_date, {sql} as value from t")
