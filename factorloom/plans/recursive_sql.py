"""SQL of recursive indicators and of windows over lists: recursive tables over each ticker's numbered values."""

from __future__ import annotations

from ..functions.panel_ops import half_life_weights

P = "(partition by ticker order by trade_date)"
_JOIN = "using (ticker, trade_date)"


def smoothed(name: str, source: str, n: int, alpha: float, x: str = "x") -> str:
    """Tables ending in `name` (ticker, trade_date, x): exponential smoothing of source's x, seeded with the mean of its first n values."""
    return f"""{name}_v as (select ticker, trade_date, {x} as x, row_number() over {P} as i from {source} where {x} is not null),
{name}_s as (select ticker, avg(x) as e from {name}_v where i <= {n} group by ticker having count(*) = {n}),
{name}_r(ticker, i, e) as (select ticker, cast({n} as bigint), e from {name}_s union all select v.ticker, v.i, r.e + {alpha!r} * (v.x - r.e) from {name}_r r join {name}_v v on v.ticker = r.ticker and v.i = r.i + 1),
{name} as (select p.ticker, p.trade_date, r.e as x from p left join {name}_v v on v.ticker = p.ticker and v.trade_date = p.trade_date left join {name}_r r on r.ticker = v.ticker and r.i = v.i)"""


def ema(name: str, n: int, source: str = "p", x: str = "close") -> str:
    return smoothed(name, source, n, 2 / (n + 1), x)


def _steps(name: str, lag: int = 1, dense: bool = False) -> str:
    """Rises and falls of the close against `lag` known values before (rows before, if dense)."""
    where = "" if dense else "where close is not null"
    known = "close is not null and b is not null" if not dense else "true"
    return f"{name} as (select ticker, trade_date, case when {known} then greatest(close - b, 0) end as up, case when {known} then greatest(b - close, 0) end as down, close - b as d from (select ticker, trade_date, close, lag(close, {lag}) over {P} as b from p {where}))"


def _both(value: str, first: str, *others: str) -> str:
    """Select of a value over joined tables of x (named as the tables)."""
    return f"select ticker, trade_date, {value} as value from {first} " + " ".join(f"join {o} {_JOIN}" for o in others)


def _ewma(half_life: float = 0.0, span: float | None = None) -> str:
    a = 2 / (span + 1) if span else 1 - 0.5 ** (1 / half_life)
    return f"""d as (select ticker, trade_date, close, row_number() over {P} as i from p),
r(ticker, i, m, w) as (select ticker, i, close, 1.0::double from d where i = 1 union all
  select d.ticker, d.i, case when d.close is null then r.m when r.m is null then d.close else (r.w * {1 - a!r} * r.m + {a!r} * d.close) / (r.w * {1 - a!r} + {a!r}) end,
    case when d.close is null and r.m is not null then r.w * {1 - a!r} else 1.0 end from r join d on d.ticker = r.ticker and d.i = r.i + 1)
select d.ticker, d.trade_date, r.m as value from d join r on r.ticker = d.ticker and r.i = d.i"""


_RSI = f"{_steps('st')}, {smoothed('u', 'st', 14, 1 / 14, 'up')}, {smoothed('w', 'st', 14, 1 / 14, 'down')}, rs as (select ticker, trade_date, case when u.x + w.x > 0 then 100 * u.x / (u.x + w.x) end as x from u join w {_JOIN})"
_MACD = f"{ema('f', 12)}, {ema('s', 26)}, mc as (select ticker, trade_date, f.x - s.x as x from f join s {_JOIN})"
_TRIX = ", ".join((ema("e1", 5), ema("e2", 5, "e1", "x"), ema("e3", 5, "e2", "x"))) + f", tx as (select ticker, trade_date, 100 * (x / lag(x) over {P} - 1) as x from e3)"
_TRIX15 = ", ".join((ema("e1", 15), ema("e2", 15, "e1", "x"), ema("e3", 15, "e2", "x"))) + f", tx as (select ticker, trade_date, 100 * (x / lag(x) over {P} - 1) as x from e3)"
_HL = half_life_weights(5, 2.0)
_W5 = f"(partition by ticker order by trade_date rows between 4 preceding and current row)"
_W20 = f"(partition by ticker order by trade_date rows between 19 preceding and current row)"



def _weighted(products: dict[str, str]) -> str:
    """Weighted means over five rows of products of ln(close) and ln(open), NULL if one is missing."""
    cols = ", ".join(f"case when count({e}) over {_W5} = 5 then " + " + ".join(f"{w!r} * " + (f"lag({e}, {4 - i}) over {P}" if i < 4 else f"({e})") for i, w in enumerate(_HL)) + f" end as {n}" for n, e in products.items())
    return f"lg as (select ticker, trade_date, case when close > 0 then ln(close) end as y, case when open > 0 then ln(open) end as x from p), m as (select ticker, trade_date, {cols} from lg)"


_ALL5 = {"my": "y", "mx": "x", "mxy": "x * y", "mxx": "x * x", "myy": "y * y"}


def _present(expression: str, name: str) -> str:
    return " + ".join(f"{w!r} * coalesce(" + (f"lag({expression}, {4 - i}) over {P}" if i < 4 else expression) + ", 0)" for i, w in enumerate(_HL)) + f" as {name}"


_BOTH = "case when close is not null and open is not null then {} end"
#: Query name: tables and a last select of ticker, trade_date, value, over p.
SQL: dict[str, str] = {
    "ind_ema": ema("e", 12) + " select ticker, trade_date, x as value from e",
    "ind_smma": smoothed("e", "p", 14, 1 / 14, "close") + " select ticker, trade_date, x as value from e",
    "ind_dema": f"{ema('a', 10)}, {ema('b', 10, 'a', 'x')} " + _both("2 * a.x - b.x", "a", "b"),
    "ind_tema": f"{ema('a', 10)}, {ema('b', 10, 'a', 'x')}, {ema('c', 10, 'b', 'x')} " + _both("3 * a.x - 3 * b.x + c.x", "a", "b", "c"),
    "ind_macd": _MACD + " select ticker, trade_date, x as value from mc",
    "lib_macd_signal": f"{_MACD}, {ema('g', 9, 'mc', 'x')} select ticker, trade_date, x as value from g",
    "lib_macd_histogram": f"{_MACD}, {ema('g', 9, 'mc', 'x')} " + _both("mc.x - g.x", "mc", "g"),
    "lib_price_oscillator": _MACD + " select ticker, trade_date, x as value from mc",
    "lib_percentage_price_oscillator": f"{ema('f', 12)}, {ema('s', 26)} " + _both("100 * (f.x - s.x) / nullif(s.x, 0)", "f", "s"),
    "ind_rsi": _RSI + " select p.ticker, p.trade_date, x as value from p left join rs " + _JOIN,
    "lib_stochastic_rsi": f"{_RSI}, pr as (select p.ticker, p.trade_date, x from p left join rs {_JOIN}), mm as (select *, case when count(x) over w = 14 then min(x) over w end as lo, case when count(x) over w = 14 then max(x) over w end as hi from pr window w as (partition by ticker order by trade_date rows between 13 preceding and current row)) select ticker, trade_date, 100 * (x - lo) / nullif(hi - lo, 0) as value from mm",
    "lib_rmi": f"{_steps('st', 5, True)}, {smoothed('u', 'st', 20, 1 / 20, 'coalesce(up, 0)')}, {smoothed('w', 'st', 20, 1 / 20, 'coalesce(down, 0)')} " + _both("100 * u.x / nullif(u.x + w.x, 0)", "u", "w"),
    "ind_trix": _TRIX + " select ticker, trade_date, x as value from tx",
    "lib_trix_signal": f"{_TRIX15}, {ema('g', 9, 'tx', 'x')} select ticker, trade_date, x as value from g",
    "ind_zero_lag_ema": f"z as (select ticker, trade_date, close + (close - lag(close, 5) over {P}) as x from p), {ema('e', 12, 'z', 'x')} select ticker, trade_date, x as value from e",
    "ind_tsi": f"{_steps('st')}, {ema('a', 25, 'st', 'd')}, {ema('b', 13, 'a', 'x')}, {ema('c', 25, 'st', 'abs(d)')}, {ema('e', 13, 'c', 'x')} " + _both("100 * b.x / nullif(e.x, 0)", "b", "e"),
    "ind_ewm_mean": _ewma(span=10), "fx_ewma": _ewma(5), "fx_ewma_half_life": _ewma(3.0),
    "ind_heikin_open": f"""k as (select ticker, trade_date, open as o, close as c, (open + high + low + close) / 4 as hc, row_number() over {P} as i from p where open + high + low + close is not null),
r(ticker, i, ho) as (select ticker, i, (o + c) / 2 from k where i = 1 union all select k.ticker, k.i, (r.ho + b.hc) / 2 from r join k on k.ticker = r.ticker and k.i = r.i + 1 join k b on b.ticker = r.ticker and b.i = r.i)
select p.ticker, p.trade_date, r.ho / 3.7 as value from p left join k {_JOIN} left join r on r.ticker = k.ticker and r.i = k.i""",
    "lib_heikin_delta": f"""k as (select ticker, trade_date, open as o, close as c, (open + high + low + close) / 4 as hc, row_number() over {P} as i from p where open + high + low + close is not null),
r(ticker, i, ho) as (select ticker, i, (o + c) / 2 from k where i = 1 union all select k.ticker, k.i, (r.ho + b.hc) / 2 from r join k on k.ticker = r.ticker and k.i = r.i + 1 join k b on b.ticker = r.ticker and b.i = r.i)
select p.ticker, p.trade_date, (k.hc - r.ho) / 3.7 as value from p left join k {_JOIN} left join r on r.ticker = k.ticker and r.i = k.i""",
    "fx_ts_cov_weighted": _weighted(_ALL5) + " select ticker, trade_date, mxy - mx * my as value from m",
    "fx_ts_corr_weighted": _weighted(_ALL5) + " select ticker, trade_date, case when myy - my * my > 1e-12 and mxx - mx * mx > 1e-12 then (mxy - mx * my) / sqrt((myy - my * my) * (mxx - mx * mx)) end as value from m",
    "fx_ts_linreg_weighted": f"""q as (select ticker, trade_date, {_BOTH.format('close')} as y, {_BOTH.format('open')} as x, {_BOTH.format('1.0')} as o from p),
s as (select ticker, trade_date, count(*) over {_W5} as n, count(y) over {_W5} as k, {_present('o', 'sw')}, {_present('x', 'sx')}, {_present('y', 'sy')}, {_present('x * y', 'sxy')}, {_present('x * x', 'sxx')} from q)
select ticker, trade_date, case when n = 5 and k >= 2 and sw * sxx - sx * sx > 1e-12 then (sw * sxy - sx * sy) / (sw * sxx - sx * sx) end as value from s""",
    "fx_ts_linreg_resid": f"q as (select ticker, trade_date, close, open, {_BOTH.format('close')} as y, {_BOTH.format('open')} as x from p) select ticker, trade_date, case when count(*) over w = 10 and count(y) over w >= 2 and var_pop(x) over w > 0 then close - regr_intercept(y, x) over w - regr_slope(y, x) over w * open end * 0.7310585786 as value from q window w as (partition by ticker order by trade_date rows between 9 preceding and current row)",
    "fx_ts_cumsum_agg_min_backward": f"l as (select ticker, trade_date, count(*) over w as n, count(pct_chg) over w as k, coalesce(pct_chg, 0) as a, coalesce(lag(pct_chg, 1) over {P}, 0) as b, coalesce(lag(pct_chg, 2) over {P}, 0) as c, coalesce(lag(pct_chg, 3) over {P}, 0) as d from p window w as (partition by ticker order by trade_date rows between 3 preceding and current row)) select ticker, trade_date, case when k > 0 then least(a, case when n >= 2 then a + b end, case when n >= 3 then a + b + c end, case when n >= 4 then a + b + c + d end) end as value from l",
    "fx_clip_mad_rolling": f"l as (select ticker, trade_date, close, list(close) filter (close is not null) over {_W20} as l from p), m as (select *, list_median(l) as m from l), d as (select *, 1.4826 * 3 * list_median([abs(v - m) for v in l]) as d from m) select ticker, trade_date, case when close is not null then greatest(least(close, m + d), m - d) end as value from d",
    "fx_winsorize_rolling": f"l as (select ticker, trade_date, close, list_sort(list(close) filter (close is not null) over {_W20}) as l from p) select ticker, trade_date, case when close is not null then greatest(least(close, l[len(l) - cast(floor(0.1 * len(l)) as bigint)]), l[cast(floor(0.1 * len(l)) as bigint) + 1]) end as value from l",
    "ind_skew": f"c as (select ticker, trade_date, list(pct_chg) filter (pct_chg is not null) over {_W20} as l, avg(pct_chg) over {_W20} as m from p), s as (select *, list_sum([(v - m) * (v - m) for v in l]) / len(l) as m2, list_sum([(v - m) * (v - m) * (v - m) for v in l]) / len(l) as m3 from c) select ticker, trade_date, case when len(l) = 20 and m2 > 1e-18 then m3 / pow(m2, 1.5) end as value from s",
    "lab_triple_barrier": f"""n as (select ticker, trade_date, close, row_number() over {P} as i, count(*) over (partition by ticker) as n from p),
h as (select a.ticker, a.i, min(b.i) filter (b.close / a.close - 1 >= 0.05) as up, min(b.i) filter (b.close / a.close - 1 <= -0.05) as down from n a join n b on a.ticker = b.ticker and b.i > a.i and b.i <= a.i + 10 group by 1, 2)
select n.ticker, trade_date, case when close is null or i > n - 10 then null when up is null and down is null then 0 when down is null or up < down then 1 else -1 end as value from n left join h using (ticker, i)""",
    "fx_neutralize_rank": f"""r as (select *, case when industry is not null and close is not null then (rank() over (partition by trade_date, industry order by case when industry is not null then close end nulls last) + (count(close) over (partition by trade_date, industry, close) - 1) / 2) / count(close) over (partition by trade_date, industry) end as q0 from p),
q as (select *, greatest(least(q0, 1 - 1e-6), 1e-6) as q from r), t as (select *, sqrt(-2 * ln(least(q, 1 - q))) as t, (q - 0.5) * (q - 0.5) as s from q)
select ticker, trade_date, case when q0 is null then close when q between 0.02425 and 1 - 0.02425 then
    (q - 0.5) * (((((-39.69683028665376 * s + 220.9460984245205) * s - 275.9285104469687) * s + 138.357751867269) * s - 30.66479806614716) * s + 2.506628277459239) / (((((-54.47609879822406 * s + 161.5858368580409) * s - 155.6989798598866) * s + 66.80131188771972) * s - 13.28068155288572) * s + 1)
  else (case when q < 0.5 then 1 else -1 end) * (((((-0.007784894002430293 * t - 0.3223964580411365) * t - 2.400758277161838) * t - 2.549732539343734) * t + 4.374664141464968) * t + 2.938163982698783) / ((((0.007784695709041462 * t + 0.3224671290700398) * t + 2.445134137142996) * t + 3.754408661907416) * t + 1) end as value from t""",
    "ind_renko": f"""k as (select ticker, trade_date, close as v, row_number() over {P} as i from p where close is not null),
r(ticker, i, level) as (select ticker, i, v from k where i = 1 union all select k.ticker, k.i, r.level + trunc(k.v - r.level) from r join k on k.ticker = r.ticker and k.i = r.i + 1)
select p.ticker, p.trade_date, r.level as value from p left join k {_JOIN} left join r on r.ticker = k.ticker and r.i = k.i""",
    "ind_laguerre": f"""k as (select ticker, trade_date, close as v, row_number() over {P} as i from p where close is not null),
r(ticker, i, a, b, c, d) as (select ticker, i, v, v, v, v from k where i = 1 union all
  select ticker, i, na, nb, nc, -0.5 * nc + c + 0.5 * d from (select ticker, i, na, nb, -0.5 * nb + b + 0.5 * c as nc, c, d from (select ticker, i, na, -0.5 * na + a + 0.5 * b as nb, b, c, d from (select k.ticker, k.i, 0.5 * k.v + 0.5 * r.a as na, r.a, r.b, r.c, r.d from r join k on k.ticker = r.ticker and k.i = r.i + 1))))
select p.ticker, p.trade_date, (r.a + 2 * r.b + 2 * r.c + r.d) / 6 * 0.7310585786 as value from p left join k {_JOIN} left join r on r.ticker = k.ticker and r.i = k.i""",
    "sig_stop_exit": f"""k as (select ticker, trade_date, close as v, row_number() over {P} as i from p where close is not null),
r(ticker, i, ref, hit) as (select ticker, i, v, 0 from k where i = 1 union all
  select k.ticker, k.i, case when r.ref is null then k.v when k.v <= r.ref * 0.9 then null else greatest(r.ref, k.v) end, case when r.ref is not null and k.v <= r.ref * 0.9 then 1 else 0 end from r join k on k.ticker = r.ticker and k.i = r.i + 1)
select p.ticker, p.trade_date, coalesce(r.hit, 0) as value from p left join k {_JOIN} left join r on r.ticker = k.ticker and r.i = k.i""",
    "ind_kama": f"""k as (select ticker, trade_date, close as v, row_number() over {P} as i, abs(close - lag(close, 10) over {P}) as far, abs(close - lag(close) over {P}) as step from p where close is not null),
w as (select ticker, trade_date, v, i, pow(coalesce(far / nullif(case when count(step) over (partition by ticker order by i rows between 9 preceding and current row) = 10 then sum(step) over (partition by ticker order by i rows between 9 preceding and current row) end, 0), 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) as w from k),
s as (select ticker, avg(v) as e from w where i <= 10 group by ticker having count(*) = 10),
r(ticker, i, e) as (select ticker, cast(10 as bigint), e from s union all select w.ticker, w.i, r.e + w.w * (w.v - r.e) from r join w on w.ticker = r.ticker and w.i = r.i + 1)
select p.ticker, p.trade_date, r.e as value from p left join k {_JOIN} left join r on r.ticker = k.ticker and r.i = k.i""",
    "ind_adx": f"""k as (select ticker, trade_date, high, low, high - lag(high) over {P} as up, lag(low) over {P} - low as dn, lag(close) over {P} as c1 from p where high is not null and low is not null and close is not null),
m as (select ticker, trade_date, case when c1 is not null then case when up > dn and up > 0 then up else 0 end end as plus, case when c1 is not null then case when dn > up and dn > 0 then dn else 0 end end as minus, case when c1 is not null then greatest(high - low, abs(high - c1), abs(low - c1)) end as tr from k),
{smoothed('sp', 'm', 14, 1 / 14, 'plus')}, {smoothed('sm', 'm', 14, 1 / 14, 'minus')}, {smoothed('st', 'm', 14, 1 / 14, 'tr')},
dx as (select k.ticker, k.trade_date, case when a.x + b.x > 0 then 100 * abs(a.x - b.x) / (a.x + b.x) when c.x is not null then 0 end as x from k join sp a {_JOIN} join sm b {_JOIN} join st c {_JOIN}), {smoothed('ax', 'dx', 14, 1 / 14)}
select ticker, trade_date, x as value from ax""",
    "ind_supertrend": f"""k as (select ticker, trade_date, (high + low) / 2 as mid, close as c, row_number() over {P} as i, greatest(high - low, coalesce(abs(high - lag(close) over {P}), 0), coalesce(abs(low - lag(close) over {P}), 0)) as tr from p where high is not null and low is not null and close is not null),
{smoothed('ar', 'k', 10, 1 / 10, 'tr')}, q as (select k.ticker, k.trade_date, k.i, c, mid + 3 * x as u, mid - 3 * x as d, lag(c) over (partition by k.ticker order by k.i) as before from k join ar {_JOIN} where x is not null),
z as (select *, row_number() over (partition by ticker order by i) as j from q),
r(ticker, j, up, low, rising) as (select ticker, j, u, d, c >= d from z where j = 1 union all
  select ticker, j, up, low, case when was then c >= low else c > up end from (select z.ticker, z.j, z.c, r.rising as was, case when z.u < r.up or z.before > r.up then z.u else r.up end as up, case when z.d > r.low or z.before < r.low then z.d else r.low end as low from r join z on z.ticker = r.ticker and z.j = r.j + 1))
select p.ticker, p.trade_date, case when rising then low else up end as value from p left join z {_JOIN} left join r on r.ticker = z.ticker and r.j = z.j""".replace("case when rising then low else up end", "case when r.rising then r.low else r.up end"),
}
