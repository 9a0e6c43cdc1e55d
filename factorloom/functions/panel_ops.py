"""Column builders of the formula language: element-wise, time-series and cross-section operators.

Every builder takes the panel's key columns (`Keys`) and names of columns already there,
and returns a Column; none runs anything. The panel is dense (a row for each ticker and
date), missing values are NULL. Time-series operators need a full window of non-null
values unless their docstring says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Keys:
    """Key columns of a panel."""

    ticker: str = "ticker"
    date: str = "trade_date"

    @property
    def along(self) -> WindowSpec:
        return Window.partitionBy(self.ticker).orderBy(self.date)

    def last(self, n: int) -> WindowSpec:
        """The last n rows of a ticker, this one included."""
        return self.along.rowsBetween(-(int(n) - 1), 0)

    @property
    def past(self) -> WindowSpec:
        """All rows of a ticker up to this one."""
        return self.along.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def backward(self) -> WindowSpec:
        """All rows of a ticker from its last back to this one: a frame to the end would be scanned anew for every row."""
        return Window.partitionBy(self.ticker).orderBy(F.col(self.date).desc()).rowsBetween(Window.unboundedPreceding, 0)

    @property
    def day(self) -> WindowSpec:
        """The cross-section of a date."""
        return Window.partitionBy(self.date)


def clean(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def div(x: Column, y: Column) -> Column:
    """x / y, NULL where y is 0 (no infinities in the panel)."""
    return F.try_divide(x, y)


def sqrt(x: Column) -> Column:
    """Square root, NULL for negatives."""
    return F.when(x >= 0, F.sqrt(x))


def log(x: Column, base: Column | None = None) -> Column:
    """Natural logarithm, or to a base; NULL for what isn't positive."""
    n = F.when(x > 0, F.ln(x))
    return n if base is None else div(n, F.when(base > 0, F.ln(base)))


def power(x: Column, p: Column) -> Column:
    """x to the p; NULL where it isn't a number."""
    return clean(F.pow(x, p))


def signedpower(x: Column, p: Column) -> Column:
    """sign(x) |x|^p."""
    return clean(F.signum(x) * F.pow(F.abs(x), p))


def compare(op: str, x: Column, y: Column) -> Column:
    """Comparison in which a missing operand is False (True for !=)."""
    c = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "==": x == y, "!=": x != y}[op]
    return F.coalesce(c, F.lit(op == "!="))


def _full(k: Keys, x: str, n: int, agg: Column) -> Column:
    w = k.last(n)
    return F.when(F.count(F.col(x)).over(w) >= n, agg.over(w))


def _rows(k: Keys, n: int) -> Column:
    """Whether the window has n rows, missing values counted."""
    return F.count(F.lit(1)).over(k.last(n)) >= n


def delay(k: Keys, x: str, n: int) -> Column:
    """The value n rows before (after, if n < 0)."""
    return F.lag(F.col(x), int(n)).over(k.along) if n >= 0 else F.lead(F.col(x), -int(n)).over(k.along)


def delta(k: Keys, x: str, n: int) -> Column:
    return F.col(x) - delay(k, x, n)


def pct_change(k: Keys, x: str, n: int = 1) -> Column:
    before = delay(k, x, n)
    return div(F.col(x) - before, before)


def ffill(k: Keys, x: str) -> Column:
    """The last value so far."""
    return F.last(F.col(x), ignorenulls=True).over(k.past)


def bfill(k: Keys, x: str) -> Column:
    """The next value from here on."""
    return F.last(F.col(x), ignorenulls=True).over(k.backward)


def ts_sum(k: Keys, x: str, n: int) -> Column:
    return _full(k, x, n, F.sum(F.col(x)))


def ts_prod(k: Keys, x: str, n: int) -> Column:
    return _full(k, x, n, F.product(F.col(x)))


def ts_min(k: Keys, x: str, n: int) -> Column:
    return _full(k, x, n, F.min(F.col(x)))


def ts_max(k: Keys, x: str, n: int) -> Column:
    return _full(k, x, n, F.max(F.col(x)))


def half_life_weights(n: int, half_life: float) -> list[float]:
    """Weights of the n rows of a window, oldest first, halving every half_life rows, of sum 1."""
    w = [0.5 ** (a / half_life) for a in range(n, 0, -1)]
    return [x / sum(w) for x in w]


def ts_mean(k: Keys, x: str, n: int, weight: bool = False, half_life: float | None = None) -> Column:
    """Mean of the window; with half-life weights if weight (NULL if any value is missing)."""
    if not weight:
        return _full(k, x, n, F.avg(F.col(x)))
    return weighted_sum(k, F.col(x), half_life_weights(n, half_life))


def weighted_sum(k: Keys, c: Column, weights: list[float], missing: float | None = None) -> Column:
    """Sum of the weights (oldest first) times the last rows' values, folded over one array whatever the width.

    NULL if a value is missing, or, if `missing` is given, that value stands for it (the window must have all its rows).
    """
    n = len(weights)
    w = k.last(n)
    full = F.count(c if missing is None else F.lit(1)).over(w) >= n
    arr = F.collect_list(c if missing is None else F.coalesce(c, F.lit(missing))).over(w)
    products = F.zip_with(arr, F.array(*[F.lit(float(x)) for x in weights]), lambda v, x: v * x)
    return F.when(full, F.aggregate(products, F.lit(0.0), lambda a, v: a + v))


def ts_stddev(k: Keys, x: str, n: int, weight: bool = False, half_life: float | None = None) -> Column:
    """Sample deviation of the window; population deviation with half-life weights if weight."""
    if not weight:
        return _full(k, x, n, F.stddev_samp(F.col(x)))
    m1, m2 = (ts_moment(k, [x] * p, n, half_life) for p in (1, 2))
    return F.when(m2.isNotNull(), F.sqrt(F.greatest(m2 - m1 * m1, F.lit(0.0))))


def ts_moment(k: Keys, xs: list[str], n: int, half_life: float | None) -> Column:
    """Weighted mean over the window of the product of columns; NULL if any value is missing."""
    c = F.col(xs[0])
    for x in xs[1:]:
        c = c * F.col(x)
    ws = half_life_weights(n, half_life) if half_life else [1 / n] * n
    return weighted_sum(k, c, ws)


def _both(k: Keys, y: str, x: str, n: int) -> Column:
    return F.count(F.col(y) + F.col(x)).over(k.last(n)) >= n


def ts_cov(k: Keys, y: str, x: str, n: int, weight: bool = False, half_life: float | None = None) -> Column:
    """Population covariance over the window (half-life weighted if weight); NULL if any value is missing."""
    if not weight:
        return F.when(_both(k, y, x, n), F.covar_pop(F.col(y), F.col(x)).over(k.last(n)))
    return ts_moment(k, [y, x], n, half_life) - ts_moment(k, [y], n, half_life) * ts_moment(k, [x], n, half_life)


def ts_corr(k: Keys, y: str, x: str, n: int, weight: bool = False, half_life: float | None = None) -> Column:
    """Correlation over the window; NULL if any value is missing or a side is constant."""
    if not weight:
        w = k.last(n)
        spread = F.var_pop(F.col(y)).over(w) * F.var_pop(F.col(x)).over(w)
        return F.when(_both(k, y, x, n) & (spread > 1e-18), div(F.covar_pop(F.col(y), F.col(x)).over(w), F.sqrt(spread)))
    vy, vx = (ts_moment(k, [c, c], n, half_life) - F.pow(ts_moment(k, [c], n, half_life), F.lit(2)) for c in (y, x))
    return F.when((vy > 1e-12) & (vx > 1e-12), ts_cov(k, y, x, n, True, half_life) / F.sqrt(vy * vx))


def ts_rank(k: Keys, x: str, n: int) -> Column:
    """Rank of this value in the window, the greatest first, ties averaged."""
    arr = F.collect_list(F.col(x)).over(k.last(n))
    more = F.size(F.filter(arr, lambda v: v > F.col(x)))
    same = F.size(F.filter(arr, lambda v: v == F.col(x)))
    return F.when((F.size(arr) >= n) & F.col(x).isNotNull(), 1 + more + (same - 1) / 2)


def ts_argmax(k: Keys, x: str, n: int) -> Column:
    """Position (0 = oldest) of the first greatest value; missing ones count least, all missing gives NULL."""
    arr = F.collect_list(F.coalesce(F.col(x), F.lit(float("-inf")))).over(k.last(n))
    return F.when(_rows(k, n) & (F.count(F.col(x)).over(k.last(n)) > 0), (F.array_position(arr, F.array_max(arr)) - 1).cast("double"))


def ts_cumsum_agg(k: Keys, x: str, n: int, agg: str = "max", direction: str = "forward") -> Column:
    """Greatest or least running sum within the window (from its newest row, if backward); short windows allowed."""
    arr = F.collect_list(F.coalesce(F.col(x), F.lit(0.0))).over(k.last(n))
    if direction == "backward":
        arr = F.reverse(arr)
    pick, start = (F.greatest, "-inf") if agg == "max" else (F.least, "inf")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(float(start)).alias("e"))
    best = F.aggregate(arr, zero, lambda a, v: F.struct((a.s + v).alias("s"), pick(a.e, a.s + v).alias("e")), lambda a: a.e)
    return F.when(F.count(F.col(x)).over(k.last(n)) > 0, best)


def _about_mean(k: Keys, x: str, n: int, above: bool, squared: bool) -> Column:
    w = k.last(n)
    arr, mean = F.collect_list(F.col(x)).over(w), F.avg(F.col(x)).over(w)
    part = F.filter(arr, lambda v: (v > mean) if above else (v < mean))
    out = F.aggregate(part, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) if squared else F.size(part).cast("double")
    return F.when(_rows(k, n), F.coalesce(out, F.lit(0.0)))


def num_gt_mean(k: Keys, x: str, n: int) -> Column:
    """How many values of the window exceed its mean; missing values don't count."""
    return _about_mean(k, x, n, True, False)


def num_lt_mean(k: Keys, x: str, n: int) -> Column:
    return _about_mean(k, x, n, False, False)


def upper_center_squared_sum(k: Keys, x: str, n: int) -> Column:
    """Sum of squared deviations of the values above the window's mean."""
    return _about_mean(k, x, n, True, True)


def lower_center_squared_sum(k: Keys, x: str, n: int) -> Column:
    return _about_mean(k, x, n, False, True)


def ts_linreg(k: Keys, y: str, x: str, n: int, param: str = "beta", weight: bool = False, half_life: float | None = None) -> Column:
    """Least squares of y on x over the window: beta, alpha, or resid (this row's residual).

    The window must have n rows; of them those with both values count, two at least; a
    constant x gives NULL. With weight: half-life weights, and residuals scaled by the root
    of the row's weight.
    """
    w = k.last(n)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    yy, xx = F.when(both, F.col(y)), F.when(both, F.col(x))
    if not weight:
        slope, cut, scale = F.regr_slope(yy, xx).over(w), F.regr_intercept(yy, xx).over(w), F.lit(1.0)
        enough = F.count(yy).over(w) >= 2
    else:
        ws = half_life_weights(n, half_life)
        s = {p: _present(k, ws, c) for p, c in {"w": F.when(both, F.lit(1.0)), "x": xx, "y": yy, "xy": xx * yy, "xx": xx * xx}.items()}
        slope = div(s["w"] * s["xy"] - s["x"] * s["y"], F.when(s["w"] * s["xx"] - s["x"] * s["x"] > 1e-12, s["w"] * s["xx"] - s["x"] * s["x"]))
        cut, scale, enough = div(s["y"] - slope * s["x"], s["w"]), F.lit(math.sqrt(ws[-1])), F.count(yy).over(w) >= 2
    value = {"beta": slope, "alpha": cut, "resid": (F.col(y) - cut - slope * F.col(x)) * scale}[param]
    return F.when(_rows(k, n) & enough, value)


def _present(k: Keys, ws: list[float], c: Column) -> Column:
    return weighted_sum(k, c, ws, missing=0.0)


def block_agg(k: Keys, x: str, n: int, sections: int, inner: str, outer: str) -> Column:
    """Two-level aggregate: the full window in equal blocks of rows, inner over each, outer over the blocks.

    inner and outer: mean, sum, min, max; outer also range.
    """
    if n % sections:
        raise ValueError("the window must divide into the sections")
    size = n // sections
    arr = F.collect_list(F.col(x)).over(k.last(n))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    agg = {"sum": total, "mean": lambda a: total(a) / F.size(a), "min": F.array_min, "max": F.array_max, "range": lambda a: F.array_max(a) - F.array_min(a)}
    blocks = F.array(*[agg[inner](F.slice(arr, i * size + 1, size)) for i in range(sections)])
    return F.when(F.size(arr) >= n, agg[outer](blocks))


def cs_rank(k: Keys, x: str) -> Column:
    """Dense rank within the date, the greatest first; NULL for missing values."""
    w = k.day.orderBy(F.col(x).desc_nulls_last())
    return F.when(F.col(x).isNotNull(), F.dense_rank().over(w).cast("double"))


def cs_mean(k: Keys, x: str, weight: str | None = None) -> Column:
    """Mean of the date's other tickers; unweighted, missing ones dilute it."""
    if weight is None:
        others = F.count(F.lit(1)).over(k.day) - 1
        return div(F.coalesce(F.sum(F.col(x)).over(k.day), F.lit(0.0)) - F.col(x), F.when(others > 0, others))
    wx = F.col(x) * F.col(weight)
    return div(F.sum(wx).over(k.day) - wx, F.sum(F.col(weight)).over(k.day) - F.col(weight))


def cs_mean_by_industry(k: Keys, x: str, industry: str, weight: str | None = None) -> Column:
    """Weighted mean of the other tickers of the date and industry; NULL where there is none."""
    g = Window.partitionBy(k.date, industry)
    wt = F.lit(1.0) if weight is None else F.col(weight)
    wx = F.col(x) * wt
    return F.when(F.col(industry).isNotNull(), div(F.coalesce(F.sum(wx).over(g), F.lit(0.0)) - wx, F.sum(wt).over(g) - wt))


def cs_linreg(k: Keys, y: str, x: str, param: str = "beta", weight: str | None = None) -> Column:
    """Least squares of y on x over the date's tickers: beta, alpha, or each ticker's resid; NULL rows stay NULL."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    if weight:
        both = both & F.col(weight).isNotNull()
    yy, xx = F.when(both, F.col(y)), F.when(both, F.col(x))
    if weight is None:
        slope, cut = F.regr_slope(yy, xx).over(k.day), F.regr_intercept(yy, xx).over(k.day)
    else:
        w = F.when(both, F.col(weight))
        s = {p: F.sum(w * c).over(k.day) for p, c in {"w": F.lit(1.0), "x": xx, "y": yy, "xy": xx * yy, "xx": xx * xx}.items()}
        slope = div(s["w"] * s["xy"] - s["x"] * s["y"], s["w"] * s["xx"] - s["x"] * s["x"])
        cut = div(s["y"] - slope * s["x"], s["w"])
    value = {"beta": slope, "alpha": cut, "resid": F.col(y) - cut - slope * F.col(x)}[param]
    return F.when(both & (F.count(yy).over(k.day) >= 2), value)


def _frame(k: Keys, cross_section: bool, expanding: bool, window: int | None) -> WindowSpec:
    if cross_section:
        return k.day
    if expanding == (window is not None):
        raise ValueError("give either expanding or a window")
    return k.past if expanding else k.last(window)


def normalize(k: Keys, x: str, cross_section: bool = False, expanding: bool = False, window: int | None = None) -> Column:
    """Min-max scaling over the date, the last rows, or all rows so far; NULL where constant."""
    w = _frame(k, cross_section, expanding, window)
    lo, hi = F.min(F.col(x)).over(w), F.max(F.col(x)).over(w)
    return div(F.col(x) - lo, hi - lo)


def standardize(k: Keys, x: str, cross_section: bool = False, expanding: bool = False, window: int | None = None) -> Column:
    """z-score by the sample deviation; NULL where constant."""
    w = _frame(k, cross_section, expanding, window)
    s = F.stddev_samp(F.col(x)).over(w)
    return div(F.col(x) - F.avg(F.col(x)).over(w), F.when(s > 1e-12, s))


def _once(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of c, with c computed once however often fn names it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def _middle(s: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(s)
    at = lambda i: F.try_element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2)


def clip_mad(k: Keys, x: str, multiplier: float = 3.0, cross_section: bool = False, expanding: bool = False, window: int | None = None) -> Column:
    """Clip to median +- multiplier * 1.4826 * MAD of the last rows or of all so far.

    A row sorts its values once and their distances from the median once. The compiler
    lays the cross-section form out in levels of cs_median, so that no row carries its
    date's values.
    """

    def about(values: Column, m: Column) -> Column:
        far = F.sort_array(F.transform(values, lambda v: F.abs(v - m)))
        mad = _once(far, _middle)
        return _once(1.4826 * multiplier * mad, lambda d: F.greatest(F.least(F.col(x), m + d), m - d))

    arr = F.sort_array(F.collect_list(F.col(x)).over(_frame(k, False, expanding, window)))
    return F.when(F.col(x).isNotNull(), _once(arr, lambda s: _once(_middle(s), lambda m: about(s, m))))


def winsorize_quantile(k: Keys, x: str, low: float = 0.1, high: float = 0.1, cross_section: bool = False, expanding: bool = False, window: int | None = None) -> Column:
    """Clip to the values of the last rows (or all so far) that stay when the int(low n) least and int(high n) greatest go.

    The compiler lays the cross-section form out in levels.
    """
    s = F.array_sort(F.collect_list(F.col(x)).over(_frame(k, False, expanding, window)))
    ends = F.transform(F.array(s), lambda a: F.struct(F.try_element_at(a, (F.floor(F.lit(low) * F.size(a)) + 1).cast("int")).alias("lo"), F.try_element_at(a, (F.size(a) - F.floor(F.lit(high) * F.size(a))).cast("int")).alias("hi")))
    return F.when(F.col(x).isNotNull(), F.element_at(F.transform(ends, lambda e: F.greatest(F.least(F.col(x), e.hi), e.lo)), 1))


def cs_median(k: Keys, x: str) -> Column:
    """Median of the date's values."""
    return F.median(F.col(x)).over(k.day)


def cs_row(k: Keys, x: str) -> Column:
    """Place of the value in the date's ascending order, missing ones last."""
    return F.row_number().over(k.day.orderBy(F.col(x).asc_nulls_last())).cast("double")


def cs_count(k: Keys, x: str) -> Column:
    """How many values the date has."""
    return F.count(F.col(x)).over(k.day).cast("double")


def cs_max(k: Keys, x: str) -> Column:
    return F.max(F.col(x)).over(k.day)


def cs_min(k: Keys, x: str) -> Column:
    return F.min(F.col(x)).over(k.day)


#: The rational approximation of the normal quantile (Acklam), inner and tail coefficients.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(cs: tuple[float, ...], x: Column) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution, relative error below 1.2e-9."""
    q = p - 0.5
    r = q * q
    mid = q * _poly(ACKLAM_A, r) / _poly(ACKLAM_B, r)
    tail = lambda t: _poly(ACKLAM_C, F.sqrt(-2 * F.ln(t))) / _poly(ACKLAM_D, F.sqrt(-2 * F.ln(t)))
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(mid)


#: The approximation 26.2.17 of the normal distribution (Abramowitz and Stegun), scale and coefficients.
CDF_P, CDF_B = 0.2316419, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0)


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal, absolute error below 7.5e-8."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi)) * _poly(CDF_B, 1 / (1 + x * F.lit(CDF_P)))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def industry_neutralize(k: Keys, x: str, industry: str, method: str = "demean") -> Column:
    """Within date and industry: demean, standardize, rank (to normal quantiles) or regression.

    Rows without industry or value stay as they are. standardize: a deviation that is 0 or
    missing counts as 1. regression: residual on industry dummies, which is the demeaned
    value where the date has more than one industry, and the value itself otherwise.
    """
    v = F.when(F.col(industry).isNotNull(), F.col(x))
    g = Window.partitionBy(k.date, industry)
    mean = F.avg(v).over(g)
    if method == "demean":
        out = v - mean
    elif method == "standardize":
        s = F.stddev_samp(v).over(g)
        out = (v - mean) / F.when(s > 0, s).otherwise(1.0)
    elif method == "rank":
        r = F.rank().over(g.orderBy(v.asc_nulls_last()))
        ties = F.count(v).over(Window.partitionBy(k.date, industry, x))
        pct = (r + (ties - 1) / 2) / F.count(v).over(g)
        out = normal_quantile(F.greatest(F.least(pct, F.lit(1 - 1e-6)), F.lit(1e-6)))
    elif method == "regression":
        kinds = F.size(F.collect_set(F.when(v.isNotNull(), F.col(industry))).over(k.day))
        out = F.when(kinds > 1, v - mean).otherwise(v)
    else:
        raise ValueError(f"unknown method {method}")
    return F.when(v.isNotNull(), out).otherwise(F.col(x))
