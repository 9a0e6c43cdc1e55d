"""Technical indicators, labels and signals as Column builders over a dense panel.

Arguments are names of columns already there; windows are rows of one ticker. Full
windows of non-null values are needed unless said otherwise; warm-up rows are NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .panel_ops import Keys, delay, div, ts_max, ts_mean, ts_min, ts_stddev, weighted_sum


def wma(k: Keys, x: str, n: int) -> Column:
    """Linearly weighted mean, the newest row heaviest."""
    return weighted_sum(k, F.col(x), [2 * (i + 1) / (n * (n + 1)) for i in range(n)])


def bollinger_upper(k: Keys, x: str, n: int = 20, width: float = 2.0) -> Column:
    return ts_mean(k, x, n) + F.lit(width) * _pop(k, x, n)


def bollinger_lower(k: Keys, x: str, n: int = 20, width: float = 2.0) -> Column:
    return ts_mean(k, x, n) - F.lit(width) * _pop(k, x, n)


def bollinger_percent(k: Keys, x: str, n: int = 20, width: float = 2.0) -> Column:
    """Place of the value between the bands: 0 at the lower, 1 at the upper."""
    s = F.lit(width) * _pop(k, x, n)
    return div(F.col(x) - ts_mean(k, x, n) + s, F.when(s > 1e-12, 2 * s))


def _pop(k: Keys, x: str, n: int) -> Column:
    w = k.last(n)
    return F.when(F.count(F.col(x)).over(w) >= n, F.stddev_pop(F.col(x)).over(w))


def ts_stddev_pop(k: Keys, x: str, n: int) -> Column:
    """Population deviation of the window."""
    return _pop(k, x, n)


def ts_max_drawdown(k: Keys, x: str, n: int) -> Column:
    """Greatest fall within the window from its own running peak, as a share (0 or negative)."""
    arr = F.collect_list(F.col(x)).over(k.last(n))
    start = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("worst"))
    step = lambda a, v: F.struct(F.greatest(a.peak, v).alias("peak"), F.least(a.worst, F.coalesce(F.try_divide(v, F.greatest(a.peak, v)) - 1, F.lit(0.0))).alias("worst"))
    return F.when(F.size(arr) >= n, F.aggregate(arr, start, step, lambda a: a.worst))


def ts_share_below(k: Keys, x: str, n: int) -> Column:
    """Share of the window's values that are less than this one."""
    arr = F.collect_list(F.col(x)).over(k.last(n))
    return F.when((F.size(arr) >= n) & F.col(x).isNotNull(), F.size(F.filter(arr, lambda v: v < F.col(x))) / F.lit(n))


def log_true_range(k: Keys, high: str, low: str, close: str) -> Column:
    """True range of the logarithms; the first row has its own range."""
    h, lo, before = (F.when(c > 0, F.ln(c)) for c in (F.col(high), F.col(low), F.lag(close).over(k.along)))
    return F.when(h.isNotNull() & lo.isNotNull(), F.greatest(h - lo, h - before, before - lo))


def polynomials(n: int, degree: int) -> list[list[float]]:
    """Orthonormal polynomials of degrees 0 to `degree` on n equidistant points (Gram-Schmidt)."""
    at = [2 * i / (n - 1) - 1 if n > 1 else 0.0 for i in range(n)]
    basis: list[list[float]] = []
    for d in range(degree + 1):
        v = [t**d for t in at]
        for b in basis:
            dot = sum(x * y for x, y in zip(v, b, strict=True))
            v = [x - dot * y for x, y in zip(v, b, strict=True)]
        size = sum(x * x for x in v) ** 0.5
        basis.append([x / size for x in v])
    return basis


def _dot(arr: Column, weights: list[float]) -> Column:
    """Sum of an array's values times weights."""
    return F.aggregate(F.zip_with(arr, F.array(*[F.lit(w) for w in weights]), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)


def ts_poly_trend(k: Keys, x: str, n: int, degree: int) -> Column:
    """Twice the orthonormal component of a degree (1 line, 2 parabola, 3 cubic) of the window's logarithms, times its share of their variance."""
    v = F.when(F.col(x) > 0, F.ln(F.col(x)))
    arr = F.collect_list(v).over(k.last(n))
    coef, total = _dot(arr, polynomials(n, degree)[degree]), F.var_pop(v).over(k.last(n)) * n
    share = F.when(total > 1e-18, F.least(coef * coef / total, F.lit(1.0)))
    return F.when(F.size(arr) >= n, 2 * coef * share)


def ts_poly_deviation(k: Keys, x: str, n: int, degree: int) -> Column:
    """This value's distance from the polynomial fitted to the window of logarithms, in root mean squares of the residuals."""
    v = F.when(F.col(x) > 0, F.ln(F.col(x)))
    arr = F.collect_list(v).over(k.last(n))
    basis = polynomials(n, degree)
    coefs = [_dot(arr, b) for b in basis]
    fitted = sum((c * F.lit(b[-1]) for c, b in zip(coefs[1:], basis[1:], strict=True)), coefs[0] * F.lit(basis[0][-1]))
    rest = F.aggregate(arr, F.lit(0.0), lambda a, y: a + y * y) - sum((c * c for c in coefs[1:]), coefs[0] * coefs[0])
    rms = F.sqrt(F.greatest(rest, F.lit(0.0)) / n)
    return F.when(F.size(arr) >= n, div(v - fitted, F.when(rms > 1e-9, rms)))


def rolling_zscore(k: Keys, x: str, n: int) -> Column:
    s = ts_stddev(k, x, n)
    return div(F.col(x) - ts_mean(k, x, n), F.when(s > 1e-12, s))


def roc(k: Keys, x: str, n: int) -> Column:
    """Rate of change over n rows, in percent."""
    return 100 * (div(F.col(x), delay(k, x, n)) - 1)


def log_return(k: Keys, x: str, n: int = 1) -> Column:
    r = div(F.col(x), delay(k, x, n))
    return F.when(r > 0, F.ln(r))


def stoch_k(k: Keys, close: str, high: str, low: str, n: int = 14) -> Column:
    """Place of the close in the window's range, in percent."""
    lo, hi = ts_min(k, low, n), ts_max(k, high, n)
    return 100 * div(F.col(close) - lo, hi - lo)


def williams_r(k: Keys, close: str, high: str, low: str, n: int = 14) -> Column:
    lo, hi = ts_min(k, low, n), ts_max(k, high, n)
    return -100 * div(hi - F.col(close), hi - lo)


def true_range(k: Keys, high: str, low: str, close: str) -> Column:
    """Greatest of the range and the gaps from the close before; the first row has its range."""
    before = delay(k, close, 1)
    return F.when(F.col(high).isNotNull() & F.col(low).isNotNull(), F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)))


def mean_deviation(k: Keys, x: str, n: int) -> Column:
    """Mean absolute deviation from the window's mean."""
    w = k.last(n)
    arr, m = F.collect_list(F.col(x)).over(w), F.avg(F.col(x)).over(w)
    return F.when(F.size(arr) >= n, F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.abs(v - m)) / n)


def cci(k: Keys, typical: str, n: int = 20) -> Column:
    """Commodity channel index of a typical price."""
    d = mean_deviation(k, typical, n)
    return div(F.col(typical) - ts_mean(k, typical, n), F.when(d > 1e-12, 0.015 * d))


def aroon_up(k: Keys, high: str, n: int = 25) -> Column:
    """100 (n - rows since the latest highest of n + 1 rows) / n."""
    arr = F.reverse(F.collect_list(F.col(high)).over(k.last(n + 1)))
    return F.when(F.size(arr) >= n + 1, 100 * (n - (F.array_position(arr, F.array_max(arr)) - 1)) / n)


def aroon_down(k: Keys, low: str, n: int = 25) -> Column:
    arr = F.reverse(F.collect_list(F.col(low)).over(k.last(n + 1)))
    return F.when(F.size(arr) >= n + 1, 100 * (n - (F.array_position(arr, F.array_min(arr)) - 1)) / n)


def signed_volume(k: Keys, close: str, volume: str) -> Column:
    """Volume with the sign of the close's change; 0 where unknown."""
    return F.coalesce(F.signum(F.col(close) - delay(k, close, 1)) * F.col(volume), F.lit(0.0))


def cumulative(k: Keys, x: str) -> Column:
    """Running sum, missing values as 0."""
    return F.sum(F.coalesce(F.col(x), F.lit(0.0))).over(k.past)


def expanding_max(k: Keys, x: str) -> Column:
    return F.max(F.col(x)).over(k.past)


def expanding_min(k: Keys, x: str) -> Column:
    return F.min(F.col(x)).over(k.past)


def drawdown(k: Keys, x: str) -> Column:
    """Fall from the highest value so far, as a share (0 or negative)."""
    return div(F.col(x), expanding_max(k, x)) - 1


def crossed_above(k: Keys, x: str, y: str) -> Column:
    """1 where x rises over y: above now, not above in the row before."""
    return F.coalesce((F.col(x) > F.col(y)) & (F.lag(x).over(k.along) <= F.lag(y).over(k.along)), F.lit(False)).cast("double")


def crossed_below(k: Keys, x: str, y: str) -> Column:
    return F.coalesce((F.col(x) < F.col(y)) & (F.lag(x).over(k.along) >= F.lag(y).over(k.along)), F.lit(False)).cast("double")


def future_max(k: Keys, x: str, n: int) -> Column:
    """Greatest of the next n rows (this one left out); full window needed."""
    w = k.along.rowsBetween(1, n)
    return F.when(F.count(F.col(x)).over(w) >= n, F.max(F.col(x)).over(w))


def future_min(k: Keys, x: str, n: int) -> Column:
    w = k.along.rowsBetween(1, n)
    return F.when(F.count(F.col(x)).over(w) >= n, F.min(F.col(x)).over(w))


def future_mean(k: Keys, x: str, n: int) -> Column:
    w = k.along.rowsBetween(1, n)
    return F.when(F.count(F.col(x)).over(w) >= n, F.avg(F.col(x)).over(w))


def future_std(k: Keys, x: str, n: int) -> Column:
    w = k.along.rowsBetween(1, n)
    return F.when(F.count(F.col(x)).over(w) >= n, F.stddev_pop(F.col(x)).over(w))


def fixed_label(k: Keys, x: str, n: int) -> Column:
    """Change to the value n rows on, as a share."""
    return div(F.lead(x, n).over(k.along), F.col(x)) - 1


def ts_quantile(k: Keys, x: str, n: int, q: float) -> Column:
    """Interpolated quantile of the window."""
    w = k.last(n)
    return F.when(F.count(F.col(x)).over(w) >= n, F.percentile(F.col(x), F.lit(float(q))).over(w))


def ts_skew(k: Keys, x: str, n: int) -> Column:
    w = k.last(n)
    return F.when((F.count(F.col(x)).over(w) >= n) & (F.var_pop(F.col(x)).over(w) > 1e-18), F.skewness(F.col(x)).over(w))


def ts_count(k: Keys, x: str, n: int) -> Column:
    """Non-null values among the last n rows."""
    return F.count(F.col(x)).over(k.last(n)).cast("double")


def rolling_sum_wide(k: Keys, x: str, n: int) -> Column:
    """Rolling sum as a difference of running sums: constant work a row however wide the window."""
    run = F.sum(F.coalesce(F.col(x), F.lit(0.0))).over(k.past)
    cnt = F.count(F.col(x)).over(k.past)
    older = F.sum(F.coalesce(F.col(x), F.lit(0.0))).over(k.along.rowsBetween(Window.unboundedPreceding, -n))
    seen = F.count(F.col(x)).over(k.along.rowsBetween(Window.unboundedPreceding, -n))
    return F.when(cnt - seen >= n, run - F.coalesce(older, F.lit(0.0)))


def ts_any(k: Keys, x: str, n: int) -> Column:
    """1 if one of the window's values is not 0; full window of known values needed."""
    w = k.last(n)
    return F.when(F.count(F.col(x)).over(w) >= n, F.max((F.col(x) != 0).cast("double")).over(w))


def ts_all(k: Keys, x: str, n: int) -> Column:
    """1 if none of the window's values is 0."""
    w = k.last(n)
    return F.when(F.count(F.col(x)).over(w) >= n, F.min((F.col(x) != 0).cast("double")).over(w))


def _back(k: Keys, x: str, n: int, pick: Callable[[Column], Column], newest: bool) -> Column:
    """Rows back to the newest (or oldest) place of a window's extreme value."""
    arr = F.collect_list(F.col(x)).over(k.last(n))
    at = F.array_position(F.reverse(arr), pick(arr)) - 1 if newest else n - F.array_position(arr, pick(arr))
    return F.when(F.size(arr) >= n, at.cast("double"))


def since_highest(k: Keys, x: str, n: int) -> Column:
    """Rows since the window's highest value, the newest of equals."""
    return _back(k, x, n, F.array_max, True)


def since_lowest(k: Keys, x: str, n: int) -> Column:
    return _back(k, x, n, F.array_min, True)


def since_first_highest(k: Keys, x: str, n: int) -> Column:
    """Rows since the window's highest value, the oldest of equals."""
    return _back(k, x, n, F.array_max, False)


def since_first_lowest(k: Keys, x: str, n: int) -> Column:
    return _back(k, x, n, F.array_min, False)


def ts_argmin(k: Keys, x: str, n: int) -> Column:
    """Position (0 = oldest) of the first least value of a full window."""
    arr = F.collect_list(F.col(x)).over(k.last(n))
    return F.when(F.size(arr) >= n, (F.array_position(arr, F.array_min(arr)) - 1).cast("double"))


def ts_median(k: Keys, x: str, n: int) -> Column:
    return ts_quantile(k, x, n, 0.5)


def ts_kurt(k: Keys, x: str, n: int) -> Column:
    """Excess kurtosis (population moments) of a full window; NULL where constant."""
    w = k.last(n)
    return F.when((F.count(F.col(x)).over(w) >= n) & (F.var_pop(F.col(x)).over(w) > 1e-18), F.kurtosis(F.col(x)).over(w))


def partial_mean(k: Keys, x: str, n: int, least: int = 1) -> Column:
    """Mean of the window's known values, of which there must be `least`."""
    w = k.last(n)
    return F.when(F.count(F.col(x)).over(w) >= least, F.avg(F.col(x)).over(w))


def partial_std(k: Keys, x: str, n: int, least: int = 1, ddof: int = 0) -> Column:
    """Deviation of the window's known values, of which there must be `least` and more than ddof (0 or 1)."""
    w = k.last(n)
    agg = F.stddev_samp if ddof else F.stddev_pop
    return F.when(F.count(F.col(x)).over(w) >= max(least, ddof + 1), agg(F.col(x)).over(w))


def expanding_mean(k: Keys, x: str, least: int = 1) -> Column:
    return F.when(F.count(F.col(x)).over(k.past) >= least, F.avg(F.col(x)).over(k.past))


def expanding_std(k: Keys, x: str, least: int = 1) -> Column:
    """Population deviation of all known values so far."""
    return F.when(F.count(F.col(x)).over(k.past) >= least, F.stddev_pop(F.col(x)).over(k.past))


def rebase(k: Keys, x: str, base: float = 100.0) -> Column:
    """Values as multiples of the ticker's first known one, times a base."""
    return div(F.col(x), F.first(F.col(x), ignorenulls=True).over(k.past)) * F.lit(float(base))


def nonzero_difference(k: Keys, x: str, y: str) -> Column:
    """x - y, or, where that is 0, the last difference that was not."""
    d = F.col(x) - F.col(y)
    return F.last(F.when(d != 0, d), ignorenulls=True).over(k.past)


def cross_over(k: Keys, x: str, y: str) -> Column:
    """1 where x rises over y, -1 where it falls below: against the side of the last row on which they differed; else 0."""
    d = F.col(x) - F.col(y)
    before = F.last(F.when(d != 0, d), ignorenulls=True).over(k.along.rowsBetween(Window.unboundedPreceding, -1))
    return F.when((before < 0) & (d > 0), 1.0).when((before > 0) & (d < 0), -1.0).otherwise(0.0)


def mean_label(k: Keys, x: str, n: int, wait: int = 1) -> Column:
    """Change to the mean of the n rows that begin `wait` rows on, as a share."""
    w = k.along.rowsBetween(wait, wait + n - 1)
    return F.when(F.count(F.col(x)).over(w) >= n, div(F.avg(F.col(x)).over(w), F.col(x)) - 1)


ONE = ("wma", "ts_stddev_pop", "ts_max_drawdown", "ts_share_below", "ts_poly_trend", "ts_poly_deviation", "bollinger_upper", "bollinger_lower", "bollinger_percent", "rolling_zscore", "roc", "log_return", "mean_deviation", "cci", "aroon_up", "aroon_down", "cumulative", "expanding_max", "expanding_min", "drawdown", "future_max", "future_min", "future_mean", "future_std", "fixed_label", "ts_quantile", "ts_skew", "ts_count", "rolling_sum_wide", "ts_any", "ts_all", "since_highest", "since_lowest", "since_first_highest", "since_first_lowest", "ts_argmin", "ts_median", "ts_kurt", "partial_mean", "partial_std", "expanding_mean", "expanding_std", "rebase", "mean_label")
TWO = ("signed_volume", "crossed_above", "crossed_below", "nonzero_difference", "cross_over")
THREE = ("stoch_k", "williams_r", "true_range", "log_true_range")
