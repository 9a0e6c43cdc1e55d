"""Pipeline terms over a panel: numeric factors, boolean filters and label classifiers, laid out in layers of one plan.

A term holds a Column and the layers of columns it reads. Where a window is put on a term
that has one already, that term becomes a column of its own in the layer before, so terms
compose freely; `Pipeline.run` materialises the layers, each with the windows of all terms.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel_ops import Keys, div, weighted_sum
from .tables import business_days

_names = itertools.count()


class Grid:
    """Key columns of the (date, asset) grid."""

    def __init__(self, date: str = "trade_date", asset: str = "ticker"):
        self.date, self.asset = date, asset

    def factor(self, name: str) -> Factor:
        return Factor(self, F.col(name))

    def filter(self, name: str) -> Filter:
        return Filter(self, F.coalesce(F.col(name).cast("boolean"), F.lit(False)))

    def classifier(self, name: str) -> Classifier:
        return Classifier(self, F.col(name))

    def everything(self) -> Classifier:
        """One label for all assets."""
        return Classifier(self, F.lit(0))

    def single_asset(self, asset: str) -> Filter:
        return Filter(self, F.col(self.asset) == asset)

    def static_assets(self, assets: Sequence[str]) -> Filter:
        return Filter(self, F.col(self.asset).isin(*assets))

    @property
    def keys(self) -> Keys:
        return Keys(self.asset, self.date)


class Term:
    """A Column on a grid. steps: columns to be there before, as name -> (layer, Column)."""

    def __init__(self, grid: Grid, column: Column, layer: int = 0, windowed: bool = False, steps: dict[str, tuple[int, Column]] | None = None):
        self.grid, self.column, self.layer, self.windowed, self.steps = grid, column, layer, windowed, steps or {}

    def fixed(self) -> Term:
        """This term as a column of its own, if it has windows; windows can then be put on it."""
        if not self.windowed:
            return self
        name = f"_p{next(_names)}"
        return type(self)(self.grid, F.col(name), self.layer + 1, False, {**self.steps, name: (self.layer, self.column)})

    def derive(self, cls: type, build: Callable[..., Column], *others: Term | None, window: bool = False):
        """A term of a class built from this one's and others' columns (None stays None); window: the build puts windows on them."""
        every: list[Term | None] = [self, *others]
        if window:
            every = [t and t.fixed() for t in every]
        there = [t for t in every if t is not None]
        steps: dict[str, tuple[int, Column]] = {}
        for t in there:
            steps |= t.steps
        column = build(*[None if t is None else t.column for t in every])
        return cls(self.grid, column, max(t.layer for t in there), window or any(t.windowed for t in there), steps)

    def _last(self, n: int) -> WindowSpec:
        return Window.partitionBy(self.grid.asset).orderBy(self.grid.date).rowsBetween(-(n - 1), 0)

    def latest(self):
        """The last known value per asset."""
        w = Window.partitionBy(self.grid.asset).orderBy(self.grid.date).rowsBetween(Window.unboundedPreceding, 0)
        return self.derive(type(self), lambda x: F.last(x, ignorenulls=True).over(w), window=True)

    def isnull(self) -> Filter:
        return self.derive(Filter, lambda x: x.isNull())

    def notnull(self) -> Filter:
        return ~self.isnull()

    def downsample(self, unit: str):
        """The value of the first row of each calendar period (week, month, quarter, year) held through it."""
        w = Window.partitionBy(self.grid.asset, F.date_trunc(unit, F.col(self.grid.date))).orderBy(self.grid.date).rowsBetween(Window.unboundedPreceding, 0)
        return self.derive(type(self), lambda x: F.first(x).over(w), window=True)

    def slice(self, asset: str):
        """The value of one asset on each date, for every asset."""
        w = Window.partitionBy(self.grid.date)
        return self.derive(type(self), lambda x: F.max(F.when(F.col(self.grid.asset) == asset, x)).over(w), window=True)


class Filter(Term):
    """A boolean term; missing is False."""

    def __and__(self, other: Filter) -> Filter:
        return self.derive(Filter, lambda a, b: a & b, other)

    def __or__(self, other: Filter) -> Filter:
        return self.derive(Filter, lambda a, b: a | b, other)

    def __xor__(self, other: Filter) -> Filter:
        return self.derive(Filter, lambda a, b: a != b, other)

    def __invert__(self) -> Filter:
        return self.derive(Filter, lambda a: ~a)

    def if_else(self, yes: Term, no: Term) -> Term:
        return self.derive(type(yes), lambda c, a, b: F.when(c, a).otherwise(b), yes, no)

    def all_of(self, n: int) -> Filter:
        """True on every one of the last n rows."""
        return self.at_least(n, n)

    def any_of(self, n: int) -> Filter:
        """True on one of the last n rows."""
        return self.at_least(1, n)

    def at_least(self, times: int, n: int) -> Filter:
        """True on at least `times` of the last n rows."""
        return self.derive(Filter, lambda x: F.coalesce(F.sum(x.cast("int")).over(self._last(n)) >= times, F.lit(False)), window=True)


class Classifier(Term):
    """A label term."""

    def _test(self, build: Callable[[Column], Column]) -> Filter:
        return self.derive(Filter, lambda c: F.coalesce(build(c), F.lit(False)))

    def eq(self, label: object) -> Filter:
        return self._test(lambda c: c == label)

    def ne(self, label: object) -> Filter:
        return self._test(lambda c: c != label)

    def startswith(self, s: str) -> Filter:
        return self._test(lambda c: c.startswith(s))

    def endswith(self, s: str) -> Filter:
        return self._test(lambda c: c.endswith(s))

    def has_substring(self, s: str) -> Filter:
        return self._test(lambda c: c.contains(s))

    def matches(self, pattern: str) -> Filter:
        """Whether the label's beginning matches a pattern."""
        return self._test(lambda c: c.rlike(f"^(?:{pattern})"))

    def element_of(self, choices: Sequence) -> Filter:
        return self._test(lambda c: c.isin(*choices))

    def relabel(self, mapping: dict) -> Classifier:
        """Labels renamed by a mapping; others become missing."""
        m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return self.derive(Classifier, lambda c: F.try_element_at(m, c))

    def peer_count(self, mask: Filter | None = None) -> Factor:
        """Assets of the same label on the date (among those of the mask)."""
        w = lambda c: Window.partitionBy(F.col(self.grid.date), c)
        return self.derive(Factor, lambda c, m: (F.count(F.lit(1)) if m is None else F.count(F.when(m, 1))).over(w(c)).cast("double"), mask, window=True)


class Factor(Term):
    """A numeric term. mask: rows that take part; group: a classifier within which to work."""

    def _across(self, build: Callable[[Column, WindowSpec], Column], mask: Filter | None, group: Classifier | None, cls: type | None = None):
        """A term from windows over the date (and group); x is missing outside the mask."""

        def column(x: Column, m: Column | None, g: Column | None) -> Column:
            by = Window.partitionBy(*[F.col(self.grid.date), *([g] if g is not None else [])])
            return build(x if m is None else F.when(m, x), by)

        return self.derive(cls or Factor, column, mask, group, window=True)

    def demean(self, mask: Filter | None = None, group: Classifier | None = None) -> Factor:
        return self._across(lambda x, w: x - F.avg(x).over(w), mask, group)

    def zscore(self, mask: Filter | None = None, group: Classifier | None = None) -> Factor:
        """Standard scores by the population deviation; missing where constant."""

        def score(x: Column, w: WindowSpec) -> Column:
            s = F.stddev_pop(x).over(w)
            return div(x - F.avg(x).over(w), F.when(s > 1e-12, s))

        return self._across(score, mask, group)

    def rank(self, method: str = "ordinal", ascending: bool = True, mask: Filter | None = None, group: Classifier | None = None) -> Factor:
        """Rank per date: ordinal (ties by asset), min, max, dense or average."""

        def column(x: Column, m: Column | None, g: Column | None) -> Column:
            x = x if m is None else F.when(m, x)
            keys = [F.col(self.grid.date), *([g] if g is not None else [])]
            order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
            w = Window.partitionBy(*keys)
            by = w.orderBy(order)
            ties = F.count(x).over(Window.partitionBy(*keys, x))
            r = {
                "ordinal": F.row_number().over(w.orderBy(order, F.col(self.grid.asset))), "min": F.rank().over(by), "max": F.rank().over(by) + ties - 1,
                "dense": F.dense_rank().over(by), "average": F.rank().over(by) + (ties - 1) / 2,
            }[method]
            return F.when(x.isNotNull(), r).cast("double")

        return self.derive(Factor, column, mask, group, window=True)

    def quantiles(self, bins: int, mask: Filter | None = None) -> Classifier:
        """Bucket 0..bins-1 per date by interpolated edges, closed on the right; missing gives -1."""

        def bucket(x: Column, w: WindowSpec) -> Column:
            edges = F.percentile(x, F.array(*[F.lit(i / bins) for i in range(1, bins)])).over(w)
            return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x))).otherwise(-1)

        return self._across(bucket, mask, None, Classifier)

    def quartiles(self, mask: Filter | None = None) -> Classifier:
        return self.quantiles(4, mask)

    def quintiles(self, mask: Filter | None = None) -> Classifier:
        return self.quantiles(5, mask)

    def deciles(self, mask: Filter | None = None) -> Classifier:
        return self.quantiles(10, mask)

    def top(self, n: int, mask: Filter | None = None, group: Classifier | None = None) -> Filter:
        return self.rank("ordinal", False, mask, group) <= n

    def bottom(self, n: int, mask: Filter | None = None, group: Classifier | None = None) -> Filter:
        return self.rank("ordinal", True, mask, group) <= n

    def maximum(self, mask: Filter | None = None, group: Classifier | None = None) -> Filter:
        """The one asset of greatest value per date (and group), of equals the first by asset."""
        return self.top(1, mask, group)

    def percentile_between(self, low: float, high: float, mask: Filter | None = None) -> Filter:
        """Within the date's percentiles low to high (0..100), both in."""

        def inside(x: Column, w: WindowSpec) -> Column:
            a, b = (F.percentile(x, F.lit(p / 100)).over(w) for p in (low, high))
            return F.coalesce((x >= a) & (x <= b), F.lit(False))

        return self._across(inside, mask, None, Filter)

    def winsorize(self, low: float, high: float, mask: Filter | None = None, group: Classifier | None = None) -> Factor:
        """Values clipped to those that stay when the floor(low n) least and the n - ceil(high n) greatest of the date go (0 and 1: none)."""
        if not 0 <= low < high <= 1:
            raise ValueError("percentiles must rise within 0 and 1")

        def column(x: Column, m: Column | None, g: Column | None) -> Column:
            x = x if m is None else F.when(m, x)
            keys = [F.col(self.grid.date), *([g] if g is not None else [])]
            return F.struct(x.alias("x"), F.row_number().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_last())).alias("r"), F.count(x).over(Window.partitionBy(*keys)).alias("n"))

        placed = self.derive(Factor, column, mask, group, window=True)

        def clipped(p: Column, g: Column | None) -> Column:
            w = Window.partitionBy(*[F.col(self.grid.date), *([g] if g is not None else [])])
            r, n, x = p["r"], p["n"], p["x"]
            lo = F.max(F.when(r == F.floor(n * low) + 1, x)).over(w)
            hi = F.max(F.when(r == F.greatest(F.ceil(n * high), F.lit(1)), x)).over(w)
            return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))

        return placed.derive(Factor, clipped, group, window=True)

    def clip(self, low: float, high: float, mask: Filter | None = None) -> Factor:
        return self.derive(Factor, lambda x, m: F.when(x.isNotNull() & (F.lit(True) if m is None else m), F.greatest(F.least(x, F.lit(high)), F.lit(low))), mask)

    def isnan(self) -> Filter:
        return self.isnull()

    def isnull(self) -> Filter:
        return self.derive(Filter, lambda x: x.isNull() | F.isnan(x))

    def isfinite(self) -> Filter:
        return self.derive(Filter, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))

    def apply(self, name: str) -> Factor:
        """A function of each value: sin, cos, tan, arcsin, ..., tanh, arctanh, log, log1p, exp, expm1, sqrt, abs."""
        known = {"arcsin": "asin", "arccos": "acos", "arctan": "atan", "arcsinh": "asinh", "arccosh": "acosh", "arctanh": "atanh", "log": "ln"}
        if name not in (*known, "sin", "cos", "tan", "sinh", "cosh", "tanh", "log1p", "exp", "expm1", "sqrt", "abs"):
            raise ValueError(f"no function {name}")
        return self.derive(Factor, getattr(F, known.get(name, name)))

    def summary(self, kind: str, mask: Filter | None = None) -> Factor:
        """mean, stddev (population), max, min, median, sum or count of the date's values, for every asset."""
        agg = {"mean": F.avg, "stddev": F.stddev_pop, "max": F.max, "min": F.min, "median": F.median, "sum": F.sum, "count": F.count}[kind]
        return self._across(lambda x, w: agg(x).over(w).cast("double"), mask, None)

    # along an asset's rows

    def _along(self, build: Callable[..., Column], n: int, *others: Term | None) -> Factor:
        return self.derive(Factor, lambda *xs: build(*xs, self._last(n)), *others, window=True)

    def lag(self, n: int) -> Factor:
        w = Window.partitionBy(self.grid.asset).orderBy(self.grid.date)
        return self.derive(Factor, lambda x: F.lag(x, n).over(w), window=True)

    def returns(self, n: int) -> Factor:
        """Change over a window of n rows (n - 1 steps), as a share."""
        before = self.lag(n - 1)
        return self.derive(Factor, lambda x, b: div(x, b) - 1, before)

    def percent_change(self, n: int) -> Factor:
        """Change over a window of n rows relative to the absolute old value."""
        before = self.lag(n - 1)
        return self.derive(Factor, lambda x, b: div(x - b, F.abs(b)), before)

    def sma(self, n: int) -> Factor:
        """Mean of the known values of the last n rows (short windows allowed)."""
        return self._along(lambda x, w: F.avg(x).over(w), n)

    def weighted_average(self, weight: Factor, n: int) -> Factor:
        """Sum of value times weight over the sum of weights of the last n rows."""
        return self._along(lambda x, v, w: div(F.sum(x * v).over(w), F.sum(v).over(w)), n, weight)

    def max_drawdown(self, n: int) -> Factor:
        """Greatest fall from an earlier value of the last n rows, relative to the value fallen to."""

        def fold(x: Column, w: WindowSpec) -> Column:
            arr = F.collect_list(x).over(w)
            zero = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("drop"), F.lit(None).cast("double").alias("end"))
            step = lambda a, v: F.struct(F.greatest(a.peak, v).alias("peak"), F.greatest(a.drop, F.greatest(a.peak, v) - v).alias("drop"), F.when(F.greatest(a.peak, v) - v > a.drop, v).otherwise(a.end).alias("end"))
            return F.when(F.size(arr) > 0, F.aggregate(arr, zero, step, lambda a: F.coalesce(F.try_divide(a.drop, a.end), F.lit(0.0))))

        return self._along(fold, n)

    def average_dollar_volume(self, volume: Factor, n: int) -> Factor:
        """Sum of price times volume of the last n rows over n."""
        return self._along(lambda x, v, w: F.coalesce(F.sum(x * v).over(w), F.lit(0.0)) / n, n, volume)

    def annualized_volatility(self, n: int, year: float = 252.0) -> Factor:
        """Population deviation of the last n rows times the root of a year's rows."""
        return self._along(lambda x, w: F.stddev_pop(x).over(w) * math.sqrt(year), n)

    def ewma(self, n: int, decay: float) -> Factor:
        """Mean of the last n rows with weights decay^(age + 1); missing until n rows are known."""
        ws = exponential_weights(n, decay)
        return self.derive(Factor, lambda x: weighted_sum(self.grid.keys, x, [v / sum(ws) for v in ws]), window=True)

    def ewmstd(self, n: int, decay: float) -> Factor:
        """Deviation under the weights of ewma, corrected for bias."""
        ws = exponential_weights(n, decay)
        total, squares = sum(ws), sum(v * v for v in ws)
        k = self.grid.keys
        unit = [v / total for v in ws]
        # of equal weights the correction is n / (n - 1)
        bias = total * total / (total * total - squares)
        return self.derive(Factor, lambda x: F.sqrt(F.greatest(weighted_sum(k, x * x, unit) - F.pow(weighted_sum(k, x, unit), F.lit(2)), F.lit(0.0)) * bias), window=True)

    def linear_weighted_average(self, n: int) -> Factor:
        """Weights 1..n over their whole sum, missing values counting as 0."""
        return self.derive(Factor, lambda x: weighted_sum(self.grid.keys, x, [2 * (i + 1) / (n * (n + 1)) for i in range(n)], missing=0.0), window=True)

    def all_present(self, n: int) -> Filter:
        """No missing value in the last n rows."""
        return self.derive(Filter, lambda x: F.count(x).over(self._last(n)) >= n, window=True)

    def pearsonr(self, target: Factor, n: int, mask: Filter | None = None) -> Factor:
        """Correlation with another factor over the last n rows; missing if a value is, or a side is constant."""

        def corr(x: Column, y: Column, m: Column | None, w: WindowSpec) -> Column:
            spread = F.var_pop(x).over(w) * F.var_pop(y).over(w)
            full = (F.count(x + y).over(w) >= n) & (spread > 1e-18)
            return F.when(full if m is None else full & m, F.covar_pop(x, y).over(w) / F.sqrt(spread))

        return self._along(corr, n, target, mask)

    def spearmanr(self, target: Factor, n: int, mask: Filter | None = None) -> Factor:
        """Correlation of the ranks (ties averaged) of two factors within the last n rows."""

        def corr(x: Column, y: Column, m: Column | None, w: WindowSpec) -> Column:
            both = x.isNotNull() & y.isNotNull()
            xs, ys = (F.collect_list(F.when(both, c)).over(w) for c in (x, y))
            ranks = lambda a: F.transform(a, lambda v: F.size(F.filter(a, lambda u: u < v)) + (F.size(F.filter(a, lambda u: u == v)) - 1) / 2)
            mean = (n - 1) / 2
            dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - mean) * (q - mean)), F.lit(0.0), lambda s, v: s + v)
            made = F.transform(F.array(F.struct(ranks(xs).alias("a"), ranks(ys).alias("b"))), lambda s: F.try_divide(dot(s.a, s.b), F.sqrt(dot(s.a, s.a) * dot(s.b, s.b))))
            full = F.size(xs) >= n
            return F.when(full if m is None else full & m, F.element_at(made, 1))

        return self._along(corr, n, target, mask)

    def linear_regression(self, target: Factor, n: int, mask: Filter | None = None) -> dict[str, Factor]:
        """alpha, beta, r_value, stderr and p_value of this factor on another over the last n rows (all must be known)."""

        def part(kind: str) -> Callable[..., Column]:
            def column(y: Column, x: Column, m: Column | None, w: WindowSpec) -> Column:
                vx, vy = F.var_pop(x).over(w), F.var_pop(y).over(w)
                full = (F.count(x + y).over(w) >= n) & (vx > 1e-18)
                slope = F.covar_pop(y, x).over(w) / vx
                r = F.when(vy > 1e-18, F.covar_pop(y, x).over(w) / F.sqrt(vx * vy))
                error = F.sqrt(F.greatest(1 - r * r, F.lit(0.0)) * vy / vx / (n - 2))
                value = {"beta": slope, "alpha": F.avg(y).over(w) - slope * F.avg(x).over(w), "r_value": r, "stderr": error, "t": div(slope, error)}[kind]
                return F.when(full if m is None else full & m, value)

            return column

        out = {k: self._along(part(k), n, target, mask) for k in ("alpha", "beta", "r_value", "stderr")}
        t = self._along(part("t"), n, target, mask).fixed()
        out["p_value"] = t.derive(Factor, lambda c: two_sided_p(n - 2)(c))
        return out

    def beta(self, target: Factor, n: int, missing: float = 0.25) -> Factor:
        """Slope on another factor over the last n rows; rows with a missing value drop out, of which at most that share may be."""

        def slope(y: Column, x: Column, w: WindowSpec) -> Column:
            both = y.isNotNull() & x.isNotNull()
            a, b = F.when(both, y), F.when(both, x)
            enough = (F.count(F.lit(1)).over(w) >= n) & (n - F.count(a).over(w) <= int(n * missing))
            v = F.var_pop(b).over(w)
            return F.when(enough, div(F.covar_pop(a, b).over(w), F.when(v > 1e-18, v)))

        return self._along(slope, n, target)

    def business_days_since(self) -> Factor:
        """Weekdays from this date-valued term to the row's date."""
        return self.derive(Factor, lambda x: business_days(x.cast("date"), F.col(self.grid.date)).cast("double"))

    def business_days_until(self) -> Factor:
        """Weekdays from the row's date to this date-valued term."""
        return self.derive(Factor, lambda x: business_days(F.col(self.grid.date), x.cast("date")).cast("double"))

    # arithmetic

    def _op(self, other: object, f: Callable[[Column, Column], Column], cls: type | None = None):
        if isinstance(other, Term):
            return self.derive(cls or Factor, f, other)
        return self.derive(cls or Factor, lambda x: f(x, F.lit(other)))

    def _compare(self, other: object, f: Callable[[Column, Column], Column]) -> Filter:
        return self._op(other, lambda a, b: F.coalesce(f(a, b), F.lit(False)), Filter)

    def __add__(self, o: object) -> Factor:
        return self._op(o, lambda a, b: a + b)

    def __radd__(self, o: object) -> Factor:
        return self._op(o, lambda a, b: b + a)

    def __sub__(self, o: object) -> Factor:
        return self._op(o, lambda a, b: a - b)

    def __rsub__(self, o: object) -> Factor:
        return self._op(o, lambda a, b: b - a)

    def __mul__(self, o: object) -> Factor:
        return self._op(o, lambda a, b: a * b)

    def __rmul__(self, o: object) -> Factor:
        return self._op(o, lambda a, b: b * a)

    def __truediv__(self, o: object) -> Factor:
        return self._op(o, div)

    def __rtruediv__(self, o: object) -> Factor:
        return self._op(o, lambda a, b: div(b, a))

    def __mod__(self, o: object) -> Factor:
        return self._op(o, lambda a, b: F.pmod(a, F.nullif(b.cast("double"), F.lit(0.0))))

    def __pow__(self, o: object) -> Factor:
        return self._op(o, F.pow)

    def __neg__(self) -> Factor:
        return self.derive(Factor, lambda x: -x)

    def __abs__(self) -> Factor:
        return self.apply("abs")

    def __gt__(self, o: object) -> Filter:
        return self._compare(o, lambda a, b: a > b)

    def __ge__(self, o: object) -> Filter:
        return self._compare(o, lambda a, b: a >= b)

    def __lt__(self, o: object) -> Filter:
        return self._compare(o, lambda a, b: a < b)

    def __le__(self, o: object) -> Filter:
        return self._compare(o, lambda a, b: a <= b)

    def eq(self, o: object) -> Filter:
        return self._compare(o, lambda a, b: a == b)

    def ne(self, o: object) -> Filter:
        """Different or missing."""
        return ~self.eq(o)


def exponential_weights(n: int, decay: float) -> list[float]:
    """decay^(age + 1) of n rows, oldest first."""
    return [decay ** (n - i) for i in range(n)]


def decay_of(span: float | None = None, half_life: float | None = None, centre: float | None = None) -> float:
    """Decay rate from a span, a half-life or a centre of mass."""
    if sum(x is not None for x in (span, half_life, centre)) != 1:
        raise ValueError("give one of span, half_life and centre")
    if span is not None:
        return 1 - 2 / (1 + span)
    return math.exp(math.log(0.5) / half_life) if half_life is not None else 1 - 1 / (1 + centre)


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (Lentz), on the side where it converges."""
    x = np.asarray(x, float)
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + aa * np.log(z) + bb * np.log1p(-z)) / aa
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (aa + bb) * z / (aa + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 200):
        for num in (m * (bb - m) * z / ((aa + 2 * m - 1) * (aa + 2 * m)), -(aa + m) * (aa + bb + m) * z / ((aa + 2 * m) * (aa + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    out = np.where(z <= 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


def two_sided_p(freedom: int) -> Callable[[Column], Column]:
    """Two-sided p-value of a t statistic, over Arrow batches."""

    @F.pandas_udf("double")
    def p(t: pd.Series) -> pd.Series:
        v = t.to_numpy(float)
        out = incomplete_beta(freedom / 2, 0.5, freedom / (freedom + np.where(np.isnan(v), 0.0, v) ** 2))
        return pd.Series(np.where(np.isnan(v), np.nan, out))

    return lambda c: F.when(c.isNotNull(), p(c))


class Pipeline:
    """Named terms and a screen."""

    def __init__(self, columns: dict[str, Term] | None = None, screen: Filter | None = None):
        self.columns, self.screen = dict(columns or {}), screen

    def add(self, term: Term, name: str, overwrite: bool = False) -> None:
        if name in self.columns and not overwrite:
            raise ValueError(f"there is a column {name}")
        self.columns[name] = term

    def remove(self, name: str) -> Term:
        return self.columns.pop(name)

    def set_screen(self, screen: Filter, overwrite: bool = False) -> None:
        if self.screen is not None and not overwrite:
            raise ValueError("there is a screen")
        self.screen = screen

    def run(self, panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
        """date, asset and the terms of the rows that pass the screen, from start to end (YYYY-MM-DD, both in).

        Windows see the rows before start; layers are materialised one after the other, the
        windows of a layer over one partitioning sharing a shuffle and a sort.
        """
        terms = [*self.columns.values(), *([self.screen] if self.screen is not None else [])]
        if not terms:
            raise ValueError("nothing to compute")
        grid = terms[0].grid
        df = materialise(panel, terms)
        df = df.withColumns({f"_out_{n}": t.column for n, t in self.columns.items()} | ({"_screen": self.screen.column} if self.screen is not None else {}))
        if self.screen is not None:
            df = df.where("_screen")
        for bound, op in ((start, ">="), (end, "<=")):
            if bound:
                df = df.where(f"`{grid.date}` {op} date'{bound}'")
        return df.select(grid.date, grid.asset, *[F.col(f"_out_{n}").alias(n) for n in self.columns])


def materialise(panel: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """The panel with every column the terms read, layer by layer."""
    layers: dict[int, dict[str, Column]] = {}
    for t in terms:
        for name, (layer, column) in t.steps.items():
            layers.setdefault(layer, {})[name] = column
    for layer in sorted(layers):
        panel = panel.withColumns(layers[layer])
    return panel


def custom_factor(panel: DataFrame, grid: Grid, inputs: Sequence[str], n: int, compute: Callable[..., dict[str, float] | float | bool | str | None], outputs: dict[str, str]) -> DataFrame:
    """Adds columns from a user's function of each asset's last n rows: compute(*arrays) -> value, or dict of outputs.

    outputs: column -> DDL type (one for a plain value); types double, boolean, string, ... serve
    factors, filters and classifiers. Rows with fewer than n before them get nulls. One
    grouped map per asset.
    """
    schema = T.StructType([*panel.schema.fields, *[T.StructField(o, T._parse_datatype_string(t)) for o, t in outputs.items()]])
    names = list(outputs)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(grid.date, kind="stable").reset_index(drop=True)
        arrays = [pdf[c].to_numpy() for c in inputs]
        res: dict[str, list] = {o: [None] * len(pdf) for o in names}
        for i in range(n - 1, len(pdf)):
            value = compute(*[a[i - n + 1 : i + 1] for a in arrays])
            for o, v in (value if isinstance(value, dict) else {names[0]: value}).items():
                res[o][i] = v
        return pdf.assign(**{o: pd.Series(v, dtype=object) for o, v in res.items()})

    return panel.groupBy(grid.asset).applyInPandas(each, schema)


def custom_row_transform(panel: DataFrame, grid: Grid, x: str, fn: Callable[[np.ndarray], np.ndarray], out: str, group: str | None = None) -> DataFrame:
    """Adds a function of the vector of each date's (and group's) values; missing ones are left out and stay missing."""
    schema = T.StructType([*panel.schema.fields, T.StructField(out, T.DoubleType())])

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(grid.asset, kind="stable").reset_index(drop=True)
        v = pdf[x].to_numpy(float)
        res, ok = np.full(len(v), np.nan), ~np.isnan(v)
        if ok.any():
            res[ok] = fn(v[ok])
        return pdf.assign(**{out: res})

    return panel.groupBy(grid.date, *([group] if group else [])).applyInPandas(each, schema)


def sampling_dates(dates: DataFrame, date: str, unit: str) -> DataFrame:
    """The first date of each calendar period."""
    return dates.groupBy(F.date_trunc(unit, F.col(date)).alias("_p")).agg(F.min(date).alias(date)).select(date)


def root_mask(sessions: DataFrame, assets: DataFrame, date: str, asset: str, first: str, last: str) -> DataFrame:
    """date, asset of every session of an asset's life (open ends allowed): sessions are bounded by the calendar and broadcast."""
    alive = (F.col(date) >= F.coalesce(F.col(first).cast("date"), F.lit("0001-01-01").cast("date"))) & (F.col(date) <= F.coalesce(F.col(last).cast("date"), F.lit("9999-12-31").cast("date")))
    return assets.join(F.broadcast(sessions.select(date).distinct()), alive).select(date, asset).distinct()


