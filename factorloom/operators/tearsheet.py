"""Compositions of factor analytics: clean factor tables, bins, group adjustment, cumulative returns, positions, account input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.panel_ops import Keys, div
from .analytics import date_index, factor_weights, forward_returns, quantile_bucket


class MaxLossError(ValueError):
    """More rows were lost on the way to a clean factor table than allowed."""


def bin_bucket(df: DataFrame, factor: str, bins: int | Sequence[float], keys: Keys = Keys(), group: str | None = None, by: Column | None = None) -> DataFrame:
    """Adds factor_quantile: the bin (from 1) of equal width within the date (and group), or between given edges, closed on the right.

    Values outside given edges have none; where all values are equal the middle bin holds them.
    """
    x = F.col(factor)
    if isinstance(bins, int):
        w = Window.partitionBy(F.col(keys.date), *([F.col(group)] if group else []), *([by] if by is not None else []))
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        at = F.greatest(F.ceil(div(x - lo, hi - lo) * bins), F.lit(1)).cast("int")
        # widened around a constant, it lies on the middle bin's right edge or inside it
        return df.withColumn("factor_quantile", F.when(x.isNotNull(), F.when(hi > lo, F.least(at, F.lit(bins))).otherwise(F.lit((bins + 1) // 2))))
    edges = list(bins)
    inside = (x > edges[0]) & (x <= edges[-1])
    q = sum((F.when(x > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(1))
    return df.withColumn("factor_quantile", F.when(inside, q).cast("int"))


def zero_aware_bucket(df: DataFrame, factor: str, n: int, keys: Keys = Keys(), group: str | None = None, equal_width: bool = False) -> DataFrame:
    """Adds factor_quantile with the negative values in the lower half of n buckets and the others in the upper half, each cut on its own."""
    half = n // 2
    side = (F.col(factor) >= 0).cast("int")
    t = df.withColumn("_side", side)
    if equal_width:
        t = bin_bucket(t, factor, half, keys, group, F.col("_side"))
    else:
        w = Window.partitionBy(keys.date, *([group] if group else []), "_side")
        edges = F.percentile(F.col(factor), F.array(*[F.lit(i / half) for i in range(1, half)], F.lit(1.0))).over(w)
        t = t.withColumn("_edges", edges)
        q = F.expr(f"1 + size(filter(slice(_edges, 1, {half - 1}), e -> e < `{factor}`))") if half > 1 else F.lit(1)
        t = t.withColumn("factor_quantile", F.when(F.col(factor).isNotNull(), q)).drop("_edges")
    return t.withColumn("factor_quantile", (F.col("factor_quantile") + F.when(F.col("_side") == 1, half).otherwise(0)).cast("int")).drop("_side")


def clean_factor(panel: DataFrame, factor: str, price: str, periods: Sequence[int] = (1, 5, 10), keys: Keys = Keys(), quantiles: int | None = 5, bins: int | Sequence[float] | None = None, group: str | None = None, by_group: bool = False, zero_aware: bool = False, filter_zscore: float | None = None, max_loss: float | None = None) -> DataFrame:
    """The table factor analytics work on: keys, factor, group, r<n> of every period, factor_quantile; rows lacking one of them are gone.

    filter_zscore: forward returns further than so many deviations from the table's mean
    become missing first. max_loss: the share of rows with a factor that may be lost; counting
    it runs one aggregate, and more is a MaxLossError.
    """
    if (quantiles is None) == (bins is None):
        raise ValueError("give either quantiles or bins")
    rs = [f"r{n}" for n in periods]
    t = forward_returns(panel, price, periods, keys).select(keys.ticker, keys.date, F.col(factor).alias("factor"), *rs, *([F.col(group).alias("group")] if group else []))
    t = t.where(F.col("factor").isNotNull())
    start = t
    if filter_zscore is not None:
        stats = t.agg(*[c for r in rs for c in (F.avg(r).alias(f"_m{r}"), F.stddev_samp(r).alias(f"_s{r}"))])
        t = t.crossJoin(F.broadcast(stats))  # one row
        t = t.withColumns({r: F.when(F.abs(F.col(r) - F.col(f"_m{r}")) <= filter_zscore * F.col(f"_s{r}"), F.col(r)) for r in rs}).drop(*[f"_{k}{r}" for r in rs for k in "ms"])
    t = t.dropna(subset=[*rs, *(["group"] if group else [])])
    by = "group" if by_group else None
    if zero_aware:
        t = zero_aware_bucket(t, "factor", quantiles or int(bins), keys, by, equal_width=bins is not None)
    else:
        t = quantile_bucket(t, "factor", quantiles, keys, by) if quantiles else bin_bucket(t, "factor", bins, keys, by)
    t = t.where(F.col("factor_quantile").isNotNull())
    if max_loss is not None:
        n, kept = start.count(), t.count()
        if n and 1 - kept / n > max_loss:
            raise MaxLossError(f"{1 - kept / n:.1%} of the rows were lost, {max_loss:.1%} are allowed")
    return t


def demean_returns(df: DataFrame, returns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Returns less their mean within the columns `by` (the date, or date and group)."""
    w = Window.partitionBy(*by)
    return df.withColumns({r: F.col(r) - F.avg(r).over(w) for r in returns})


def mean_by_quantile(df: DataFrame, returns: Sequence[str], keys: Keys = Keys(), by_date: bool = False, by_group: bool = False, adjust: str | None = "universe") -> DataFrame:
    """Mean, standard error and count of each return per quantile (and date, and group).

    adjust: universe (less the date's mean), group (less the mean of date and group) or None.
    """
    t = df
    if adjust:
        t = demean_returns(df, returns, [keys.date, *(["group"] if adjust == "group" else [])])
    dims = ["factor_quantile", *([keys.date] if by_date else []), *(["group"] if by_group else [])]
    aggs = [c for r in returns for c in (F.avg(r).alias(f"mean_{r}"), (F.stddev_samp(r) / F.sqrt(F.count(r))).alias(f"stderr_{r}"), F.count(r).alias(f"n_{r}"))]
    return t.groupBy(*dims).agg(*aggs)


def spread_with_error(means: DataFrame, r: str, upper: int, lower: int, by: Sequence[str]) -> DataFrame:
    """Mean of the upper quantile less that of the lower per `by`, and the joint standard error."""
    pick = lambda q, c: F.max(F.when(F.col("factor_quantile") == q, F.col(c)))
    err = F.sqrt(F.pow(pick(upper, f"stderr_{r}"), F.lit(2)) + F.pow(pick(lower, f"stderr_{r}"), F.lit(2)))
    return means.groupBy(*by).agg((pick(upper, f"mean_{r}") - pick(lower, f"mean_{r}")).alias("spread"), err.alias("joint_stderr"))


def mean_ic(ic: DataFrame, columns: Sequence[str], keys: Keys = Keys(), unit: str | None = None, group: str | None = None) -> DataFrame:
    """Mean information coefficients over all dates, or per calendar period and group."""
    dims = [*([F.date_trunc(unit, F.col(keys.date)).cast("date").alias("period")] if unit else []), *([F.col(group)] if group else [])]
    return ic.groupBy(*dims).agg(*[F.avg(c).alias(c) for c in columns])


def returns_by_asset(df: DataFrame, returns: Sequence[str], keys: Keys = Keys(), demeaned: bool = True, equal_weight: bool = False, group: str | None = None) -> DataFrame:
    """Each asset's weighted return per date: what sums to the factor's return."""
    w = factor_weights(df, "factor", keys, demeaned, equal_weight, group)
    return w.select(keys.ticker, keys.date, "weight", *[(F.col("weight") * F.col(r)).alias(f"weighted_{r}") for r in returns])


def _subset(df: DataFrame, quantiles: Sequence[int] | None, groups: Sequence[str] | None) -> DataFrame:
    if quantiles is not None:
        df = df.where(F.col("factor_quantile").isin(*quantiles))
    return df if groups is None else df.where(F.col("group").isin(*groups))


def factor_cumulative_returns(df: DataFrame, period: int = 1, keys: Keys = Keys(), long_short: bool = True, group_neutral: bool = False, equal_weight: bool = False, quantiles: Sequence[int] | None = None, groups: Sequence[str] | None = None) -> DataFrame:
    """trade_date and cumulative return of the portfolio the factor weighs, of chosen quantiles and groups.

    The return of a period of several rows is spread evenly over its rows as a geometric
    mean; overlapping portfolios are not averaged.
    """
    t = _subset(df, quantiles, groups)
    w = factor_weights(t, "factor", keys, long_short, equal_weight, "group" if group_neutral else None)
    daily = w.groupBy(keys.date).agg(F.sum(F.col("weight") * F.col(f"r{period}")).alias("_r"))
    step = F.pow(F.greatest(1 + F.coalesce("_r", F.lit(0.0)), F.lit(0.0)), F.lit(1.0 / period))
    # one row per date
    return daily.select(keys.date, (F.product(step).over(Window.orderBy(keys.date).rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("cumulative"))


def factor_positions(df: DataFrame, period: int = 1, keys: Keys = Keys(), long_short: bool = True, group_neutral: bool = False, equal_weight: bool = False, quantiles: Sequence[int] | None = None, groups: Sequence[str] | None = None) -> DataFrame:
    """Share held per date and asset when every date's weights are kept for `period` dates, scaled so that absolute shares sum to 1."""
    t = _subset(df, quantiles, groups)
    w = factor_weights(t, "factor", keys, long_short, equal_weight, "group" if group_neutral else None)
    idx = date_index(w, keys)
    held = w.where("weight is not null").join(idx, keys.date).select(keys.ticker, "weight", F.explode(F.sequence(F.col("_i"), F.col("_i") + period - 1)).alias("_i"))
    summed = held.groupBy(keys.ticker, "_i").agg(F.sum("weight").alias("_s")).join(idx, "_i")
    return summed.select(keys.ticker, keys.date, div(F.col("_s"), F.sum(F.abs("_s")).over(keys.day)).alias("position"))


def account_input(df: DataFrame, period: int, keys: Keys = Keys(), capital: float | None = None, benchmark_period: int = 1, **options: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily returns, positions (shares of the whole, or amounts of a capital, and the rest as cash) and benchmark returns of a factor's portfolio.

    options are those of factor_cumulative_returns. The benchmark is the universe's mean
    return of benchmark_period.
    """
    cumulative = factor_cumulative_returns(df, period, keys, **options)
    along = Window.orderBy(keys.date)
    nav = 1 + F.col("cumulative")
    returns = cumulative.select(keys.date, (div(nav, F.coalesce(F.lag(nav).over(along), F.lit(1.0))) - 1).alias("value_return"))
    pos = factor_positions(df, period, keys, **options)
    if capital:
        pos = pos.join(cumulative, keys.date).select(keys.ticker, keys.date, (F.col("position") * capital * nav).alias("position"))
        total = cumulative.select(keys.date, (nav * capital).alias("_t"))
    else:
        total = cumulative.select(keys.date, F.lit(1.0).alias("_t"))
    held = pos.groupBy(keys.date).agg(F.sum("position").alias("_h"))
    cash = total.join(held, keys.date, "left").select(F.lit("cash").alias(keys.ticker), keys.date, (F.col("_t") - F.coalesce("_h", F.lit(0.0))).alias("position"))
    benchmark = df.groupBy(keys.date).agg(F.avg(f"r{benchmark_period}").alias("benchmark_return"))
    return returns, pos.unionByName(cash), benchmark


def rate_of_return(r: Column, periods: Column | float) -> Column:
    """The return of one base period that compounds to r over `periods`."""
    return F.pow(1 + r, 1.0 / periods if isinstance(periods, (int, float)) else 1 / periods) - 1


def std_conversion(std: Column, periods: float) -> Column:
    """The deviation of one base period whose sum over `periods` has the given one."""
    return std / F.sqrt(F.lit(float(periods)))
