"""Factor analytics: forward returns, quantiles, information coefficients, turnover, event studies, metrics.

Tables are long: one row per date and ticker. Missing values are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.panel_ops import Keys, div


def forward_returns(panel: DataFrame, price: str, periods: Sequence[int] = (1, 5, 10), keys: Keys = Keys()) -> DataFrame:
    """Adds r<n>, the return from this row to the one n rows on."""
    return panel.withColumns({f"r{n}": div(F.lead(price, n).over(keys.along), F.col(price)) - 1 for n in periods})


def quantile_bucket(df: DataFrame, factor: str, n: int = 5, keys: Keys = Keys(), group: str | None = None) -> DataFrame:
    """Adds factor_quantile (1..n) within the date (and group): interpolated edges, closed on the right."""
    w = Window.partitionBy(*[keys.date, *([group] if group else [])])
    edges = F.percentile(F.col(factor), F.array(*[F.lit(i / n) for i in range(1, n)])).over(w)
    with_edges = df.withColumn("_edges", edges)
    q = F.expr(f"1 + size(filter(_edges, e -> e < `{factor}`))")
    return with_edges.withColumn("factor_quantile", F.when(F.col(factor).isNotNull(), q)).drop("_edges")


def average_rank(df: DataFrame, by: Sequence[str], x: str, name: str) -> DataFrame:
    """Adds the ascending rank of x within `by`, ties averaged; rows of null x rank NULL."""
    r = F.rank().over(Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return df.withColumn(name, F.when(F.col(x).isNotNull(), r + (ties - 1) / 2))


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation aggregate over the rows with both values; NULL if a side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.var_pop(a) * F.var_pop(b)
    return F.when(spread > 1e-18, div(F.covar_pop(a, b), F.sqrt(spread)))


def information_coefficient(df: DataFrame, factor: str, returns: Sequence[str], keys: Keys = Keys(), method: str = "spearman", group: str | None = None) -> DataFrame:
    """Per date (and group) the correlation of factor and each return; ranks among rows that have both."""
    by = [keys.date, *([group] if group else [])]
    out = None
    for r in returns:
        t = df.where(F.col(factor).isNotNull() & F.col(r).isNotNull())
        if method == "spearman":
            t = average_rank(average_rank(t, by, factor, "_a"), by, r, "_b")
            one = t.groupBy(*by).agg(safe_corr(F.col("_a"), F.col("_b")).alias(f"ic_{r}"))
        else:
            one = t.groupBy(*by).agg(safe_corr(F.col(factor), F.col(r)).alias(f"ic_{r}"))
        out = one if out is None else out.join(one, by, "full")
    return out


def factor_weights(df: DataFrame, factor: str, keys: Keys = Keys(), demeaned: bool = True, equal_weight: bool = False, group: str | None = None) -> DataFrame:
    """Adds weight: the factor demeaned within date (and group) and scaled so that the date's absolute weights sum to 1.

    equal_weight gives the names above the median (if demeaned) equal long weights and those below equal short ones.
    """
    g = Window.partitionBy(*[keys.date, *([group] if group else [])])
    x = F.col(factor)
    if equal_weight:
        centre = F.median(x).over(g) if demeaned else F.lit(0.0)
        raw = F.signum(x - centre)
        df = df.withColumn("_raw", raw)
        side = F.sum(F.when(F.signum("_raw") == F.col("_raw"), F.abs("_raw"))).over(Window.partitionBy(*[keys.date, *([group] if group else []), "_raw"]))
        df = df.withColumn("_raw", div(F.col("_raw"), side))
    else:
        df = df.withColumn("_raw", x - F.avg(x).over(g) if demeaned else x)
    return df.withColumn("weight", div(F.col("_raw"), F.sum(F.abs("_raw")).over(keys.day))).drop("_raw")


def factor_returns(weighted: DataFrame, returns: Sequence[str], keys: Keys = Keys()) -> DataFrame:
    """Per date the weighted return of each period."""
    return weighted.groupBy(keys.date).agg(*[F.sum(F.col("weight") * F.col(r)).alias(f"factor_{r}") for r in returns])


def alpha_beta(weighted: DataFrame, r: str, keys: Keys = Keys(), periods_per_year: int = 252) -> DataFrame:
    """One row: annualised alpha and beta of the factor's return against the universe's mean return."""
    daily = weighted.groupBy(keys.date).agg(F.sum(F.col("weight") * F.col(r)).alias("f"), F.avg(r).alias("m")).where("f is not null and m is not null")
    return daily.agg((F.pow(1 + F.regr_intercept("f", "m"), F.lit(periods_per_year)) - 1).alias("ann_alpha"), F.regr_slope("f", "m").alias("beta"))


def mean_return_by_quantile(df: DataFrame, returns: Sequence[str], keys: Keys = Keys(), demeaned: bool = True, by_date: bool = False) -> DataFrame:
    """Mean, standard error and count of the returns per quantile (per date first: dates count alike)."""
    t = df.where("factor_quantile is not null")
    if demeaned:
        t = t.withColumns({r: F.col(r) - F.avg(r).over(keys.day) for r in returns})
    daily = t.groupBy(keys.date, "factor_quantile").agg(*[F.avg(r).alias(r) for r in returns])
    if by_date:
        return daily
    aggs = [c for r in returns for c in (F.avg(r).alias(f"mean_{r}"), (F.stddev_samp(r) / F.sqrt(F.count(r))).alias(f"stderr_{r}"))]
    return daily.groupBy("factor_quantile").agg(*aggs)


def quantile_spread(daily: DataFrame, r: str, top: int, bottom: int, keys: Keys = Keys()) -> DataFrame:
    """Per date the top quantile's mean return less the bottom's."""
    pick = lambda q: F.max(F.when(F.col("factor_quantile") == q, F.col(r)))
    return daily.groupBy(keys.date).agg((pick(top) - pick(bottom)).alias("spread"))


def date_index(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Dates numbered from 0: one row per date, bounded by the calendar."""
    dates = df.select(keys.date).distinct()
    return dates.withColumn("_i", F.row_number().over(Window.orderBy(keys.date)) - 1)


def quantile_turnover(df: DataFrame, quantile: int, period: int = 1, keys: Keys = Keys()) -> DataFrame:
    """Per date the share of a quantile's names that weren't in it `period` dates before; the first dates have none."""
    idx = date_index(df, keys)
    t = df.where(F.col("factor_quantile") == quantile).select(keys.ticker, keys.date).join(idx, keys.date)
    before = t.select(keys.ticker, (F.col("_i") + period).alias("_i"), F.lit(1).alias("_old"))
    j = t.join(before, [keys.ticker, "_i"], "left").where(F.col("_i") >= period)
    return j.groupBy(keys.date).agg((1 - F.count("_old") / F.count(F.lit(1))).alias("turnover"))


def rank_autocorrelation(df: DataFrame, factor: str, period: int = 1, keys: Keys = Keys()) -> DataFrame:
    """Per date the correlation of the factor's ranks with those of `period` dates before."""
    idx = date_index(df, keys)
    t = average_rank(df.where(F.col(factor).isNotNull()), [keys.date], factor, "_rank").select(keys.ticker, keys.date, "_rank").join(idx, keys.date)
    before = t.select(keys.ticker, (F.col("_i") + period).alias("_i"), F.col("_rank").alias("_before"))
    return t.join(before, [keys.ticker, "_i"]).groupBy(keys.date).agg(safe_corr(F.col("_rank"), F.col("_before")).alias("autocorrelation"))


def cumulative_returns(daily: DataFrame, r: str, keys: Keys = Keys()) -> DataFrame:
    """Running product of 1 + r along the dates of a table of one row per date."""
    return daily.withColumn("cumulative", F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(Window.orderBy(keys.date).rowsBetween(Window.unboundedPreceding, 0)))


def event_study(events: DataFrame, panel: DataFrame, price: str, before: int, after: int, keys: Keys = Keys()) -> DataFrame:
    """Mean and deviation of returns relative to the event's price, at each offset of rows around events.

    `events` (ticker, date, bucket). The offsets are exploded from the events, which are then
    equi-joined to the ticker's numbered rows, so nothing is compared with a whole ticker.
    """
    rows = panel.select(keys.ticker, keys.date, F.col(price).alias("_p"), F.row_number().over(keys.along).alias("_i"))
    at = events.join(rows, [keys.ticker, keys.date]).withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    around = at.select(keys.ticker, "bucket", "offset", (F.col("_i") + F.col("offset")).alias("_i"), F.col("_p").alias("_base"))
    j = around.join(rows.select(keys.ticker, "_i", "_p"), [keys.ticker, "_i"])
    ret = div(F.col("_p"), F.col("_base")) - 1
    return j.groupBy("bucket", "offset").agg(F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("std"), F.count(ret).alias("n"))


def strategy_metrics(daily: DataFrame, account: str, benchmark: str, date: str = "trade_date") -> DataFrame:
    """One row of performance metrics of an account against a benchmark, from a table of one row per date.

    annual_rate and benchmark_rate (252 periods, over n + 1), alpha, beta, sharpe, sortino,
    information_ratio (not annualised), max_drawdown of the account's net value.
    """
    a, b = F.col(account), F.col(benchmark)
    t = daily.where(a.isNotNull() & b.isNotNull()).withColumn("_nav", F.product(1 + a).over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_dd", 1 - div(F.col("_nav"), F.max("_nav").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0))))
    annual = lambda c: F.pow(F.product(1 + c), 252 / (F.count(F.lit(1)) + 1)) - 1
    beta = div(F.covar_samp(a, b), F.var_samp(b))
    down = F.sqrt(F.avg(F.pow(F.least(a, F.lit(0.0)), F.lit(2))))
    return t.agg(
        annual(a).alias("annual_rate"), annual(b).alias("benchmark_rate"), (annual(a) - beta * annual(b)).alias("alpha"), beta.alias("beta"),
        (div(F.avg(a), F.stddev_samp(a)) * F.sqrt(F.lit(252.0))).alias("sharpe"), (div(F.avg(a), down) * F.sqrt(F.lit(252.0))).alias("sortino"),
        div(F.avg(a - b), F.stddev_samp(a - b)).alias("information_ratio"), F.max("_dd").alias("max_drawdown"), F.count(F.lit(1)).alias("days"),
    )


def overlapping_positions(weighted: DataFrame, period: int, keys: Keys = Keys()) -> DataFrame:
    """Average weight held per date and ticker when every date's weights are kept for `period` dates."""
    idx = date_index(weighted, keys)
    held = weighted.where(F.col("weight").isNotNull()).select(keys.ticker, keys.date, "weight").join(idx, keys.date)
    spread = held.select(keys.ticker, "weight", F.explode(F.sequence(F.col("_i"), F.col("_i") + period - 1)).alias("_i"))
    dates = idx.join(weighted.select(keys.date).distinct(), keys.date)
    summed = spread.groupBy(keys.ticker, "_i").agg((F.sum("weight") / period).alias("position"))
    return summed.join(dates, "_i").select(keys.ticker, keys.date, "position")
