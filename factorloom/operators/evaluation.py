"""Evaluation of profits and returns per group: streaks, drawdowns, fit, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel_ops import div


def profit_statistics(df: DataFrame, group: str, order: str, x: str) -> DataFrame:
    """Per group over its known profits in order: counts, sums, means and extremes of wins and losses, longest streaks, profit factor.

    profit factor: (1e-10 + gains) / (1e-10 + losses); rates are percents of the won and lost ones.
    """
    v = F.col(x)
    t = df.where(v.isNotNull()).withColumn("_s", F.signum(v))
    along = Window.partitionBy(group).orderBy(order)
    t = t.withColumn("_new", F.coalesce((F.col("_s") != F.lag("_s").over(along)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy(group, "_run").agg(F.first("_s").alias("_s"), F.count(F.lit(1)).alias("_n")).groupBy(group).agg(
        F.coalesce(F.max(F.when(F.col("_s") > 0, F.col("_n"))), F.lit(0)).alias("most_wins"), F.coalesce(F.max(F.when(F.col("_s") < 0, F.col("_n"))), F.lit(0)).alias("most_losses")
    )
    won, lost = F.when(v > 0, v), F.when(v < 0, v)
    rated = F.count(won) + F.count(lost)
    sums = t.groupBy(group).agg(
        F.count(won).alias("won"), F.count(lost).alias("lost"), (100 * div(F.count(won), F.when(rated > 0, rated))).alias("win_rate"), (100 * div(F.count(lost), F.when(rated > 0, rated))).alias("loss_rate"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("gained"), F.coalesce(F.sum(lost), F.lit(0.0)).alias("given"), F.coalesce(F.avg(won), F.lit(0.0)).alias("mean_win"), F.coalesce(F.avg(lost), F.lit(0.0)).alias("mean_loss"),
        F.coalesce(F.max(won), F.lit(0.0)).alias("largest_win"), F.coalesce(F.min(lost), F.lit(0.0)).alias("largest_loss"),
        ((1e-10 + F.coalesce(F.sum(won), F.lit(0.0))) / (1e-10 - F.coalesce(F.sum(lost), F.lit(0.0)))).alias("profit_factor"),
    )
    return sums.join(runs, group)


def equity_statistics(df: DataFrame, group: str, order: str, value: str, year: int = 252) -> DataFrame:
    """Per group over its equity in order: greatest drawdown in money and percent and its rows, fit of a line on time, spread, total and annual return, entropy of ten bins over the most possible.

    sharpe: mean over population deviation of the returns (not annualised); sortino: over that
    of the negative ones; calmar: mean return times `year` over the drawdown share.
    """
    v = F.col(value)
    t = df.where(v.isNotNull()).select(group, order, v.cast("double").alias("_v"))
    along = Window.partitionBy(group).orderBy(order)
    past = along.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(group)
    t = t.withColumns({"_i": F.row_number().over(along).cast("double"), "_peak": F.max("_v").over(past), "_r": div(F.col("_v"), F.lag("_v").over(along)) - 1, "_lo": F.min("_v").over(every), "_hi": F.max("_v").over(every), "_n": F.count(F.lit(1)).over(every)})
    t = t.withColumns({"_dd": F.col("_v") - F.col("_peak"), "_ddp": div(F.col("_v"), F.col("_peak")) - 1, "_bin": F.least(F.floor(10 * div(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))), F.lit(9))})
    p = F.col("_c") / F.col("_n")
    entropy = t.groupBy(group, "_bin", "_n").agg(F.count(F.lit(1)).alias("_c")).groupBy(group).agg((-F.sum(p * F.ln(p)) / F.ln(F.lit(10.0))).alias("entropy"))
    r = F.col("_r")
    s, down = F.stddev_pop(r), F.stddev_pop(F.when(r < 0, r))
    first, last = F.min_by("_v", "_i"), F.max_by("_v", "_i")
    spread = F.percentile("_v", F.lit(0.75)) - F.percentile("_v", F.lit(0.25))
    out = t.groupBy(group).agg(
        F.min("_dd").alias("max_drawdown"), (100 * F.min("_ddp")).alias("max_drawdown_percent"), F.regr_r2("_v", "_i").alias("r_squared"), F.sqrt(F.avg(F.col("_ddp") * F.col("_ddp"))).alias("ulcer"), spread.alias("iqr"),
        (100 * (div(last, first) - 1)).alias("total_return_percent"), (100 * (F.pow(div(last, first), F.lit(float(year)) / F.count(F.lit(1))) - 1)).alias("annual_return_percent"),
        div(F.avg(r), F.when(s > 1e-12, s)).alias("sharpe"), div(F.avg(r), F.when(down > 1e-12, down)).alias("sortino"), div(F.avg(r) * year, F.abs(F.min("_ddp"))).alias("calmar"),
    )
    return out.join(entropy, group)


def profit_factor(x: np.ndarray) -> np.ndarray:
    """Log profit factor of samples (rows)."""
    return np.log((1e-10 + np.where(x > 0, x, 0).sum(-1)) / (1e-10 - np.where(x < 0, x, 0).sum(-1)))


def sharpe_ratio(x: np.ndarray) -> np.ndarray:
    """Mean over population deviation of samples (rows); 0 where constant."""
    s = x.std(-1)
    return np.where(s > 0, x.mean(-1) / np.where(s > 0, s, 1), 0.0)


def bca_interval(x: np.ndarray, stat: Callable[[np.ndarray], np.ndarray], levels: Sequence[float] = (0.025, 0.05, 0.1), samples: int = 1000, seed: int = 42, block: int | None = None) -> list[tuple[float, float]]:
    """Bias-corrected and accelerated bootstrap intervals of a statistic of rows, one per level (each tail has `level`).

    stat works along the last axis. block: draws runs of so many consecutive values instead of
    single ones. Constant or single values give an interval of no width.
    """
    n = len(x)
    if n < 2:
        v = float(stat(x[None])[0]) if n else np.nan
        return [(v, v)] * len(levels)
    rng = np.random.default_rng(seed)
    if block:
        starts = rng.integers(0, n, (samples, -(-n // block)))
        take = ((starts[:, :, None] + np.arange(block)) % n).reshape(samples, -1)[:, :n]
    else:
        take = rng.integers(0, n, (samples, n))
    theta, boot = float(stat(x[None])[0]), np.sort(stat(x[take]))
    norm = NormalDist()
    z0 = norm.inv_cdf(float(np.clip((np.count_nonzero(boot < theta) + 0.5 * np.count_nonzero(boot == theta)) / samples, 1e-4, 1 - 1e-4)))
    left_out = stat(np.array([np.delete(x, i) for i in range(n)])) if n <= 2000 else stat(np.array([np.delete(x, slice(i, i + n // 1000)) for i in range(0, n - n // 1000, n // 1000)]))
    d = left_out.mean() - left_out
    scale = (d * d).sum() ** 1.5
    a = (d**3).sum() / (6 * scale) if scale > 0 else 0.0

    def at(p: float) -> float:
        z = z0 + norm.inv_cdf(p)
        q = norm.cdf(z0 + z / (1 - a * z))
        return float(np.quantile(boot, q))

    return [(at(p), at(1 - p)) for p in levels]


def drawdown_bounds(returns: np.ndarray, levels: Sequence[float] = (0.9, 0.95, 0.99, 0.999), samples: int = 1000, seed: int = 42) -> list[float]:
    """The greatest drawdown (share, negative) not exceeded with each probability, by resampled paths of the returns."""
    if not len(returns):
        return [np.nan] * len(levels)
    rng = np.random.default_rng(seed)
    path = np.cumprod(1 + returns[rng.integers(0, len(returns), (samples, len(returns)))], axis=1)
    peak = np.maximum(np.maximum.accumulate(path, axis=1), 1.0)
    worst = (path / peak - 1).min(axis=1)
    return [float(np.quantile(worst, 1 - p)) for p in levels]


def bootstrap_evaluation(df: DataFrame, group: str, order: str, x: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """Per group the bootstrap intervals of log profit factor and sharpe ratio (statistic, level, low, high) and the drawdown bounds (high null).

    A group's series is one row list of a grouped map, bounded by its length; groups run side
    by side. Fewer than two known values give no rows.
    """
    schema = T.StructType([df.schema[group], *T._parse_datatype_string("statistic string, level double, low double, high double").fields])
    levels = (0.025, 0.05, 0.1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order, kind="stable")[x].dropna().to_numpy(float)
        out = []
        if len(v) >= 2:
            for name, stat in (("log_profit_factor", profit_factor), ("sharpe", sharpe_ratio)):
                out += [(pdf[group].iat[0], name, 1 - 2 * p, lo, hi) for p, (lo, hi) in zip(levels, bca_interval(v, stat, levels, samples, seed), strict=True)]
            tops = (0.9, 0.95, 0.99, 0.999)
            out += [(pdf[group].iat[0], "drawdown", p, b, None) for p, b in zip(tops, drawdown_bounds(v, tops, samples, seed), strict=True)]
        return pd.DataFrame(out, columns=schema.names)

    return df.where(F.col(group).isNotNull()).select(group, order, x).groupBy(group).applyInPandas(run, schema)


def expected_max_sharpe(mean: float, variance: float, trials: int) -> float:
    """Expected greatest of `trials` independent sharpe ratios of a mean and variance."""
    if trials < 2:
        return mean
    norm, gamma = NormalDist(), 0.5772156649015329
    return mean + variance**0.5 * ((1 - gamma) * norm.inv_cdf(1 - 1 / trials) + gamma * norm.inv_cdf(1 - 1 / (trials * np.e)))


def deflated_sharpe(sharpe: float, variance: float, trials: int, periods: int, skew: float, kurtosis: float) -> float:
    """Probability that a sharpe ratio, the best of `trials`, exceeds what chance would give; kurtosis is that of a normal at 3."""
    rest = sharpe - expected_max_sharpe(0.0, variance, trials)
    return NormalDist().cdf(rest * (periods - 1) ** 0.5 / (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) ** 0.5)


def describe(df: DataFrame, group: str, x: str, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std, min, percentiles and max of a column per group."""
    return df.groupBy(group).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), *[F.percentile(x, F.lit(float(s))).alias(f"p{round(100 * s)}") for s in shares], F.max(x).alias("max"))
