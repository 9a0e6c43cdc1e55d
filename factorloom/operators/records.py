"""Sparse records (key, order, value) of a table, and analyzers of accounts and trades."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel_ops import div
from .topn import top_n


def to_records(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The non-missing cells of a panel: key, order, value."""
    return df.where(F.col(value).isNotNull()).select(key, order, value)


def best_records(records: DataFrame, key: str, order: str, value: str, n: int, largest: bool = True) -> DataFrame:
    """The n largest (or smallest) records of each key by bounded heaps, equal values by order ascending; adds rank_no."""
    if largest:
        return top_n(records, [key], value, order, n)
    flipped = top_n(records.withColumn("_v", -F.col(value).cast("double")), [key], "_v", order, n)
    return flipped.select(key, "rank_no", order, (-F.col("_v")).alias(value))


def value_counts(records: DataFrame, key: str, value: str | Column) -> DataFrame:
    """How often each value occurs per key, its share, and its rank by count (equal counts by value)."""
    v = F.col(value) if isinstance(value, str) else value
    g = records.groupBy(key, v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    return g.select(key, "value", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), F.row_number().over(w.orderBy(F.col("n").desc(), F.col("value"))).alias("rank_no"))


def reduce_records(records: DataFrame, key: str, order: str, value: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per key: count, sum, mean, deviations, extremes and where they lie first, first and last value, percentiles."""
    v = F.col(value)
    return records.groupBy(key).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"), F.min(v).alias("least"), F.max(v).alias("greatest"),
        # of equal extremes the first in order
        F.min(F.struct(v.alias("v"), F.col(order).alias("o")))["o"].alias("least_at"), F.min(F.struct((-v).alias("v"), F.col(order).alias("o")))["o"].alias("greatest_at"),
        F.min_by(v, order).alias("first_value"), F.max_by(v, order).alias("last_value"), *[F.percentile(v, F.lit(float(p))).alias(f"p{round(100 * p)}") for p in percentiles],
    )


def nth_record(records: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n-th record of each key in order (0 the first, -1 the last); keys with fewer have none."""
    by = F.col(order).asc() if n >= 0 else F.col(order).desc()
    at = n if n >= 0 else -n - 1
    return records.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(by)) - 1).where(F.col("_r") == at).drop("_r")


def expand_records(records: DataFrame, grid: DataFrame, keys: Sequence[str], value: str, fill: float | None = None) -> DataFrame:
    """The records on a dense grid of keys, missing cells filled."""
    t = grid.select(*keys).distinct().join(records.select(*keys, value), list(keys), "left")
    return t if fill is None else t.withColumn(value, F.coalesce(value, F.lit(fill)))


def stack_records(records: DataFrame, key: str, order: str, value: str, most: int) -> DataFrame:
    """One row per key with its first `most` records in order as columns v0, v1, ..."""
    t = records.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).where(F.col("_i") < most)
    return t.groupBy(key).agg(*[F.max(F.when(F.col("_i") == i, F.col(value))).alias(f"v{i}") for i in range(most)])


def apply_by_key(records: DataFrame, key: str, order: str, fn: Callable[[pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    """A user's function of each key's records in order, returning rows of the given types (key included)."""
    return records.groupBy(key).applyInPandas(lambda pdf: fn(pdf.sort_values(order, kind="stable")), T._parse_datatype_string(ddl))


# Analyzers -----------------------------------------------------------------------------------


def variability_weighted_return(values: DataFrame, group: str, order: str, value: str, year: int = 252, tau: float = 2.0, sigma_max: float = 0.2) -> DataFrame:
    """Annual compound return per group in percent, less the more the value strays from its own steady growth path.

    vwr = 100 (e^(r * year) - 1) (1 - (s / sigma_max)^tau), r the mean log step, s the sample deviation of
    value / path - 1; groups of fewer than three known positive values are left out.
    """
    along = Window.partitionBy(group).orderBy(order)
    every = Window.partitionBy(group)
    t = values.where(F.col(value) > 0).select(group, order, F.col(value).cast("double").alias("_v"))
    t = t.withColumns({"_i": F.row_number().over(along) - 1, "_first": F.first("_v").over(along), "_last": F.max_by("_v", order).over(every), "_n": F.count(F.lit(1)).over(every)}).where("_n >= 3")
    r = F.ln(F.col("_last") / F.col("_first")) / (F.col("_n") - 1)
    stray = F.col("_v") / (F.col("_first") * F.exp(r * F.col("_i"))) - 1
    g = t.withColumns({"_r": r, "_d": stray}).groupBy(group).agg(F.first("_r").alias("_r"), F.stddev_samp("_d").alias("_s"))
    return g.select(group, (F.col("_r") * year).alias("annual_log_return"), F.col("_s").alias("strayed"), (100 * (F.exp(F.col("_r") * year) - 1) * (1 - F.pow(F.col("_s") / sigma_max, F.lit(tau)))).alias("vwr"))


def period_statistics(values: DataFrame, group: str, order: str, value: str, unit: str) -> DataFrame:
    """Per group over the returns of calendar periods: mean, deviation (population), how many are positive, negative and zero, the best and the worst."""
    ends = values.where(F.col(value) > 0).groupBy(group, F.date_trunc(unit, F.col(order)).alias("_p")).agg(F.max_by(value, order).alias("_v"), F.min_by(value, order).alias("_o"))
    before = F.coalesce(F.lag("_v").over(Window.partitionBy(group).orderBy("_p")), F.col("_o"))
    r = ends.withColumn("_r", F.col("_v") / before - 1)
    x = F.col("_r")
    return r.groupBy(group).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(F.when(x > 0, 1)).alias("positive"), F.count(F.when(x < 0, 1)).alias("negative"), F.count(F.when(x == 0, 1)).alias("zero"), F.max(x).alias("best"), F.min(x).alias("worst"))


def leverage(values: DataFrame, group: str, date: str) -> DataFrame:
    """Gross leverage per group and date of account values (cash, value): (value - cash) / value."""
    return values.select(group, date, div(F.col("value") - F.col("cash"), F.col("value")).alias("leverage"))


def transactions(orders: DataFrame, group: str, date: str, asset: str) -> DataFrame:
    """Signed size, price and signed value of every order."""
    return orders.select(group, date, asset, "order_no", (F.col("side") * F.col("size")).alias("amount"), "price", (-F.col("side") * F.col("size") * F.col("price")).alias("value"))


def trade_excursions(trades: DataFrame, prices: DataFrame, key: str, date: str, high: str, low: str) -> DataFrame:
    """Adds mfe and mae, the best and worst a long trade stood at from entry_day to exit_day (both in) relative to its entry price.

    Trades are exploded into months and equi-joined with the prices of those months, so a
    trade meets only rows near its span.
    """
    month = lambda c: F.trunc(c, "month")
    t = trades.where("exit_day is not null").withColumn("_id", F.xxhash64(key, "entry_day"))
    spread = t.select("_id", key, "entry_day", "exit_day", "entry_price", F.explode(F.sequence(month(F.col("entry_day")), month(F.col("exit_day")), F.expr("interval 1 month"))).alias("_m"))
    p = prices.select(key, F.col(date).alias("_d"), F.col(high).alias("_h"), F.col(low).alias("_l"), month(F.col(date)).alias("_m"))
    j = spread.join(p, [key, "_m"]).where(F.col("_d").between(F.col("entry_day"), F.col("exit_day")))
    g = j.groupBy("_id", key, "entry_day").agg((F.max("_h") / F.first("entry_price") - 1).alias("mfe"), (F.min("_l") / F.first("entry_price") - 1).alias("mae"))
    return t.join(g.drop("_id"), [key, "entry_day"], "left").drop("_id")


def account_metrics(values: DataFrame, group: str, date: str, value: str, benchmark: DataFrame | None = None, year: int = 252) -> DataFrame:
    """One row of key figures per group over its daily account values: returns, risk, drawdown and, with a benchmark (date, r), beta and excess.

    Drawdown length is the most rows in a row below the running peak.
    """
    along = Window.partitionBy(group).orderBy(date)
    past = along.rowsBetween(Window.unboundedPreceding, 0)
    t = values.select(group, date, F.col(value).alias("_v")).withColumns({"_r": div(F.col("_v"), F.lag("_v").over(along)) - 1, "_peak": F.max("_v").over(past)})
    t = t.withColumn("_new", (F.col("_v") >= F.col("_peak")).cast("int")).withColumn("_era", F.sum("_new").over(past))
    t = t.withColumn("_under", F.count(F.when(F.col("_new") == 0, 1)).over(Window.partitionBy(group, "_era")))
    b = F.lit(None).cast("double")
    if benchmark is not None:
        t = t.join(benchmark.select(F.col(date), F.col("r").alias("_b")), date, "left")
        b = F.when(F.col("_r").isNotNull(), F.col("_b"))
    r = F.col("_r")
    s = F.stddev_samp(r)
    both = F.when(b.isNotNull(), r)
    return t.groupBy(group).agg(
        F.count(F.lit(1)).alias("days"), (div(F.max_by("_v", date), F.min_by("_v", date)) - 1).alias("total_return"), (F.pow(div(F.max_by("_v", date), F.min_by("_v", date)), F.lit(float(year)) / F.count(r)) - 1).alias("annual_return"),
        (s * F.sqrt(F.lit(float(year)))).alias("volatility"), (div(F.avg(r), F.when(s > 1e-12, s)) * F.sqrt(F.lit(float(year)))).alias("sharpe"), F.min(F.col("_v") / F.col("_peak") - 1).alias("max_drawdown"), F.max("_under").alias("drawdown_days"),
        div(F.covar_samp(both, b), F.var_samp(b)).alias("beta"), F.avg(both - b).alias("mean_excess"),
    )
