"""Returns, drawdown and trade records, adjustments and execution rules over panels of prices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel_ops import Keys, div


def daily_returns(panel: DataFrame, price: str = "close", keys: Keys = Keys()) -> DataFrame:
    """Adds r, the return from the row before (NULL where either price is missing or not positive)."""
    p = F.when(F.col(price) > 0, F.col(price))
    return panel.withColumn("r", div(p, F.lag(p).over(keys.along)) - 1)


def return_metrics(returns: DataFrame, r: str = "r", benchmark: str | None = None, keys: Keys = Keys(), year: int = 252) -> DataFrame:
    """One row of statistics per ticker over its known returns (tickers of fewer than three are left out).

    total and annualised return, volatility, sharpe, sortino, omega, value at risk (5 %),
    expected shortfall, tail ratio, skew, excess kurtosis, win rate, profit factor, maximum
    drawdown, calmar; with a benchmark also beta and up and down capture (of mean returns).
    """
    x = F.col(r)
    along = keys.past
    t = returns.where(x.isNotNull()).withColumn("_nav", F.product(1 + x).over(along))
    t = t.withColumn("_dd", F.col("_nav") / F.greatest(F.max("_nav").over(along), F.lit(1.0)) - 1)
    t = t.withColumn("_var", F.percentile(x, F.lit(0.05)).over(Window.partitionBy(keys.ticker)))
    n, mean, std = F.count(x), F.avg(x), F.stddev_samp(x)
    total = F.product(1 + x) - 1
    annual = F.pow(1 + total, year / n) - 1
    up, down = F.sum(F.greatest(x, F.lit(0.0))), F.sum(F.greatest(-x, F.lit(0.0)))
    worst = F.min("_dd")
    aggs = [
        n.alias("n"), total.alias("total_return"), annual.alias("annual_return"), (std * F.sqrt(F.lit(float(year)))).alias("volatility"), (div(mean, F.when(std > 1e-12, std)) * F.sqrt(F.lit(float(year)))).alias("sharpe"),
        (div(mean, F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2))))) * F.sqrt(F.lit(float(year)))).alias("sortino"), div(up, down).alias("omega"), F.percentile(x, F.lit(0.05)).alias("value_at_risk"),
        F.avg(F.when(x <= F.col("_var"), x)).alias("expected_shortfall"), div(F.abs(F.percentile(x, F.lit(0.95))), F.abs(F.percentile(x, F.lit(0.05)))).alias("tail_ratio"),
        F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("win_rate"), worst.alias("max_drawdown"), div(annual, F.abs(worst)).alias("calmar"),
    ]
    if benchmark:
        b = F.col(benchmark)
        mean_if = lambda c, k: F.avg(F.when(k, c))
        aggs += [div(F.covar_samp(x, b), F.var_samp(b)).alias("beta"), div(mean_if(x, b > 0), mean_if(b, b > 0)).alias("up_capture"), div(mean_if(x, b < 0), mean_if(b, b < 0)).alias("down_capture")]
    return t.groupBy(keys.ticker).agg(*aggs).where("n >= 3")


def period_returns(returns: DataFrame, unit: str, r: str = "r", keys: Keys = Keys()) -> DataFrame:
    """Compounded return per ticker and calendar period (its first day)."""
    t = returns.where(F.col(r).isNotNull())
    return t.groupBy(keys.ticker, F.date_trunc(unit, F.col(keys.date)).cast("date").alias("period")).agg((F.product(1 + F.col(r)) - 1).alias("period_return"))


def drawdown_records(panel: DataFrame, price: str = "close", keys: Keys = Keys()) -> DataFrame:
    """One row per fall below a running peak: ticker, peak_day, valley_day, recovery_day (null if still open), depth, rows."""
    t = panel.where(F.col(price) > 0).select(keys.ticker, keys.date, F.col(price).alias("_p"))
    t = t.withColumn("_peak", F.max("_p").over(keys.past))
    t = t.withColumn("_new", (F.col("_p") >= F.col("_peak")).cast("int")).withColumn("_g", F.sum("_new").over(keys.past))
    starts = t.where("_new = 1").select(keys.ticker, "_g", F.col(keys.date).alias("peak_day"))
    falls = t.where("_new = 0").groupBy(keys.ticker, "_g").agg(F.min_by(keys.date, F.struct("_p", keys.date)).alias("valley_day"), (F.min("_p") / F.first("_peak") - 1).alias("depth"), F.count(F.lit(1)).cast("int").alias("rows"))
    ends = starts.select(keys.ticker, (F.col("_g") - 1).alias("_g"), F.col("peak_day").alias("recovery_day"))
    return falls.join(starts, [keys.ticker, "_g"]).join(ends, [keys.ticker, "_g"], "left").select(keys.ticker, "peak_day", "valley_day", "recovery_day", "depth", "rows")


def trades(panel: DataFrame, entry: Column, exit_: Column, price: str = "close", keys: Keys = Keys()) -> DataFrame:
    """Round trips: an entry while out opens, the next exit closes: ticker, entry_day, exit_day, entry_price, exit_price, trade_return, rows.

    Rows without a price don't trade; an entry and exit on the same row is an exit while in,
    else an entry. Open trades have null exits.
    """
    t = panel.where(F.col(price) > 0).withColumn("_i", F.row_number().over(keys.along))
    both = t.withColumns({"_in": F.coalesce(entry, F.lit(False)), "_out": F.coalesce(exit_, F.lit(False))}).where("_in or _out")
    side = F.when(F.col("_in") & ~F.col("_out"), 1).when(F.col("_out") & ~F.col("_in"), -1).otherwise(0)
    s = both.withColumn("_s", side).where("_s != 0")
    s = s.withColumn("_before", F.coalesce(F.lag("_s").over(keys.along), F.lit(-1))).where("_s != _before")
    s = s.withColumns({"_xd": F.lead(keys.date).over(keys.along), "_xp": F.lead(price).over(keys.along), "_xi": F.lead("_i").over(keys.along)}).where("_s = 1")
    return s.select(keys.ticker, F.col(keys.date).alias("entry_day"), F.col("_xd").alias("exit_day"), F.col(price).alias("entry_price"), F.col("_xp").alias("exit_price"), (F.col("_xp") / F.col(price) - 1).alias("trade_return"), (F.col("_xi") - F.col("_i")).cast("int").alias("rows"))


def trade_statistics(closed: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Per ticker over closed trades: count, won, lost, mean return, best, worst, mean rows, profit factor, quality number."""
    x = F.col("trade_return")
    s = F.stddev_samp(x)
    return closed.where(x.isNotNull()).groupBy(keys.ticker).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(x > 0, 1)).alias("won"), F.count(F.when(x < 0, 1)).alias("lost"), F.avg(x).alias("mean"), F.max(x).alias("best"), F.min(x).alias("worst"), F.avg("rows").alias("rows"),
        div(F.sum(F.greatest(x, F.lit(0.0))), F.sum(F.greatest(-x, F.lit(0.0)))).alias("profit_factor"), (F.sqrt(F.count(F.lit(1))) * div(F.avg(x), F.when(s > 1e-12, s))).alias("quality"),
    )


def adjusted_close(prices: DataFrame, close: str, before: str, keys: Keys = Keys()) -> DataFrame:
    """Adds adj_factor and adj_close: prices as if every later change of base had happened before.

    A change of base shows where the recorded previous close differs from the row before's
    close; only positive known prices count. The product is taken over logarithms.
    """
    prev = F.last(F.when(F.col(close) > 0, F.col(close)), ignorenulls=True).over(keys.along.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when((F.col(before) > 0) & (prev > 0), F.ln(F.col(before) / prev)).otherwise(0.0)
    t = prices.withColumn("_step", step)
    later = F.coalesce(F.sum("_step").over(keys.backward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return t.withColumn("adj_factor", F.exp(later)).withColumn("adj_close", F.col(close) * F.col("adj_factor")).drop("_step")


def execution_price(price: Column, side: Column, slippage: float, kind: str = "percentage") -> Column:
    """Price with slippage against the trader: side 1 buys, -1 sells; percentage of the price or a fixed amount."""
    return price * (1 + side * slippage) if kind == "percentage" else price + side * slippage


def blocked(price: Column, before: Column, volume: Column, side: str, limit: float = 0.1) -> Column:
    """Whether a trade can't happen: no volume, or the price at its limit on the trader's side (rounded to cents)."""
    edge = F.round(before * (1 + limit if side == "buy" else 1 - limit), 2)
    at = F.round(price, 2) >= edge if side == "buy" else F.round(price, 2) <= edge
    return F.coalesce(volume <= 0, F.lit(True)) | F.coalesce(at, F.lit(False))


def rolling_apply(df: DataFrame, x: str, n: int, fn: Callable[[np.ndarray], float], out: str, keys: Keys = Keys(), min_periods: int | None = None) -> DataFrame:
    """A Python function of each ticker's last n values (missing ones dropped; NULL if fewer than min_periods, n by default)."""
    need = n if min_periods is None else min_periods
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys.date, kind="stable")
        v = pdf[x].to_numpy(float)
        res = np.full(len(v), np.nan)
        for i in range(len(v)):
            w = v[max(0, i - n + 1) : i + 1]
            w = w[~np.isnan(w)]
            if len(w) >= need:
                res[i] = fn(w)
        return pdf.assign(**{out: res})

    return df.groupBy(keys.ticker).applyInPandas(each, schema)


def rolling_regression(df: DataFrame, y: str, xs: Sequence[str], n: int, out: str, keys: Keys = Keys(), half_life: float | None = None) -> DataFrame:
    """Adds `out`, an array of alpha and betas of y on several columns over the last n rows.

    Rows with a missing value drop out of their window; NULL with fewer than len(xs) + 1
    left, or where the regressors are collinear. Normal equations from running windows per ticker.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys.date, kind="stable").reset_index(drop=True)
        a = np.column_stack([np.ones(len(pdf)), *(pdf[c].to_numpy(float) for c in xs)])
        b = pdf[y].to_numpy(float)
        ok = ~np.isnan(a).any(1) & ~np.isnan(b)
        w = np.array([0.5 ** (k / half_life) for k in range(n, 0, -1)]) if half_life else np.ones(n)
        res: list = [None] * len(pdf)
        for i in range(n - 1, len(pdf)):
            rows = slice(i - n + 1, i + 1)
            keep = ok[rows]
            if keep.sum() < a.shape[1]:
                continue
            m, v = a[rows][keep], w[keep]
            g = m.T @ (m * v[:, None])
            if abs(np.linalg.det(g)) > 1e-12:
                res[i] = np.linalg.solve(g, m.T @ (b[rows][keep] * v)).tolist()
        return pdf.assign(**{out: pd.Series(res, dtype=object)})

    return df.groupBy(keys.ticker).applyInPandas(each, schema)
