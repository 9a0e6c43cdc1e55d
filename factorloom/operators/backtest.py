"""Rebalance simulation: period signals in Spark, the path of a run in one grouped map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_k_holdings(scores: DataFrame, run: str, date: str, ticker: str, score: str, k: int, every: int) -> DataFrame:
    """The k tickers of highest score on every `every`-th date of a run, equal weights: run, date, ticker, weight.

    Ties go to the lower ticker; missing scores are out.
    """
    dates = scores.select(run, date).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(run).orderBy(date)) - 1)
    t = scores.where(F.col(score).isNotNull()).join(dates.where(F.col("_i") % every == 0), [run, date])
    r = F.row_number().over(Window.partitionBy(run, date).orderBy(F.col(score).desc(), F.col(ticker)))
    held = t.withColumn("_r", r).where(F.col("_r") <= k)
    return held.select(run, date, ticker, (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(run, date))).alias("weight"))


def affordable_shares(cash: float, price: float, rate: float, floor: float, lot: int = 100) -> int:
    """Most shares in whole lots that cash buys with a commission of rate * value, floor at least."""
    if price <= 0 or cash <= floor:
        return 0
    n = int(min(cash / (price * (1 + rate)), (cash - floor) / price) // lot) * lot
    return max(n, 0)


def simulate(prices: DataFrame, holdings: DataFrame, run: str, date: str, ticker: str, price: str, cash: float = 1e6, rate: float = 5e-4, floor: float = 5.0, slippage: float = 1e-3, tax: float = 1e-3, lot: int = 100) -> DataFrame:
    """Account value per run and date under lots, commission with a floor, slippage and a tax on sales.

    Trades happen at the price of the rebalance date: names no longer held are sold whole,
    then the others are brought to their weight of the account's value, in whole lots, in
    order of ticker. A missing price keeps the last one and blocks trading that name. A run
    is one group; its rows are dates x names ever held, since prices are first cut to those
    names by a semi join.
    """
    names = holdings.select(run, ticker).distinct()
    p = prices.select(date, ticker, price).join(names, ticker).select(run, date, ticker, F.col(price).cast("double").alias("price"))
    h = holdings.select(run, date, ticker, F.col("weight").alias("weight"))
    j = p.join(h, [run, date, ticker], "full")
    rebalance = holdings.select(run, date, F.lit(1).alias("rebalance")).distinct()
    t = j.join(rebalance, [run, date], "left").select(run, date, ticker, "price", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("rebalance", F.lit(0)).alias("rebalance"))
    schema = T.StructType([t.schema[run], t.schema[date], T.StructField("account", T.DoubleType()), T.StructField("cash", T.DoubleType()), T.StructField("turnover", T.DoubleType())])

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        money, shares, last, out = cash, {}, {}, []
        for d, g in pdf.sort_values([date, ticker], kind="stable").groupby(date, sort=True):
            now = {a: b for a, b in zip(g[ticker], g["price"], strict=True) if b == b and b > 0}
            last.update(now)
            traded = 0.0
            if g["rebalance"].iat[0]:
                value = money + sum(n * last.get(a, 0.0) for a, n in shares.items())
                want = {a: w for a, w in zip(g[ticker], g["weight"], strict=True) if w > 0}
                goal = {a: int(value * w / now[a] // lot) * lot for a, w in want.items() if a in now}
                for a in sorted(set(shares) & set(now)):
                    sell = shares[a] - goal.get(a, 0)
                    if sell > 0:
                        gross = sell * now[a] * (1 - slippage)
                        money += gross - max(gross * rate, floor) - gross * tax
                        shares[a] -= sell
                        traded += gross
                for a in sorted(goal):
                    at = now[a] * (1 + slippage)
                    buy = min(goal[a] - shares.get(a, 0), affordable_shares(money, at, rate, floor, lot))
                    if buy > 0:
                        gross = buy * at
                        money -= gross + max(gross * rate, floor)
                        shares[a] = shares.get(a, 0) + buy
                        traded += gross
                shares = {a: n for a, n in shares.items() if n}
            out.append((pdf[run].iat[0], d, money + sum(n * last.get(a, 0.0) for a, n in shares.items()), money, traded))
        return pd.DataFrame(out, columns=[run, date, "account", "cash", "turnover"])

    return t.groupBy(run).applyInPandas(path, schema)


def bootstrap_interval(returns: np.ndarray, samples: int = 1000, level: float = 0.9, seed: int = 42) -> tuple[float, float]:
    """Bootstrap interval of the mean of returns."""
    rng = np.random.default_rng(seed)
    means = returns[rng.integers(0, len(returns), (samples, len(returns)))].mean(1)
    return tuple(np.quantile(means, [(1 - level) / 2, (1 + level) / 2]))
