"""Panels: one row per ticker and date, dense over dates, missing values as NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import latest_version


def nulled(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """NaN and infinities of the fields as NULL."""
    return df.withColumns({f: F.when(~F.isnan(f) & (F.abs(F.col(f)) != F.lit(float("inf"))), F.col(f)) for f in fields})


def densify(df: DataFrame, ticker: str, date: str) -> DataFrame:
    """Adds the rows of every ticker for every date that any ticker has.

    The dates are collected into one array (bounded by the calendar, not by the rows) and
    exploded per ticker; the rows are joined to it. Rows of null keys are left out.
    """
    known = df.where(F.col(ticker).isNotNull() & F.col(date).isNotNull())
    dates = known.agg(F.sort_array(F.collect_set(date)).alias("_dates"))
    grid = known.select(ticker).distinct().crossJoin(F.broadcast(dates)).select(ticker, F.explode("_dates").alias(date))
    return grid.join(known, [ticker, date], "left")


def daily_panel(prices: DataFrame, fields: Sequence[str] = ("open", "high", "low", "close", "volume", "amount", "pct_chg")) -> DataFrame:
    """The dense panel of the version of each daily record that holds."""
    days = prices.where(F.col("ticker").isNotNull() & F.col("trade_date").isNotNull()).withColumn("trade_date", F.col("trade_date").cast("date"))
    return densify(nulled(latest_version(days, ["ticker", "trade_date"], "created_at", fields), fields), "ticker", "trade_date")
