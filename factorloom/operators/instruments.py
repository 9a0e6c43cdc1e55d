"""Currency conversion and continuous series of expiring contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import asof_join


def convert_currency(values: DataFrame, rates: DataFrame, value: str, currency: str, date: str, out: str) -> DataFrame:
    """Adds `out`, the value times its currency's last rate at or before the date; NULL without one.

    `rates` has currency, date and rate; of one currency and time the greatest rate holds.
    """
    r = rates.select(F.col("currency").alias("_c"), F.col("date").alias("_d"), F.col("rate").alias("_rate"))
    j = asof_join(values, r, {currency: "_c"}, (date, "_d"), ["_rate"])
    return j.withColumn(out, F.col(value) * F.col("_rate")).drop("_rate")


def continuous_series(prices: DataFrame, contracts: DataFrame, offset_days: int = 0, adjust: bool = True) -> DataFrame:
    """One price per root and day from expiring contracts: that of the contract in front.

    `prices` (root, contract, day, close), `contracts` (root, contract, last_day). In front is
    the contract of the earliest last_day at least offset_days after the day. adjust: prices
    before a roll are scaled by the ratio of the new to the old contract's close on the last
    day the old one is in front (1 where either is missing).
    Columns: root, day, contract, close, adjusted.
    """
    p = prices.dropna(subset=["root", "contract", "day"]).select("root", "contract", F.col("day").cast("date").alias("day"), "close")
    days = p.select("root", "day").distinct().withColumn("_from", F.date_add("day", offset_days))
    c = contracts.select(F.col("root").alias("_root"), F.col("last_day").cast("date").alias("_last"), "contract")
    front = asof_join(days, c, {"root": "_root"}, ("_from", "_last"), ["contract"], direction="forward").where(F.col("contract").isNotNull())
    s = front.select("root", "day", "contract").join(p, ["root", "day", "contract"], "left")
    along = Window.partitionBy("root").orderBy("day")
    s = s.withColumn("_next", F.lead("contract").over(along))
    other = p.select("root", "day", F.col("contract").alias("_next"), F.col("close").alias("_nc"))
    s = s.join(other, ["root", "day", "_next"], "left")
    rolls = (F.col("_next") != F.col("contract")) & (F.col("close") > 0) & (F.col("_nc") > 0)
    s = s.withColumn("_step", F.when(rolls, F.ln(F.col("_nc") / F.col("close"))).otherwise(0.0) if adjust else F.lit(0.0))
    backward = Window.partitionBy("root").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    scale = F.exp(F.sum("_step").over(backward))
    return s.withColumn("adjusted", F.col("close") * scale).select("root", "day", "contract", "close", "adjusted")
