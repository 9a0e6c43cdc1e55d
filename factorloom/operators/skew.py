"""Joins that stay balanced when a few keys hold much of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Keys holding more than `share` of all rows, and _salts, how many times that share: at most 1/share rows by construction."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg((F.count(F.lit(1)) * F.lit(share)).alias("_limit"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") > F.col("_limit")).select(*keys, F.ceil(F.col("_n") / F.col("_limit")).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: str, how: str = "inner", share: float = 0.01, salts: int | None = None) -> DataFrame:
    """Equi-join in which the left rows of a heavy key are spread over several tasks.

    A key of k times `share` of the left rows gets k salts (or `salts`, if given), so that no
    task holds much more than that share. The right rows of heavy keys are repeated once per
    salt, all others go once. The heavy keys are at most 1/share, which bounds what is
    broadcast. `spread` is a left column whose hash chooses the salt. how: inner or left.
    Null keys never match.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    heavy = heavy_keys(left.select(*on), on, share)
    hot = F.broadcast(heavy.withColumn("_salts", F.lit(salts)) if salts else heavy)
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")
    a = left.join(hot, list(on), "left").withColumn("_salt", salt).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    b = right.join(hot, list(on), "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return a.join(b, [*on, "_salt"], how).drop("_salt")
