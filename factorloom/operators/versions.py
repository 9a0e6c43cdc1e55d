"""The version of a record that holds: one row per key, the latest by a version column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_version(df: DataFrame, keys: Sequence[str], version: str, values: Sequence[str | Column]) -> DataFrame:
    """One row per key with the values of the row of the latest version.

    A partial aggregate before the shuffle folds repeated rows, so a key that is
    sent again very often never gathers in one task. A null version counts as the
    oldest; equal versions with different values resolve to the greatest values in
    column order (null least, NaN greatest), so the result is deterministic. The
    latest version holds even if its values are null. Columns not named are pruned.
    """
    cols = [F.col(v) if isinstance(v, str) else v for v in values]
    best = F.max(F.struct(F.col(version).alias("_version"), *cols)).alias("_held")
    return df.groupBy(*keys).agg(best).select(*keys, "_held.*").drop("_version")
