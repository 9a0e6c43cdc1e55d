"""Train and test periods over the dates of a table: ranges, rolling, expanding and walk-forward splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panel_ops import Keys
from .analytics import date_index

Range = tuple[int, int, int, int]


def _sets(split: int, first: int, last: int, lengths: Sequence[float | int | None], from_left: bool = True) -> list[Range]:
    """(split, set, first, last) of a range cut into sets: lengths below 1 are shares, others rows, one may be None (the rest)."""
    total = last - first + 1
    sizes: list[int | None] = [None if x is None else int(math.floor(x * total)) if 0 < x < 1 else int(x) for x in lengths]
    rest = total - sum(s for s in sizes if s is not None)
    if sizes.count(None) > 1 or rest < 0:
        raise ValueError("the sets don't fit the range")
    if None in sizes:
        sizes[sizes.index(None)] = rest
    at = first if from_left else last - sum(sizes) + 1
    out = []
    for k, s in enumerate(sizes):
        if s < 1:
            raise ValueError("a set is empty")
        out.append((split, k, at, at + s - 1))
        at += s
    return out


def rolling_ranges(rows: int, window: int, step: int | None = None, n: int | None = None, sets: Sequence[float | int | None] = (None,)) -> list[Range]:
    """Windows of equal length, `step` rows apart, or n of them spread evenly over the rows."""
    if window > rows:
        raise ValueError("the window is longer than the table")
    last = rows - window
    starts = [round(i * last / max(n - 1, 1)) for i in range(n)] if n else list(range(0, last + 1, step or 1))
    return [r for i, s in enumerate(starts) for r in _sets(i, s, s + window - 1, sets)]


def expanding_ranges(rows: int, least: int = 1, n: int | None = None, step: int = 1, sets: Sequence[float | int | None] = (None,)) -> list[Range]:
    """Windows from the first row on, growing from `least` rows, by `step` or to n ends spread evenly; sets are cut from the right."""
    ends = [round(least - 1 + i * (rows - least) / max(n - 1, 1)) for i in range(n)] if n else list(range(least - 1, rows, step))
    return [r for i, e in enumerate(ends) for r in _sets(i, 0, e, sets)]


def walk_forward_ranges(rows: int, windows: int, train: float = 0.5, gap: int = 0) -> list[Range]:
    """`windows` consecutive windows, the last ending with the last row, each of a train and a test set `gap` rows apart.

    Test sets follow each other without overlap; a train set is train / (1 - train) times as long
    as its test set. Set 0 is train (missing if train is 0), set 1 test.
    """
    if not 0 <= train < 1 or windows < 1:
        raise ValueError("train must be in [0, 1) and windows at least 1")
    ratio = train / (1 - train)
    test = int((rows - gap) / (windows + ratio))
    learn = int(test * ratio)
    if test < 1:
        raise ValueError("too few rows")
    out = []
    for i in range(windows):
        end = rows - 1 - (windows - 1 - i) * test
        begin = end - test + 1
        if learn:
            out.append((i, 0, max(begin - gap - learn, 0), begin - gap - 1))
        out.append((i, 1, begin, end))
    return out


def split_dates(df: DataFrame, ranges: Sequence[Range], keys: Keys = Keys()) -> DataFrame:
    """split, set_no and date of every date of each range; join it by date to cut a table.

    The dates are numbered once (bounded by the calendar), the ranges exploded into numbers
    and equi-joined.
    """
    if not ranges:
        raise ValueError("no ranges")
    spark = df.sparkSession
    t = spark.createDataFrame([tuple(map(int, r)) for r in ranges], "split int, set_no int, _a int, _b int")
    numbered = date_index(df, keys).withColumn("_i", F.col("_i").cast("int"))
    return t.withColumn("_i", F.explode(F.sequence("_a", "_b"))).join(numbered, "_i").select("split", "set_no", keys.date)


def count_dates(df: DataFrame, keys: Keys = Keys()) -> int:
    """How many dates a table has."""
    return df.select(keys.date).distinct().count()
