"""Bars remade: sessions kept or filled, calendar days added, ticks counted into bars, bars split, ratios of corporate actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import asof_join


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(ts: Column, sessions: Sequence[tuple[str, str]]) -> Column:
    """Whether a time of day lies in one of the sessions (HH:MM, both ends in)."""
    at = lambda s: int(s[:2]) * 60 + int(s[3:])
    m = minute_of_day(ts)
    hit = F.lit(False)
    for a, b in sessions:
        hit = hit | m.between(at(a), at(b))
    return hit


def session_grid(days: DataFrame, day: str, sessions: Sequence[tuple[str, str]], minutes: int, name: str = "bar_time") -> DataFrame:
    """Adds the bar times of each day: every `minutes` after a session's start up to its end, named by their ends."""
    at = lambda s: int(s[:2]) * 60 + int(s[3:])
    ends = sorted({m for a, b in sessions for m in range(at(a) + minutes, at(b) + 1, minutes)})
    start = F.col(day).cast("timestamp")
    return days.withColumn("_m", F.explode(F.array(*[F.lit(m) for m in ends]))).withColumn(name, F.timestamp_seconds(F.unix_seconds(start) + F.col("_m") * 60)).drop("_m")


def fill_session(bars: DataFrame, key: str, ts: str, sessions: Sequence[tuple[str, str]], minutes: int, prices: Sequence[str], close: str, sums: Sequence[str] = ()) -> DataFrame:
    """Bars with one for every bar time of the sessions on each key's days: missing ones hold the last close and no volume, and filled = true.

    A day's bars before its first own one stay missing until a close is known that day.
    """
    day = F.col(ts).cast("date")
    grid = session_grid(bars.where(F.col(key).isNotNull()).select(key, day.alias("_day")).distinct(), "_day", sessions, minutes, ts)
    t = grid.join(bars, [key, ts], "left")
    along = Window.partitionBy(key, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("filled", F.col(close).isNull()).withColumn("_c", F.last(close, ignorenulls=True).over(along))
    t = t.where(F.col("_c").isNotNull())
    return t.withColumns({**{p: F.coalesce(p, "_c") for p in prices}, **{s: F.coalesce(s, F.lit(0).cast(bars.schema[s].dataType)) for s in sums}}).drop("_c", "_day")


def calendar_days(bars: DataFrame, key: str, date: str, prices: Sequence[str], close: str, sums: Sequence[str] = ()) -> DataFrame:
    """Daily bars with one for every calendar day from a key's first to last: the added ones hold the last close and no volume."""
    span = bars.groupBy(key).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    grid = span.select(key, F.explode(F.sequence("_a", "_b")).alias(date))
    t = grid.join(bars, [key, date], "left")
    along = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_c", F.last(close, ignorenulls=True).over(along))
    return t.withColumns({**{p: F.coalesce(p, "_c") for p in prices}, **{s: F.coalesce(s, F.lit(0).cast(bars.schema[s].dataType)) for s in sums}}).drop("_c")


def count_bars(ticks: DataFrame, key: str, ts: str, tie: str, value: str, n: int) -> DataFrame:
    """Bars of n ticks each per key, in order of time; the last may hold fewer. A key's ticks are numbered by a window."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(ts, tie)) - 1
    return _fold(ticks.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("bar_no", F.floor(i / n).cast("int")), key, ts, tie, value)


def volume_bars(ticks: DataFrame, key: str, ts: str, tie: str, value: str, volume: str, size: float) -> DataFrame:
    """Bars that end with the tick whose running volume passes the next multiple of size."""
    before = F.coalesce(F.sum(volume).over(Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _fold(ticks.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("bar_no", F.floor(before / size).cast("int")), key, ts, tie, value)


def _fold(t: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    order = F.struct(ts, tie)
    return t.groupBy(key, "bar_no").agg(F.min(ts).alias("first_time"), F.max(ts).alias("last_time"), F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(F.lit(1)).alias("ticks"))


def split_bars(bars: DataFrame, keys: Sequence[str], open_: str, high: str, low: str, close: str, volume: str) -> DataFrame:
    """Each bar as two steps: the opening (step 0: the open alone, no volume) and the whole bar (step 1)."""
    opening = F.struct(F.lit(0).alias("step"), F.col(open_).alias("open"), F.col(open_).alias("high"), F.col(open_).alias("low"), F.col(open_).alias("close"), F.lit(0.0).alias("volume"))
    whole = F.struct(F.lit(1).alias("step"), F.col(open_).alias("open"), F.col(high).alias("high"), F.col(low).alias("low"), F.col(close).alias("close"), F.col(volume).cast("double").alias("volume"))
    return bars.select(*keys, F.explode(F.array(opening, whole)).alias("_s")).select(*keys, "_s.*")


def dividend_ratios(dividends: DataFrame, prices: DataFrame, key: str, ex_date: str, amount: str, date: str, close: str) -> DataFrame:
    """Per key and ex-date the ratio 1 - amount / close of the last session before it; amounts of one day are summed.

    Without a positive close before, or where the ratio isn't positive, there is none.
    """
    d = dividends.where(F.col(key).isNotNull() & F.col(ex_date).isNotNull()).groupBy(key, F.col(ex_date).alias("_ex")).agg(F.sum(amount).alias("_a"))
    p = prices.where(F.col(close) > 0).select(key, F.col(date).alias("_d"), F.col(close).alias("_p"))
    both = d.select(key, F.col("_ex").alias("_d"), F.lit(0).alias("_side"), "_a", F.lit(None).cast("double").alias("_p")).unionByName(p.select(key, "_d", F.lit(1).alias("_side"), F.lit(None).cast(d.schema["_a"].dataType).alias("_a"), F.col("_p").cast("double")))
    # an ex-date sorts before its own session, so the close carried to it is that of the session before
    w = Window.partitionBy(key).orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, -1)
    t = both.withColumn("_before", F.last("_p", ignorenulls=True).over(w)).where("_side = 0")
    ratio = 1 - F.col("_a") / F.col("_before")
    return t.where(ratio > 0).select(key, F.col("_d").alias("ex_date"), ratio.alias("ratio"))


def apply_ratios(prices: DataFrame, ratios: DataFrame, key: str, date: str, columns: Sequence[str], divide: Sequence[str] = ()) -> DataFrame:
    """Prices multiplied (volumes in `divide` divided) by the ratios of all later ex-dates, as seen from the last date."""
    r = ratios.groupBy(key, F.col("ex_date").alias(date)).agg(F.sum(F.ln("ratio")).alias("_l"))
    j = prices.join(r, [key, date], "full")
    later = Window.partitionBy(key).orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("_f", F.exp(F.coalesce(F.sum(F.coalesce("_l", F.lit(0.0))).over(later), F.lit(0.0))))
    marked = prices.select(key, date).distinct().withColumn("_own", F.lit(1))
    j = j.join(marked, [key, date], "left_semi")
    return j.withColumns({**{c: F.col(c) * F.col("_f") for c in columns}, **{c: F.col(c) / F.col("_f") for c in divide}}).drop("_l", "_f")


def restricted(rows: DataFrame, restrictions: DataFrame, key: str, ts: str) -> DataFrame:
    """Adds is_restricted: whether the state set last at or before the row's time is a restriction (none set: not restricted).

    restrictions: key, effective (timestamp), frozen (boolean).
    """
    j = asof_join(rows, restrictions.select(F.col(key).alias("_k"), F.col("effective").alias("_e"), F.col("frozen").alias("_frozen")), {key: "_k"}, (ts, "_e"), ["_frozen"])
    return j.withColumn("is_restricted", F.coalesce("_frozen", F.lit(False))).drop("_frozen")
