"""Quarterly estimates and events as known at each date: the next or previous quarters, adjusted for splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import interval_join, validity_intervals
from .tables import asof_join


def quarter_number(year: F.Column, quarter: F.Column) -> F.Column:
    """Quarters numbered through: year * 4 + quarter - 1."""
    return (year * 4 + quarter - 1).cast("int")


def split_quarter(number: F.Column) -> tuple[F.Column, F.Column]:
    """Year and quarter (1 to 4) of a quarter number."""
    return F.floor(number / 4).cast("int"), (F.pmod(number, F.lit(4)) + 1).cast("int")


def quarters_as_of(dates: DataFrame, estimates: DataFrame, sid: str, day: str, known: str, quarter: str, event: str, values: Sequence[str], offsets: Sequence[int] = (1,), forward: bool = True, splits: DataFrame | None = None, adjusted: Sequence[str] = ()) -> DataFrame:
    """Per sid and day, for each offset k, the estimates known that day of the k-th next (or previous) quarter.

    `dates` has sid and `day` (day numbers), `estimates` a row per sid, quarter number and day
    it became `known`, with the day of the quarter's `event` and the values. The next quarter
    is the earliest whose event, as then known, lies on or after the day; the previous the
    latest before it; the k-th is k - 1 quarters further. Of a quarter the version known
    last holds. Quarters not yet known give nulls; dates without a known one of that kind
    have nulls in all. splits (sid, day, ratio): `adjusted` values are multiplied by the
    ratios of the days after they were known, up to the date.

    Versions become half-open intervals, joined to the dates by sid and time bucket, so a
    date meets the quarters known that day, not their histories. Columns: sid, day, and per
    offset q<k> and <value>_<k>.
    """
    days = dates.where(F.col(sid).isNotNull() & F.col(day).isNotNull()).select(sid, day).distinct().withColumn("_id", F.xxhash64(sid, day))
    held = validity_intervals(estimates.where(F.col(quarter).isNotNull() & F.col(event).isNotNull()).withColumn("_known", F.col(known)), [sid, quarter], known, ["_known"], [event, *values])
    j = interval_join(days.withColumn("_to", F.col(day)), held, [sid], day, "_to", "_id")
    if splits is not None and adjusted:
        factor = split_factor(j, splits, sid, "_known", day)
        j = factor.withColumns({v: F.col(v) * F.col("_factor") for v in adjusted}).drop("_factor")
    mine = Window.partitionBy(sid, day)
    side = F.col(event) >= F.col(day) if forward else F.col(event) < F.col(day)
    near = F.min_by(quarter, F.when(side, F.struct(event, quarter))).over(mine) if forward else F.max_by(quarter, F.when(side, F.struct(event, quarter))).over(mine)
    j = j.withColumn("_near", near)
    sign = 1 if forward else -1
    at = lambda k: F.col(quarter) == F.col("_near") + sign * (k - 1)
    aggs = [F.first("_near", ignorenulls=True).alias("_near")] + [F.max(F.when(at(k), F.col(v))).alias(f"{v}_{k}") for k in offsets for v in values]
    got = j.groupBy(sid, day).agg(*aggs)
    cols = [c for k in offsets for c in ((F.col("_near") + sign * (k - 1)).alias(f"q{k}"), *[F.col(f"{v}_{k}") for v in values])]
    return days.drop("_id").join(got, [sid, day], "left").select(sid, day, *cols)


def split_factor(rows: DataFrame, splits: DataFrame, sid: str, since: str, until: str) -> DataFrame:
    """Adds _factor: the product of a sid's split ratios on days after `since` up to `until` (1 without any).

    Ratios are summed as logarithms once per sid; both days look their running sum up as-of.
    """
    s = splits.where((F.col("ratio") > 0) & F.col(sid).isNotNull()).groupBy(sid, "day").agg(F.sum(F.ln("ratio")).alias("_l"))
    s = s.withColumn("_run", F.sum("_l").over(Window.partitionBy(sid).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    stamp = lambda c: F.timestamp_seconds(F.col(c).cast("long") * 86_400)
    right = s.select(sid, stamp("day").alias("_at"), "_run")
    out = rows
    for c, name in ((since, "_before"), (until, "_after")):
        out = asof_join(out.withColumn("_when", stamp(c)), right, {sid: sid}, ("_when", "_at"), ["_run"], block_days=3660).withColumnRenamed("_run", name).drop("_when")
    factor = F.exp(F.coalesce("_after", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0)))
    return out.withColumn("_factor", factor).drop("_before", "_after")


def events_as_of(dates: DataFrame, events: DataFrame, sid: str, day: str, known: str, event: str, values: Sequence[str], forward: bool) -> DataFrame:
    """Per sid and day the values of the next (or previous) event among those known that day.

    An event counts from the later of the day it became known and, for the previous one, the
    event itself. Of events on one day the greatest values hold.
    """
    days = dates.where(F.col(sid).isNotNull() & F.col(day).isNotNull()).select(sid, day).distinct()
    e = events.where(F.col(sid).isNotNull() & F.col(known).isNotNull() & F.col(event).isNotNull()).select(sid, known, event, *values)
    if not forward:
        # by the order in which they count; the latest event of those wins
        counts = validity_intervals(e.withColumn("_counts", F.greatest(known, event)).withColumn("_event", F.col(event)), [sid], "_counts", ["_event"], values)
        j = interval_join(days.withColumn("_to", F.col(day)).withColumn("_id", F.xxhash64(sid, day)), counts, [sid], day, "_to", "_id").select(sid, day, F.col("_event").alias(event), *values)
        return days.join(j, [sid, day], "left")
    # an announced event is next from the day it is known through its own day
    spans = e.where(F.col(event) >= F.col(known)).withColumn("valid_from", F.col(known)).withColumn("valid_to", F.col(event) + 1)
    j = interval_join(days.withColumn("_to", F.col(day)).withColumn("_id", F.xxhash64(sid, day)), spans, [sid], day, "_to", "_id")
    first = j.groupBy(sid, day).agg(F.min_by(F.struct(event, *values), F.struct(F.col(event), *[F.col(v) for v in values])).alias("_e"))
    return days.join(first, [sid, day], "left").select(sid, day, f"_e.{event}", *[f"_e.{v}" for v in values])
