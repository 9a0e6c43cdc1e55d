"""Attributes as known at event time: validity intervals, time buckets, equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import salted_join

#: Day number past every real date: the open end of an interval.
OPEN = 1 << 20


def day_number(c: Column) -> Column:
    """Days since 1970-01-01 of a date or timestamp."""
    return F.unix_date(c.cast("date")).cast("int")


def parse_day(c: Column) -> Column:
    """The day of a text date in any of the usual forms; null where it isn't a real date.

    Read: YYYYMMDD, YYYY-MM-DD, YYYY/MM/DD, YYYY.MM.DD (one or two digits of month and
    day where separated), each also followed by a time of day, which is ignored; and
    YYYYQn, the last day of the quarter. Anything else, and impossible days, give null.
    """
    t = F.trim(c.cast("string"))
    y, m, d = (F.regexp_extract(t, r"^(\d{4})([-/.]?)(\d{1,2})\2(\d{1,2})(?:[T ].*)?$", i) for i in (1, 3, 4))
    ok = t.rlike(r"^(\d{8}|\d{4}([-/.])\d{1,2}\2\d{1,2})([T ].*)?$")
    day = F.when(ok, F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))
    q = F.regexp_extract(t, r"^(\d{4})[Qq]([1-4])$", 1)
    qn = F.regexp_extract(t, r"^(\d{4})[Qq]([1-4])$", 2)
    quarter = F.when(q != "", F.last_day(F.try_to_date(F.concat_ws("-", q, F.lpad((qn.try_cast("int") * 3).cast("string"), 2, "0"), F.lit("01")), "yyyy-MM-dd")))
    return F.coalesce(day, quarter)


def validity_intervals(changes: DataFrame, entity: Sequence[str], at: str, rank: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Half-open intervals [valid_from, valid_to) of the record in force per entity.

    `changes` are records known from day `at` on. In force on a day is, of the records
    known by then, the greatest by `rank`. Successive change times bound the intervals;
    the last is open (valid_to = OPEN). Records that never come into force give no
    interval. Rows with a null entity or `at` are left out; repeated rows are folded by a
    partial aggregate before the window, whose group is therefore one entity's distinct
    (day, rank) pairs, not its rows. Equal rank and day: greatest `keep` values.
    """
    c = changes.where(" and ".join(f"`{k}` is not null" for k in [*entity, at]))
    best = F.max(F.struct(*rank, *keep)).alias("_best")
    daily = c.groupBy(*entity, at).agg(best)
    by = Window.partitionBy(*entity).orderBy(at)
    state = daily.withColumn("_best", F.max("_best").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    state = state.withColumn("_before", F.lag("_best").over(by)).where(F.col("_before").isNull() | (F.col("_before") != F.col("_best")))
    out = state.withColumn("valid_to", F.coalesce(F.lead(at).over(by), F.lit(OPEN)))
    return out.select(*entity, F.col(at).alias("valid_from"), "valid_to", *(F.col(f"_best.{x}").alias(x) for x in [*rank, *keep]))


def interval_join(events: DataFrame, intervals: DataFrame, entity: Sequence[str], start: str, end: str, event_id: str, bucket_days: int = 366, share: float = 0.01, salts: int | None = None) -> DataFrame:
    """Events joined with every interval of their entity that overlaps [start, end].

    Both sides are exploded into buckets of `bucket_days` days and equi-joined on entity
    and bucket, then checked with half-open containment; a pair is reported only in the
    bucket in which its overlap begins, so it comes out once. A point event has
    start = end. Open intervals reach to the bucket of the latest event day (one
    aggregate). Buckets that hold a large share of the events are salted. Events with a
    null entity, start or end, or start > end, match nothing (inner join).
    """
    n = F.lit(bucket_days)
    bucket = lambda c: F.floor(c / n).cast("int")
    ev = events.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    span = events.agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    iv = intervals.crossJoin(F.broadcast(span)).withColumn("_from", F.greatest("valid_from", "_lo")).withColumn("_last", F.least(F.col("valid_to") - 1, F.col("_hi")))
    iv = iv.where(F.col("_from") <= F.col("_last")).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_last"))))).drop("_lo", "_hi", "_from", "_last")
    j = salted_join(ev, iv, [*entity, "_bucket"], event_id, "inner", share, salts)
    begins = F.greatest(F.col(start), F.col("valid_from"))
    return j.where((begins <= F.col(end)) & (begins < F.col("valid_to")) & (bucket(begins) == F.col("_bucket"))).drop("_bucket")
