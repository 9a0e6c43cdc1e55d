"""Rebalance schedules from a trading calendar, by rule text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The names of weekdays, Monday first.
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
RULE = re.compile(r"(\d*)(D|W|MS|ME|QS|QE|YS|YE)(?:-([A-Z]{3}))?\Z")


def parse_rule(rule: str) -> tuple[int, str, str | None]:
    """(every, unit, anchor) of a rule such as D, 2W-WED, ME, 3MS, QE or YS; ValueError for anything else."""
    m = RULE.match(rule.strip().upper())
    if not m or (m[3] and (m[2] != "W" or m[3] not in WEEKDAYS)) or m[1] == "0":
        raise ValueError(f"no schedule rule: {rule}")
    return int(m[1] or 1), m[2], m[3]


def _bucket(day: Column, unit: str, anchor: str | None) -> Column:
    """Number of the period a day is in; consecutive periods have consecutive numbers."""
    if unit == "W":
        # weeks end on the anchor; 1970-01-01 was a Thursday
        end = WEEKDAYS.index(anchor or "FRI")
        return F.floor((F.unix_date(day) + 3 + 6 - end) / 7)
    if unit[0] == "M":
        return F.year(day) * 12 + F.month(day)
    if unit[0] == "Q":
        return F.year(day) * 4 + F.quarter(day)
    return F.year(day)


def rebalance_dates(sessions: DataFrame, rule: str, exchange: str = "exchange", day: str = "day") -> DataFrame:
    """The sessions on which a rule rebalances, per exchange: first or last session of every n-th period.

    D takes every n-th session; W, ME, QE and YE the last session of a period, MS, QS and YS
    the first. Periods without a session have none. `sessions` holds open days only; it is
    bounded by the calendar, so windows over an exchange are small.
    """
    every, unit, anchor = parse_rule(rule)
    if unit == "D":
        t = sessions.select(exchange, day).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(exchange).orderBy(day)) - 1)
        return t.where(F.col("_k") % every == 0).select(exchange, day)
    pick = F.min if unit in ("MS", "QS", "YS") else F.max
    per = sessions.groupBy(exchange, _bucket(F.col(day), unit, anchor).alias("_b")).agg(pick(day).alias(day))
    first = Window.partitionBy(exchange).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.withColumn("_first", F.min("_b").over(first)).where((F.col("_b") - F.col("_first")) % every == 0).select(exchange, day)
