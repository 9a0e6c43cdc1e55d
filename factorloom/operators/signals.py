"""Boolean signals along each ticker's rows: cleaning, ranks, generation, ranges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.panel_ops import Keys


def _on(c: str) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


def clean_signals(df: DataFrame, entry: str, exit_: str, keys: Keys = Keys(), entry_first: bool = True) -> DataFrame:
    """The signals with only those kept that alternate: the first of each run of one side; rows with both sides drop both.

    entry_first: an exit before the first entry is dropped.
    """
    side = F.when(_on(entry) & ~_on(exit_), 1).when(_on(exit_) & ~_on(entry), -1)
    t = df.withColumn("_s", side)
    before = F.last("_s", ignorenulls=True).over(keys.along.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_before", F.coalesce(before, F.lit(-1 if entry_first else 0)))
    keep = F.coalesce(F.col("_s") != F.col("_before"), F.lit(False))
    return t.withColumns({entry: keep & (F.col("_s") == 1), exit_: keep & (F.col("_s") == -1)}).withColumns({entry: _on(entry), exit_: _on(exit_)}).drop("_s", "_before")


def signal_ranks(df: DataFrame, flag: str, keys: Keys = Keys(), reset: str | None = None) -> DataFrame:
    """Adds pos_rank (0, 1, ... within each run of set signals, since the last `reset` signal) and partition_rank (number of the run from 0); -1 where not set."""
    on = _on(flag)
    t = df.withColumn("_on", on.cast("int")).withColumn("_begin", (on & ~F.coalesce(F.lag(on).over(keys.along), F.lit(False))).cast("int"))
    if reset:
        # the row of a reset itself counts for the period before it
        t = t.withColumn("_era", F.coalesce(F.sum(_on(reset).cast("int")).over(keys.along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        t = t.withColumn("_begin", (F.col("_on") == 1).cast("int") * F.greatest(F.col("_begin"), (F.col("_era") != F.coalesce(F.lag("_era").over(keys.along), F.lit(0))).cast("int")))
    else:
        t = t.withColumn("_era", F.lit(0))
    t = t.withColumn("_run", F.sum("_begin").over(keys.past))
    inside = Window.partitionBy(keys.ticker, "_run").orderBy(keys.date).rowsBetween(Window.unboundedPreceding, 0)
    eras = Window.partitionBy(keys.ticker, "_era").orderBy(keys.date).rowsBetween(Window.unboundedPreceding, 0)
    set_ = F.col("_on") == 1
    t = t.withColumns({"pos_rank": F.when(set_, F.sum("_on").over(inside) - 1).otherwise(-1).cast("int"), "partition_rank": F.when(set_, F.sum("_begin").over(eras) - 1).otherwise(-1).cast("int")})
    return t.drop("_on", "_begin", "_era", "_run")


def random_signals(df: DataFrame, name: str, keys: Keys = Keys(), share: float | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """Adds a flag set at random by a hash of the key and seed: on a share of rows, or on n rows of each ticker.

    The choice doesn't depend on partitions or order of rows.
    """
    h = F.xxhash64(F.lit(seed), F.col(keys.ticker), F.col(keys.date))
    if n is None:
        # 53 bits of the hash as a number in [0, 1)
        return df.withColumn(name, F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) < F.lit(share))
    r = F.row_number().over(Window.partitionBy(keys.ticker).orderBy(h, keys.date))
    return df.withColumn(name, r <= n)


def delayed_exits(df: DataFrame, entry: str, name: str, wait: int, keys: Keys = Keys()) -> DataFrame:
    """Adds a flag `wait` rows after each entry."""
    return df.withColumn(name, F.coalesce(F.lag(_on(entry), wait).over(keys.along), F.lit(False)))


def first_exits(df: DataFrame, entry: str, condition: str, name: str, keys: Keys = Keys(), wait: int = 1) -> DataFrame:
    """Adds a flag on the first row, at least `wait` rows after each entry and before the next one, where the condition holds."""
    t = df.withColumns({"_i": F.row_number().over(keys.along), "_g": F.coalesce(F.sum(_on(entry).cast("int")).over(keys.past), F.lit(0))})
    g = Window.partitionBy(keys.ticker, "_g").orderBy(keys.date)
    t = t.withColumn("_at", F.first("_i").over(g))
    ok = (F.col("_g") > 0) & (F.col("_i") >= F.col("_at") + wait) & _on(condition)
    t = t.withColumn("_ok", ok.cast("int"))
    return t.withColumn(name, (F.col("_ok") == 1) & (F.sum("_ok").over(g.rowsBetween(Window.unboundedPreceding, 0)) == 1)).drop("_i", "_g", "_at", "_ok")


def ranges_between(df: DataFrame, begin: str, end: str | None = None, keys: Keys = Keys()) -> DataFrame:
    """From each `begin` signal to the next `end` signal after it (the next `begin`, without `end`): ticker, start_day, end_day (null if open), rows."""
    t = df.withColumn("_i", F.row_number().over(keys.along))
    mark = _on(end) if end else _on(begin)
    following = Window.partitionBy(keys.ticker).orderBy(F.col(keys.date).desc()).rowsBetween(Window.unboundedPreceding, -1)
    # carried backwards in the reverse order: a frame to the end is scanned anew for every row
    t = t.withColumn("_next", F.last(F.when(mark, F.struct(F.col(keys.date).alias("d"), F.col("_i").alias("i"))), ignorenulls=True).over(following))
    return t.where(_on(begin)).select(keys.ticker, F.col(keys.date).alias("start_day"), F.col("_next.d").alias("end_day"), (F.col("_next.i") - F.col("_i")).cast("int").alias("rows"))


def partition_ranges(df: DataFrame, flag: str, keys: Keys = Keys()) -> DataFrame:
    """Runs of set signals: ticker, start_day, end_day, rows, is_open (the run reaches the ticker's last row)."""
    t = df.withColumn("_i", F.row_number().over(keys.along)).withColumn("_last", F.count(F.lit(1)).over(Window.partitionBy(keys.ticker)))
    t = t.where(_on(flag)).withColumn("_g", F.col("_i") - F.row_number().over(keys.along))
    return t.groupBy(keys.ticker, "_g").agg(F.min(keys.date).alias("start_day"), F.max(keys.date).alias("end_day"), F.count(F.lit(1)).cast("int").alias("rows"), (F.max("_i") == F.first("_last")).alias("is_open")).drop("_g")


def range_coverage(ranges: DataFrame, totals: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Share of a ticker's rows that its ranges cover (ranges that don't overlap). totals: ticker, n."""
    covered = ranges.groupBy(keys.ticker).agg(F.sum("rows").alias("_c"))
    return totals.join(covered, keys.ticker, "left").select(keys.ticker, (F.coalesce("_c", F.lit(0)) / F.col("n")).alias("coverage"))


def ranges_to_mask(df: DataFrame, ranges: DataFrame, name: str, keys: Keys = Keys()) -> DataFrame:
    """Adds a flag on the rows from a range's start_day to its end_day, both in (to the ticker's end, if open)."""
    marks = ranges.select(keys.ticker, F.col("start_day").alias(keys.date), F.lit(1).alias("_d")).groupBy(keys.ticker, keys.date).agg(F.sum("_d").alias("_in"))
    outs = ranges.where("end_day is not null").groupBy(keys.ticker, F.col("end_day").alias(keys.date)).agg(F.count(F.lit(1)).alias("_out"))
    t = df.join(marks, [keys.ticker, keys.date], "left").join(outs, [keys.ticker, keys.date], "left")
    begun = F.sum(F.coalesce("_in", F.lit(0))).over(keys.past)
    ended = F.sum(F.coalesce("_out", F.lit(0))).over(keys.along.rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn(name, begun > F.coalesce(ended, F.lit(0))).drop("_in", "_out")


def crossed(df: DataFrame, x: str, y: str, name: str, keys: Keys = Keys(), wait: int = 0) -> DataFrame:
    """Adds a flag on the (wait + 1)-th row of a run of x > y that began after a row of x < y (rows of equal values in between don't end it)."""
    above, below = F.coalesce(F.col(x) > F.col(y), F.lit(False)), F.coalesce(F.col(x) < F.col(y), F.lit(False))
    t = df.withColumns({"_a": above.cast("int"), "_b": below.cast("int"), "_u": (F.col(x).isNull() | F.col(y).isNull()).cast("int")})
    # a run ends with every row that isn't above; the side before it is that of the last row that was above or below
    t = t.withColumn("_run", F.sum(1 - F.col("_a")).over(keys.past))
    side = F.last(F.when(F.col("_u") == 1, 0).when(F.col("_a") == 1, 1).when(F.col("_b") == 1, -1), ignorenulls=True).over(keys.along.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_side", side)
    run = Window.partitionBy(keys.ticker, "_run").orderBy(keys.date).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"_k": F.sum("_a").over(run), "_from": F.first(F.when(F.col("_a") == 1, F.col("_side")), ignorenulls=True).over(run)})
    return t.withColumn(name, (F.col("_a") == 1) & (F.col("_k") == wait + 1) & F.coalesce(F.col("_from") == -1, F.lit(False))).drop("_a", "_b", "_u", "_run", "_side", "_k", "_from")
