"""A factor store of Parquet partitions, time-series loading, and what is missing in either."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


class FactorStore:
    """Long factor values (factor_name, ticker, trade_date, value), a Parquet partition per factor, under a folder all executors share."""

    SCHEMA = "ticker string, trade_date date, value double, factor_name string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _partition(self, name: str) -> str:
        quote = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.path}/values/factor_name={quote(name)}"

    def exists(self, name: str | None = None) -> bool:
        """Whether a factor (or any) is stored."""
        fs, folder = self._fs(self._partition(name) if name is not None else f"{self.path}/values")
        return fs.exists(folder)

    def names(self) -> list[str]:
        """The factors there are, from the folders' names."""
        fs, root = self._fs(f"{self.path}/values")
        unquote = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(unquote(n.split("=", 1)[1]) for n in found if n.startswith("factor_name="))

    def read(self, names: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """factor_name, ticker, trade_date, value of the factors (all by default), from start to end (both in); partitions and dates are pruned by the scan."""
        if not self.exists():
            return self.spark.createDataFrame([], self.SCHEMA).select("factor_name", "ticker", "trade_date", "value")
        t = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/values").select("factor_name", "ticker", "trade_date", "value")
        if names is not None:
            t = t.where(F.col("factor_name").isin(*names))
        return between(t, "trade_date", start, end)

    def upsert(self, values: DataFrame) -> None:
        """New values (factor_name, ticker, trade_date, value) replace or join the stored ones; a null keeps the stored value.

        Only the partitions of the factors in `values` are read and replaced. The merged values
        are written aside first and then take the partitions' places through Spark's committer,
        so a lost executor reruns its task and a failed job leaves what was stored. Rows of
        null keys are left out; of repeated keys the greatest value holds.
        """
        keys = ["factor_name", "ticker", "trade_date"]
        new = values.dropna(subset=keys).groupBy("factor_name", "ticker", F.col("trade_date").cast("date").alias("trade_date")).agg(F.max(F.col("value").cast("double")).alias("value"))
        if self.exists():
            old = self.read().join(new.select("factor_name").distinct(), "factor_name", "left_semi").withColumnRenamed("value", "_old")
            new = new.join(old, keys, "full").select(*keys, F.coalesce("value", "_old").alias("value"))
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        new.select("ticker", "trade_date", "value", "factor_name").write.parquet(staged)
        done = self.spark.read.schema(self.SCHEMA).parquet(staged).repartitionByRange("factor_name", "trade_date").sortWithinPartitions("factor_name", "trade_date", "ticker")
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("factor_name").parquet(f"{self.path}/values")
        fs, folder = self._fs(staged)
        fs.delete(folder, True)

    def delete(self, name: str) -> bool:
        """Remove a factor; whether it was there."""
        fs, folder = self._fs(self._partition(name))
        return fs.delete(folder, True)

    def date_ranges(self) -> DataFrame:
        """First and last date, and count, of every factor's known values."""
        return self.read().where("value is not null").groupBy("factor_name").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.count(F.lit(1)).alias("n"))


def between(df: DataFrame, date: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from start to end (YYYY-MM-DD, both in; either may be open), by a filter the scan can use."""
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    return df.where(F.col(date) < F.date_add(F.lit(end).cast("date"), 1)) if end else df


def missing_ranges(sessions: DataFrame, stored: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Per key the runs of sessions without a stored row: keys, first_day, last_day, days. What a backfill has to compute.

    Sessions are bounded by the calendar, and met by the keys' own distinct dates only.
    """
    numbered = sessions.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))
    have = stored.select(*keys, date).distinct()
    grid = have.select(*keys).distinct().crossJoin(F.broadcast(numbered))
    gaps = grid.join(have, [*keys, date], "left_anti")
    g = gaps.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(*keys).orderBy("_i")))
    return g.groupBy(*keys, "_g").agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.count(F.lit(1)).cast("int").alias("days")).drop("_g")


def next_load_days(stored: DataFrame, key: str, date: str, universe: DataFrame, first: str) -> DataFrame:
    """Per key of the universe the day from which to load: the day after its last stored one, or `first`."""
    last = stored.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(date).cast("date").alias("_last"))
    return universe.select(key).where(F.col(key).isNotNull()).distinct().join(last, key, "left").select(key, F.coalesce(F.date_add("_last", 1), F.lit(first).cast("date")).alias("load_from"))


def append_new(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of `new` to append: those whose key is not stored, one per key (the greatest), null keys left out."""
    clean = new.dropna(subset=list(keys))
    rest = [c for c in new.columns if c not in keys]
    one = clean.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else clean.distinct()
    return one.join(stored.select(*keys), list(keys), "left_anti").select(*new.columns)


def load_series(table: DataFrame, key: str, date: str, columns: Sequence[str], universe: Sequence[str] | None = None, start: str | None = None, end: str | None = None, lookback: int = 0, calendar: DataFrame | None = None, fill: bool = False) -> DataFrame:
    """key, date and columns of a universe from start to end, `lookback` sessions of the calendar earlier, exact repeats once.

    fill carries a key's last known values forward within what is loaded. The start is looked
    up in the calendar (one aggregate) so that the filter on dates reaches the scan.
    """
    if lookback and start:
        if calendar is None:
            raise ValueError("a lookback needs a calendar")
        days = calendar.where(F.col(date) < F.lit(start).cast("date")).select(date).distinct().orderBy(F.col(date).desc()).limit(lookback)
        start = days.agg(F.min(F.col(date).cast("date")).cast("string")).first()[0] or start
    t = between(table, date, start, end).select(key, date, *columns)
    if universe is not None:
        t = t.where(F.col(key).isin(*universe))
    t = t.distinct()
    if fill:
        past = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
        t = t.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})
    return t


def members_as_of(members: DataFrame, group: str, member: str, date: str, weight: str, at: str) -> DataFrame:
    """Members and weights of every group's latest composition at or before a day."""
    known = members.where(F.col(date) <= F.lit(at).cast("timestamp"))
    last = known.groupBy(group).agg(F.max(date).alias("_d"))
    return known.join(last, group).where(F.col(date) == F.col("_d")).groupBy(group, member).agg(F.max(weight).alias(weight))


def wide_table(long: DataFrame, key: str, date: str, column: str, names: Sequence[str]) -> DataFrame:
    """One column per key (the named ones), a row per date; the last of repeated values by size."""
    return long.where(F.col(key).isin(*names)).groupBy(date).pivot(key, list(names)).agg(F.max(column))


def long_table(wide: DataFrame, date: str, key: str, column: str) -> DataFrame:
    """Wide columns back to rows, missing values dropped."""
    return wide.unpivot(date, [c for c in wide.columns if c != date], key, column).where(F.col(column).isNotNull())


def condition(field: str, text: str) -> Column:
    """A Column from a text condition on a field: comparisons joined by and / or, as `> 0 and <= 30`, `!= nan`, `== nan or > 5`.

    `and` binds closer than `or`. A missing value satisfies only == nan.
    """
    c = F.col(field).cast("double")
    missing = c.isNull() | F.isnan(c)
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"

    def one(part: str) -> Column:
        m = re.fullmatch(rf"\s*(==|!=|>=|<=|>|<)\s*({number}|nan|none)\s*", part, re.IGNORECASE)
        if not m:
            raise ValueError(f"can't read the condition {part!r} on {field}")
        op, v = m[1], m[2].lower()
        if v in ("nan", "none"):
            if op not in ("==", "!="):
                raise ValueError(f"nan can only be tested with == and !=: {part!r}")
            return missing if op == "==" else ~missing
        x = F.lit(float(v))
        test = {"==": c == x, "!=": c != x, ">=": c >= x, "<=": c <= x, ">": c > x, "<": c < x}[op]
        return ~missing & F.coalesce(test, F.lit(False))

    out = None
    for alternative in re.split(r"\bor\b", text, flags=re.IGNORECASE):
        every = None
        for part in re.split(r"\band\b", alternative, flags=re.IGNORECASE):
            every = one(part) if every is None else every & one(part)
        out = every if out is None else out | every
    return out


def screen_by(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Rows that satisfy the text condition of every named field there is."""
    for field, text in conditions.items():
        if field in df.columns:
            df = df.where(condition(field, text))
    return df


def industry_series(dates: DataFrame, tickers: DataFrame, industries: DataFrame, overrides: DataFrame | None = None, missing: str = "unclassified") -> DataFrame:
    """ticker, trade_date, industry of every ticker and date: static labels, overrides before them, a default for the rest.

    The dates are bounded by the calendar and broadcast.
    """
    base = tickers.select("ticker").where("ticker is not null").distinct()
    one = lambda df, name: df.where("ticker is not null").groupBy("ticker").agg(F.min("industry").alias(name))
    t = base.join(one(industries, "_i"), "ticker", "left")
    t = t.join(one(overrides, "_o"), "ticker", "left") if overrides is not None else t.withColumn("_o", F.lit(None).cast("string"))
    return t.select("ticker", F.coalesce("_o", "_i", F.lit(missing)).alias("industry")).crossJoin(F.broadcast(dates.select("trade_date").distinct()))


def holidays_between(days: DataFrame, start: str, end: str, calendar: DataFrame, day: str, is_open: str) -> DataFrame:
    """Adds has_holiday: whether a closed weekday lies from start to end (both in). The closed days of a calendar are numbered, not crossed."""
    c = calendar.groupBy(F.col(day).cast("date").alias("_d")).agg(F.max(is_open).alias("_o"))
    closed = ((F.col("_o") == 0) & (F.weekday("_d") < 5)).cast("int")
    run = c.select("_d", F.sum(closed).over(Window.orderBy("_d")).alias("_n"), closed.alias("_c"))
    a = run.select(F.col("_d").alias(start), (F.col("_n") - F.col("_c")).alias("_a"))
    b = run.select(F.col("_d").alias(end), F.col("_n").alias("_b"))
    return days.join(F.broadcast(a), start, "left").join(F.broadcast(b), end, "left").withColumn("has_holiday", F.col("_b") > F.col("_a")).drop("_a", "_b")


def default_store(spark: SparkSession) -> FactorStore:
    """A store of its own in the shared checkpoint folder."""
    return FactorStore(spark, f"{checkpoint_dir(spark)}/factors-{uuid.uuid4().hex}")
