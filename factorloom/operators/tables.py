"""Table operators: as-of joins, resampling, calendars, runs, universe screens, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocked import carry


def asof_join(left: DataFrame, right: DataFrame, by: dict[str, str], at: tuple[str, str], values: Sequence[str], direction: str = "backward", block_days: int = 30) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time (forward: the first at or after).

    `by` maps left key columns to right ones, `at` names the two time columns. Of right rows
    of one key and time the greatest values hold. The two sides are stacked and the value
    carried along time in blocks of days, so a hot key is split and nothing is multiplied;
    left rows without a match get nulls; rows of null key or time match nothing but stay.
    """
    back = direction == "backward"
    lt, rt = at
    stamp = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keys = [f"_k{i}" for i in range(len(by))]
    a = left.select(F.struct(*left.columns).alias("_left"), *[F.col(x).alias(k) for k, x in zip(keys, by, strict=True)], stamp(lt).alias("_t"))
    a = a.select("*", F.lit(1 if back else 0).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    b = right.select(*[F.col(x).alias(k) for k, x in zip(keys, by.values(), strict=True)], stamp(rt).alias("_t"), F.struct(*values).alias("_v")).dropna(subset=[*keys, "_t"])
    b = b.groupBy(*keys, "_t").agg(F.max("_v").alias("_v"))
    b = b.select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *keys, "_t", F.lit(0 if back else 1).alias("_side"), "_v")
    both = a.unionByName(b).withColumn("_block", F.floor(F.col("_t") / (86_400_000_000 * block_days)))
    done = carry(both, keys, "_block", ["_t", "_side"], F.col("_v"), "_found", forward=back)
    return done.where(F.col("_left").isNotNull()).select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def calendar_bucket(date: Column, start: Column, n: int) -> Column:
    """Number of the n-day bucket of a date, counted from start."""
    return F.floor(F.datediff(date, start) / n).cast("int")


def resample_days(df: DataFrame, n: int, ticker: str, date: str, aggs: Sequence[Column], label: str = "right") -> DataFrame:
    """Aggregates per ticker and bucket of n calendar days from the table's first date; the last, incomplete bucket is dropped.

    label: right (the bucket's last day), left (its first) or center.
    """
    span = df.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    t = df.crossJoin(F.broadcast(span)).withColumn("_b", calendar_bucket(F.col(date), F.col("_lo"), n))
    t = t.where(F.date_add(F.col("_lo"), ((F.col("_b") + 1) * n - 1).cast("int")) <= F.col("_hi"))
    at = {"right": (F.col("_b") + 1) * n - 1, "left": F.col("_b") * n, "center": F.col("_b") * n + F.lit(n // 2)}[label]
    return t.groupBy(ticker, F.date_add(F.col("_lo"), at.cast("int")).alias(date)).agg(*aggs)


def resample_rows(df: DataFrame, n: int, ticker: str, date: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per ticker and bucket of n trading dates, labelled with the bucket's last date; incomplete ones dropped."""
    dates = df.select(date).distinct()
    idx = dates.withColumn("_i", F.row_number().over(Window.orderBy(date)) - 1).withColumn("_b", F.floor(F.col("_i") / n))
    ends = idx.groupBy("_b").agg(F.max(date).alias("_end"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n)
    return df.join(idx, date).join(ends, "_b").groupBy(ticker, F.col("_end").alias(date)).agg(*aggs)


def resample_period(df: DataFrame, unit: str, ticker: str, date: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per ticker and calendar period (week, month, quarter, year), labelled with the period's first day."""
    return df.groupBy(ticker, F.date_trunc(unit, F.col(date)).cast("date").alias(date)).agg(*aggs)


def bar_aggs(order: str, open_: str = "open", high: str = "high", low: str = "low", close: str = "close", volume: str = "volume", amount: str = "amount") -> list[Column]:
    """Aggregates that fold finer bars into one: first open, max high, min low, last close, summed volume and amount."""
    known = lambda x: F.when(F.col(x).isNotNull(), F.col(order))
    return [
        F.min_by(F.col(open_), known(open_)).alias("open"), F.max(high).alias("high"), F.min(low).alias("low"),
        F.max_by(F.col(close), known(close)).alias("close"), F.sum(volume).alias("volume"), F.sum(amount).alias("amount"),
    ]


def bars_from_ticks(ticks: DataFrame, key: str, ts: str, tie: str, value: str, unit: str = "day") -> DataFrame:
    """Bars of ticks per key and time unit; equal times are ordered by `tie`."""
    order = F.struct(ts, tie)
    g = ticks.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, F.date_trunc(unit, F.col(ts)).alias("bar_time"))
    return g.agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(value).alias("volume"), F.sum(value).alias("amount"))


def trading_days(calendar: DataFrame) -> DataFrame:
    """Every calendar day per exchange with its session number: exchange, day, is_open, session (of the day or the last before it)."""
    c = calendar.where("exchange is not null and cal_date is not null").groupBy("exchange", F.col("cal_date").cast("date").alias("day")).agg(F.max("is_open").alias("is_open"))
    return c.withColumn("session", F.sum(F.col("is_open").cast("int")).over(Window.partitionBy("exchange").orderBy("day")).cast("int"))


def shift_sessions(calendar: DataFrame, n: int) -> DataFrame:
    """Adds shifted: the session n sessions after (before, if negative) each day; from a closed day, n = 0 is the last session before it."""
    t = trading_days(calendar)
    opens = t.where("is_open = 1").select("exchange", F.col("session").alias("_s"), F.col("day").alias("shifted"))
    return t.withColumn("_s", F.col("session") + n).join(opens, ["exchange", "_s"], "left").select("exchange", "day", "is_open", "shifted")


def runs(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """Runs of consecutive rows of a key where the flag holds: key, first, last, rows."""
    along = Window.partitionBy(key).orderBy(order)
    t = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_i", F.row_number().over(along))
    t = t.where("_f").withColumn("_g", F.col("_i") - F.row_number().over(along))
    return t.groupBy(key, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).cast("int").alias("rows")).drop("_g")


def screen(basic: DataFrame, as_of: str, min_days: int, boards: Sequence[str] = (), drop_st: bool = True) -> DataFrame:
    """Tickers that pass the preliminary screen: listed for min_days by a day, not delisted, no ST name, not on given boards (prefixes)."""
    day = F.lit(as_of).cast("date")
    ok = (F.datediff(day, F.col("list_date").cast("date")) >= min_days) & (F.col("delist_date").isNull() | (F.col("delist_date").cast("date") > day))
    if drop_st:
        ok = ok & ~F.coalesce(F.upper("name").contains("ST"), F.lit(False))
    for b in boards:
        ok = ok & ~F.col("ticker").startswith(b)
    return basic.where(F.col("ticker").isNotNull() & ok).select("ticker").distinct()


def upsert(store: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The store after new rows replace or join those of their key; a null new value keeps the old one; new columns are added."""
    olds, news = [c for c in store.columns if c not in keys], [c for c in new.columns if c not in keys]
    a, b = store.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in olds]), new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in news])
    j = a.join(b, list(keys), "full")
    cols = [F.coalesce(*([F.col(f"_n_{c}")] if c in news else []), *([F.col(f"_o_{c}")] if c in olds else [])).alias(c) for c in dict.fromkeys([*olds, *news])]
    return j.select(*keys, *cols)


def insert_ignore(store: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The store with the new rows whose key it doesn't hold; of new rows of one key one is kept."""
    return store.unionByName(new.dropDuplicates(list(keys)).join(store.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def business_days(a: Column, b: Column) -> Column:
    """Weekdays from date a (in) to date b (out); negative the other way round."""
    # days since a Monday; 5 per whole week plus those of the rest
    count = lambda d: F.floor((F.unix_date(d) + 3) / 7) * 5 + F.least(F.pmod(F.unix_date(d) + 3, F.lit(7)), F.lit(5))
    return (count(b) - count(a)).cast("int")
