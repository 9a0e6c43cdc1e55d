"""Queries of the general data problems (pN_...), over their whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import anomalies, asof, compaction, fill, rolling_totals, schema_drift, topn
from ..operators.versions import latest_version
from ..session import checkpoint_dir, cut_lineage, read_table
from ..sources import minute_csv
from .training_sql import ORACLES  # noqa: F401


def day_text(day) -> F.Column:
    """YYYY-MM-DD of a day number."""
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


def _daily(spark: SparkSession, d: str, fields: list[str]) -> DataFrame:
    t = read_table(spark, d, "stock_daily_real").withColumn("day", asof.day_number(F.col("trade_date")))
    return latest_version(t, ["ticker", "day"], "created_at", fields)


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return rolling_totals.rolling_totals(_daily(spark, d, ["volume", "amount"]), "ticker", "day", ["volume", "amount"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Quiet and surging days of volume and amount."""
    t = _totals(spark, d).where("age >= 29")
    rows = t.select("ticker", day_text(F.col("day")).alias("trade_day"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_7").alias("t7"), F.col(f"{f}_30").alias("t30")) for f in ("volume", "amount")])).alias("x")).select("ticker", "trade_day", "x.*")
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("t7") == 0, "quiet"), F.when(30 * F.col("t7") > 14 * F.col("t30"), "surge"))))
    return rows.select("ticker", "trade_day", "field_name", kinds.alias("kind"))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages over 7 and 30 calendar days, of every ticker and day."""
    t = _totals(spark, d)
    cols = [c for f in ("volume", "amount") for w in (7, 30) for c in (F.col(f"{f}_{w}").alias(f"{f}_sum_{w}d"), F.round(F.col(f"{f}_{w}") / w, 4).alias(f"{f}_avg_{w}d"))]
    return t.select("ticker", day_text(F.col("day")).alias("trade_day"), *cols, F.col("volume_7_n").cast("int").alias("days_with_volume_7d"))


#: The day up to which p1_corrected's trees are first stored.
STORED_UNTIL = "2024-05-31"


def p1_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Totals of volume from trees stored with what was recorded by a day, after everything recorded later corrected them.

    Later records restate days, fill gaps months late, carry tickers on past their last day,
    begin earlier, or bring new tickers; the result is that of the whole table.
    """
    t = read_table(spark, d, "stock_daily_real").where("ticker is not null and trade_date is not null").withColumn("day", asof.day_number(F.col("trade_date")))
    version = F.struct(F.col("created_at").alias("_v"), F.when(~F.isnan("volume"), F.col("volume")).alias("volume"))
    early = F.col("created_at").isNull() | (F.col("created_at") < F.lit(STORED_UNTIL).cast("timestamp"))
    both = t.groupBy("ticker", "day").agg(F.max(version).alias("now"), F.max(F.when(early, version)).alias("before"))
    trees = cut_lineage(rolling_totals.tree_table(both.where("before is not null").select("ticker", "day", "before.volume"), "ticker", "day", "volume"))
    zero, has = F.lit(0.0), lambda c: F.col(c).isNotNull().cast("int")
    late = both.where("before is null or not (now.volume <=> before.volume)").select("ticker", "day", (F.coalesce("now.volume", zero) - F.coalesce("before.volume", zero)).alias("delta"), (has("now.volume") - has("before.volume")).alias("added"))
    out = rolling_totals.totals_from_trees(rolling_totals.correct_tree_table(trees, late, "ticker", "day"), "ticker", "day", (7, 30))
    return out.select("ticker", day_text(F.col("day")).alias("trade_day"), F.col("total_7").alias("volume_sum_7d"), F.col("total_30").alias("volume_sum_30d"), F.col("n_7").cast("int").alias("days_with_volume_7d"))


def _fill_numeric(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "stock_fundamental").withColumn("day", asof.day_number(F.col("trade_date")))
    return fill.fill_numeric(t, "ticker", "day", {f: fill.usable_ratio(F.col(f)) for f in ("pe", "pb")})


def _fill_names(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "factor_lifecycle").withColumn("updated", F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(0)))
    return fill.fill_category(t, "uid", ["updated", "record_id"], F.floor(F.col("updated") / (30 * 86_400_000_000)).cast("int"), fill.usable_text(F.col("factor_name")), ["record_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Missing values that were filled."""
    num = _fill_numeric(spark, d).where("filled").select("field_name", F.concat_ws("|", "ticker", day_text(F.col("day"))).alias("record_key"), F.lit("").alias("filled"))
    cat = _fill_names(spark, d).where("filled").select(F.lit("factor_name").alias("field_name"), F.col("record_id").cast("string").alias("record_key"), F.col("value").alias("filled"))
    return num.unionByName(cat).distinct()


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    """pe and pb of every snapshot after filling, with the mask."""
    return _fill_numeric(spark, d).select("field_name", "ticker", day_text(F.col("day")).alias("trade_day"), F.round("value", 4).alias("value"), "filled")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The income report known at each query's target date, period or range."""
    day = lambda c: asof.day_number(asof.parse_day(F.col(c)))
    q = read_table(spark, d, "pit_queries").select("query_id", "helper", "ticker", day("target_date").alias("last"), day("start_date").alias("start"), day("period").alias("end_day"))
    q = q.where(F.col("last").isNotNull()).distinct()
    inc = read_table(spark, d, "stock_income").where((F.col("report_type") == "1") & F.col("f_ann_date").isNotNull() & F.col("end_date").isNotNull())
    inc = inc.select("ticker", asof.day_number(F.col("f_ann_date")).alias("known"), asof.day_number(F.col("end_date")).alias("end_day")).withColumn("ann", F.col("known"))
    by_period = asof.validity_intervals(inc, ["ticker", "end_day"], "known", ["ann"])
    newest = asof.validity_intervals(inc, ["ticker"], "known", ["end_day", "ann"])
    value = q.where("helper = 'ValueQueryHelper'").select("query_id", "ticker", "end_day", "last").withColumn("first", F.col("last"))
    known = q.where("helper in ('FinancialReportQueryHelper', 'ContinuousQueryHelper')").select("query_id", "ticker", "last", F.when(F.col("helper") == "ContinuousQueryHelper", F.col("start")).otherwise(F.col("last")).alias("first"))
    a = asof.interval_join(value, by_period, ["ticker", "end_day"], "first", "last", "query_id")
    b = asof.interval_join(known, newest, ["ticker"], "first", "last", "query_id")
    out = a.select("query_id", "end_day", "ann").unionByName(b.select("query_id", "end_day", "ann"))
    text = lambda c: F.date_format(F.date_from_unix_date(F.col(c)), "yyyyMMdd")
    return out.select("query_id", text("end_day").alias("end_day"), text("ann").alias("f_ann_day")).distinct()


CHARTS = (
    anomalies.Chart("close", floor=0.0, log=True, walk=True, limit=9.0),
    anomalies.Chart("pct_chg", floor=-100.0, limit=9.0),
    anomalies.Chart("volume", floor=0.0, strict=True, log=True, limit=7.0, least=2.3),
)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings of close, pct_chg and volume that can't be true."""
    held = _daily(spark, d, ["close", "pct_chg", "volume"])
    out = anomalies.implausible_readings(held, "ticker", "day", CHARTS, idle="volume")
    return out.select("ticker", day_text(F.col("day")).alias("trade_day"), "field_name", "kind")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return compaction.consolidate(read_table(spark, d, "csv_files"), read_table(spark, d, "csv_contents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files holding a bar in common."""
    return compaction.shared_bars(_bars(spark, d))


def p5_bars(spark: SparkSession, d: str) -> DataFrame:
    """Every bar exactly once, as it goes into the consolidated files."""
    at = F.date_format(F.timestamp_seconds(F.col("minute") * 60), "yyyy-MM-dd HH:mm")
    files = read_table(spark, d, "csv_files").where("exchange is not null and symbol is not null")
    contents = read_table(spark, d, "csv_contents").join(_learned(spark, d, files), "file_id", "left")
    return compaction.consolidate(files, contents).select("exchange", "symbol", at.alias("bar_minute"), *minute_csv.FIELDS, F.size("file_ids").alias("n_files"))


def p5_unread(spark: SparkSession, d: str) -> DataFrame:
    """Files that hold rows but give no bars."""
    return minute_csv.unread_files(read_table(spark, d, "csv_contents"))


def p5_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated outputs as written, with their key ranges (8 MB each, about)."""
    out = f"{checkpoint_dir(spark)}/consolidated-{uuid.uuid4().hex}"
    compaction.write_consolidated(_bars(spark, d), out, 8 << 20)
    m = spark.read.parquet(f"{out}/ranges")
    return m.select("output_no", "rows", "bytes", F.concat_ws(".", "first_key.symbol", "first_key.exchange").alias("first_ticker"), F.concat_ws(".", "last_key.symbol", "last_key.exchange").alias("last_ticker"))


def p5_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the outputs and their range metadata, read back file by file: all counts must be 0.

    few: outputs lacking of ten; unlike: outputs whose metadata differ from their rows;
    overlapping: neighbouring key ranges that overlap; unsorted: rows before their
    predecessor in a file; lost, doubled: bars against the merged ones.
    """
    out = f"{checkpoint_dir(spark)}/consolidated-{uuid.uuid4().hex}"
    merged = cut_lineage(_bars(spark, d))
    compaction.write_consolidated(merged, out, outputs=12)
    key = F.struct("exchange", "symbol", "minute")
    stored = spark.read.parquet(f"{out}/bars").select(key.alias("key"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.row_index").alias("at"))
    after = Window.partitionBy("file").orderBy("at")
    per_file = stored.withColumn("_before", F.lag("key").over(after)).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.when(F.col("key") <= F.col("_before"), 1)).alias("unsorted"))
    ranges = spark.read.parquet(f"{out}/ranges")
    unlike = F.count(F.when(~(F.col("rows").eqNullSafe(F.col("n")) & F.col("first_key").eqNullSafe(F.col("lo")) & F.col("last_key").eqNullSafe(F.col("hi"))), 1))
    files = ranges.join(per_file, "file", "full").agg(F.greatest(10 - F.count(F.lit(1)), F.lit(0)).alias("few"), unlike.alias("unlike"), F.sum("unsorted").alias("unsorted"))
    # one row per output
    overlapping = ranges.withColumn("_last", F.lag("last_key").over(Window.orderBy("output_no"))).agg(F.count(F.when(F.col("first_key") <= F.col("_last"), 1)).alias("overlapping"))
    want = merged.select(key.alias("key")).distinct()
    have = stored.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    bars = want.join(have, "key", "full").agg(F.count(F.when(F.col("n").isNull(), 1)).alias("lost"), F.count(F.when(F.col("n") > 1, 1)).alias("doubled"))
    return files.crossJoin(overlapping).crossJoin(bars).select("few", "unlike", "overlapping", "unsorted", "lost", "doubled")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten tickers of highest value of each date and factor."""
    held = latest_version(read_table(spark, d, "factor_values"), ["ticker", "trade_date", "factor_name"], "written_at", ["factor_value"])
    top = topn.top_n(held, ["factor_name", "trade_date"], "factor_value", "ticker", 10)
    return top.select("factor_name", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_day"), "rank_no", "ticker")


def _schemas(spark: SparkSession, d: str, files: DataFrame) -> DataFrame:
    """The schema of each of the files, in blocks of a month; parsed once, as it is read several times."""
    at = files.select("file_id", "exchange", "symbol", F.col("year").try_cast("int").alias("_y"), F.coalesce(F.col("month").try_cast("int"), F.lit(0)).alias("_m")).dropDuplicates(["file_id"])
    schemas = minute_csv.file_schemas(read_table(spark, d, "csv_contents")).join(at, "file_id")
    # files without a year come last
    return cut_lineage(schemas.withColumn("_block", F.coalesce(F.col("_y"), F.lit(9999)) * 16 + F.col("_m")))


def _learned(spark: SparkSession, d: str, files: DataFrame) -> DataFrame:
    return schema_drift.learned_columns(_schemas(spark, d, files), ["exchange", "symbol"], "_block", ["_block", "file_id"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Columns added, removed, renamed or retyped from file to file of a symbol."""
    schemas = _schemas(spark, d, read_table(spark, d, "csv_files").where("year is not null and exchange is not null and symbol is not null"))
    before = schema_drift.previous_schema(schemas, ["exchange", "symbol"], "_block", ["_block", "file_id"])
    return schema_drift.drift_report(before).distinct()


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """The bar rows of every file of a symbol in one table of fixed columns, whatever the file's headers."""
    files = read_table(spark, d, "csv_files").where("exchange is not null and symbol is not null")
    placed = files.select("file_id", "exchange", "symbol").dropDuplicates(["file_id"]).join(_learned(spark, d, files), "file_id", "left")
    rows = minute_csv.project(read_table(spark, d, "csv_contents").join(placed, "file_id"))
    at = F.date_format(F.timestamp_seconds(F.col("minute") * 60), "yyyy-MM-dd HH:mm")
    return rows.select("file_id", F.concat_ws(".", "symbol", "exchange").alias("ticker"), at.alias("bar_minute"), *minute_csv.FIELDS, "others")


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p1_corrected, p2_found, p2_filled, p3_found, p4_found, p5_found, p5_bars, p5_unread, p5_outputs, p5_ranges, p6_found, p7_found, p7_table)}
