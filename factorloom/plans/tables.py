"""Queries of table, pipeline, risk, back-test and streaming operators, with SQL equivalents where there are."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panel_ops import Keys, div
from ..operators import backtest, pipeline, risk, tables
from ..operators.versions import latest_version
from ..session import checkpoint_dir, read_table
from ..streaming import bars
from .formulas import PANEL_SQL, panel


def _day(c: str, name: str = "trade_day") -> F.Column:
    return F.date_format(c, "yyyy-MM-dd").alias(name)


def t_scan_filter(spark: SparkSession, d: str) -> DataFrame:
    """Projection, membership and date range pushed into the scan."""
    t = read_table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp")))
    return t.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def t_equi_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders per region and nation through equi-joins."""
    o, c, n, r = (read_table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def t_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an event."""
    c, e = read_table(spark, d, "customer"), read_table(spark, d, "events")
    return c.join(e, c.c_custkey == e.user_id, "left_semi").select("c_custkey", "c_name")


def t_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order."""
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def t_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """The last report quarter known at each snapshot day, as-of."""
    f = read_table(spark, d, "stock_fundamental").select("ticker", "trade_date").distinct()
    i = read_table(spark, d, "stock_income").where("f_ann_date is not null").select("ticker", "f_ann_date", F.col("end_date").cast("date").alias("end_date"))
    j = tables.asof_join(f, i, {"ticker": "ticker"}, ("trade_date", "f_ann_date"), ["end_date"])
    return j.select("ticker", _day("trade_date"), _day("end_date", "end_day"))


def t_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    """The next report announced at or after each snapshot day."""
    f = read_table(spark, d, "stock_fundamental").select("ticker", "trade_date").distinct()
    i = read_table(spark, d, "stock_income").where("f_ann_date is not null").select("ticker", "f_ann_date", F.col("f_ann_date").cast("date").alias("next_ann"))
    j = tables.asof_join(f, i, {"ticker": "ticker"}, ("trade_date", "f_ann_date"), ["next_ann"], direction="forward")
    return j.select("ticker", _day("trade_date"), _day("next_ann", "next_ann"))




def t_resample_days(spark: SparkSession, d: str) -> DataFrame:
    """Mean close per ticker and ten calendar days."""
    r = tables.resample_days(panel(spark, d), 10, "ticker", "trade_date", [F.round(F.avg("close"), 6).alias("close"), F.count("close").alias("n")])
    return r.select("ticker", _day("trade_date"), "close", "n")


def t_resample_rows(spark: SparkSession, d: str) -> DataFrame:
    """Mean close per ticker and ten trading dates."""
    r = tables.resample_rows(panel(spark, d), 10, "ticker", "trade_date", [F.round(F.avg("close"), 6).alias("close"), F.count("close").alias("n")])
    return r.select("ticker", _day("trade_date"), "close", "n")


def t_resample_month(spark: SparkSession, d: str) -> DataFrame:
    """Monthly bars of the daily panel."""
    r = tables.resample_period(panel(spark, d), "month", "ticker", "trade_date", tables.bar_aggs("trade_date"))
    return r.select("ticker", _day("trade_date"), "open", "high", "low", "close", "volume", "amount")


def t_resample_week(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bars of the daily panel."""
    r = tables.resample_period(panel(spark, d), "week", "ticker", "trade_date", tables.bar_aggs("trade_date"))
    return r.select("ticker", _day("trade_date"), "open", "high", "low", "close", "volume", "amount")


def t_bars_from_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of the event stream."""
    b = tables.bars_from_ticks(read_table(spark, d, "events"), "user_id", "ts", "event_id", "value")
    return b.select("user_id", _day("bar_time"), "open", "high", "low", "close", "volume", F.round("amount", 4).alias("amount"))


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars by Structured Streaming over the event files, all windows: partial bars of each trigger, folded at the end of the input."""
    schema = read_table(spark, d, "events").schema
    ticks = bars.stream_ticks(spark, d, "events.parquet", schema)
    out = f"{checkpoint_dir(spark)}/stream-bars-{uuid.uuid4().hex}"
    bars.run_to_parts(ticks, out, lambda t: bars.partial_bars(t, "user_id", "ts", "event_id", "value"))
    folded = bars.fold_bars(spark.read.parquet(f"{out}/parts"), "user_id")
    return folded.select("user_id", _day("bar_time"), "open", "high", "low", "close", "volume", F.round("amount", 4).alias("amount"))


def t_next_session(spark: SparkSession, d: str) -> DataFrame:
    """The next session after each calendar day."""
    return tables.shift_sessions(read_table(spark, d, "trade_calendar"), 1).select("exchange", _day("day", "day"), _day("shifted", "next_session"))


def t_previous_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Five sessions before each open day."""
    t = tables.shift_sessions(read_table(spark, d, "trade_calendar"), -5).where("is_open = 1")
    return t.select("exchange", _day("day", "day"), _day("shifted", "session"))


def t_business_days(spark: SparkSession, d: str) -> DataFrame:
    """Weekdays from each report's end to its announcement."""
    t = read_table(spark, d, "stock_income").where("f_ann_date is not null and end_date is not null").select("ticker", F.col("end_date").cast("date").alias("a"), F.col("f_ann_date").cast("date").alias("b")).distinct()
    return t.select("ticker", _day("a", "end_day"), _day("b", "ann_day"), tables.business_days(F.col("a"), F.col("b")).alias("weekdays"))


def t_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive rising days per ticker."""
    r = tables.runs(panel(spark, d), "ticker", "trade_date", F.col("pct_chg") > 0)
    return r.select("ticker", _day("first", "first_day"), _day("last", "last_day"), "rows")


def t_screen(spark: SparkSession, d: str) -> DataFrame:
    """Preliminary universe on 2024-06-28."""
    return tables.screen(read_table(spark, d, "stock_basic"), "2024-06-28", 365, ("8", "9"))


def t_industry_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Count and share of tickers per industry."""
    b = read_table(spark, d, "stock_basic").where("ticker is not null").groupBy("ticker").agg(F.min("industry").alias("industry"))
    g = b.groupBy(F.coalesce("industry", F.lit("unclassified")).alias("industry")).agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("industry", "n", F.round(F.col("n") / F.col("total"), 8).alias("share"))


def t_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A factor store after the values of the last date replace those before."""
    v = read_table(spark, d, "factor_values").where("factor_name = 'composite_score' and ticker is not null and trade_date is not null")
    v = latest_version(v.withColumn("factor_value", F.when(~F.isnan("factor_value"), F.col("factor_value"))), ["ticker", "trade_date"], "written_at", ["factor_value"])
    old = v.groupBy("ticker").agg(F.min_by("factor_value", "trade_date").alias("score"))
    new = v.groupBy("ticker").agg(F.max_by("factor_value", "trade_date").alias("score"), F.count("factor_value").alias("n"))
    return tables.upsert(old, new, ["ticker"])


def t_upsert_all(spark: SparkSession, d: str) -> DataFrame:
    """t_upsert of every factor: per factor and ticker the values of its last date replace those of its first."""
    keys = ["factor_name", "ticker"]
    v = read_table(spark, d, "factor_values").where("factor_name is not null and ticker is not null and trade_date is not null")
    v = latest_version(v.withColumn("factor_value", F.when(~F.isnan("factor_value"), F.col("factor_value"))), [*keys, "trade_date"], "written_at", ["factor_value"])
    old = v.groupBy(*keys).agg(F.min_by("factor_value", "trade_date").alias("score"))
    new = v.groupBy(*keys).agg(F.max_by("factor_value", "trade_date").alias("score"), F.count("factor_value").alias("n"))
    return tables.upsert(old, new, keys)


def t_lifecycle_latest(spark: SparkSession, d: str) -> DataFrame:
    """The present state of every factor: the last change by time, then record."""
    t = read_table(spark, d, "factor_lifecycle").where("uid is not null")
    g = t.groupBy("uid").agg(F.max_by("status", F.struct("updated_at", "record_id")).alias("status"), F.countDistinct("record_id").alias("changes"))
    return g.select("uid", "status", "changes")


def t_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Records per category of the statuses development, testing and active, wide; t_status_pivot_all has every record."""
    t = read_table(spark, d, "factor_lifecycle").withColumn("category", F.coalesce("category", F.lit("none")))
    return t.groupBy("category").pivot("status", ["development", "testing", "active"]).agg(F.count(F.lit(1))).na.fill(0)


def t_status_pivot_all(spark: SparkSession, d: str) -> DataFrame:
    """Records per category and status, wide, every record in one column: `other` are those of null or any further status."""
    known = ["development", "testing", "active", "deprecated"]
    t = read_table(spark, d, "factor_lifecycle").select(F.coalesce("category", F.lit("none")).alias("category"), F.when(F.col("status").isin(known), F.col("status")).otherwise("other").alias("status"))
    return t.groupBy("category").pivot("status", [*known, "other"]).agg(F.count(F.lit(1))).na.fill(0)


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, pipeline.Grid, pipeline.Factor, pipeline.Classifier]:
    g = pipeline.Grid()
    return panel(spark, d), g, g.factor("close"), g.classifier("industry")


def _terms(spark: SparkSession, d: str, **terms: F.Column) -> DataFrame:
    t = panel(spark, d).withColumns(terms)
    return t.select("ticker", _day("trade_date"), *[F.round(n, 6).alias(n) if k == "double" else n for n, k in t.dtypes if n in terms])


def pl_demean_group(spark: SparkSession, d: str) -> DataFrame:
    """Close less its industry's mean, among names traded that day."""
    _, g, x, ind = _grid(spark, d)
    return _terms(spark, d, value=x.demean(mask=g.factor("volume") > 0, group=ind).column)


def pl_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Standard score per date and industry."""
    _, _, x, ind = _grid(spark, d)
    return _terms(spark, d, value=x.zscore(group=ind).column)


def pl_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The five rank methods."""
    _, _, x, _ = _grid(spark, d)
    return _terms(spark, d, **{f"r_{m}": x.rank(m).column for m in ("ordinal", "min", "max", "dense", "average")})


def pl_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartile of the close per date."""
    _, _, x, _ = _grid(spark, d)
    return _terms(spark, d, value=x.quantiles(4).column.cast("int"))


def pl_top_bottom(spark: SparkSession, d: str) -> DataFrame:
    """The three dearest names of each date and industry, and the three cheapest of each date."""
    _, _, x, ind = _grid(spark, d)
    return _terms(spark, d, is_top=x.top(3, group=ind).column, is_bottom=x.bottom(3).column).where("is_top or is_bottom")


def pl_percentile_between(spark: SparkSession, d: str) -> DataFrame:
    """Names between the 20th and 80th percentile."""
    _, _, x, _ = _grid(spark, d)
    return _terms(spark, d, inside=x.percentile_between(20, 80).column)


def pl_latest_sma_peers(spark: SparkSession, d: str) -> DataFrame:
    """Last known close, partial moving average, clipped change and peers."""
    _, g, x, ind = _grid(spark, d)
    return _terms(spark, d, latest=x.latest().column, sma=x.sma(10).column, clipped=g.factor("pct_chg").clip(-1, 1).column, peers=ind.peer_count().column)


def pl_classifier_tests(spark: SparkSession, d: str) -> DataFrame:
    """String tests on tickers."""
    t = pipeline.Grid().classifier("ticker")
    return _terms(spark, d, a=t.endswith(".SH").column, b=t.startswith("1").column, c=t.has_substring("34").column, e=t.matches("[0-4]").column, f=t.element_of(["123457.SH"]).column).distinct()


def rk_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Covariance of every pair of industries' mean returns."""
    r = panel(spark, d).where("industry is not null").groupBy("industry", "trade_date").agg((F.avg("pct_chg") / 100).alias("r"))
    return risk.pairwise_covariance(r, "industry", "trade_date", "r").select("a", "b", F.round("covariance", 12).alias("covariance"), "n")


def rk_single_index(spark: SparkSession, d: str) -> DataFrame:
    """Beta, alpha and residual deviation of every ticker against the universe's mean change."""
    p = panel(spark, d)
    m = p.groupBy("trade_date").agg(F.avg("pct_chg").alias("m"))
    j = p.join(m, "trade_date").where("pct_chg is not null")
    g = j.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("pct_chg", "m").alias("c"), F.var_pop("m").alias("v"), F.var_pop("pct_chg").alias("s"), F.avg("pct_chg").alias("a"), F.avg("m").alias("b"))
    beta = div(F.col("c"), F.col("v"))
    return g.where("n > 2 and v > 0").select("ticker", F.round(beta, 8).alias("beta"), F.round(F.col("a") - beta * F.col("b"), 8).alias("alpha"), F.round(F.greatest(F.col("s") - beta * F.col("c"), F.lit(0.0)), 6).alias("residual_variance"))


def _industry_moments(spark: SparkSession, d: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Industries (at most risk.DENSE), their mean returns and the covariance over the dates on which all have one, by one fold of the vectors."""
    r = panel(spark, d).where("industry is not null").groupBy("industry", "trade_date").agg((F.avg("pct_chg") / 100).alias("r")).where("r is not null")
    names = sorted(x[0] for x in r.select("industry").distinct().limit(risk.DENSE + 1).collect())
    by_name = F.transform(F.array_sort(F.collect_list(F.struct("industry", "r"))), lambda x: x["r"])
    n, sums, g = risk.gram(r.groupBy("trade_date").agg(by_name.alias("v")), "v", len(names))
    mean = sums / max(n, 1)
    return names, mean, g / max(n, 1) - np.outer(mean, mean)


def _weights(spark: SparkSession, names: list[str], w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, float(np.round(v, 6))) for i, v in zip(names, w, strict=True)], "industry string, weight double")


def rk_weights(spark: SparkSession, d: str) -> DataFrame:
    """Least-variance weights of the industries (the covariance half shrunk to equal variances)."""
    names, mean, cov = _industry_moments(spark, d)
    shrunk = 0.5 * cov + 0.5 * np.eye(len(names)) * np.trace(cov) / len(names)
    return _weights(spark, names, risk.optimise(mean, shrunk))


def rk_long_short(spark: SparkSession, d: str) -> DataFrame:
    """The same with short positions allowed."""
    names, mean, cov = _industry_moments(spark, d)
    shrunk = 0.5 * cov + 0.5 * np.eye(len(names)) * np.trace(cov) / len(names)
    return _weights(spark, names, risk.optimise(mean, shrunk, bounds=(-1.0, 1.0)))


def bt_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Account value of a top-ten portfolio rebalanced every twenty sessions, for two factors."""
    p = panel(spark, d)
    mom = div(F.col("close"), F.lag("close", 10).over(Keys().along)) - 1
    t = p.select("ticker", "trade_date", "close", mom.alias("momentum"))
    runs = F.explode(F.array(F.struct(F.lit("momentum").alias("run"), F.col("momentum").alias("score")), F.struct(F.lit("reversal").alias("run"), (-F.col("momentum")).alias("score")))).alias("x")
    scores = t.select("ticker", "trade_date", runs).select("ticker", "trade_date", "x.*")
    held = backtest.top_k_holdings(scores, "run", "trade_date", "ticker", "score", 10, 20)
    out = backtest.simulate(t, held, "run", "trade_date", "ticker", "close")
    return out.select("run", _day("trade_date"), F.round("account", 2).alias("account"), F.round("cash", 2).alias("cash"), F.round("turnover", 2).alias("turnover"))


def bt_holdings(spark: SparkSession, d: str) -> DataFrame:
    """The holdings behind a top-ten portfolio by change over ten rows."""
    mom = div(F.col("close"), F.lag("close", 10).over(Keys().along)) - 1
    t = panel(spark, d).select(F.lit("momentum").alias("run"), "ticker", "trade_date", mom.alias("score"))
    h = backtest.top_k_holdings(t, "run", "trade_date", "ticker", "score", 10, 20)
    return h.select("run", _day("trade_date"), "ticker", F.round("weight", 8).alias("weight"))


def t_sliding_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per type in windows of an hour, sliding by half."""
    e = read_table(spark, d, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def t_json_extract(spark: SparkSession, d: str) -> DataFrame:
    """A number out of the events' JSON text."""
    return read_table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k"))


def t_factor_ic_store(spark: SparkSession, d: str) -> DataFrame:
    """Ranked values and extent of every stored factor and date."""
    v = latest_version(read_table(spark, d, "factor_values"), ["ticker", "trade_date", "factor_name"], "written_at", ["factor_value"])
    ok = v.where("factor_value is not null and not isnan(factor_value) and abs(factor_value) < double('infinity')")
    return ok.groupBy("factor_name", _day("trade_date")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("factor_value"), 6).alias("lo"), F.round(F.max("factor_value"), 6).alias("hi"))


_ALL = (
    t_scan_filter, t_equi_join, t_semi_join, t_anti_join, t_asof_backward, t_asof_forward, t_resample_days, t_resample_rows, t_resample_month, t_resample_week, t_bars_from_ticks, stream_bars, t_next_session, t_previous_sessions, t_business_days,
    t_runs, t_screen, t_industry_statistics, t_upsert, t_upsert_all, t_lifecycle_latest, t_status_pivot, t_status_pivot_all, pl_demean_group, pl_zscore, pl_ranks, pl_quartiles, pl_top_bottom, pl_percentile_between, pl_latest_sma_peers, pl_classifier_tests,
    rk_covariance, rk_single_index, rk_weights, rk_long_short, bt_top_k, bt_holdings, t_sliding_window_counts, t_json_extract, t_factor_ic_store,
)
QUERIES = {f.__name__: f for f in _ALL}

_D = "strftime(trade_date, '%Y-%m-%d') as trade_day"
_BAR = "arg_min(open, trade_date) filter (open is not null) as open, max(high) as high, min(low) as low, arg_max(close, trade_date) filter (close is not null) as close, sum(volume) as volume, sum(amount) as amount"
_TICKS = "select user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as trade_day, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(value) as volume, round(sum(value), 4) as amount from events where user_id is not null and ts is not null group by 1, 2"
_SESS = "c as (select exchange, cast(cal_date as date) as day, max(is_open) as is_open from trade_calendar where exchange is not null and cal_date is not null group by 1, 2), s as (select *, sum(is_open) over (partition by exchange order by day) as n from c), o as (select exchange, n, day as shifted from s where is_open = 1)"
_HELD = "held as (select ticker, trade_date, factor_name, factor_value from factor_values qualify row_number() over (partition by ticker, trade_date, factor_name order by written_at desc nulls last) = 1)"

ORACLES = {
    "t_scan_filter": "select o_orderkey, o_custkey, round(o_totalprice, 2) as o_totalprice from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderdate between timestamp '1996-01-01' and timestamp '1997-12-31'",
    "t_equi_join": "select r_name, n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
    "t_semi_join": "select c_custkey, c_name from customer where c_custkey in (select user_id from events)",
    "t_anti_join": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')",
    "t_asof_backward": "with f as (select distinct ticker, trade_date from stock_fundamental), i as (select ticker, f_ann_date, max(cast(end_date as date)) as e from stock_income where f_ann_date is not null and ticker is not null group by 1, 2) select f.ticker, strftime(f.trade_date, '%Y-%m-%d') as trade_day, strftime(e, '%Y-%m-%d') as end_day from f asof left join i on f.ticker = i.ticker and f.trade_date >= i.f_ann_date",
    "t_asof_forward": "with f as (select distinct ticker, trade_date from stock_fundamental), i as (select distinct ticker, f_ann_date from stock_income where f_ann_date is not null and ticker is not null) select f.ticker, strftime(f.trade_date, '%Y-%m-%d') as trade_day, strftime(i.f_ann_date, '%Y-%m-%d') as next_ann from f asof left join i on f.ticker = i.ticker and f.trade_date <= i.f_ann_date",
    "t_resample_days": f"with {PANEL_SQL}, x as (select *, min(trade_date) over () as lo, max(trade_date) over () as hi from p), b as (select *, (trade_date - lo) // 10 as k from x) select ticker, strftime(lo + cast((k + 1) * 10 - 1 as integer), '%Y-%m-%d') as trade_day, round(avg(close), 6) as close, count(close) as n from b where lo + cast((k + 1) * 10 - 1 as integer) <= hi group by ticker, lo, k",
    "t_resample_rows": f"with {PANEL_SQL}, d as (select trade_date, (row_number() over (order by trade_date) - 1) // 10 as k from (select distinct trade_date from p)), e as (select k, max(trade_date) as e from d group by k having count(*) = 10) select ticker, strftime(e.e, '%Y-%m-%d') as trade_day, round(avg(close), 6) as close, count(close) as n from p join d using (trade_date) join e using (k) group by ticker, e.e",
    "t_resample_month": f"with {PANEL_SQL} select ticker, strftime(date_trunc('month', trade_date), '%Y-%m-%d') as trade_day, {_BAR} from p group by 1, 2",
    "t_resample_week": f"with {PANEL_SQL} select ticker, strftime(date_trunc('week', trade_date), '%Y-%m-%d') as trade_day, {_BAR} from p group by 1, 2",
    "t_bars_from_ticks": _TICKS,
    "stream_bars": _TICKS,
    "t_upsert_all": "with held as (select factor_name, ticker, trade_date, case when isnan(factor_value) then null else factor_value end as v from factor_values where factor_name is not null and ticker is not null and trade_date is not null qualify row_number() over (partition by factor_name, ticker, trade_date order by written_at desc nulls last) = 1), w as (select factor_name, ticker, count(v) as n, first(v order by trade_date) as a, last(v order by trade_date) as b from held group by 1, 2) select factor_name, ticker, coalesce(b, a) as score, n from w",
    "t_status_pivot_all": "select coalesce(category, 'none') as category, count(*) filter (status = 'development') as development, count(*) filter (status = 'testing') as testing, count(*) filter (status = 'active') as active, count(*) filter (status = 'deprecated') as deprecated, count(*) filter (coalesce(status not in ('development', 'testing', 'active', 'deprecated'), true)) as other from factor_lifecycle group by 1",
    "t_next_session": f"with {_SESS} select s.exchange, strftime(day, '%Y-%m-%d') as day, strftime(shifted, '%Y-%m-%d') as next_session from s left join o on s.exchange = o.exchange and o.n = s.n + 1",
    "t_previous_sessions": f"with {_SESS} select s.exchange, strftime(day, '%Y-%m-%d') as day, strftime(shifted, '%Y-%m-%d') as session from s left join o on s.exchange = o.exchange and o.n = s.n - 5 where is_open = 1",
    "t_business_days": "with t as (select distinct ticker, cast(end_date as date) as a, cast(f_ann_date as date) as b from stock_income where f_ann_date is not null and end_date is not null), n as (select *, (select count(*) from range(0, cast(abs(b - a) as bigint)) r(k) where dayofweek(least(a, b) + cast(k as integer)) between 1 and 5) as w from t) select ticker, strftime(a, '%Y-%m-%d') as end_day, strftime(b, '%Y-%m-%d') as ann_day, cast(case when b >= a then w else -w end as integer) as weekdays from n",
    "t_runs": f"with {PANEL_SQL}, i as (select *, row_number() over (partition by ticker order by trade_date) as i from p), g as (select *, i - row_number() over (partition by ticker order by trade_date) as g from i where pct_chg > 0) select ticker, strftime(min(trade_date), '%Y-%m-%d') as first_day, strftime(max(trade_date), '%Y-%m-%d') as last_day, cast(count(*) as integer) as rows from g group by ticker, g",
    "t_screen": "select distinct ticker from stock_basic where ticker is not null and date '2024-06-28' - cast(list_date as date) >= 365 and (delist_date is null or cast(delist_date as date) > date '2024-06-28') and not coalesce(contains(upper(name), 'ST'), false) and not starts_with(ticker, '8') and not starts_with(ticker, '9')",
    "t_industry_statistics": "with b as (select ticker, min(industry) as i from stock_basic where ticker is not null group by ticker) select coalesce(i, 'unclassified') as industry, count(*) as n, round(count(*) / (select count(*) from b), 8) as share from b group by 1",
    "t_upsert": "with held as (select ticker, trade_date, case when isnan(factor_value) then null else factor_value end as v from factor_values where factor_name = 'composite_score' and ticker is not null and trade_date is not null qualify row_number() over (partition by ticker, trade_date order by written_at desc nulls last) = 1), w as (select ticker, count(v) as n, first(v order by trade_date) as a, last(v order by trade_date) as b from held group by ticker) select ticker, coalesce(b, a) as score, n from w",
    "t_lifecycle_latest": "select uid, arg_max(status, (updated_at, record_id)) as status, count(distinct record_id) as changes from factor_lifecycle where uid is not null group by uid",
    "t_status_pivot": "select coalesce(category, 'none') as category, count(*) filter (status = 'development') as development, count(*) filter (status = 'testing') as testing, count(*) filter (status = 'active') as active from factor_lifecycle group by 1",
    "pl_demean_group": f"with {PANEL_SQL}, m as (select *, case when volume > 0 then close end as x from p) select ticker, {_D}, round(x - avg(x) over (partition by trade_date, industry), 6) as value from m",
    "pl_zscore": f"with {PANEL_SQL} select ticker, {_D}, round((close - avg(close) over w) / case when stddev_pop(close) over w > 1e-12 then stddev_pop(close) over w end, 6) as value from p window w as (partition by trade_date, industry)",
    "pl_ranks": f"with {PANEL_SQL} select ticker, {_D}, case when close is not null then cast(row_number() over (partition by trade_date order by close nulls last, ticker) as double) end as r_ordinal, case when close is not null then cast(rank() over w as double) end as r_min, case when close is not null then cast(rank() over w + count(close) over (partition by trade_date, close) - 1 as double) end as r_max, case when close is not null then cast(dense_rank() over w as double) end as r_dense, case when close is not null then rank() over w + (count(close) over (partition by trade_date, close) - 1) / 2 end as r_average from p window w as (partition by trade_date order by close nulls last)",
    "pl_quartiles": f"with {PANEL_SQL}, e as (select *, quantile_cont(close, [0.25, 0.5, 0.75]) over (partition by trade_date) as edges from p) select ticker, {_D}, cast(case when close is not null then len([x for x in edges if x < close]) else -1 end as integer) as value from e",
    "pl_top_bottom": f"with {PANEL_SQL}, r as (select ticker, trade_date, close is not null and row_number() over (partition by trade_date, industry order by close desc nulls last, ticker) <= 3 as is_top, close is not null and row_number() over (partition by trade_date order by close nulls last, ticker) <= 3 as is_bottom from p) select ticker, {_D}, is_top, is_bottom from r where is_top or is_bottom",
    "pl_percentile_between": f"with {PANEL_SQL} select ticker, {_D}, coalesce(close >= quantile_cont(close, 0.2) over w and close <= quantile_cont(close, 0.8) over w, false) as inside from p window w as (partition by trade_date)",
    "pl_latest_sma_peers": f"with {PANEL_SQL} select ticker, {_D}, round(last_value(close ignore nulls) over (partition by ticker order by trade_date rows between unbounded preceding and current row), 6) as latest, round(avg(close) over (partition by ticker order by trade_date rows between 9 preceding and current row), 6) as sma, case when pct_chg is not null then greatest(least(pct_chg, 1), -1) end as clipped, cast(count(*) over (partition by trade_date, industry) as double) as peers from p",
    "pl_classifier_tests": f"with {PANEL_SQL} select distinct ticker, {_D}, ends_with(ticker, '.SH') as a, starts_with(ticker, '1') as b, contains(ticker, '34') as c, regexp_matches(ticker, '^[0-4]') as e, ticker = '123457.SH' as f from p",
    "rk_covariance": f"with {PANEL_SQL}, r as (select industry, trade_date, avg(pct_chg) / 100 as r from p where industry is not null group by 1, 2 having avg(pct_chg) is not null) select x.industry as a, y.industry as b, round(covar_samp(x.r, y.r), 12) as covariance, count(*) as n from r x join r y using (trade_date) group by 1, 2",
    "rk_single_index": f"with {PANEL_SQL}, m as (select trade_date, avg(pct_chg) as m from p group by 1), j as (select * from p join m using (trade_date) where pct_chg is not null) select ticker, round(covar_pop(pct_chg, m) / var_pop(m), 8) as beta, round(avg(pct_chg) - covar_pop(pct_chg, m) / var_pop(m) * avg(m), 8) as alpha, round(greatest(var_pop(pct_chg) - covar_pop(pct_chg, m) / var_pop(m) * covar_pop(pct_chg, m), 0), 6) as residual_variance from j group by ticker having count(*) > 2 and var_pop(m) > 0",
    "bt_holdings": f"with {PANEL_SQL}, s as (select ticker, trade_date, close / nullif(lag(close, 10) over (partition by ticker order by trade_date), 0) - 1 as score from p), d as (select trade_date, row_number() over (order by trade_date) - 1 as i from (select distinct trade_date from s)), r as (select ticker, trade_date, row_number() over (partition by trade_date order by score desc, ticker) as r from s join d using (trade_date) where i % 20 = 0 and score is not null) select 'momentum' as run, {_D}, ticker, round(1.0 / count(*) over (partition by trade_date), 8) as weight from r where r <= 10",
    "t_sliding_window_counts": "select event_type, strftime(s, '%Y-%m-%d %H:%M') as start, count(*) as n from (select event_type, unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as s from events) group by 1, 2",
    "t_json_extract": "select event_type, cast(sum(try_cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by 1",
    "t_factor_ic_store": f"with {_HELD} select factor_name, strftime(trade_date, '%Y-%m-%d') as trade_day, count(*) as n, round(min(factor_value), 6) as lo, round(max(factor_value), 6) as hi from held where factor_value is not null and not isnan(factor_value) and not isinf(factor_value) group by 1, 2",
}
