
import datetime as dt
import pathlib
import random

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from factorloom.operators import compaction, schema_drift
from factorloom.sources import minute_csv
from factorloom.streaming import bars

from util import bag, frame_bag

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="no test tables here")


@needs_tables
def test_stream_bars_has_every_window(spark):
    c = duckdb.connect()
    c.sql(f"create view events as select * from read_parquet('{DATA}/events.parquet')")
    want = c.sql(entry.oracle_sql()["t_bars_from_ticks"]).df()
    got = entry.queries()["stream_bars"](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert frame_bag(got) == frame_bag(want)


def test_partial_bars_take_late_ticks_and_resume(spark, tmp_path):
    t0, schema = dt.datetime(2024, 1, 1), "id long, k string, ts timestamp, v double"
    src = lambda: bars.stream_ticks(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema, 1)
    run = lambda: bars.run_to_parts(src().withColumnRenamed("v", "x"), str(tmp_path / "out"), lambda t: bars.partial_bars(t, "k", "ts", "id", "x"))
    add = lambda hours: spark.createDataFrame([(i, "a", t0 + dt.timedelta(hours=i), float(i)) for i in hours], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(range(100, 200)), run()
    add(range(100)), run()  # days behind the newest
    run()
    got = bars.fold_bars(spark.read.parquet(str(tmp_path / "out/parts")), "k").select("bar_time", "open", "high", "low", "close", "volume", "amount").collect()
    days = [range(24 * d, min(24 * d + 24, 200)) for d in range(9)]
    assert bag(got) == bag([(t0 + dt.timedelta(days=i), float(r[0]), float(r[-1]), float(r[0]), float(r[-1]), len(r), float(sum(r))) for i, r in enumerate(days)])


DRIFT = [
    (1, "s", 1, "datetime,open,close,zz_quux\n2023-01-03 10:00,5.18,5.19,3\n"),
    (2, "s", 2, "datetime,open_it,closing,zz_quux\n2023-01-04 10:00,5.28,5.29,4\n"),  # renamed from listed headers
    (3, "s", 3, "closing,open_it,datetime\n5.39,5.38,2023-01-05 10:00\n"),  # paired with the unlisted ones before
    (4, "r", 1, "datetime,vol_um,low\n2023-01-03 10:00,7,5.01\n"),  # listed in a later file only
    (5, "r", 2, "datetime,vol_um,low_\n2023-01-04 10:00,8,5.02\n"),
    (6, "r", 3, "datetime,volume,low_\n2023-01-05 10:00,9,5.03\n"),
    (7, "q", 1, ""),
]


def test_projections_follow_the_edit_scripts(spark):
    df = spark.createDataFrame(DRIFT, "file_id long, symbol string, blk int, raw_text string").withColumn("exchange", F.lit("SH"))
    schemas = minute_csv.file_schemas(df).join(df.drop("raw_text"), "file_id")
    learned = schema_drift.learned_columns(schemas, ["symbol"], "blk", ["blk", "file_id"])
    got = {r["file_id"]: r for r in minute_csv.project(df.join(learned, "file_id", "left")).collect()}
    assert {i: (r["open"], r["close"], r["volume"], r["low"], r["others"]) for i, r in got.items()} == {
        1: (5.18, 5.19, None, None, {"zz_quux": "3"}), 2: (5.28, 5.29, None, None, {"zz_quux": "4"}), 3: (5.38, 5.39, None, None, None),
        4: (None, None, 7, 5.01, None), 5: (None, None, 8, 5.02, None), 6: (None, None, 9, 5.03, None),
    }
    assert schema_drift.learned_columns(schemas.limit(0), ["symbol"], "blk", ["blk", "file_id"]).count() == 0


@needs_tables
def test_p7_table_has_every_bar_row(spark):
    files = {r["file_id"]: r for r in spark.read.parquet(f"{DATA}/csv_files.parquet").collect() if r["exchange"] and r["symbol"]}
    texts = {r["file_id"]: r["raw_text"] for r in spark.read.parquet(f"{DATA}/csv_contents.parquet").collect()}
    want = [(i, f"{files[i]['symbol']}.{files[i]['exchange']}", *b[2:]) for i, t in texts.items() if i in files for b in minute_csv.read_bars(t)]
    got = entry.queries()["p7_table"](spark, DATA).select("file_id", "ticker", *minute_csv.FIELDS).collect()
    assert want and bag(got) == bag(want)


def test_status_pivot_counts_every_record(spark, tmp_path):
    states = ["development", "testing", "active", "deprecated", "retired", None]
    rows = [(c, s) for i, s in enumerate(states) for c in ("a", None) for _ in range(i + 1)]
    spark.createDataFrame(rows, "category string, status string").write.parquet(str(tmp_path / "factor_lifecycle.parquet"))
    got = entry.queries()["t_status_pivot_all"](spark, str(tmp_path)).select("category", "development", "testing", "active", "deprecated", "other").collect()
    assert bag(got) == bag([(c, 1, 2, 3, 4, 11) for c in ("a", "none")])
    assert sum(sum(r[1:]) for r in got) == len(rows)


def test_hot_ranges_are_folded_not_gathered(spark):
    rng = random.Random(2)
    at = dt.datetime(2023, 7, 3)
    line = lambda f, k: f"{at + dt.timedelta(minutes=k):%Y-%m-%d %H:%M},{5 + f % 3}.5,{rng.choice(['6.5', 'NA', '--'])}"
    texts = [(f, "datetime,open,close\n" + "\n".join(line(f, k) for k in rng.sample(range(40), 12))) for f in range(1, 31)]
    texts += [(40 + f, "datetime,open,close\n2023-09-01 10:00,1.5,2.5\n") for f in range(3)]
    files = spark.createDataFrame([(f, "SH", "1") for f, _ in texts], "file_id long, exchange string, symbol string")
    runs = minute_csv.sorted_runs(spark.createDataFrame(texts, "file_id long, raw_text string")).join(files, "file_id")
    folded, merged = (bag(compaction.merge_runs(runs, most=n).select("minute", *minute_csv.FIELDS, "file_ids").collect()) for n in (5, 1000))
    assert folded == merged and max(len(r[-1]) for r in folded) > 5 and min(len(r[-1]) for r in folded) >= 1
    assert compaction.merge_runs(runs.limit(0), most=5).count() == 0


def test_unlisted_time_headers_give_bars(spark, tmp_path):
    texts = [
        (1, "datetime,open,close\n2023-01-03 10:00,5.18,5.19\n"), (2, "vom,open_it,close,zahl\n2023-01-03 10:00,5.18,5.19,1688381161\n2023-01-04 10:00,5.28,5.29,5\n"),
        (3, "zahl,stempel,close_\n7,1688381160,5.39\n"), (4, "a,b\n1,x\n2,y\n"), (5, "datetime,open\n"), (6, None),
    ]
    spark.createDataFrame(texts, "file_id long, raw_text string").write.parquet(str(tmp_path / "csv_contents.parquet"))
    spark.createDataFrame([(i, "SH", "1", "2023", str(i)) for i, _ in texts], "file_id long, exchange string, symbol string, year string, month string").write.parquet(str(tmp_path / "csv_files.parquet"))
    q = lambda name: entry.queries()[name](spark, str(tmp_path))
    assert bag(q("p5_bars").select("bar_minute", "open", "close", "n_files").collect()) == bag([("2023-01-03 10:00", 5.18, 5.19, 2), ("2023-01-04 10:00", 5.28, 5.29, 1), ("2023-07-03 10:46", None, 5.39, 1)])
    assert bag(q("p5_found").collect()) == bag([(1, 2)])
    assert bag(q("p5_unread").collect()) == bag([(4, 2)])
    assert {tuple(r) for r in q("p7_found").collect()} >= {(2, "renamed", "vom"), (3, "renamed", "stempel"), (3, "renamed", "close_")}


def test_range_metadata_describes_the_files(spark, tmp_path):
    rows = [("SH", f"{i % 7}", i, *[float(i)] * len(minute_csv.FIELDS), [i]) for i in range(5000)]
    ddl = "exchange string, symbol string, minute bigint, " + ", ".join(f"{f} double" for f in minute_csv.FIELDS) + ", file_ids array<bigint>"
    compaction.write_consolidated(spark.createDataFrame(rows, ddl), str(tmp_path / "out"), 40_000)
    ranges = {r["file"]: r for r in spark.read.parquet(str(tmp_path / "out/ranges")).collect()}
    parts = list((tmp_path / "out/bars").glob("*.parquet"))
    assert len(parts) > 2 and {p.name for p in parts} == set(ranges) and sum(r["rows"] for r in ranges.values()) == 5000
    for p in parts:
        keys = [tuple(r) for r in spark.read.parquet(str(p)).select("exchange", "symbol", "minute").collect()]
        r = ranges[p.name]
        assert (len(keys), p.stat().st_size, min(keys), max(keys)) == (r["rows"], r["bytes"], tuple(r["first_key"]), tuple(r["last_key"]))
        assert keys == sorted(keys)


@needs_tables
def test_upsert_of_every_factor(spark):
    c = duckdb.connect()
    c.sql(f"create view factor_values as select * from read_parquet('{DATA}/factor_values.parquet')")
    sql, want = entry.oracle_sql()["t_upsert"], []
    for (f,) in c.sql("select distinct factor_name from factor_values where factor_name is not null").fetchall():
        want += [(f, *r) for r in c.sql(f"select ticker, score, n from ({sql.replace('composite_score', f)})").fetchall()]
    got = entry.queries()["t_upsert_all"](spark, DATA).select("factor_name", "ticker", "score", "n").collect()
    assert len({r[0] for r in want}) > 1 and bag(got) == bag(want)
