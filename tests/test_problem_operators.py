"""The general problem operators against brute force, with nulls, ties, repeated rows, empty tables, extra columns."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import anomalies, asof, blocked, compaction, fill, rolling_totals, schema_drift, skew, topn
from factorloom.operators.versions import latest_version
from factorloom.sources import minute_csv

from util import bag

NAN, INF = float("nan"), float("inf")


def test_latest_version(spark):
    rows = [("a", 1, 1.0), ("a", 2, None), ("a", 1, 5.0), ("b", None, 3.0), ("b", None, 4.0), (None, 1, 2.0), ("a", 2, None)]
    df = spark.createDataFrame(rows, "k string, v int, x double")
    assert bag(latest_version(df, ["k"], "v", ["x"]).collect()) == bag([("a", None), ("b", 4.0), (None, 2.0)])
    assert latest_version(df.limit(0), ["k"], "v", ["x"]).count() == 0


def test_top_n_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randint(0, 4)}" if rng.random() > 0.05 else None, f"t{i:03d}", rng.choice([1.0, 2.0, 3.0, None, NAN, INF, -INF, -0.0, 0.0, rng.random()]), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "grp string, id string, s double, _top string").repartition(7)
    got = topn.top_n(df, ["grp"], "s", "id", 10).select("grp", "rank_no", "id").collect()
    want = []
    by = defaultdict(list)
    for g, i, s, _ in rows:
        if s is not None and np.isfinite(s):
            by[g].append((-s, i))
    for g, items in by.items():
        want += [(g, k + 1, i) for k, (_, i) in enumerate(sorted(items)[:10])]
    assert bag(got) == bag(want)
    assert topn.top_n(df.limit(0), ["grp"], "s", "id", 3).count() == 0


def test_rolling_totals_brute_force(spark):
    rng = random.Random(5)
    rows = [(t, d, rng.choice([None, NAN, float(rng.randint(-5, 50))]), 1.0) for t in ("a", "b") for d in sorted(rng.sample(range(-40, 900), 150))] + [("c", 7, 2.0, None), (None, 3, 1.0, 1.0), ("d", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, day int, v double, _shard double")
    got = {(r["ticker"], r["day"]): r for r in rolling_totals.rolling_totals(df, "ticker", "day", ["v"], (7, 30)).collect()}
    value = {(t, d): (0.0 if v is None or np.isnan(v) else v) for t, d, v, _ in rows}
    known = {(t, d) for t, d, v, _ in rows if v is not None and not np.isnan(v)}
    for t in ("a", "b", "c"):
        days = [d for x, d, _, _ in rows if x == t]
        for d in range(min(days), max(days) + 1):
            r = got.pop((t, d))
            for w in (7, 30):
                assert r[f"v_{w}"] == sum(value.get((t, e), 0) for e in range(d - w + 1, d + 1))
                assert r[f"v_{w}_n"] == sum((t, e) in known for e in range(d - w + 1, d + 1))
            assert r["age"] == d - min(days)
    assert not got
    assert rolling_totals.rolling_totals(df.limit(0), "ticker", "day", ["v"]).count() == 0


def test_late_correction_touches_ancestors_only():
    leaves = np.arange(8.0)
    tree = rolling_totals.build_trees(leaves[None])
    before = tree.copy()
    rolling_totals.correct_trees(tree, np.array([0]), np.array([5]), np.array([10.0]))
    assert (tree != before).sum() == 4
    leaves[5] += 10
    assert (tree == rolling_totals.build_trees(leaves[None])).all()


def test_corrections_extend_spans_and_create_shards(spark):
    rng = random.Random(3)
    base = [("a", d, float(rng.randint(0, 9))) for d in range(100, 111)] + [("b", d, float(d)) for d in (500, 700)] + [("q", 5, 1.0)]
    late = [("a", 90, 5.0), ("a", 105, -2.0), ("a", 115, 7.0), ("a", 900, 3.0), ("b", 712, 4.0), ("b", 728, 6.0), ("new", 40, 8.0), ("new", 300, 9.0), (None, 4, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(base, "ticker string, day int, v double")
    fixes = spark.createDataFrame([(t, d, v, 0 if (t, d) == ("a", 105) else 1) for t, d, v in late], "ticker string, day int, delta double, added int")
    trees = rolling_totals.tree_table(df, "ticker", "day", "v")
    got = {(r["ticker"], r["day"]): (r["total_7"], r["total_30"], r["n_30"]) for r in rolling_totals.totals_from_trees(rolling_totals.correct_tree_table(trees, fixes, "ticker", "day"), "ticker", "day", (7, 30)).collect()}
    sums, days = {}, {}
    for t, d, v in [*base, *late]:
        if t and d is not None:
            sums[t, d] = sums.get((t, d), 0.0) + v
            days.setdefault(t, set()).add(d)
    for t, ds in days.items():
        for d in range(min(ds), max(ds) + 1):
            assert got.pop((t, d)) == (sum(sums.get((t, e), 0) for e in range(d - 6, d + 1)), sum(sums.get((t, e), 0) for e in range(d - 29, d + 1)), sum(e in ds for e in range(d - 29, d + 1))), (t, d)
    assert not got


def test_parse_day(spark):
    cases = {"20240229": "2024-02-29", "20230229": None, "2024-1-5": "2024-01-05", "2024/03/02": "2024-03-02", "2024-09-26 09:30:00": "2024-09-26", "2021Q2": "2021-06-30", "n/a": None, "": None, None: None, "2024-13-01": None, " 20240101 ": "2024-01-01", "2024-01/02": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for r in df.select("t", "want", F.date_format(asof.parse_day(F.col("t")), "yyyy-MM-dd").alias("got")).collect():
        assert r["got"] == r["want"], r


def test_interval_join_brute_force(spark):
    rng = random.Random(8)
    recs = [(rng.choice("abc"), rng.randint(0, 2000), rng.randint(0, 50)) for _ in range(60)] + [("a", 5, 5), ("a", 5, 5), (None, 4, 1), ("a", None, 2)]
    events = [(i, "a" if i % 3 else rng.choice("abcz"), s, s + rng.choice([0, 0, 400])) for i, s in enumerate(rng.randint(-10, 2500) for _ in range(300))] + [(900, None, 3, 3), (901, "a", 9, 5), (902, "a", None, 5)]
    c = spark.createDataFrame(recs, "k string, at int, r int")
    e = spark.createDataFrame(events, "id int, k string, s int, e int")
    iv = asof.validity_intervals(c, ["k"], "at", ["r"])
    got = asof.interval_join(e, iv, ["k"], "s", "e", "id", bucket_days=100, share=0.2, salts=4).select("id", "r").collect()
    want = []
    for i, k, s, t in events:
        if k is None or s is None or s > t:
            continue
        held = set()
        for d in range(s, t + 1):
            known = [r for kk, at, r in recs if kk == k and at is not None and at <= d]
            if known:
                held.add(max(known))
        want += [(i, r) for r in held]
    assert bag(got) == bag(want)
    assert asof.interval_join(e.limit(0), iv, ["k"], "s", "e", "id").count() == 0


def test_salted_join_equals_join(spark):
    a = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id int, k string")
    b = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left"):
        got = skew.salted_join(a, b, ["k"], "id", how, share=0.1, salts=5).select("id", "k", "v").collect()
        assert bag(got) == bag(a.join(b, ["k"], how).select("id", "k", "v").collect())


def _daily(values):
    day = dt.date(2024, 1, 1)
    return [("t", day + dt.timedelta(i), *v) for i, v in enumerate(values)]


def test_implausible_readings(spark):
    rng = np.random.default_rng(1)
    close = list(np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.01, 120))), 2))
    vol = list(np.round(np.exp(rng.normal(11, 0.3, 120))))
    close[60:] = [c / 2 for c in close[60:]]  # a split is no spike
    close[30] *= 10
    close[80] = -1.0
    for i in range(90, 95):
        close[i] = 33.0
    vol[40], vol[41] = vol[40] * 100, vol[41] * 100
    vol[50] = 0.0
    vol[70] = -3.0
    df = spark.createDataFrame(_daily([(None if i == 10 else float(c), float(v)) for i, (c, v) in enumerate(zip(close, vol))]), "ticker string, day date, close double, volume double")
    charts = (anomalies.Chart("close", 0.0, log=True, walk=True), anomalies.Chart("volume", 0.0, strict=True, log=True, limit=7.0, least=2.3))
    got = {((r["day"] - dt.date(2024, 1, 1)).days, r["field_name"], r["kind"]) for r in anomalies.implausible_readings(df, "ticker", "day", charts, idle="volume").collect()}
    assert got == {(30, "close", "spike"), (80, "close", "impossible"), (40, "volume", "spike"), (41, "volume", "spike"), (70, "volume", "impossible"), *((i, "close", "stuck") for i in range(90, 95))}
    assert anomalies.implausible_readings(df.limit(0), "ticker", "day", charts).count() == 0
    assert anomalies.implausible_readings(df.limit(1), "ticker", "day", charts).count() == 0


def test_run_lengths():
    x = np.array([[1.0, 1, NAN, 1, 2, 2, 2]])
    assert anomalies.run_lengths(x).tolist() == [[2, 2, 0, 1, 3, 3, 3]]


def test_fill_numeric(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{i}", d, float(np.exp(i % 5 + 0.01 * d + rng.normal(0, 0.05)))) for i in range(20) for d in range(30)]
    holes = {(f"t{i}", i) for i in range(20)}
    data = [(t, d, None if (t, d) in holes and int(t[1:]) % 2 else (999999.0 if (t, d) in holes else v)) for t, d, v in rows] + [("none", 1, None), ("none", 2, NAN), (None, 1, 3.0), ("t0", 1, rows[1][2])]
    df = spark.createDataFrame(data, "g string, t int, x double")
    got = fill.fill_numeric(df, "g", "t", {"x": fill.usable_ratio(F.col("x"))}).collect()
    true = {(t, d): v for t, d, v in rows}
    filled = {(r["g"], r["t"]): r["value"] for r in got if r["filled"]}
    assert set(filled) == holes
    assert max(abs(np.log(v / true[k])) for k, v in filled.items()) < 0.25
    assert [r["value"] for r in got if r["g"] == "none"] == [None, None]
    assert fill.fill_numeric(df.limit(0), "g", "t", {"x": fill.usable_ratio(F.col("x"))}).count() == 0


def test_fill_category(spark):
    rows = [("u", 1, 10, None), ("u", 2, 20, "a"), ("u", 3, 20, "N/A"), ("u", 4, 90, "b"), ("u", 5, 95, " "), ("u", 5, 95, " "), ("w", 6, 1, "null"), (None, 7, 1, "z"), ("u", 8, 30, "unknown")]
    df = spark.createDataFrame(rows, "u string, id int, at int, name string")
    got = fill.fill_category(df, "u", ["at", "id"], F.floor(F.col("at") / 25), fill.usable_text(F.col("name")), ["id"]).collect()
    assert {(r["id"], r["value"], r["filled"]) for r in got} == {(1, "a", True), (2, "a", False), (3, "a", True), (4, "b", False), (5, "b", True), (6, None, False), (8, "a", True)}
    # no value repeats the one before: both names are as probable as their shares
    assert all(r["confidence"] == 0.5 for r in got if r["filled"])


def test_fill_category_takes_the_most_probable(spark):
    steady = [("u", i, "a") for i in range(5)] + [("u", 5, None)] + [("u", i, "b") for i in range(6, 9)] + [("u", 9, "")]
    wild = [("v", 2 * i + 1, "c" if i % 2 else f"x{i}") for i in range(20)] + [("v", 40, None)]
    fitted = {}
    for name, rows in (("steady", steady), ("wild", [*wild, ("v", 41, "y"), ("v", 42, None)])):
        df = spark.createDataFrame(rows, "u string, id int, name string")
        got = fill.fill_category(df, "u", ["id"], F.floor(F.col("id") / 4), fill.usable_text(F.col("name")), ["id"]).collect()
        fitted[name] = {r["id"]: (r["value"], round(r["confidence"], 6)) for r in got if r["filled"]}
    p = 6 / 7
    assert fitted["steady"] == {5: ("a", round(p + (1 - p) * 5 / 8, 6)), 9: ("b", round(p + (1 - p) * 3 / 8, 6))}
    assert fitted["wild"] == {40: ("c", round(10 / 21, 6)), 42: ("c", round(10 / 21, 6))}


@pytest.mark.parametrize("forward", [True, False])
def test_carry_brute_force(spark, forward):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v int").withColumn("blk", F.floor(F.col("o") / 7))
    got = blocked.carry(df, ["k"], "blk", ["o"], F.col("v"), "c", forward).select("k", "o", "c").collect()
    want = []
    for k, o, _ in rows:
        near = [v for kk, oo, v in rows if kk == k and v is not None and (oo < o if forward else oo > o)]
        want.append((k, o, (max(near) if forward else min(near)) if near else None))
    assert bag(got) == bag(want)


TEXTS = [
    (1, "﻿日期,代码,开盘价,最高价,最低价,收盘价,成交量（手）,成交额（元）\r\n2023-07-03 10:46,SH.123457,5.18,5.20,5.15,5.17,1448,\"748,712.00\"\r\n\r\n2023-07-04 10:46,SH.123457,5.18,520,5.15,5.17,--,NA\r\n"),
    (2, " datetime ; ticker ; open ; high ; low ; close ; volume \n2023/07/03 10:46;123457;5.18元;5.20;5.15;5.17;1448手\n"),
    (3, "datetime,ticker,open\n"),
    (4, ""),
    (5, None),
    (6, "datetime\tts_code\topen\thigh\tlow\tclose\tvolume\tamount\n1688381160\t123457.XSHG\t518\t520\t515\t517\t1448\t1.00\nbad\tx\t1\t1\t1\t1\t1\t1\n"),
]


def test_read_bars():
    a = minute_csv.read_bars(TEXTS[0][1])
    assert [x[0] for x in a] == sorted(x[0] for x in a) and len(a) == 2
    assert a[0][2:6] == (5.18, 5.20, 5.15, 5.17) and a[0][9] == 748712.0
    assert a[1][3] == 5.20 and a[1][8] is None
    assert minute_csv.read_bars(TEXTS[1][1])[0][0] == a[0][0] == minute_csv.read_bars(TEXTS[5][1])[0][0]
    assert minute_csv.read_bars(TEXTS[5][1])[0][2] == 5.18
    assert [len(minute_csv.read_bars(t)) for _, t in TEXTS] == [2, 1, 0, 0, 0, 1]


def test_consolidation(spark, tmp_path):
    files = spark.createDataFrame([(i, "SH", "123457", 1) for i in range(1, 7)] + [(8, None, "1", 1)], "file_id long, exchange string, symbol string, minute int")
    contents = spark.createDataFrame(TEXTS, "file_id long, raw_text string")
    merged = compaction.consolidate(files, contents)
    got = {r["minute"]: (r["file_ids"], r["amount"]) for r in merged.collect()}
    assert sorted(v[0] for v in got.values()) == [[1], [1, 2, 6]]
    assert bag(compaction.shared_bars(merged).collect()) == bag([(1, 2), (1, 6), (2, 6)])
    compaction.write_consolidated(merged, str(tmp_path / "out"), 1 << 20)
    assert spark.read.parquet(str(tmp_path / "out/bars")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/ranges")).collect()[0]["rows"] == 2
    assert compaction.consolidate(files, contents.limit(0)).count() == 0


def test_assignment_is_cheapest():
    import itertools

    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 6):
        for _ in range(20):
            c = rng.integers(0, 10, (n, n)).astype(float)
            got = sum(c[i, j] for i, j in enumerate(schema_drift.assign(c)))
            assert got == min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))


def test_edit_script_of_nested_schemas():
    n = schema_drift.Node
    a = n("", children=(n("ticker", "ticker", "text"), n("px", "", "struct", children=(n("open", "open", "decimal"), n("close", "close", "decimal")))))
    b = n("", children=(n("px", "", "struct", children=(n("open_px", "open", "decimal"), n("close", "close", "integer"), n("vol", "volume", "integer"))), n("代码", "ticker", "text")))
    kinds = {(k, x[-1] if x else "", y[-1] if y else "") for k, x, y in schema_drift.edit_script(a, b)[1] if k not in ("same", "moved")}
    assert kinds == {("renamed", "ticker", "代码"), ("renamed", "open", "open_px"), ("retyped", "close", "close"), ("added", "px", "vol")}


def test_drift_report(spark):
    rows = [(1, "s", 0, "datetime,ticker,open,close\n2023-01-03 10:00,SH.123457,5.18,5.19\n"), (2, "s", 1, "datetime,代码,open_px,vol\n1688381160,123457,5.18,7\n"), (3, "s", 1, "datetime,代码,open_px,vol\n1688381160,123457,5.18,--\n"), (4, "r", 9, "datetime\n"), (5, "r", 10, "datetime,open\n2023-01-03 10:00,5\n")]
    df = spark.createDataFrame(rows, "file_id long, symbol string, blk int, raw_text string")
    schemas = minute_csv.file_schemas(df).join(df.drop("raw_text"), "file_id")
    got = schema_drift.drift_report(schema_drift.previous_schema(schemas, ["symbol"], "blk", ["blk", "file_id"])).collect()
    assert bag(got) == bag([(2, "renamed", "代码"), (2, "retyped", "代码"), (2, "renamed", "open_px"), (2, "retyped", "datetime"), (2, "removed", "close"), (2, "added", "vol")])


def test_stored_trees_after_late_corrections(spark):
    rng = random.Random(6)
    rows = [(t, d, float(rng.randint(1, 9))) for t in "ab" for d in range(0, 700, 3)]
    fixes = [("a", 225, 5.0, 1), ("a", 226, -2.0, 1), ("b", 300, 4.0, 0), ("b", 300, 1.0, 0), ("z", 5, 1.0, 1), (None, 5, 1.0, 1)]
    trees = rolling_totals.tree_table(spark.createDataFrame(rows, "k string, day int, v double"), "k", "day", "v")
    fixed = rolling_totals.correct_tree_table(trees, spark.createDataFrame(fixes, "k string, day int, delta double, added int"), "k", "day")
    got = {(r["k"], r["day"]): (r["total"], r["n"]) for r in rolling_totals.totals_from_trees(fixed, "k", "day", 30).collect()}
    value, count = defaultdict(float), defaultdict(int)
    for t, d, v in rows:
        value[t, d] += v
        count[t, d] += 1
    for t, d, v, n in fixes:
        value[t, d] += v
        count[t, d] += n
    assert got == {(t, d): (sum(value[t, e] for e in range(d - 29, d + 1)), sum(count[t, e] for e in range(d - 29, d + 1))) for t in "ab" for d in range(700)} | {("z", 5): (1.0, 1)}
