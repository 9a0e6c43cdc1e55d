"""Minute bars in CSV texts of drifting form: reading, typing and unit rules."""

from __future__ import annotations

import csv
import re
import unicodedata
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The headers known for each column, in lower case, without units in brackets.
MEANINGS = {
    "datetime": ("datetime", "date_time", "timestamp", "date", "time", "bar_time", "trade_time", "trade_date", "日期", "时间", "日期时间", "交易时间", "交易日期"),
    "ticker": ("ticker", "code", "ts_code", "symbol", "sec_code", "stock_code", "代码", "证券代码", "股票代码"),
    "open": ("open", "open_px", "open_price", "开盘价", "开盘"),
    "high": ("high", "high_px", "high_price", "最高价", "最高"),
    "low": ("low", "low_px", "low_price", "最低价", "最低"),
    "close": ("close", "close_px", "close_price", "收盘价", "收盘"),
    "pre_close": ("pre_close", "prev_close", "preclose", "昨收价", "昨收", "前收盘价", "前收盘"),
    "vwap": ("vwap", "avg_price", "average_price", "均价", "成交均价"),
    "volume": ("volume", "vol", "成交量"),
    "amount": ("amount", "amt", "turnover_value", "成交额", "成交金额"),
    "turnover_rate": ("turnover_rate", "turn", "turnover", "换手率"),
    "num_trades": ("num_trades", "trade_count", "trades", "成交笔数", "笔数"),
}
MEANING_OF = {h: m for m, hs in MEANINGS.items() for h in hs}
PRICES = ("open", "high", "low", "close", "pre_close", "vwap")
FIELDS = ("open", "high", "low", "close", "pre_close", "vwap", "volume", "amount", "turnover_rate", "num_trades")
MISSING = frozenset(("", "NA", "--"))

_INT = re.compile(r"[+-]?\d+\Z")
_DEC = re.compile(r"[+-]?(\d+\.\d*|\.\d+)\Z")
_TIME = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?\Z")
_NUMBER = re.compile(r"[+-]?\d[\d,]*(?:\.\d*)?|[+-]?\.\d+")
_INTS = re.compile(r"[+-]?\d+(?:\n[+-]?\d+)*\Z")
_DECS = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:\n[+-]?(?:\d+\.?\d*|\.\d+))*\Z")
_WHEN = r"\d{4}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?"
_TIMES = re.compile(f"{_WHEN}(?:\\n{_WHEN})*\\Z")
_BLANKS = " \t\u3000\ufeff"
_UNITS = re.compile(r"[(（\[【].*?[)）\]】]")


@lru_cache(maxsize=65_536)
def meaning(header: str) -> str | None:
    """The column a header names, or None if it isn't known."""
    h = unicodedata.normalize("NFKC", header).strip().casefold()
    return MEANING_OF.get(h) or MEANING_OF.get(re.sub(r"\s+", "_", _UNITS.sub("", h).strip()))


def cells(text: str | None) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a CSV text, any line end and separator, trimmed; blank lines are no rows."""
    whole = (text or "").lstrip("\ufeff")
    if "\r" in whole:
        whole = whole.replace("\r\n", "\n").replace("\r", "\n")
    lines = [x for x in whole.split("\n") if x and not x.isspace()]
    if not lines:
        return [], []
    sep = max(",;\t|", key=lines[0].count)
    rows = list(csv.reader(lines, delimiter=sep)) if '"' in whole else [x.split(sep) for x in lines]
    rows = [[c.strip(_BLANKS) for c in r] for r in rows]
    return rows[0], rows[1:]


def column_type(values: list[str]) -> str | None:
    """integer, decimal, timestamp or text of a column's cells, judged at once; None if every cell is missing."""
    seen = [v for v in values if v not in MISSING]
    if not seen:
        return None
    if _INT.match(seen[0]) or _DEC.match(seen[0]):
        joined = "\n".join(seen)
        return "integer" if _INTS.match(joined) else "decimal" if _DECS.match(joined) else "text"
    return "timestamp" if _TIME.match(seen[0]) and _TIMES.match("\n".join(seen)) else "text"


@lru_cache(maxsize=65_536)
def _day_minutes(y: str, m: str, d: str) -> int | None:
    """Minutes from 1970 to a day; None if there is no such day."""
    try:
        return (date(int(y), int(m), int(d)).toordinal() - 719_163) * 1440
    except ValueError:
        return None


def bar_minute(v: str) -> int | None:
    """Minutes since 1970 of a wall-clock time, or of epoch seconds; None if it is neither."""
    if m := _TIME.match(v):
        y, _, mo, d, h, mi, s = m.groups()
        h, mi = int(h or 0), int(mi or 0)
        day = _day_minutes(y, mo, d)
        return None if day is None or h > 23 or mi > 59 or s and int(s) > 59 else day + 60 * h + mi
    if _INT.match(v):
        n = int(v)
        return (n // 1000 if n >= 10**11 else n) // 60 if n > 0 else None
    return None


def number(v: str, field: str) -> float | None:
    """A cell's number without unit and separators; a price without decimal point is in hundredths."""
    if v in MISSING:
        return None
    if v.isascii() and v.replace(".", "", 1).isdigit():
        n = float(v)
    elif m := _NUMBER.search(v):
        n = float(m[0].replace(",", ""))
    else:
        return None
    return n / 100 if field in PRICES and "." not in v else n


#: Epoch seconds taken for the time of a bar where no header says so: whole minutes of 1990 to 2100.
EPOCHS = range(631_152_000, 4_102_444_800, 60)


def time_column(names: list[str | None], rows: list[list[str]]) -> int | None:
    """The first column of unlisted header whose cells are all times of day, else all epoch seconds; None if there is none."""
    epoch = None
    for i, m in enumerate(names):
        seen = [r[i] for r in rows if i < len(r) and r[i] not in MISSING] if m is None else []
        if seen and all(_TIME.match(v) and bar_minute(v) is not None for v in seen):
            return i
        if seen and epoch is None and all(_INT.match(v) and int(v) in EPOCHS for v in seen):
            epoch = i
    return epoch


def meanings(header: list[str], rows: list[list[str]]) -> list[str | None]:
    """The column each header names, the time by its cells where no header is known as it."""
    names = [meaning(h) for h in header]
    if "datetime" not in names and (t := time_column(names, rows)) is not None:
        names[t] = "datetime"
    return names


def place(header: list[str], rows: list[list[str]], learned: dict[int, str] | None = None) -> dict[str, int]:
    """The position of each known column: that of the first header that names it, else of the first column learned to hold it."""
    at: dict[str, int] = {}
    for i, m in enumerate(meanings(header, rows)):
        if m:
            at.setdefault(m, i)
    for i, m in sorted((learned or {}).items()):
        if i not in at.values():
            at.setdefault(m, i)
    return at


def read_bars(text: str | None, learned: dict[int, str] | None = None) -> list[tuple]:
    """(minute, missing cells, *FIELDS) of each bar, in order of time: a sorted run. learned: what columns of unlisted header hold."""
    header, rows = cells(text)
    at = place(header, rows, learned)
    if "datetime" not in at:
        return []
    t, cols = at["datetime"], [(f, at.get(f)) for f in FIELDS]
    out = []
    for r in rows:
        if t < len(r) and (minute := bar_minute(r[t])) is not None:
            vals = [number(r[i], f) if i is not None and i < len(r) else None for f, i in cols]
            out.append((minute, sum(v is None for v in vals), *vals))
    out.sort(key=lambda b: b[:2])
    return out


BAR = pa.struct([("minute", pa.int64()), ("missing", pa.int32()), *[(f, pa.float64()) for f in FIELDS]])
BAR_DDL = f"struct<minute:bigint,missing:int,{','.join(f'{f}:double' for f in FIELDS)}>"


def sorted_runs(contents: DataFrame, range_days: int = 31, file_id: str = "file_id", text: str = "raw_text") -> DataFrame:
    """One row per file and key range it touches: (file_id, key_range, bars sorted by time).

    A key range is `range_days` days. Null, empty and header-only texts, and texts without
    a time column, give no row; repeated times within a file stay in the run. A column
    `learned` (array of pos, meaning, or null) says what columns of unlisted header hold.
    """
    projections = ["learned"] if "learned" in contents.columns else []
    out = pa.schema([("file_id", pa.int64()), ("key_range", pa.int32()), ("bars", pa.list_(BAR))])
    step = range_days * 1440

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ranges, sizes, flat = [], [], [], []
            extra = b.column(2).to_pylist() if projections else [None] * b.num_rows
            for i, x, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), extra, strict=True):
                last = None
                for bar in read_bars(x, {y["pos"]: y["meaning"] for y in more or ()}):
                    if (k := bar[0] // step) != last:
                        ids.append(i), ranges.append(k), sizes.append(0)
                        last = k
                    sizes[-1] += 1
                    flat.append(bar)
            cols = list(zip(*flat, strict=True)) if flat else [()] * len(BAR)
            bars = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BAR, strict=True)], fields=list(BAR))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ranges, pa.int32()), pa.ListArray.from_arrays(offsets, bars)], schema=out)

    return contents.select(file_id, text, *projections).mapInArrow(runs, f"file_id bigint, key_range int, bars array<{BAR_DDL}>")


def file_schemas(contents: DataFrame, file_id: str = "file_id", text: str = "raw_text") -> DataFrame:
    """One row per file with at least one bar: file_id, columns (array of header, meaning, type, middle).

    meaning is the column the header names or empty, type null if all cells are missing,
    middle, for headers of no known meaning only, the median of the numbers in it.
    """

    kind = [("header", pa.string()), ("meaning", pa.string()), ("type", pa.string()), ("middle", pa.float64())]

    def schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, flat = [], [0], ([], [], [], [])
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                header, rows = cells(x)
                names = meanings(header, rows)
                t = names.index("datetime") if "datetime" in names else None
                rows = [r for r in rows if t is not None and t < len(r) and bar_minute(r[t]) is not None]
                if not rows:
                    continue
                even = len(rows) if all(len(r) == len(header) for r in rows) else 0
                columns = zip(*rows, strict=True) if even else ([r[j] if j < len(r) else "" for r in rows] for j in range(len(header)))
                for h, m, values in zip(header, names, columns, strict=True):
                    nums = [n for v in values if (n := number(v, "")) is not None] if m is None else []
                    for c, v in zip(flat, (h, m or "", column_type(values), float(np.median(nums)) if nums else None), strict=True):
                        c.append(v)
                ids.append(i)
                sizes.append(len(header))
            columns = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(flat, kind, strict=True)], names=[n for n, _ in kind])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), columns)], names=["file_id", "columns"])

    return contents.select(file_id, text).mapInArrow(schemas, "file_id bigint, columns array<struct<header:string,meaning:string,type:string,middle:double>>")


def project(texts: DataFrame, keys: tuple[str, ...] = ("file_id", "exchange", "symbol")) -> DataFrame:
    """Every bar row of every file on the fixed columns: keys, minute, FIELDS, others.

    `texts` has the keys, raw_text and learned (array of pos, meaning, or null), the file's
    projection beyond its listed headers. `others` are the cells of columns that have no
    place, by header. Rows without a time are no bars.
    """
    kinds = [(f.name, f.dataType.simpleString()) for f in texts.schema.fields if f.name in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, minutes, values, others = [], [], [], []
            for k, (text, learned) in enumerate(zip(b.column("raw_text").to_pylist(), b.column("learned").to_pylist(), strict=True)):
                header, rows = cells(text)
                at = place(header, rows, {x["pos"]: x["meaning"] for x in learned or ()})
                if "datetime" not in at:
                    continue
                t, cols = at["datetime"], [(f, at.get(f)) for f in FIELDS]
                rest = [(i, h) for i, h in enumerate(header) if i not in at.values()]
                for r in rows:
                    if t < len(r) and (minute := bar_minute(r[t])) is not None:
                        row.append(k), minutes.append(minute)
                        values.append([number(r[i], f) if i is not None and i < len(r) else None for f, i in cols])
                        others.append(list({h: r[i] for i, h in rest if i < len(r) and r[i] not in MISSING}.items()) or None)
            own = pa.array(row, pa.int64())
            fields = list(zip(*values, strict=True)) if values else [()] * len(FIELDS)
            made = [b.column(k).take(own) for k, _ in kinds] + [pa.array(minutes, pa.int64())] + [pa.array(c, pa.float64()) for c in fields] + [pa.array(others, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(made, names=[*(k for k, _ in kinds), "minute", *FIELDS, "others"])

    ddl = ", ".join([*(f"{k} {t}" for k, t in kinds), "minute bigint", *(f"{f} double" for f in FIELDS), "others map<string,string>"])
    return texts.select(*(k for k, _ in kinds), "raw_text", "learned").mapInArrow(run, ddl)


def unread_files(contents: DataFrame, file_id: str = "file_id", text: str = "raw_text") -> DataFrame:
    """file_id, rows of the files that hold rows but give no bar: no column is known or recognised as the time, or no cell of it is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, len(rows)) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (rows := cells(x)[1]) and not read_bars(x)]
            ids, sizes = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["file_id", "rows"])

    return contents.select(file_id, text).mapInArrow(run, "file_id bigint, rows bigint")
