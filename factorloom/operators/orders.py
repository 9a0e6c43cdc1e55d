"""Order execution against bars: market, limit, stop and trailing orders, brackets, per ticker."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.panel_ops import Keys


def fill_price(kind: str, side: int, level: float, o: float, h: float, lo: float) -> float | None:
    """Price at which an order fills within a bar, or None. side 1 buys, -1 sells.

    market fills at the open. limit fills at its level or better: the open, if that is
    better already. stop fills at its level or worse: the open, if the bar opens beyond it.
    """
    if kind == "market":
        return o
    if kind == "limit":
        if side * (level - o) >= 0:
            return o
        return level if lo <= level <= h else None
    if kind == "stop":
        if side * (o - level) >= 0:
            return o
        return level if lo <= level <= h else None
    raise ValueError(f"no order kind {kind}")


def bracket_trades(bars: DataFrame, entry: str, stop: float, target: float, keys: Keys = Keys(), trailing: bool = False, max_rows: int = 0, slippage: float = 0.0) -> DataFrame:
    """Long round trips: an entry flag buys at the next bar's open, under a stop and a target of shares of the fill.

    `bars` has keys, open, high, low, close and a boolean `entry`. Of a bar that touches both
    exits the stop counts. trailing: the stop follows the highest close. max_rows: sell at
    the open after so many bars. Bars with a missing price are skipped; flags while in a
    position, or on the last bar, are ignored. Columns: ticker, entry_day, exit_day,
    entry_price, exit_price, reason (stop, target, time, open at the end), trade_return.
    """
    t = bars.select(keys.ticker, keys.date, "open", "high", "low", "close", entry)
    day = t.schema[keys.date].dataType
    schema = T.StructType([t.schema[keys.ticker], T.StructField("entry_day", day), T.StructField("exit_day", day), T.StructField("entry_price", T.DoubleType()), T.StructField("exit_price", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("trade_return", T.DoubleType())])

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys.date, kind="stable").dropna(subset=["open", "high", "low", "close"])
        name, out, held, wanted = None, [], None, False
        for d, o, h, lo, c, flag in zip(*(pdf[x] for x in (keys.date, "open", "high", "low", "close", entry)), strict=True):
            if held is None and wanted:
                at = fill_price("market", 1, np.nan, o, h, lo) * (1 + slippage)
                held = {"day": d, "price": at, "stop": at * (1 - stop), "target": at * (1 + target), "rows": 0}
            elif held is not None:
                held["rows"] += 1
                exits = []
                if max_rows and held["rows"] > max_rows:
                    exits.append(("time", o))
                exits += [(r, p) for r, p in (("stop", fill_price("stop", -1, held["stop"], o, h, lo)), ("target", fill_price("limit", -1, held["target"], o, h, lo))) if p is not None]
                if exits:
                    reason, p = exits[0]
                    p *= 1 - slippage
                    out.append((held["day"], d, held["price"], p, reason, p / held["price"] - 1))
                    held = None
                elif trailing:
                    held["stop"] = max(held["stop"], c * (1 - stop))
            wanted = held is None and bool(flag)
        if held is not None:
            out.append((held["day"], None, held["price"], np.nan, "open", np.nan))
        name = pdf[keys.ticker].iat[0] if len(pdf) else None
        return pd.DataFrame([(name, *r) for r in out], columns=[f.name for f in schema.fields])

    return t.groupBy(keys.ticker).applyInPandas(path, schema)
