"""Accounts run from orders or signals, and what follows from their order records as table operations.

An account (`group`) is one grouped map over its rows in time order: cash and positions are a
state that no window expresses. Many accounts run side by side. Everything derived from the
order records - holdings, cash, value, trades, positions - is DataFrame plans.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel_ops import div

SIZE_KINDS = ("amount", "value", "percent", "target_amount", "target_value", "target_percent")


@dataclass(frozen=True)
class Rules:
    """How orders are executed.

    fees: share of the traded value; fixed_fees: amount per order; slippage: share of the
    price, against the trader; lot: sizes are whole multiples (0: any); least and most: size
    limits per order; partial: fill what cash allows, else reject; short: positions may turn
    negative, backed by free cash; volume_share: the most of the row's volume that fills
    (None: all), the rest of the order lapses.
    """

    cash: float = 1e6
    fees: float = 0.0
    fixed_fees: float = 0.0
    slippage: float = 0.0
    lot: float = 0.0
    least: float = 0.0
    most: float = math.inf
    partial: bool = True
    short: bool = False
    volume_share: float | None = None


@dataclass
class Account:
    """Cash, positions, last known prices and the records of one account."""

    rules: Rules
    cash: float
    held: dict[str, float] = field(default_factory=dict)
    cost: dict[str, float] = field(default_factory=dict)
    last: dict[str, float] = field(default_factory=dict)
    orders: list[tuple] = field(default_factory=list)
    log: list[tuple] = field(default_factory=list)

    def value(self) -> float:
        return self.cash + sum(n * self.last.get(a, 0.0) for a, n in self.held.items() if n)

    def wanted(self, asset: str, size: float, kind: str, price: float) -> float:
        """The signed number of shares an order asks for."""
        have = self.held.get(asset, 0.0)
        if kind == "amount":
            return size
        if kind == "target_amount":
            return size - have
        if kind in ("value", "target_value"):
            return size / price - (have if kind == "target_value" else 0.0)
        if kind == "target_percent":
            return size * self.value() / price - have
        # percent: of free cash when buying, of the position when selling
        return size * self.free() / (price * (1 + self.rules.slippage) * (1 + self.rules.fees)) if size > 0 else size * have

    def free(self) -> float:
        """Cash not bound by short positions: their proceeds and as much again back them."""
        return self.cash - 2 * sum(-n * self.last.get(a, 0.0) for a, n in self.held.items() if n < 0)

    def order(self, when: object, asset: str, size: float, kind: str, price: float, volume: float = math.nan) -> float:
        """Execute one order; returns the signed size filled. Every order leaves a line in the log."""
        r = self.rules
        if not (price > 0 and math.isfinite(price)) or size != size:
            return self._note(when, asset, size, 0.0, "no price" if size == size else "no size")
        have = self.held.get(asset, 0.0)
        want = self.wanted(asset, size, kind, price)
        side = 1 if want > 0 else -1
        amount = min(abs(want), r.most)
        if r.volume_share is not None:
            amount = min(amount, r.volume_share * volume if volume == volume else 0.0)
        at = price * (1 + side * r.slippage)
        if side > 0:
            cover = max(-have, 0.0)
            # covering a short frees the cash that backs it
            money = self.cash if cover else self.free()
            limit = (money - r.fixed_fees) / (at * (1 + r.fees))
        elif r.short:
            limit = max(have, 0.0) + max(self.free() - r.fixed_fees, 0.0) / (at * (1 + r.fees))
        else:
            limit = max(have, 0.0)
        if amount > limit * (1 + 1e-12):
            if not r.partial and math.isfinite(amount):
                return self._note(when, asset, want, 0.0, "not enough cash" if side > 0 else "not enough shares")
            amount = max(limit, 0.0)
        if r.lot:
            amount = math.floor(amount / r.lot + 1e-9) * r.lot
        if amount <= 1e-12 or amount < r.least:
            return self._note(when, asset, want, 0.0, "size too small")
        paid = amount * at * r.fees + r.fixed_fees
        self.cash -= side * amount * at + paid
        self.held[asset] = have + side * amount
        if abs(self.held[asset]) < 1e-9:
            self.held[asset] = 0.0
        self.orders.append((when, asset, len(self.orders), amount, at, paid, side))
        return self._note(when, asset, want, side * amount, "filled")

    def _note(self, when: object, asset: str, want: float, filled: float, status: str) -> float:
        self.log.append((when, asset, want, filled, status, self.cash))
        return filled


ORDER_FIELDS = "order_no int, size double, price double, fees double, side int"


def _order_schema(df: DataFrame, group: str, date: str, asset: str) -> T.StructType:
    return T.StructType([df.schema[group], df.schema[date], df.schema[asset], *T._parse_datatype_string(ORDER_FIELDS).fields])


def _records(account: Account, group: object, schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame([(group, *o) for o in account.orders], columns=schema.names)


def run_orders(df: DataFrame, group: str, date: str, asset: str, price: str, size: str, kind: str = "amount", rules: Rules = Rules(), volume: str | None = None, sells_first: bool = True, log: bool = False) -> DataFrame:
    """Order records of accounts that are given a size (or null) per date and asset.

    kind: what the sizes mean (SIZE_KINDS; targets are brought about, negative sizes sell).
    Assets of a group share its cash; on one date sales come first (unless not sells_first),
    then the order of asset. Sizes resolve against the account's value at the date's prices;
    a missing price keeps the last one for valuing and rejects the order. Columns: group,
    date, asset, order_no, size, price, fees, side (1 or -1). log: instead every order asked
    for, with group, date, asset, wanted, filled, status and the cash after it.
    Null groups form one account; repeated rows of a date and asset are orders of their own.
    """
    if kind not in SIZE_KINDS:
        raise ValueError(f"kind must be one of {SIZE_KINDS}")
    cols = [group, date, asset, price, size, *([volume] if volume else [])]
    schema = _order_schema(df, group, date, asset)
    if log:
        schema = T.StructType([*schema.fields[:3], *T._parse_datatype_string("wanted double, filled double, status string, cash double").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = Account(rules, rules.cash)
        for when, day in pdf.sort_values([date, asset], kind="stable").groupby(date, sort=True):
            rows = list(zip(day[asset], day[price].astype(float), day[size].astype(float), day[volume].astype(float) if volume else [math.nan] * len(day), strict=True))
            acc.last.update({a: p for a, p, _, _ in rows if p == p and p > 0})
            asked = [r for r in rows if r[2] == r[2]]
            if sells_first:
                # targets are resolved by their sign of change, at the date's opening state
                asked.sort(key=lambda r: acc.wanted(r[0], r[2], kind, r[1]) > 0 if r[1] > 0 else True)
            for a, p, s, v in asked:
                acc.order(when, a, s, kind, p, v)
        if log:
            return pd.DataFrame([(pdf[group].iat[0], *x) for x in acc.log], columns=schema.names)
        return _records(acc, pdf[group].iat[0], schema)

    return df.select(*dict.fromkeys(cols)).groupBy(group).applyInPandas(run, schema)


def run_signals(df: DataFrame, group: str, date: str, asset: str, entries: str, exits: str, close: str = "close", high: str | None = None, low: str | None = None, open_: str | None = None, size: float = math.inf, kind: str = "amount", rules: Rules = Rules(), stop: float | None = None, trail: float | None = None, take: float | None = None, hold: int | None = None, accumulate: bool = False) -> DataFrame:
    """Order records of accounts that follow entry and exit signals, with stops.

    An entry while out of the asset buys `size` (all free cash by default), an exit while in
    sells the whole position; both at once while in is an exit, while out an entry.
    accumulate lets entries add to a position. stop, take: loss and gain as shares of the
    entry price; trail: fall from the highest price since; they are checked from the row
    after the entry against low and high (the close where not given) and fill at their level,
    or at the open where it is already beyond. hold: rows after which a position is closed at
    the close. Stops go before signals; of several hit, the loss counts. Long positions only.
    """
    used = [group, date, asset, close, entries, exits, *[c for c in (high, low, open_) if c]]
    schema = T.StructType([*_order_schema(df, group, date, asset).fields, T.StructField("reason", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        acc, reasons = Account(rules, rules.cash), []
        base: dict[str, float] = {}
        peak: dict[str, float] = {}
        age: dict[str, int] = {}

        def trade(when: object, a: str, s: float, k: str, p: float, why: str) -> None:
            n = len(acc.orders)
            acc.order(when, a, s, k, p)
            if len(acc.orders) > n:
                reasons.append(why)
                if acc.held[a] <= 0:
                    base.pop(a, None)
                elif s > 0 and a not in base:
                    base[a], peak[a], age[a] = acc.orders[-1][4], p, 0

        pdf = pdf.sort_values([date, asset], kind="stable")
        cols = [pdf[c].to_numpy() for c in (date, asset)] + [pdf[c].to_numpy(float) for c in (close, high or close, low or close, open_ or close)] + [pdf[c].fillna(False).to_numpy(bool) for c in (entries, exits)]
        for when, a, c, h, lo, o, enter, leave in zip(*cols, strict=True):
            if not c > 0:
                continue
            acc.last[a] = c
            if a in base:
                age[a] += 1
                levels = [(x, why) for x, why in ((base[a] * (1 - stop) if stop is not None else None, "stop"), (peak[a] * (1 - trail) if trail is not None else None, "trail")) if x is not None]
                level, why = max(levels, default=(None, ""))
                begins = o if o > 0 and open_ else None
                if level is not None and lo <= level:
                    trade(when, a, -math.inf, "amount", min(level, begins) if begins else level, why)
                elif take is not None and h >= base[a] * (1 + take):
                    level = base[a] * (1 + take)
                    trade(when, a, -math.inf, "amount", max(level, begins) if begins else level, "take")
                elif hold is not None and age[a] >= hold:
                    trade(when, a, -math.inf, "amount", c, "hold")
                if a in base:
                    peak[a] = max(peak[a], h if h == h else c)
            inside = acc.held.get(a, 0.0) > 0
            if inside and leave:
                trade(when, a, -math.inf, "amount", c, "exit")
            elif enter and (not inside or accumulate):
                trade(when, a, size, kind, c, "entry")
        return _records(acc, pdf[group].iat[0], T.StructType(schema.fields[:-1])).assign(reason=pd.Series(reasons, dtype=object))

    return df.select(*dict.fromkeys(used)).groupBy(group).applyInPandas(run, schema)


def holding_orders(df: DataFrame, group: str, date: str, asset: str, price: str, rules: Rules = Rules()) -> DataFrame:
    """Order records of accounts that buy their one asset with all cash at its first price and keep it: no grouped map needed."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(date, asset))
    first = df.where(F.col(price) > 0).withColumn("_r", r).where("_r = 1")
    at = F.col(price) * (1 + rules.slippage)
    n = (rules.cash - rules.fixed_fees) / (at * (1 + rules.fees))
    n = F.floor(n / rules.lot) * rules.lot if rules.lot else n
    made = first.select(group, date, asset, F.lit(0).alias("order_no"), n.alias("size"), at.alias("price"), (n * at * rules.fees + rules.fixed_fees).alias("fees"), F.lit(1).alias("side"))
    return made.where("size > 0")


def asset_flow(orders: DataFrame, group: str, date: str, asset: str) -> DataFrame:
    """Shares bought less sold per group, date and asset."""
    return orders.groupBy(group, date, asset).agg(F.sum(F.col("side") * F.col("size")).alias("flow"))


def cash_flow(orders: DataFrame, group: str, date: str) -> DataFrame:
    """Cash received less paid per group and date, fees included."""
    return orders.groupBy(group, date).agg(F.sum(-F.col("side") * F.col("size") * F.col("price") - F.col("fees")).alias("flow"))


def account_values(orders: DataFrame, prices: DataFrame, group: str, date: str, asset: str, price: str, cash: float) -> DataFrame:
    """cash, asset_value, value, gross_exposure and return of every group and date of its price rows.

    `prices` has a row per group, date and asset (dense: every asset on every date of the
    group); holdings are running sums of the flow, valued at the last known price.
    """
    along = Window.partitionBy(group, asset).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    t = prices.select(group, date, asset, F.when(F.col(price) > 0, F.col(price)).alias("_p")).join(asset_flow(orders, group, date, asset), [group, date, asset], "left")
    t = t.withColumns({"_n": F.sum(F.coalesce("flow", F.lit(0.0))).over(along), "_at": F.last("_p", ignorenulls=True).over(along)})
    daily = t.groupBy(group, date).agg(F.sum(F.col("_n") * F.coalesce("_at", F.lit(0.0))).alias("asset_value"))
    days = Window.partitionBy(group).orderBy(date)
    d = daily.join(cash_flow(orders, group, date), [group, date], "left")
    d = d.withColumn("cash", F.lit(float(cash)) + F.sum(F.coalesce("flow", F.lit(0.0))).over(days.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("value", F.col("cash") + F.col("asset_value"))
    before = F.coalesce(F.lag("value").over(days), F.lit(float(cash)))
    return d.select(group, date, "cash", "asset_value", "value", div(F.col("asset_value"), F.col("value")).alias("gross_exposure"), (div(F.col("value"), before) - 1).alias("value_return"))


def exit_trades(orders: DataFrame, group: str, asset: str) -> DataFrame:
    """A row per order that reduces a long position: its size, average entry price and fees, exit price, profit and return; and an open rest.

    Entries are matched by the average price of the position (its entry fees are spread over
    the exits by size). Short selling isn't matched here. Averages within a position follow
    from running sums, as the average cost only changes on entries.
    """
    schema = T.StructType([orders.schema[group], orders.schema[asset], *T._parse_datatype_string("trade_no int, position_no int, size double, entry_price double, entry_fees double, exit_price double, exit_fees double, profit double, trade_return double, status string").fields])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        out, n, cost, fees, pos, last = [], 0.0, 0.0, 0.0, 0, 0.0
        head = (pdf[group].iat[0], pdf[asset].iat[0])
        for size, price, fee, side in pdf.sort_values("order_no")[["size", "price", "fees", "side"]].itertuples(index=False):
            last = price
            if side > 0:
                n, cost, fees = n + size, cost + size * price, fees + fee
                continue
            take = min(size, n)
            if take <= 0:
                continue
            share = take / n
            profit = take * price - cost * share - fees * share - fee
            out.append((*head, len(out), pos, take, cost / n, fees * share, price, fee, profit, profit / (cost * share), "closed"))
            n, cost, fees = n - take, cost * (1 - share), fees * (1 - share)
            if n < 1e-9:
                n, cost, fees, pos = 0.0, 0.0, 0.0, pos + 1
        if n > 0:
            profit = n * last - cost - fees
            out.append((*head, len(out), pos, n, cost / n, fees, None, 0.0, profit, profit / cost, "open"))
        return pd.DataFrame(out, columns=schema.names)

    return orders.groupBy(group, asset).applyInPandas(match, schema)


def positions(trades: DataFrame, group: str, asset: str) -> DataFrame:
    """Trades folded to positions: size-weighted prices, summed fees and profit; open if one of its trades is."""
    w = lambda c: F.sum(F.col("size") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("size")))
    g = trades.groupBy(group, asset, "position_no").agg(
        F.sum("size").alias("size"), w("entry_price").alias("entry_price"), w("exit_price").alias("exit_price"), F.sum(F.col("entry_fees") + F.col("exit_fees")).alias("fees"), F.sum("profit").alias("profit"),
        F.max(F.when(F.col("status") == "open", "open").otherwise("closed")).alias("status"), F.sum(F.col("size") * F.col("entry_price")).alias("_spent"),
    )
    return g.withColumn("position_return", div(F.col("profit"), F.col("_spent"))).drop("_spent")


def streaks(trades: DataFrame, keys: Sequence[str], order: str, profit: str = "profit") -> DataFrame:
    """Adds winning_streak and losing_streak: how many trades in a row, this one included, won or lost."""
    w = Window.partitionBy(*keys).orderBy(order)

    def run(hit: Column, name: str, df: DataFrame) -> DataFrame:
        df = df.withColumn("_b", F.sum(F.when(hit, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return df.withColumn(name, F.sum(F.when(hit, 1).otherwise(0)).over(Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_b")

    return run(F.coalesce(F.col(profit) < 0, F.lit(False)), "losing_streak", run(F.coalesce(F.col(profit) > 0, F.lit(False)), "winning_streak", trades))


def order_statistics(orders: DataFrame, group: str) -> DataFrame:
    """Counts, sizes, prices and fees of a group's orders by side."""
    pick = lambda s, c: F.avg(F.when(F.col("side") == s, F.col(c)))
    return orders.groupBy(group).agg(
        F.count(F.lit(1)).alias("orders"), F.count(F.when(F.col("side") == 1, 1)).alias("buys"), F.count(F.when(F.col("side") == -1, 1)).alias("sells"), F.max("size").alias("largest"), pick(1, "size").alias("mean_buy"), pick(-1, "size").alias("mean_sale"),
        pick(1, "price").alias("buy_price"), pick(-1, "price").alias("sale_price"), F.sum("fees").alias("fees"), F.sum(F.col("size") * F.col("price")).alias("turnover"),
    )


# Execution models --------------------------------------------------------------------------


def volume_share_fill(wanted: Column, price: Column, volume: Column, side: Column, limit: float = 0.025, impact: float = 0.1) -> tuple[Column, Column]:
    """Size filled and price of an order limited to a share of the row's volume, with a price impact of impact * (filled share)^2."""
    most = F.floor(volume * limit)
    filled = F.least(F.abs(wanted), most)
    share = F.least(F.try_divide(filled, volume), F.lit(limit))
    return F.when(filled > 0, filled).otherwise(0.0), price * (1 + side * impact * share * share)


def fixed_bps_fill(wanted: Column, price: Column, volume: Column, side: Column, bps: float = 5.0, limit: float = 0.1) -> tuple[Column, Column]:
    """Size filled within a share of the volume, at a price moved by basis points."""
    return F.least(F.abs(wanted), F.floor(volume * limit)), price * (1 + side * bps / 10_000)


def market_impact_price(price: Column, side: Column, size: Column, mean_volume: Column, volatility: Column, eta: float = 0.049) -> Column:
    """Price under square-root market impact: volatility * eta * sqrt(size / mean volume), both over the past."""
    return price * (1 + side * eta * volatility * F.sqrt(F.try_divide(size, mean_volume)))


def commission(size: Column, price: Column, per_share: float = 0.0, per_trade: float = 0.0, rate: float = 0.0, least: float = 0.0, stamp: float = 0.0, side: Column | None = None) -> Column:
    """Commission of a fill: per share, per trade and share of the value, at least `least`; stamp is a share of the value of sales."""
    value = F.abs(size) * price
    base = F.greatest(F.abs(size) * per_share + value * rate + F.lit(per_trade), F.lit(float(least)))
    return base + (F.when(side < 0, value * stamp).otherwise(0.0) if side is not None else F.lit(0.0))


def margin_interest(value: Column, days: Column, rate: float, year: int = 365) -> Column:
    """Interest of a borrowed value over days."""
    return F.abs(value) * rate * days / year
