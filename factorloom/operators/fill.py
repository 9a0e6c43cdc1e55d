"""Filling missing values from similar records, with a mask of what was filled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocked import carry_both

#: What stands for a missing text, in lower case.
MISSING_TEXTS = ("", "nan", "none", "null", "n/a", "na", "nil", "-", "--", "?", "??", "unknown", "undefined", "missing", "tbd", "无", "未知", "空")


def usable_ratio(c: Column, most: float = 9999.0) -> Column:
    """A positive finite number below the stand-ins (9999, 99999, 999999, ...); null otherwise."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < most), x)


def usable_text(c: Column) -> Column:
    """The trimmed text, null if it is one of the guises of a missing one."""
    t = F.trim(F.regexp_replace(c.cast("string"), "[\\s\\x{00A0}\\x{3000}\\x{FEFF}]+", " "))
    return F.when(~F.lower(t).isin(*MISSING_TEXTS), t)


#: Most rows of a table of effects that is broadcast (some tens of MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class _Effects:
    """Statistics of one field's values by group or time: n<i>, s<i>, q<i> (count, sum, sum of squares), and what follows from them all."""

    table: DataFrame
    by: str
    groups: int
    mean: list[float]
    ratio: list[float]

    def effect(self, i: int, mu: float) -> Column:
        """The shrunken mean of field i about mu: its deviation's sum / (n + noise / spread)."""
        n = F.col(f"n{i}")
        return F.when(n > 0, (F.col(f"s{i}") - n * F.lit(mu)) / (n + F.lit(self.ratio[i])))

    def join(self, rows: DataFrame, mus: Sequence[float], name: str) -> DataFrame:
        """rows with the effects of their group as <name><i>."""
        t = self.table.select(self.by, *[self.effect(i, mu).alias(f"{name}{i}") for i, mu in enumerate(mus)])
        return rows.join(F.broadcast(t) if self.groups <= BROADCAST_ROWS else t, self.by, "left")


def _effects(rows: DataFrame, by: str, residuals: Sequence[Column]) -> _Effects:
    """The fit of random effects by a column: sums in one partial aggregate, then the variance components by the method of moments.

    noise is the variance within the groups, spread that of their means beyond what noise
    explains. The components are one row of numbers, read by the driver.
    """
    sums = [c for i, r in enumerate(residuals) for c in (F.count(r).alias(f"n{i}"), F.coalesce(F.sum(r), F.lit(0.0)).alias(f"s{i}"), F.coalesce(F.sum(r * r), F.lit(0.0)).alias(f"q{i}"))]
    table = cut_lineage(rows.groupBy(by).agg(*sums))
    parts = []
    for i in range(len(residuals)):
        n, s, q = (F.col(f"{c}{i}") for c in "nsq")
        some = lambda c, n=n: F.when(n > 0, c)
        parts += [F.sum(n), F.sum(s), F.count(some(n)), F.sum(some(F.greatest(q - s * s / n, F.lit(0.0)))), F.var_pop(some(s / n)), F.avg(some(1 / n))]
    got = [float(x or 0) for x in table.agg(F.count(F.lit(1)), *parts).first()]
    mean, ratio = [], []
    for i in range(len(residuals)):
        n, s, groups, within, between, inverse = got[1 + 6 * i : 7 + 6 * i]
        noise = within / max(n - groups, 1.0)
        mean.append(s / n if n else 0.0)
        ratio.append(noise / max(between - noise * inverse, noise * 1e-3, 1e-9))
    return _Effects(table, by, int(got[0]), mean, ratio)


def fill_numeric(df: DataFrame, group: str, time: str, fields: dict[str, Column], rounds: int = 2) -> DataFrame:
    """Missing positive numbers predicted from their group's and time's other values.

    Mixed-effects model of the logarithm: overall mean + group effect + time effect, both
    effects random, shrunk by the variance components, fitted by `rounds` alternations.
    `fields` maps a field name to the expression that gives its usable value or null.
    Columns out: field_name, group, time, value (as recorded or filled), filled (boolean
    mask). A missing value is filled if its group holds a usable value of the field in
    another row; otherwise it stays missing and has filled = false. Exactly repeated rows
    count once; null groups or times are left out; an empty table gives no rows.

    Every statistic is a partial aggregate over all rows, for all fields at once; a group of
    a third of the rows sends its sums, not its rows. Effects are the only tables joined,
    of one row per group or time, broadcast only if counted to be few. Fitting runs jobs:
    calling this fits, reading the result predicts.
    """
    named = {f"x{i}": v for i, v in enumerate(fields.values())}
    keep = F.col(group).isNotNull() & F.col(time).isNotNull()
    rows = cut_lineage(df.where(keep).select(F.col(group).alias("_g"), F.col(time).alias("_t"), *[v.alias(k) for k, v in named.items()]).distinct())
    ys = [F.log(k) for k in named]
    by_time = _effects(rows, "_t", ys)
    mus = by_time.mean
    less = lambda name: [y - F.lit(mu) - F.coalesce(F.col(f"{name}{i}"), F.lit(0.0)) for i, (y, mu) in enumerate(zip(ys, mus, strict=True))]
    zeros = [0.0] * len(ys)
    times = by_time.join(rows, mus, "v")
    for i in range(rounds):
        by_group = _effects(times, "_g", less("v"))
        groups = by_group.join(rows, zeros, "u")
        if i + 1 < rounds:
            by_time = _effects(groups, "_t", less("u"))
            times = by_time.join(rows, zeros, "v")
    joined = by_time.join(groups, mus if rounds == 1 else zeros, "v")
    out = [
        F.struct(
            F.lit(f).alias("field_name"), F.coalesce(F.col(f"x{i}"), F.exp(F.lit(mus[i]) + F.col(f"u{i}") + F.coalesce(F.col(f"v{i}"), F.lit(0.0)))).alias("value"),
            (F.col(f"x{i}").isNull() & F.col(f"u{i}").isNotNull()).alias("filled"),
        )
        for i, f in enumerate(fields)
    ]
    return joined.select(F.col("_g").alias(group), F.col("_t").alias(time), F.explode(F.array(*out)).alias("_f")).select("_f.field_name", group, time, "_f.value", "_f.filled")


def fill_category(df: DataFrame, group: str, order: Sequence[str], block: Column, value: Column, keep: Sequence[str]) -> DataFrame:
    """Missing categories by a multinomial model of the group, conditioned on the closest record.

    P(c | closest record holds a, group) = p [c = a] + (1 - p) share of c in the group,
    where p, fitted over all rows, is the rate at which a usable value repeats the one
    before it. Filled in is the most probable category: of a and the group's most frequent
    one (the least, of equals), since every other is less probable than that; at equal
    probability a. With p of at least 0.5 that is a, whatever the shares. Closest is the
    last earlier record along `order` with a usable value, else the first later one.
    Columns out: group, keep, value (recorded or filled), filled (mask), confidence (the
    probability; 1 for recorded values). Records whose group has no usable value stay
    missing. Repeated rows count once; null groups are left out. `block` must not decrease
    along `order`; a group is scanned block by block, so a hot one is split.
    """
    rows = df.where(F.col(group).isNotNull()).select(group, *dict.fromkeys([*order, *keep]), value.alias("_v"), block.alias("_block")).distinct()
    near = carry_both(rows, [group], "_block", order, F.col("_v"), "_prev", "_next")
    rate = near.where(F.col("_v").isNotNull() & F.col("_prev").isNotNull()).agg(F.coalesce(F.avg((F.col("_v") == F.col("_prev")).cast("double")), F.lit(1.0)).alias("_p"))
    counts = rows.where(F.col("_v").isNotNull()).groupBy(group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    # of equally frequent ones the least
    modal = counts.groupBy(group).agg(F.min(F.struct((-F.col("_n")).alias("_less"), "_v")).alias("_top"), F.sum("_n").alias("_all")).select(group, F.col("_top._v").alias("_mode"), (-F.col("_top._less")).alias("_most"), "_all")
    lacking = near.where(F.col("_v").isNull()).withColumn("_near", F.coalesce("_prev", "_next")).join(modal, group, "left")
    held = counts.select(F.col(group).alias("_cg"), F.col("_v").alias("_near_v"), F.col("_n").alias("_near_n"))
    lacking = lacking.join(held, (F.col(group) == F.col("_cg")) & (F.col("_near") == F.col("_near_v")), "left").crossJoin(F.broadcast(rate))
    of_near = F.col("_p") + (1 - F.col("_p")) * F.col("_near_n") / F.col("_all")
    of_mode = (1 - F.col("_p")) * F.col("_most") / F.col("_all")
    keeps = of_near >= of_mode
    filled = lacking.select(group, *keep, F.when(F.col("_near").isNotNull(), F.when(keeps, F.col("_near")).otherwise(F.col("_mode"))).alias("value"), F.col("_near").isNotNull().alias("filled"), F.when(F.col("_near").isNotNull(), F.greatest(of_near, of_mode)).alias("confidence"))
    known = near.where(F.col("_v").isNotNull()).select(group, *keep, F.col("_v").alias("value"), F.lit(False).alias("filled"), F.lit(1.0).alias("confidence"))
    return known.unionByName(filled)
