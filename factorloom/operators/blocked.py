"""Values carried along an order within a key, in blocks, so that no key gathers in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: Column, name: str, forward: bool = True) -> DataFrame:
    """Adds `name`: the last non-null `value` before each row (after it, if not forward).

    `block` must not decrease along `order` within a key. Each (key, block) is scanned on
    its own; the value a block begins with comes from the block summaries, of which a key
    has as many as blocks. Rows that are equal in `order` must be distinct in it for a
    defined result; null keys form one key.
    """
    s = df.withColumn("_value", value)
    by = F.struct(*order)
    pick = F.max_by if forward else F.min_by
    ends = s.where(F.col("_value").isNotNull()).groupBy(*keys, block).agg(pick("_value", by).alias("_end"))
    every = s.select(*keys, block).distinct()
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in [*keys, block]]
    ends = every.join(ends, same(every, ends), "left").select(every["*"], ends["_end"])
    along = Window.partitionBy(*keys).orderBy(F.col(block).asc() if forward else F.col(block).desc()).rowsBetween(Window.unboundedPreceding, -1)
    into = ends.withColumn("_into", F.last("_end", ignorenulls=True).over(along)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, block])], "_into")
    within = Window.partitionBy(*keys, block).orderBy(*[F.col(o).asc() if forward else F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    here = s.withColumn("_here", F.last("_value", ignorenulls=True).over(within))
    on = [here[k].eqNullSafe(into[f"_k{i}"]) for i, k in enumerate([*keys, block])]
    return here.join(into, on, "left").withColumn(name, F.coalesce("_here", "_into")).drop("_value", "_here", "_into", *[f"_k{i}" for i in range(len(keys) + 1)])


def carry_both(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: Column, before: str, after: str) -> DataFrame:
    """Adds `before` and `after`: the nearest non-null `value` before and after each row, as two `carry`s in one pass.

    Null keys match nothing but themselves. The blocks' ends are one partial aggregate, joined once;
    the two scans of a block share its shuffle.
    """
    s = df.withColumn("_value", value)
    by = F.struct(*order)
    known = F.col("_value").isNotNull()
    ends = s.groupBy(*keys, block).agg(F.min_by("_value", F.when(known, by)).alias("_first"), F.max_by("_value", F.when(known, by)).alias("_last"))
    blocks = Window.partitionBy(*keys)
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # each way its own order: a frame that reaches to the end is scanned anew for every row
    into = ends.withColumn("_into", F.last("_last", ignorenulls=True).over(past(blocks.orderBy(F.col(block).asc()))))
    into = into.withColumn("_from", F.last("_first", ignorenulls=True).over(past(blocks.orderBy(F.col(block).desc()))))
    into = into.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, block])], "_into", "_from")
    within = Window.partitionBy(*keys, block)
    here = s.withColumn("_before", F.last("_value", ignorenulls=True).over(past(within.orderBy(*[F.col(o).asc() for o in order]))))
    here = here.withColumn("_after", F.last("_value", ignorenulls=True).over(past(within.orderBy(*[F.col(o).desc() for o in order]))))
    on = [here[k].eqNullSafe(into[f"_k{i}"]) for i, k in enumerate([*keys, block])]
    out = here.join(into, on, "left").withColumns({before: F.coalesce("_before", "_into"), after: F.coalesce("_after", "_from")})
    return out.drop("_value", "_before", "_after", "_into", "_from", *[f"_k{i}" for i in range(len(keys) + 1)])
