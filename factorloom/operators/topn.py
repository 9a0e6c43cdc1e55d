"""Top N items of every group by a mergeable bounded heap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def top_n(df: DataFrame, groups: Sequence[str], score: str, ident: str, n: int, rank: str = "rank_no") -> DataFrame:
    """The n items of highest score of each group, ranked 1..n; equal scores by ident ascending.

    Method: a JVM aggregate holding a heap of at most n (score, ident) entries per
    group. Spark builds it before the shuffle and merges the heaps afterwards, so a
    group of millions of items sends n entries per map task, whatever its share of the
    rows; there is no sort of the group and no window.

    Null, NaN and infinite scores and null idents are not ranked. A group left empty
    gives no row; null group keys form a group. Repeated (score, ident) entries each
    take a rank, so deduplicate first where rows may repeat. Columns out: groups,
    rank (int), ident, score.
    """
    s = F.col(score).cast("double")
    usable = df.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf"))) & F.col(ident).isNotNull())
    item = F.struct((F.lit(0.0) - s).alias("_neg"), F.col(ident).alias("_id"))
    heaps = usable.groupBy(*groups).agg(InternalFunction.collect_top_k(item, n, True).alias("_top"))
    return heaps.select(*groups, F.posexplode("_top").alias("_pos", "_item")).select(
        *groups, (F.col("_pos") + 1).cast("int").alias(rank), F.col("_item._id").alias(ident), (F.lit(0.0) - F.col("_item._neg")).alias(score)
    )
