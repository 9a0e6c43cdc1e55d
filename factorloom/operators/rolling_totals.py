"""Rolling totals over trailing calendar periods, by segment trees per entity and time shard."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import slices

#: Shards a worker unpacks at a time (memory bound; results don't depend on it).
SHARDS = 1000


def build_trees(leaves: np.ndarray) -> np.ndarray:
    """Segment trees in heap order from (batch, leaf) values; the number of leaves is a power of two."""
    b, n = leaves.shape
    tree = np.zeros((b, 2 * n))
    tree[:, n:] = leaves
    while n > 1:
        n //= 2
        tree[:, n : 2 * n] = tree[:, 2 * n : 4 * n : 2] + tree[:, 2 * n + 1 : 4 * n : 2]
    return tree


def query_trees(tree: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Totals over leaves [first, last] of every tree, bottom-up over at most 2 log n nodes."""
    n = tree.shape[1] // 2
    lo, hi = first + n, last + n + 1
    out = np.zeros((tree.shape[0], len(first)))
    while (open_ := lo < hi).any():
        left = open_ & (lo % 2 == 1)
        out[:, left] += tree[:, lo[left]]
        lo = lo + left
        right = open_ & (hi % 2 == 1)
        hi = hi - right
        out[:, right] += tree[:, hi[right]]
        lo, hi = lo // 2, hi // 2
    return out


def correct_trees(trees: np.ndarray, row: np.ndarray, leaf: np.ndarray, delta: np.ndarray) -> None:
    """Add late corrections to leaves of the trees (rows) in place: only the leaves' ancestors are touched."""
    node = leaf.astype(np.int64) + trees.shape[1] // 2
    while len(node) and node[0]:
        np.add.at(trees, (row, node), delta)
        node = node // 2


def shard_leaves(daily: DataFrame, entity: str, day: str, fields: Sequence[str], leaves: int, halo: int) -> DataFrame:
    """One row per entity and time shard: the days it holds, those of the halo before it included.

    Columns: entity, _shard, _lo, _hi (the entity's first and last day), _leaves (array of
    struct(leaf, one value per field)). A shard owns leaves - halo days, so its arrays are
    bounded whatever the entity's length; shards without a row are there too.
    """
    own = leaves - halo
    own_shard = F.floor(F.col(day) / own).cast("int")
    halo_to = F.floor((F.col(day) + halo) / own).cast("int")
    leaf = F.struct((F.col(day) - F.col("_shard") * own + halo).cast("int").alias("leaf"), *[F.col(f).cast("double").alias(f) for f in fields])
    spread = daily.withColumn("_shard", F.explode(F.sequence(own_shard, halo_to)))
    held = spread.groupBy(entity, "_shard").agg(F.collect_list(leaf).alias("_leaves"))
    span = daily.groupBy(entity).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    shards = span.withColumn("_shard", F.explode(F.sequence(F.floor(F.col("_lo") / own).cast("int"), F.floor(F.col("_hi") / own).cast("int"))))
    return shards.join(held, [entity, "_shard"], "left")


def _batch_trees(held: pa.ListArray, field: str, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Trees of sums and counts of one field, a pair per row of a list of struct(leaf, fields); null lists hold no day."""
    sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
    days = held.flatten()
    at = np.repeat(np.arange(len(held)), sizes)
    leaf = days.field("leaf").to_numpy(zero_copy_only=False)
    value = days.field(field).to_numpy(zero_copy_only=False).astype(float)
    sums, counts = np.zeros((len(held), leaves)), np.zeros((len(held), leaves))
    ok = ~np.isnan(value)
    np.add.at(sums, (at[ok], leaf[ok]), value[ok])
    np.add.at(counts, (at[ok], leaf[ok]), 1)
    return build_trees(sums), build_trees(counts)


def _owned(b: pa.RecordBatch, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The days each shard owns, which of them lie in its entity's span, and the span's first days."""
    shard, lo, hi = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_shard", "_lo", "_hi"))
    days = shard[:, None] * own + np.arange(own)
    return days, (days >= lo[:, None]) & (days <= hi[:, None]), lo


def rolling_totals(daily: DataFrame, entity: str, day: str, fields: Sequence[str], windows: Sequence[int] = (7, 30), leaves: int = 256) -> DataFrame:
    """Totals, averages and counts over trailing calendar days, for every day of every entity.

    `daily` has one row per entity and integer `day` number (resolve versions first: that
    is the step that folds a hot entity's repeated rows). The days from an entity's first
    to its last row come out, those without a row included. Per field f and window w:
    f_w (total; null and NaN values and absent days count as 0) and f_w_n (days holding a
    value). `age` is the number of days since the entity's first day. An average over all
    days of the window is f_w / w.

    Method: segment trees of sums and counts per entity and time shard; each day's window
    is answered from O(log w) nodes, for all shards of an Arrow batch at once. Trees
    include a halo of max(windows) - 1 days of the shard before, so that no query leaves
    its shard. An entity is cut into shards, so none is unbounded in one task. Rows with a
    null entity or day are left out; an empty table gives no rows.
    """
    halo = max(windows) - 1
    if leaves & (leaves - 1) or leaves < 2 * halo:
        raise ValueError("leaves must be a power of two and at least twice the longest window")
    own = leaves - halo
    placed = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(entity, day, *fields)
    shards = shard_leaves(placed, entity, day, fields, leaves, halo)
    out_cols = [f"{f}_{w}{k}" for f in fields for w in windows for k in ("", "_n")]
    schema = T.StructType([T.StructField(entity, placed.schema[entity].dataType), T.StructField(day, T.IntegerType()), T.StructField("age", T.IntegerType()), *[T.StructField(c, T.LongType() if c.endswith("_n") else T.DoubleType()) for c in out_cols]])
    last = np.arange(halo, leaves)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, SHARDS):
                days, inside, lo = _owned(b, own)
                cols = [b.column(entity).take(pa.array(np.repeat(np.arange(b.num_rows), inside.sum(1)))), pa.array(days[inside].astype(np.int32)), pa.array((days - lo[:, None])[inside].astype(np.int32))]
                for f in fields:
                    sums, counts = _batch_trees(b.column("_leaves"), f, leaves)
                    for w in windows:
                        cols.append(pa.array(query_trees(sums, last - w + 1, last)[inside]))
                        cols.append(pa.array(query_trees(counts, last - w + 1, last)[inside].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, names=[entity, day, "age", *out_cols])

    return shards.mapInArrow(answer, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a matrix of their own."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def tree_table(daily: DataFrame, entity: str, day: str, field: str, leaves: int = 256, halo: int = 29) -> DataFrame:
    """Stored segment trees of one field: entity, _shard, _lo, _hi, sums and counts (arrays in heap order, 2 * leaves long)."""
    placed = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(entity, day, field)
    shards = shard_leaves(placed, entity, day, [field], leaves, halo)
    kept = [f for f in shards.schema.fields if f.name != "_leaves"]
    schema = T.StructType([*kept, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("sums", "counts")]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, SHARDS):
                trees = _batch_trees(b.column("_leaves"), field, leaves)
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *map(_lists, trees)], names=schema.names)

    return shards.mapInArrow(build, schema)


def correct_tree_table(trees: DataFrame, corrections: DataFrame, entity: str, day: str, leaves: int = 256, halo: int = 29) -> DataFrame:
    """The stored trees after late corrections (entity, day, delta, added): only the changed leaves' ancestors are touched.

    delta is what the day's total changes by, added what its count does (0 for a restated
    value); null counts as 0. The corrections are summed per day first, then meet their shard -
    and the next one, where they lie in its halo - in one join; shards without a correction
    pass through. Days before an entity's first or after its last day, and new entities,
    extend the span: the shards in between are created, and the first one after the stored
    ones takes its halo from the last leaves stored. A span never shrinks.
    """
    own = leaves - halo
    shard_of = lambda c: F.floor(c / own).cast("int")
    zero = F.lit(0.0)
    daily = corrections.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(entity, day).agg(F.coalesce(F.sum(F.col("delta").cast("double")), zero).alias("delta"), F.coalesce(F.sum(F.col("added").cast("double")), zero).alias("added"))
    touched = daily.groupBy(entity).agg(F.min(day).alias("_from"), F.max(day).alias("_to"))
    stored = trees.select(entity, F.col("_lo").alias("_old_lo"), F.col("_hi").alias("_old_hi")).distinct()
    spans = touched.join(stored, entity, "left").select(entity, F.least("_from", "_old_lo").cast("int").alias("_new_lo"), F.greatest("_to", "_old_hi").cast("int").alias("_new_hi"), "_old_hi")
    needed = spans.select(entity, "_new_lo", "_new_hi", F.explode(F.sequence(shard_of(F.col("_new_lo")), shard_of(F.col("_new_hi")))).alias("_shard"))
    at = daily.withColumn("_shard", F.explode(F.sequence(shard_of(F.col(day)), shard_of(F.col(day) + halo))))
    leaf = F.struct((F.col(day) - F.col("_shard") * own + halo).cast("int").alias("leaf"), "delta", "added")
    changes = at.select(entity, "_shard", leaf.alias("_change"))
    grown = spans.where(shard_of(F.col("_new_hi")) > shard_of(F.col("_old_hi"))).select(entity, "_old_hi")
    tail = trees.join(grown, entity).where(F.col("_shard") == shard_of(F.col("_old_hi")))
    node = lambda c, i: F.element_at(F.col(c), (i + 2 * leaves - halo + 1).cast("int"))
    copied = F.transform(F.sequence(F.lit(0), F.lit(halo - 1)), lambda i: F.struct(i.cast("int").alias("leaf"), node("sums", i).alias("delta"), node("counts", i).alias("added")))
    changes = changes.unionByName(tail.select(entity, (F.col("_shard") + 1).alias("_shard"), F.explode(copied).alias("_change")))
    j = trees.join(needed.join(changes.groupBy(entity, "_shard").agg(F.collect_list("_change").alias("_changes")), [entity, "_shard"], "left"), [entity, "_shard"], "full")
    columns = [c for c in trees.columns if c not in ("_lo", "_hi")]
    j = j.select(*columns, F.coalesce("_new_lo", "_lo").alias("_lo"), F.coalesce("_new_hi", "_hi").alias("_hi"), "_changes")
    names = trees.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, SHARDS):
                made = {}
                sizes = pc.fill_null(pc.list_value_length(b.column("_changes")), 0).to_numpy(zero_copy_only=False)
                row, change = np.repeat(np.arange(b.num_rows), sizes), b.column("_changes").flatten()
                for c, by in (("sums", "delta"), ("counts", "added")):
                    have = pc.is_valid(b.column(c)).to_numpy(zero_copy_only=False)
                    nodes = np.zeros((b.num_rows, 2 * leaves))
                    nodes[have] = _matrix(b.column(c).filter(pa.array(have)))
                    correct_trees(nodes, row, change.field("leaf").to_numpy(zero_copy_only=False), change.field(by).to_numpy(zero_copy_only=False))
                    made[c] = _lists(nodes)
                yield pa.RecordBatch.from_arrays([made[n] if n in made else b.column(n) for n in names], names=names)

    return j.mapInArrow(apply, trees.schema)


def totals_from_trees(trees: DataFrame, entity: str, day: str, windows: int | Sequence[int], leaves: int = 256, halo: int = 29) -> DataFrame:
    """Total and count over the trailing window of every day of every entity, answered from stored trees.

    One window gives columns total and n, several total_<w> and n_<w>.
    """
    own, last = leaves - halo, np.arange(halo, leaves)
    ws = [windows] if isinstance(windows, int) else list(windows)
    names = ["total", "n"] if isinstance(windows, int) else [f"{c}_{w}" for w in ws for c in ("total", "n")]
    schema = T.StructType([trees.schema[entity], T.StructField(day, T.IntegerType()), *[T.StructField(n, T.LongType() if i % 2 else T.DoubleType()) for i, n in enumerate(names)]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, SHARDS):
                days, inside, _ = _owned(b, own)
                sums, counts = _matrix(b.column("sums")), _matrix(b.column("counts"))
                cols = [b.column(entity).take(pa.array(np.repeat(np.arange(b.num_rows), inside.sum(1)))), pa.array(days[inside].astype(np.int32))]
                for w in ws:
                    cols += [pa.array(query_trees(sums, last - w + 1, last)[inside]), pa.array(query_trees(counts, last - w + 1, last)[inside].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=[entity, day, *names])

    return trees.mapInArrow(answer, schema)
