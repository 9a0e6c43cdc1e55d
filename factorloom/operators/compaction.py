"""Consolidation of many tiny files: k-way merge of sorted runs per key range."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.minute_csv import FIELDS, sorted_runs

MERGED_DDL = f"minute bigint, {', '.join(f'{f} double' for f in FIELDS)}, file_ids array<bigint>"


def merge_runs(runs: DataFrame, keys: tuple[str, ...] = ("exchange", "symbol"), most: int = 1000) -> DataFrame:
    """Every distinct bar once, in key order per range, with the ids of all files that hold it.

    `runs` has the keys, file_id, key_range and bars (a run sorted by minute). The runs of
    one key and range meet in one row and a heap merges them (k-way); equal minutes become
    one bar: that of the fewest missing cells, then of the lowest file_id. A range is a
    bounded stretch of time, so a hot symbol is split over its ranges; a range of more than
    `most` runs is folded minute by minute in an aggregate instead, so that its runs never
    meet in one task. Columns: keys, minute, the bar fields, file_ids (ascending, distinct).
    """
    runs = cut_lineage(runs)  # counted, then merged
    # at most one row per `most` runs
    hot = F.broadcast(runs.groupBy(*keys, "key_range").count().where(F.col("count") > most).select(*keys, "key_range"))
    few, many = (runs.join(hot, [*keys, "key_range"], how) for how in ("left_anti", "left_semi"))
    return _merge_heads(few, keys).unionByName(_fold_minutes(many, keys))


def _fold_minutes(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """merge_runs by a partial aggregate per minute."""
    bars = runs.select(*keys, "file_id", F.posexplode("bars").alias("_i", "_b")).groupBy(*keys, F.col("_b.minute").alias("minute"))
    # _i: of equal minutes of one file the run's first, as in the heap
    best = bars.agg(F.min(F.struct("_b.missing", "file_id", "_i", *[F.col(f"_b.{f}").alias(f) for f in FIELDS])).alias("_best"), F.array_sort(F.collect_set("file_id")).alias("file_ids"))
    return best.select(*keys, "minute", *[F.col(f"_best.{f}").alias(f) for f in FIELDS], "file_ids")


def _merge_heads(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """merge_runs by a heap over the runs of a range."""
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields if f.name in keys}
    met = runs.groupBy(*keys, "key_range").agg(F.collect_list(F.struct("file_id", "bars")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_runs = b.column("runs")
            run_at = all_runs.offsets.to_numpy()
            flat = all_runs.values
            ids, bars = flat.field("file_id").to_numpy(zero_copy_only=False), flat.field("bars")
            bar_at, values = bars.offsets.to_numpy(), bars.values
            minutes, lacks = values.field("minute").to_pylist(), values.field("missing").to_pylist()
            row, take, files = [], [], []
            for i in range(b.num_rows):
                heads = []
                for r in range(run_at[i], run_at[i + 1]):
                    lo, hi = int(bar_at[r]), int(bar_at[r + 1])
                    heads.append(zip(minutes[lo:hi], lacks[lo:hi], [int(ids[r])] * (hi - lo), range(lo, hi), strict=True))
                before = None
                for minute, _, file, j in heapq.merge(*heads):
                    if minute != before:
                        before = minute
                        row.append(i), take.append(j), files.append({file})
                    else:
                        files[-1].add(file)
            pick, at = pa.array(take, pa.int64()), pa.array(row, pa.int64())
            cols = [b.column(k).take(at) for k in keys] + [values.field(f).take(pick) for f in ("minute", *FIELDS)]
            cols.append(pa.array([sorted(s) for s in files], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "minute", *FIELDS, "file_ids"])

    return met.select(*keys, "runs").mapInArrow(merge, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + MERGED_DDL)


def consolidate(files: DataFrame, contents: DataFrame, range_days: int = 31) -> DataFrame:
    """The bars of all files, each bar of an exchange, symbol and minute exactly once.

    `files` locates the texts (file_id, exchange, symbol); `contents` holds them. Files
    without text, texts without file row, and files of null exchange or symbol give no bars.
    A column `learned` of contents is passed to sorted_runs.
    """
    where = files.where(F.col("exchange").isNotNull() & F.col("symbol").isNotNull()).select("file_id", "exchange", "symbol").dropDuplicates(["file_id"])
    return merge_runs(sorted_runs(contents, range_days).join(where, "file_id"))


def shared_bars(merged: DataFrame) -> DataFrame:
    """Pairs of files with a bar in common: file_id_a < file_id_b, distinct.

    The distinct sets of files are found first, so bars that the same files share count
    once; only then is a set spelled out in pairs, which is the result asked for.
    """
    sets = merged.where(F.size("file_ids") > 1).select("file_ids").distinct()
    a = sets.select("file_ids", F.posexplode("file_ids").alias("_i", "file_id_a"))
    b = a.withColumn("file_id_b", F.explode(F.expr("slice(file_ids, _i + 2, size(file_ids))")))
    return b.select("file_id_a", "file_id_b").distinct()


def range_metadata(spark: SparkSession, bars: str) -> DataFrame:
    """Per written file of bars: output_no in key order, rows, bytes of the file, first and last key."""
    key = F.struct("exchange", "symbol", "minute")
    t = spark.read.parquet(bars).select(key.alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    m = t.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.first("bytes").alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    # one row per output
    return m.select((F.row_number().over(Window.orderBy("first_key")) - 1).alias("output_no"), "rows", "bytes", "first_key", "last_key", F.element_at(F.split("file", "/"), -1).alias("file"))


def write_consolidated(merged: DataFrame, path: str, target_bytes: int = 128 << 20, outputs: int | None = None) -> None:
    """Write the merged bars as few sorted Parquet files and the range metadata of those files beside them.

    The bars are written once as they come, whose bytes give the number of outputs of about
    target_bytes (unless `outputs` is given), then again in key order; the metadata is read from the files themselves.
    All are written through Spark's committer: a lost executor reruns its task, and no
    half-written file becomes visible.
    """
    spark, staged = merged.sparkSession, f"{path}/staged"
    merged.write.mode("overwrite").parquet(staged)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    n = outputs or max(1, -(-fs.getContentSummary(folder).getLength() // target_bytes))
    order = ("exchange", "symbol", "minute")
    spark.read.schema(merged.schema).parquet(staged).repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/bars")
    fs.delete(folder, True)
    range_metadata(spark, f"{path}/bars").write.mode("overwrite").parquet(f"{path}/ranges")
