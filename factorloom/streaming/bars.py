"""Bars from a stream of ticks: tumbling windows, closed by a watermark or folded from partial bars at the end of a bounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_ticks(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def streaming_bars(ticks: DataFrame, key: str, ts: str, tie: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Open, high, low, close, count and sum per key and window; a window closes when the watermark passes it.

    Ticks later than `late` behind the newest are dropped. State is one row per key and open window.
    """
    t = ticks.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    order = F.struct("_ts", tie)
    g = t.groupBy(key, F.window("_ts", width).alias("w")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(value).alias("volume"), F.sum(value).alias("amount")
    )
    return g.select(key, F.col("w.start").alias("bar_time"), "open", "high", "low", "close", "volume", "amount")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Process everything there is into Parquet under `folder` and stop; a rerun goes on where it ended."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def partial_bars(ticks: DataFrame, key: str, ts: str, tie: str, value: str, width: str = "1 day") -> DataFrame:
    """Bars of some of the ticks, for fold_bars: open and close still with their time and tie.

    Ticks of null key or time are in no bar; ticks of null value open and close none.
    """
    t = ticks.withColumn("_ts", F.col(ts).cast("timestamp")).where(F.col("_ts").isNotNull() & F.col(key).isNotNull())
    tick = F.when(F.col(value).isNotNull(), F.struct(F.col("_ts").alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value")))
    g = t.groupBy(key, F.window("_ts", width).alias("w")).agg(F.min(tick).alias("first"), F.max(tick).alias("last"), F.max(value).alias("high"), F.min(value).alias("low"), F.count(value).alias("volume"), F.sum(value).alias("amount"))
    return g.select(key, F.col("w.start").alias("bar_time"), "first", "last", "high", "low", "volume", "amount")


def fold_bars(parts: DataFrame, key: str) -> DataFrame:
    """The bars of all ticks from partial bars of disjoint parts of them, in whatever order the parts came."""
    g = parts.groupBy(key, "bar_time").agg(F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))
    return g.select(key, "bar_time", F.col("first.value").alias("open"), "high", "low", F.col("last.value").alias("close"), "volume", "amount")


def run_to_parts(stream: DataFrame, folder: str, part: Callable[[DataFrame], DataFrame]) -> None:
    """Process everything there is, `part` of each trigger into Parquet under `folder`/parts, and stop; a rerun goes on where it ended.

    No row is too late and none waits for a watermark. A trigger that runs again overwrites
    its own folder, so each row counts once; nothing is kept in state.
    """

    def write(batch: DataFrame, n: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{folder}/parts/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
