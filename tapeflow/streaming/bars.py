"""Ticks to intraday bars: batch and streaming forms of the same aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, glob: str = "events*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream; ``files_per_batch`` only sets the size of a micro-batch, never what comes out."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
    return (r if files_per_batch is None else r.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def partial_bars(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Bars of some of the ticks (symbol, ts, price, volume, seq), in a form that ``merged_bars`` can add up."""
    order = F.struct("ts", "seq")
    px, v = F.col("price"), F.col("volume")
    return (ticks.groupBy(F.window("ts", width).alias("w"), "symbol")
            .agg(F.min(F.struct(order.alias("at"), px.alias("price"))).alias("first"), F.max(px).alias("high"), F.min(px).alias("low"),
                 F.max(F.struct(order.alias("at"), px.alias("price"))).alias("last"), F.sum(v).alias("volume"), F.sum(px * v).alias("turnover"),
                 F.count(F.lit(1)).alias("ticks"))
            .select("symbol", F.col("w.start").alias("bar_start"), "first", "high", "low", "last", "volume", "turnover", "ticks"))


def merged_bars(parts: DataFrame) -> DataFrame:
    """One bar per (symbol, bar_start) from any split of its ticks into partial bars."""
    return (parts.groupBy("symbol", "bar_start")
            .agg(F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"),
                 F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"), F.sum("ticks").alias("ticks"))
            .select("symbol", "bar_start", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume", "turnover", "ticks"))


def tick_bars(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    """OHLCV bars of a batch of ticks (symbol, ts, price, volume, seq)."""
    return merged_bars(partial_bars(ticks, width))


def run_bars(ticks: DataFrame, out: str, checkpoint: str, width: str = "5 minutes", **trigger) -> StreamingQuery:
    """Write the partial bars of every micro-batch below ``out``.

    A tick that comes late adds a partial bar of its own, so nothing waits for a watermark and nothing is dropped;
    ``merged_bars`` over the folder equals the bars of all ticks after any cut into batches. A replayed batch
    overwrites its own folder.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        partial_bars(batch, width).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return ticks.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def session_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted mean price of the day so far. A day has at most 288 five-minute bars per symbol."""
    w = (Window.partitionBy("symbol", F.to_date("bar_start")).orderBy("bar_start")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return bars.withColumn("vwap", F.try_divide(F.sum("turnover").over(w), F.sum("volume").over(w)))


def rolling_volume(ticks: DataFrame, width: str = "30 minutes", slide: str = "5 minutes") -> DataFrame:
    """Tick volume in sliding windows. Ticks are summed per slide first; only those sums are repeated for the windows."""
    step = ticks.groupBy(F.window("ts", slide).alias("s"), "symbol").agg(F.sum("volume").alias("volume")).select(F.col("s.start").alias("ts"), "symbol", "volume")
    return (step.groupBy(F.window("ts", width, slide).alias("w"), "symbol").agg(F.sum("volume").alias("volume"))
            .select("symbol", F.col("w.start").alias("window_start"), "volume"))
