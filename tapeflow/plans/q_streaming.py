"""Queries over ticks, in batch and through Structured Streaming."""

from pyspark.sql import functions as F

from tapeflow.plans.fixture_sql import add_table
from tapeflow.plans.registry import query
from tapeflow.session import shared_folder
from tapeflow.sources import testdata as td
from tapeflow.streaming import alerts, opening_range
from tapeflow.streaming import bars as B

add_table("tick_bars", "ticks", """
SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS bar_start, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume, sum(price * volume) AS turnover, count(*) AS ticks FROM ticks GROUP BY 1, 2""")
START = "strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar_start"


def start(df, c="bar_start"):
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


@query("tick_bars", "X-01", f"SELECT symbol, {START}, open, high, low, close, volume, ticks FROM tick_bars", "tick_bars")
def tick_bars(spark, d):
    return start(B.tick_bars(td.ticks(spark, d))).drop("turnover")


@query("tick_session_vwap", "X-01", f"""
SELECT symbol, {START}, round(sum(turnover) OVER w / sum(volume) OVER w + 1e-7, 4) + 0.0 AS vwap FROM tick_bars
WINDOW w AS (PARTITION BY symbol, CAST(bar_start AS DATE) ORDER BY bar_start ROWS UNBOUNDED PRECEDING)""", "tick_bars")
def tick_session_vwap(spark, d):
    v = B.session_vwap(B.tick_bars(td.ticks(spark, d)))
    # Two-decimal prices over small volumes hit rounding ties; the shift moves off them.
    return start(v).select("symbol", "bar_start", (F.round(F.col("vwap") + 1e-7, 4) + 0.0).alias("vwap"))


@query("rolling_tick_volume", "X-01", """
SELECT symbol, strftime(b - to_minutes(CAST(5 * k AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(sum(volume) AS BIGINT) AS volume
FROM (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS b, volume FROM ticks), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) GROUP BY 1, 2""", "ticks")
def rolling_tick_volume(spark, d):
    return start(B.rolling_volume(td.ticks(spark, d)), "window_start")


RANGES = f"""
SELECT symbol, CAST(day AS VARCHAR) AS day, {START}, close, orb_high, orb_low, up AND NOT coalesce(seen, FALSE) AS entry, m >= 915 AS force_exit FROM (
  SELECT *, bool_or(up) OVER (PARTITION BY symbol, day ORDER BY bar_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (
    SELECT *, coalesce(m >= 15 AND close > orb_high AND m <= 810, FALSE) AS up FROM (
      SELECT *, max(CASE WHEN m < 15 THEN high END) OVER (PARTITION BY symbol, day) AS orb_high, min(CASE WHEN m < 15 THEN low END) OVER (PARTITION BY symbol, day) AS orb_low FROM (
        SELECT *, CAST(bar_start AS DATE) AS day, hour(bar_start) * 60 + minute(bar_start) AS m FROM tick_bars))))
WHERE m >= 15 AND orb_high IS NOT NULL"""


@query("opening_ranges", "X-02 I-32", RANGES, "tick_bars")
def opening_ranges(spark, d):
    o = opening_range.opening_range(B.tick_bars(td.ticks(spark, d)), "00:00")
    return start(o).withColumn("day", F.col("day").cast("string"))


def _run(spark, stream, name):
    """Run a stream over all available files into Parquet; returns the folder."""
    out, ck = shared_folder(spark, name), shared_folder(spark, f"{name}-checkpoint")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def _stored(spark, stream, name):
    return spark.read.schema(stream.schema).parquet(_run(spark, stream, name))


def _split_events(spark, d):
    """The events dealt over six files out of time order, as a stream that reads two files a batch."""
    path = shared_folder(spark, "event-files")
    events = spark.read.schema(B.EVENT_SCHEMA).parquet(f"{d}/events.parquet")
    events.repartition(6, "event_id").write.parquet(path)
    return td.tick_columns(B.read_events(spark, path, "part-*.parquet", files_per_batch=2))


def _streamed_bars(spark, d):
    out, ck = shared_folder(spark, "bar-parts"), shared_folder(spark, "bar-parts-checkpoint")
    B.run_bars(_split_events(spark, d), out, ck).awaitTermination()
    return B.merged_bars(spark.read.parquet(out))


@query("streamed_tick_bars", "X-01", f"SELECT symbol, {START}, open, high, low, close, volume, ticks FROM tick_bars", "tick_bars")
def streamed_tick_bars(spark, d):
    return start(_streamed_bars(spark, d)).drop("turnover")


@query("streamed_opening_ranges", "X-02", RANGES, "tick_bars")
def streamed_opening_ranges(spark, d):
    # The merged bars land in a table, dealt over files out of time order; the stateful stream reads two files of it a batch.
    path = shared_folder(spark, "bars-for-ranges")
    merged = _streamed_bars(spark, d).select("symbol", "bar_start", "high", "low", "close")
    merged.repartition(6, F.xxhash64("symbol", "bar_start")).write.parquet(path)
    _beat(merged, "bar_start").write.mode("append").parquet(path)
    bars = spark.readStream.schema(merged.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = start(_stored(spark, opening_range.stream_opening_range(bars, "00:00", LATENESS), "opening-ranges"))
    return out.withColumn("day", F.col("day").cast("string"))


LATENESS = "60 days"  # the files mix all days of the events


def _beat(rows, time):
    """A row far behind the last one, which moves the watermark past all others; its own state never ends. It has values everywhere, as
    conditions on them are checked before the watermark."""
    last = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return last.withColumns({time: F.expr(f"{time} + interval 100 days").cast(rows.schema[time].dataType), "symbol": F.lit("~")}).coalesce(1)


def tick_positions(spark, d):
    """Long-term positions on the tick symbols at twice their mean price."""
    return td.ticks(spark, d).groupBy("symbol").agg((F.avg("price") * 2).alias("avg_cost")).select(
        F.concat(F.lit("T"), "symbol").alias("holding_id"), "symbol", F.lit("long_term").alias("timeframe"), "avg_cost", F.lit(True).alias("is_active"))


add_table("tick_alerts", "ticks", """
SELECT 'T' || t.symbol AS holding_id, t.symbol, CAST(ts AS DATE) AS day, min(ts) AS ts FROM ticks t
JOIN (SELECT symbol, avg(price) * 2 AS avg_cost FROM ticks GROUP BY 1) p ON p.symbol = t.symbol WHERE (price - avg_cost) / avg_cost <= -0.10 GROUP BY 1, 2, 3""")


@query("tick_drawdown_alerts", "X-04 H-11", "SELECT holding_id, CAST(day AS VARCHAR) AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM tick_alerts", "tick_alerts")
def tick_drawdown_alerts(spark, d):
    a = alerts.drawdown_batch(td.ticks(spark, d), tick_positions(spark, d))
    return start(a, "ts").select("holding_id", F.col("day").cast("string"), "ts")


@query("streamed_drawdown_alerts", "X-04", "SELECT holding_id, CAST(day AS VARCHAR) AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM tick_alerts", "tick_alerts")
def streamed_drawdown_alerts(spark, d):
    path = shared_folder(spark, "ticks-for-alerts")
    ticks = td.ticks(spark, d).select("symbol", "ts", "price")
    ticks.repartition(6, F.xxhash64("symbol", "ts")).write.parquet(path)
    _beat(ticks, "ts").write.mode("append").parquet(path)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 2).parquet(path)
    a = _stored(spark, alerts.drawdown_stream(stream, tick_positions(spark, d), LATENESS), "drawdown-alerts")
    return start(a, "ts").select("holding_id", F.col("day").cast("string"), "ts")


@query("streamed_trigger_checks", "X-03 K-02", """
SELECT 'X' || symbol AS trigger_id, 'eligible' AS status FROM ticks GROUP BY symbol HAVING min(price) <= avg(price) * 0.5""", "ticks")
def streamed_trigger_checks(spark, d):
    trg = td.ticks(spark, d).groupBy("symbol").agg((F.avg("price") * 0.5).alias("buy_below_price")).select(
        F.concat(F.lit("X"), "symbol").alias("trigger_id"), "symbol", "buy_below_price", F.lit(None).cast("date").alias("expiry_date"),
        F.lit("pending").alias("status"), F.lit(None).cast("double").alias("current_price"), F.lit(None).cast("double").alias("distance_pct"))
    out, ck = shared_folder(spark, "trigger-changes"), shared_folder(spark, "trigger-checkpoint")
    written = []

    def read():
        if not written:
            return trg
        done = spark.read.parquet(*written)
        return trg.join(done.select("trigger_id").distinct(), "trigger_id", "left_anti").unionByName(done)

    def write(changes, batch_id):
        path = f"{out}/batch={batch_id}"
        changes.write.mode("overwrite").parquet(path)
        if path not in written:
            written.append(path)

    alerts.run_trigger_checks(_split_events(spark, d), read, write, "2024-01-31", ck).awaitTermination()
    return spark.read.parquet(out).select("trigger_id", "status")
