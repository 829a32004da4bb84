"""Trigger eligibility and drawdown alerts on a stream of prices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeflow.operators.triggers import check_triggers
from tapeflow.params import DEFAULTS


def batch_prices(ticks: DataFrame) -> DataFrame:
    """Last and lowest price per symbol of a micro-batch."""
    return ticks.groupBy("symbol").agg(F.max_by("price", "ts").alias("price"), F.min("price").alias("low"))


def run_trigger_checks(ticks: DataFrame, read_triggers: Callable[[], DataFrame], write_changes: Callable[[DataFrame, int], None],
                       as_of: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Check the pending triggers against every micro-batch of prices.

    ``read_triggers`` returns the snapshot with all changes written so far and ``write_changes`` stores
    the changed rows under the batch id, so that a replayed batch is harmless. The lowest price of a batch decides, so
    a dip inside a batch counts however the stream is cut.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        pending = read_triggers().filter("status = 'pending'")
        after = check_triggers(pending, batch_prices(batch), as_of)
        write_changes(after.filter("status <> 'pending'"), batch_id)

    return ticks.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


ALERT_SCHEMA = "holding_id string, symbol string, us bigint, price double, avg_cost double"


def _earliest(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One holding: the earliest hit of each open day (at the lowest price) waits until no earlier one can come, then is sent once."""
    days = {end: x for end, *x in zip(*state.get, strict=True)} if state.exists else {}
    now, out = state.getCurrentWatermarkMs(), []
    for rows in batches:
        rows = rows[rows["us"] > now * 1000].sort_values(["us", "price"]).drop_duplicates("day_end")  # Spark itself lets rows pass that are late by one batch only
        for symbol, us, price, cost, end in rows[["symbol", "us", "price", "avg_cost", "day_end"]].itertuples(index=False, name=None):
            old = days.get(int(end))
            if old is None or not old[0] and (us, price) < (old[2], old[3]):
                days[int(end)] = [False, symbol, int(us), float(price), float(cost)]
    for x in days.values():
        if not x[0] and x[2] <= now * 1000:
            out.append((*key, *x[1:]))
            x[0] = True
    days = {end: x for end, x in days.items() if end > now}
    if days:
        state.update((list(days), *map(list, zip(*days.values(), strict=True))))
        state.setTimeoutTimestamp(int(min(end if x[0] else -(-x[2] // 1000) for end, x in days.items())))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=[f.split()[0] for f in ALERT_SCHEMA.split(", ")])


def drawdown_stream(ticks: DataFrame, positions: DataFrame, lateness: str = "1 day", p=DEFAULTS) -> DataFrame:
    """The earliest price per position and day at or below the drawdown limit, the same as in ``drawdown_batch`` however the stream is cut.

    Stream-static join, then a state per holding with the days that the watermark has not passed. Ticks may come in any order within ``lateness``; an
    alert is sent when the watermark has passed it, as an earlier price may come until then. ``run_late_rows`` keeps the ticks that come later still.
    """
    held = positions.filter(F.col("is_active") & (F.col("timeframe") == "long_term")).select("holding_id", "symbol", "avg_cost")
    dd = (F.col("price") - F.col("avg_cost")) / F.col("avg_cost")
    hits = ticks.withWatermark("ts", lateness).filter(F.col("ts").isNotNull()).join(held, "symbol").filter(dd <= -p.drawdown_alert_pct).select(
        F.col("holding_id").cast("string"), "ts", "symbol", F.unix_micros("ts").alias("us"), "price", "avg_cost", F.unix_millis(F.date_add(F.to_date("ts"), 1).cast("timestamp")).alias("day_end"))
    found = hits.groupBy("holding_id").applyInPandasWithState(
        _earliest, ALERT_SCHEMA, "day_end array<bigint>, sent array<boolean>, symbol array<string>, us array<bigint>, price array<double>, avg_cost array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    ts = F.timestamp_micros("us")
    return found.select("holding_id", "symbol", F.to_date(ts).alias("day"), ts.alias("ts"), "price", "avg_cost", (dd * 100).alias("drawdown_pct"))


def run_late_rows(rows: DataFrame, time: str, lateness_ms: int, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the rows that a watermark of ``lateness_ms`` on ``time`` drops: those not after the latest time of all earlier batches less the lateness.

    Run beside a watermarked query on the same source and batch size. ``out``/late holds the rows and ``out``/seen the latest time, both by batch, so a replayed batch
    overwrites its own.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The first batch has nothing before it; the path is listed by Spark, so it may lie in any store.
        before = spark.read.schema("us bigint, batch bigint").parquet(f"{out}/seen").filter(F.col("batch") < batch_id).agg(F.max("us")).first()[0] if batch_id else None
        us = F.unix_micros(time)
        late = batch.filter(us <= (before // 1000 - lateness_ms) * 1000) if before is not None else batch.limit(0)
        late.write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        batch.agg(F.max(us).alias("us")).write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")

    return rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drawdown_batch(ticks: DataFrame, positions: DataFrame, p=DEFAULTS) -> DataFrame:
    """Batch twin: the earliest alert per (holding, day)."""
    held = positions.filter(F.col("is_active") & (F.col("timeframe") == "long_term")).select("holding_id", "symbol", "avg_cost")
    dd = (F.col("price") - F.col("avg_cost")) / F.col("avg_cost")
    hits = ticks.join(held, "symbol").filter(dd <= -p.drawdown_alert_pct).withColumn("day", F.to_date("ts"))
    return hits.groupBy("holding_id", "symbol", "day").agg(F.min("ts").alias("ts"))
