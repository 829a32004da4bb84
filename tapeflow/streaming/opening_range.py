"""Opening range of the day and its breakout, in batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Session times of the intraday rules.
OPEN_AT, RANGE_MINUTES, LAST_ENTRY, FORCE_EXIT = "09:15", 15, "13:30", "15:15"
ROW_SCHEMA = "symbol string, at bigint, close double, orb_high double, orb_low double, entry boolean, force_exit boolean"


def _minutes(text: str) -> int:
    h, m = text.split(":")
    return int(h) * 60 + int(m)


def opening_range(bars: DataFrame, open_at: str = OPEN_AT) -> DataFrame:
    """Range high and low, breakout entry (first close above it) and forced exit per bar."""
    minute = F.hour("bar_start") * 60 + F.minute("bar_start")
    start = _minutes(open_at)
    b = bars.withColumns({"day": F.to_date("bar_start"), "_m": minute}).filter(F.col("_m") >= start)
    day = Window.partitionBy("symbol", "day")  # at most 288 bars
    inside = F.col("_m") < start + RANGE_MINUTES
    b = b.withColumns({"orb_high": F.max(F.when(inside, F.col("high"))).over(day), "orb_low": F.min(F.when(inside, F.col("low"))).over(day)})
    above = ~inside & (F.col("close") > F.col("orb_high")) & (F.col("_m") <= _minutes(LAST_ENTRY))
    b = b.withColumn("_above", F.coalesce(above, F.lit(False)))
    before = F.max("_above").over(day.orderBy("bar_start").rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("entry", F.col("_above") & ~F.coalesce(before, F.lit(False)))
    return b.filter(~inside & F.col("orb_high").isNotNull()).select(
        "symbol", "day", "bar_start", "close", "orb_high", "orb_low", "entry",
        (F.col("_m") >= _minutes(FORCE_EXIT)).alias("force_exit"))


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState, start: int) -> Iterator[pd.DataFrame]:
    """One symbol, with its open days. Bars wait in the state until the watermark has passed them, so that they are taken in the order of time
    and the range of a day is closed before any later bar is judged, whatever the order in which they came."""
    days, bars = {}, {}  # by the end of the day; at most 288 bars of each day
    if state.exists:
        ends, highs, lows, entered, *waiting = state.get
        days = {end: x for end, *x in zip(ends, highs, lows, entered, strict=True)}
        bars = {r[0]: r for r in zip(*waiting, strict=True)}
    now, out = state.getCurrentWatermarkMs(), []
    for rows in batches:
        rows = rows[rows["at"] > now]  # Spark itself lets rows pass that are late by one batch only
        for r in rows[["at", "m", "high", "low", "close", "day_end"]].itertuples(index=False, name=None):
            bars[r[0]] = r
            days.setdefault(r[5], [None, None, False])
    for at in sorted(a for a in bars if a <= now):
        _, m, h, lo, close, end = bars.pop(at)
        high, low, done = days[end]
        if m < start:
            continue
        if m < start + RANGE_MINUTES:
            days[end][:2] = h if high is None else max(high, h), lo if low is None else min(low, lo)
        elif high is not None:
            up = close > high and m <= _minutes(LAST_ENTRY)
            out.append((*key, at, close, high, low, up and not done, m >= _minutes(FORCE_EXIT)))
            days[end][2] = done or up
    days = {end: x for end, x in days.items() if end > now}
    if days:
        state.update((list(days), *([x[i] for x in days.values()] for i in range(3)), *([list(x) for x in zip(*bars.values(), strict=True)] if bars else [[]] * 6)))
        state.setTimeoutTimestamp(int(min([*days, *bars])))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=[f.split()[0] for f in ROW_SCHEMA.split(", ")])


def stream_opening_range(bars: DataFrame, open_at: str = OPEN_AT, lateness: str = "1 day") -> DataFrame:
    """Stateful form over a stream of complete intraday bars, which may come in any order within ``lateness``.

    A bar is returned once the watermark has passed it; later ones wait in the state, which ends with its day. Spark allows this state function only on
    a stream without an aggregate, so ``bars`` has to come from a table the bar stream writes. Bars later than that are dropped, as by any
    watermark (``alerts.run_late_rows`` keeps them).
    """
    start = _minutes(open_at)
    day = F.to_date("bar_start")
    b = bars.withWatermark("bar_start", lateness).filter(F.col("bar_start").isNotNull()).select(
        "symbol", "bar_start", F.unix_millis("bar_start").alias("at"), (F.hour("bar_start") * 60 + F.minute("bar_start")).alias("m"),
        F.unix_millis(F.date_add(day, 1).cast("timestamp")).alias("day_end"), "high", "low", "close")
    # A group costs a call for each batch it has rows in, so a symbol's days share one; its state holds the days the watermark has not passed.
    found = b.groupBy("symbol").applyInPandasWithState(
        lambda key, batches, state: _advance(key, batches, state, start), ROW_SCHEMA,
        "day_end array<bigint>, high array<double>, low array<double>, entered array<boolean>, "
        "at array<bigint>, m array<int>, highs array<double>, lows array<double>, closes array<double>, ends array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    start_ = F.timestamp_millis("at")
    return found.select("symbol", F.to_date(start_).alias("day"), start_.alias("bar_start"), "close", "orb_high", "orb_low", "entry", "force_exit")
