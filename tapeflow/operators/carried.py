"""Indicators of new bars from a table of carried state, without the bars before.

A state row per symbol holds what its recurrences remember (averages with their seeds, the SAR and supertrend phases, running volume) and its last ``TAIL``
bars, which are as many as the longest window looks back on. ``refresh`` joins it with new bars, continues the recurrences on them and computes the windows
over tail and new bars; it returns the new rows and the new state. Work and reading follow the new bars, whatever the length of the history.

Defined results: a refresh gives the rows that a full run gives for the new dates. Symbols below the least number of bars give no rows and are kept; with the bar
that reaches it, all their rows are returned. Bars on or before the last date of their symbol are not taken (``late_bars`` lists them: their symbols need a
full run). The lagging span looks ahead, so it changes on rows already returned: ``late_spans`` has those values for an upsert.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from tapeflow.operators import recursive
from tapeflow.operators.indicators import BAR_COLUMNS, finish, window_columns
from tapeflow.params import DEFAULTS
from tapeflow.session import stored

TAIL = 260  #: bars; the longest look-back is 252
LAG = 26  #: bars that the lagging span looks ahead
RSI_TAIL = 20
LAGGING = "ichimoku_chikou"


class Carry:
    """What recurrences remember, as a flat list of numbers read and written in a fixed order."""

    def __init__(self, old: list[float] | None):
        self.old, self.at, self.new = old, 0, []

    def take(self, *default: float) -> list[float]:
        if not self.old:
            return list(default)
        self.at += len(default)
        return list(self.old[self.at - len(default):self.at])

    def put(self, *values: float) -> None:
        self.new.extend(float(v) for v in values)


def ema(c: Carry, x: np.ndarray, n: int) -> np.ndarray:
    """Continues ``recursive.ema``: values seen, their sum while it is the seed, and the average."""
    seen, total, value = c.take(0, 0, np.nan)
    out = np.full(len(x), np.nan)
    first = int(np.argmax(np.isfinite(x))) if np.isfinite(x).any() else len(x)
    at = first
    if seen < n:
        seed = x[first:first + n - int(seen)]
        seen, total, at = seen + len(seed), total + seed.sum(), first + len(seed)
        if seen == n and len(seed):
            value = out[at - 1] = total / n
    if seen >= n and at < len(x):
        out[at:] = pd.Series(np.concatenate(([value], x[at:]))).ewm(alpha=2 / (n + 1), adjust=False).mean().to_numpy()[1:]
        value = out[-1]
    c.put(seen, total, value)
    return out


def wilder(c: Carry, x: np.ndarray, n: int, min_n: int | None = None) -> np.ndarray:
    """Continues ``recursive.wilder``: values seen, the average, and the gap of missing values since the last one."""
    seen, value, gap = c.take(0, np.nan, 0)
    s = np.concatenate(([value], np.full(int(gap), np.nan), x)) if seen else x
    out = pd.Series(s).ewm(alpha=1 / n, adjust=False).mean().to_numpy()[len(s) - len(x):]
    ok = np.isfinite(x)
    count = seen + np.cumsum(ok)
    if ok.any():
        last = len(x) - 1 - int(np.argmax(ok[::-1]))
        c.put(count[-1], out[last], len(x) - 1 - last)
    else:
        c.put(seen, value, gap + len(x) if seen else 0)
    return np.where(count >= (n if min_n is None else min_n), out, np.nan)


def _supertrend(c: Carry, n: int, prev: float, high, low, close, atr, mult: float = 3.0):
    pu, pl, on_upper = c.take(np.nan, np.nan, 0)
    mid = (high + low) / 2
    line, side = np.full(len(close), np.nan), np.zeros(len(close))
    for i, (u, lo, x) in enumerate(zip((mid + mult * atr).tolist(), (mid - mult * atr).tolist(), close.tolist(), strict=True)):
        if n + i:
            if not (lo > pl or prev < pl):
                lo = pl
            if not (u < pu or prev > pu):
                u = pu
            if n + i == 1:
                d, on_upper = 1, False
            else:
                d = (-1 if x > u else 1) if on_upper else (1 if x < lo else -1)
                on_upper = d == 1
            side[i], line[i] = d, u if on_upper else lo
        pu, pl, prev = u, lo, x
    c.put(pu, pl, on_upper)
    return line, side


def _parabolic(c: Carry, n: int, highs: list[float], lows: list[float], high, low, step: float = 0.02, cap: float = 0.2) -> np.ndarray:
    """``highs`` and ``lows`` are those of the last two bars before, as far as there are."""
    long, sar, ep, af = c.take(1, np.nan, np.nan, step)
    h, lw = highs + high.tolist(), lows + low.tolist()
    out = np.full(len(high), np.nan)
    for i in range(len(high)):
        j = i + len(highs)
        if n + i == 0:
            sar, ep = lw[j], h[j]
            continue
        sar += af * (ep - sar)
        if long:
            sar = min(sar, lw[j - 1], lw[max(j - 2, 0)])
            if lw[j] < sar:
                long, sar, ep, af = False, ep, lw[j], step
            elif h[j] > ep:
                ep, af = h[j], min(af + step, cap)
        else:
            sar = max(sar, h[j - 1], h[max(j - 2, 0)])
            if h[j] > sar:
                long, sar, ep, af = True, ep, h[j], step
            elif lw[j] < ep:
                ep, af = lw[j], min(af + step, cap)
        if long:
            out[i] = sar
    c.put(long, sar, ep, af)
    return out


def pack(c: Carry, n: int, old: dict[str, np.ndarray], high: np.ndarray, low: np.ndarray, close: np.ndarray) -> dict[str, np.ndarray]:
    """``recursive.pack`` of the bars after the first ``n``; ``old`` has the last two bars before them."""
    def before(name, x):
        return np.concatenate((old[name][-1:] if n else [np.nan], x))

    h, lw, cl = before("high", high), before("low", low), before("close", close)
    out = {f"ema_{k}": ema(c, close, k) for k in (9, 20, 50, 100, 200)}
    out["macd"] = ema(c, close, 12) - ema(c, close, 26)
    out["macd_signal"] = ema(c, out["macd"], 9)
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    d = np.diff(cl)
    for k in (9, 14, 21):
        up, down = (wilder(c, np.where(np.isnan(d), np.nan, np.maximum(s * d, 0)), k) for s in (1, -1))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[f"rsi_{k}"] = 100 * up / (up + down)
    kept = np.concatenate((c.take(*[np.nan] * RSI_TAIL), out["rsi_14"]))
    out["stoch_rsi"] = recursive.stochastic_rsi(kept)[RSI_TAIL:]
    c.put(*kept[-RSI_TAIL:])
    tr = high - low
    tr = np.where(np.isnan(cl[:-1]), tr, np.maximum(tr, np.maximum(np.abs(high - cl[:-1]), np.abs(low - cl[:-1]))))
    up, down = np.diff(h), -np.diff(lw)
    plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(down), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        atr = wilder(c, np.where(np.isnan(up), np.nan, tr), 14)
        out["plus_di"], out["minus_di"] = 100 * wilder(c, plus, 14) / atr, 100 * wilder(c, minus, 14) / atr
        out["adx_14"] = wilder(c, 100 * np.abs(out["plus_di"] - out["minus_di"]) / (out["plus_di"] + out["minus_di"]), 14)
    out["atr_14"], out["atr_21"] = wilder(c, tr, 14), wilder(c, tr, 21)
    band = 2 * ema(c, tr, 20)
    out["kc_upper"], out["kc_lower"] = out["ema_20"] + band, out["ema_20"] - band
    out["psar"] = _parabolic(c, n, old["high"][-2:].tolist(), old["low"][-2:].tolist(), high, low)
    out["supertrend"], out["supertrend_dir"] = _supertrend(c, n, old["close"][-1] if n else np.nan, high, low, close, wilder(c, tr, 10, 0))
    return out


def state_schema(bars: DataFrame) -> T.StructType:
    """symbol, n (bars so far), last_date, obv, carry and the tail of bars."""
    tail = T.StructType([bars.schema[c] for c in BAR_COLUMNS if c != "symbol"])
    return T.StructType([bars.schema["symbol"], T.StructField("n", T.LongType()), T.StructField("last_date", bars.schema["date"].dataType), T.StructField("obv", T.DoubleType()),
                         T.StructField("carry", T.ArrayType(T.DoubleType())), T.StructField("tail", T.ArrayType(tail))])


def empty_state(bars: DataFrame) -> DataFrame:
    return bars.sparkSession.createDataFrame([], state_schema(bars))


def _advance(min_bars: int, out_schema: pa.Schema, state_type: pa.StructType):
    bar_names = [c for c in BAR_COLUMNS if c != "symbol"]
    tail_type = state_type.field("tail").type.value_type

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        old = left.to_pylist()[0] if left.num_rows else {"n": 0, "last_date": None, "obv": 0.0, "carry": None, "tail": []}
        new = right.select(bar_names).sort_by("date")
        if old["last_date"] is not None and new.num_rows:
            new = new.filter(pa.array([d > old["last_date"] for d in new.column("date").to_pylist()]))
        before = pa.Table.from_struct_array(pa.array(old["tail"], tail_type)).cast(new.schema)
        if not new.num_rows:
            blank = {f.name: pa.nulls(1, f.type) for f in out_schema}
            blank |= {"symbol": pa.array([key[0].as_py()], out_schema.field("symbol").type), "_new": pa.array([False]), "_state": pa.array([{k: old[k] for k in state_type.names}], state_type)}
            return pa.table([blank[f.name] for f in out_schema], schema=out_schema).slice(0, 1 if old["n"] else 0)
        n, total = old["n"], old["n"] + new.num_rows
        every = pa.concat_tables([before, new])
        fresh = n < min_bars <= total  # its first rows: all bars are still in the tail
        skip = 0 if fresh else before.num_rows
        part = {x: every.column(x).to_numpy().astype(float) for x in ("high", "low", "close", "volume")}
        carry, cols = Carry(None if fresh else old["carry"]), None
        if total >= min_bars:
            cols = pack(carry, 0 if fresh else n, {x: part[x][:skip] for x in part}, *(part[x][skip:] for x in ("high", "low", "close")))
        flow = np.sign(np.diff(part["close"])) * part["volume"][1:]
        held = before.num_rows
        base = old["obv"] - flow[:max(held - 1, 0)].sum()  # at the first bar of the tail
        state = {"n": total, "last_date": new.column("date")[-1].as_py(), "obv": base + flow.sum(), "carry": carry.new if cols else None, "tail": every.slice(max(0, len(every) - TAIL)).to_pylist()}
        size, out = len(every), {"symbol": pa.array([key[0].as_py()] * len(every), out_schema.field("symbol").type)}
        out |= {x: every.column(x) for x in bar_names}
        for x in recursive.COLUMNS:
            out[x] = pa.array(np.concatenate((np.full(skip, np.nan), cols[x])) if cols else np.full(size, np.nan), pa.float64(), from_pandas=True)
        out["_new"] = pa.array((np.arange(size) >= skip) & (cols is not None))
        out["_age"] = pa.array([None if cols is None or i >= skip else skip - i for i in range(size)], pa.int64())  # of rows returned before
        out["_before"], out["_obv"] = pa.array(np.full(size, n - held)), pa.array(np.full(size, base))
        out["_state"] = pa.array([None] * (size - 1) + [state], state_type)
        return pa.table([out[f.name] for f in out_schema], schema=out_schema)
    return run


def refresh(state: DataFrame, bars: DataFrame, min_bars: int = DEFAULTS.min_bars_indicators) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of the new bars, values of the lagging span on earlier rows, new state). What comes out of the one pass over state and bars is stored."""
    schema = state_schema(bars)
    inner = T.StructType([f for f in schema.fields if f.name != "symbol"])
    out = T.StructType([bars.schema[c] for c in BAR_COLUMNS] + [T.StructField(c, T.DoubleType()) for c in recursive.COLUMNS] + [
        T.StructField("_new", T.BooleanType()), T.StructField("_age", T.LongType()), T.StructField("_before", T.LongType()), T.StructField("_obv", T.DoubleType()), T.StructField("_state", inner)])
    run = _advance(min_bars, to_arrow_schema(out), to_arrow_type(inner))
    moved = stored(state.groupBy("symbol").cogroup(bars.select(*BAR_COLUMNS).groupBy("symbol")).applyInArrow(run, out), "carried")
    panel = finish(window_columns(moved.filter("date is not null").drop("_state"), F.col("_before"), F.col("_obv")), "_new", "_age")
    rows = panel.filter("_new").drop("_new", "_age")
    spans = panel.filter(f"_age <= {LAG}").filter(F.col(LAGGING).isNotNull()).select("symbol", "date", LAGGING)
    return rows, spans, moved.filter("_state is not null").select("symbol", "_state.*")


def late_bars(state: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars that a refresh does not take: on or before the last date of their symbol."""
    return bars.join(state.select("symbol", "last_date"), "symbol").filter(F.col("date") <= F.col("last_date")).drop("last_date")
