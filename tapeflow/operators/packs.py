"""Indicator columns of many series at once: each step of a recurrence and each shift of a window is one operation over a pack.

A pack is a matrix with a series per column and a bar per row; series of similar length share one, so at most half of it is padding. NaN stands for NULL.
Windows follow ``indicators.window_columns``, which skips NULLs, and add in the order of the bars; recurrences follow ``recursive.pack``. Series with a missing
price or date are rare and take ``recursive.pack`` itself, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tapeflow.functions.rules import look_back_column
from tapeflow.operators import recursive

ROWS = 1 << 17  #: bars that are computed together; a longer series is taken whole
BATCH = 1 << 14  #: rows of a batch that is sent back


def lag(x: np.ndarray, n: int) -> np.ndarray:
    """The value n rows before; after, if n is negative."""
    out = np.full_like(x, np.nan)
    if n > 0:
        out[n:] = x[:-n]
    elif n < 0:
        out[:n] = x[-n:]
    else:
        out[:] = x
    return out


def lags(x: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The last n rows, oldest first."""
    return (lag(x, i) for i in range(n - 1, -1, -1))


def window_sum(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the values in the last n rows; NaN and 0 if there is none."""
    total, count = np.zeros_like(x), np.zeros_like(x)
    for v in lags(x, n):
        ok = np.isfinite(v)
        total, count = total + np.where(ok, v, 0.0), count + ok
    return np.where(count > 0, total, np.nan), count


def window_mean(x: np.ndarray, n: int) -> np.ndarray:
    total, count = window_sum(x, n)
    return total / count


def window_deviation(x: np.ndarray, n: int) -> np.ndarray:
    """Population deviation of the last n rows, updated value by value as Spark does: equal values give 0."""
    count, mean, square = (np.zeros_like(x) for _ in range(3))
    for v in lags(x, n):
        ok = np.isfinite(v)
        count = count + ok
        delta = np.where(ok, v - mean, 0.0)
        part = delta / np.maximum(count, 1)
        mean, square = mean + part, square + delta * (delta - part)
    return np.where(count > 0, np.sqrt(square / np.maximum(count, 1)), np.nan)


def window_extreme(pick, x: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """``pick`` (np.fmax or np.fmin) over every ``step``-th of the last n rows."""
    out = x
    for i in range(step, n, step):
        out = pick(out, lag(x, i))
    return out


def running_sum(x: np.ndarray) -> np.ndarray:
    ok = np.isfinite(x)
    return np.where(np.logical_or.accumulate(ok, axis=0), np.cumsum(np.where(ok, x, 0.0), axis=0), np.nan)


def divided(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Quotient, missing where the divisor is 0."""
    return x / np.where(y == 0, np.nan, y)


def window_columns(h: np.ndarray, lo: np.ndarray, c: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """The rolling columns of ``indicators.WINDOW_COLUMNS``."""
    rn = np.arange(1, len(c) + 1)[:, None]

    def from_(n, x):
        return np.where(rn >= n, x, np.nan)

    tp, span, prev = (h + lo + c) / 3, h - lo, lag(c, 1)
    ptp, flow = lag(tp, 1), tp * v
    mfv = np.where(span > 0, ((c - lo) - (h - c)) / np.where(span > 0, span, np.nan) * v, 0.0)
    total = running_sum(c)
    hh, ll = ({n: window_extreme(pick, x, n) for n in (9, 13, 14)} for pick, x in ((np.fmax, h), (np.fmin, lo)))
    for n in (26, 52):
        hh[n], ll[n] = window_extreme(np.fmax, hh[13], n, 13), window_extreme(np.fmin, ll[13], n, 13)
    high252, low252 = (window_extreme(pick, window_extreme(pick, c, 14), 252, 14) for pick in (np.fmax, np.fmin))

    def long_mean(n):
        old = lag(total, n)
        return (total - np.where(np.isfinite(old), old, 0.0)) / n

    o = {"sma_20": from_(20, window_mean(c, 20)), "sma_50": from_(50, long_mean(50)), "sma_200": from_(200, long_mean(200)),
         "ichimoku_tenkan": from_(9, (hh[9] + ll[9]) / 2), "ichimoku_kijun": from_(26, (hh[26] + ll[26]) / 2), "ichimoku_chikou": lag(c, -26)}
    o["ichimoku_senkou_a"] = lag((o["ichimoku_tenkan"] + o["ichimoku_kijun"]) / 2, 26)
    o["ichimoku_senkou_b"] = lag(from_(52, (hh[52] + ll[52]) / 2), 26)
    o["stoch_k"] = from_(16, window_mean(from_(14, divided(100 * (c - ll[14]), hh[14] - ll[14])), 3))
    o["stoch_d"] = from_(18, window_mean(o["stoch_k"], 3))
    o["williams_r"] = from_(14, divided(-100 * (hh[14] - c), hh[14] - ll[14]))
    tp20 = window_mean(tp, 20)
    mad = np.zeros_like(c)
    for x in lags(tp, 20):
        away = np.abs(x - tp20)
        mad = mad + np.where(np.isfinite(x), away, 0.0)
    o["cci_20"] = from_(20, divided(tp - tp20, 0.015 * (mad / 20)))
    o |= {f"roc_{n}": 100 * (divided(c, lag(c, n)) - 1) for n in (10, 20)}
    up, down = (window_sum(np.where(side, flow, 0.0), 14)[0] for side in (tp > ptp, tp < ptp))
    o["mfi_14"] = from_(15, divided(100 * up, up + down))
    m, sd = o["sma_20"], window_deviation(c, 20)
    o |= {"bb_upper": m + 2 * sd, "bb_mid": m, "bb_lower": m - 2 * sd, "bb_pct_b": divided(c - (m - 2 * sd), 4 * sd), "bb_width": divided(400 * sd, m)}
    ratio = divided(c, prev)
    ret = np.log(np.where(ratio > 0, ratio, np.nan))
    rs, rq = running_sum(ret), running_sum(ret * ret)
    for n in (21, 63):
        first, second = (x - np.where(np.isfinite(lag(x, n)), lag(x, n), 0.0) for x in (rs, rq))
        var = np.fmax(0.0, second - first * first / n) / (n - 1)
        o[f"hist_vol_{n}"] = from_(n + 1, np.sqrt(var) * float(np.sqrt(252)) * 100)
    change = c - prev
    o["obv"] = running_sum(np.where(np.isfinite(change), np.sign(change), 0.0) * v)
    o["cmf_20"] = from_(20, divided(window_sum(mfv, 20)[0], window_sum(v, 20)[0]))
    o["volume_sma20"] = from_(20, window_mean(v, 20))
    o["volume_ratio"] = divided(v, o["volume_sma20"])
    o["pct_from_52w_high"] = from_(50, (divided(c, high252) - 1) * 100)
    o["pct_from_52w_low"] = from_(50, (divided(c, low252) - 1) * 100)
    return o


def averages(x: np.ndarray, alphas: list[float], least: list[int]) -> np.ndarray:
    """Exponential averages along the first axis of x (bar, average, series), as pandas' ``ewm(adjust=False)`` forms them: a gap lowers the weight of what is
    before it. Missing until ``least`` values have been seen."""
    new = np.array([1 / (1 + (1 - a) / a) for a in alphas])[:, None]
    keep = 1 - new
    out, w, weight = np.empty_like(x), np.full(x.shape[1:], np.nan), np.ones(x.shape[1:])
    for t in range(len(x)):
        cur = x[t]
        here, begun = ~np.isnan(cur), ~np.isnan(w)
        weight = np.where(begun, weight * keep, 1.0)
        moved = np.where(w != cur, (weight * w + new * cur) / (weight + new), w)
        w = np.where(here, np.where(begun, moved, cur), w)
        weight = np.where(here, 1.0, weight)
        out[t] = w
    out[np.cumsum(~np.isnan(x), axis=0) < np.array(least)[:, None]] = np.nan
    return out


def seeded(x: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """Input of an EMA(n) of a series that begins at row ``first``: the mean of its first n values stands at the n-th."""
    out, at = x.copy(), first + n - 1
    out[:at] = np.nan
    if at < len(x):
        out[at] = np.ascontiguousarray(x[first:at + 1].T).mean(axis=1)
    return out


def parabolic_sar(h: np.ndarray, lw: np.ndarray, step: float = 0.02, cap: float = 0.2) -> np.ndarray:
    out = np.full_like(h, np.nan)
    long, sar, ep, af = np.ones(h.shape[1], bool), lw[0].copy(), h[0].copy(), np.full(h.shape[1], step)
    for i in range(1, len(h)):
        sar = sar + af * (ep - sar)
        j = max(i - 2, 0)
        sar = np.where(long, np.minimum(np.minimum(sar, lw[i - 1]), lw[j]), np.maximum(np.maximum(sar, h[i - 1]), h[j]))
        turn = np.where(long, lw[i] < sar, h[i] > sar)
        further = ~turn & np.where(long, h[i] > ep, lw[i] < ep)
        own, other = np.where(long, h[i], lw[i]), np.where(long, lw[i], h[i])
        sar = np.where(turn, ep, sar)
        ep = np.where(turn, other, np.where(further, own, ep))
        af = np.where(turn, step, np.where(further, np.minimum(af + step, cap), af))
        long = long ^ turn
        out[i] = np.where(long, sar, np.nan)
    return out


def supertrend(h: np.ndarray, lw: np.ndarray, c: np.ndarray, atr: np.ndarray, mult: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    mid = (h + lw) / 2
    upper, lower = mid + mult * atr, mid - mult * atr
    line, side = np.full_like(c, np.nan), np.zeros_like(c)
    on_upper = np.zeros(c.shape[1], bool)
    for i in range(1, len(c)):
        pu, pl, pc_ = upper[i - 1], lower[i - 1], c[i - 1]
        lower[i] = np.where((lower[i] > pl) | (pc_ < pl), lower[i], pl)
        upper[i] = np.where((upper[i] < pu) | (pc_ > pu), upper[i], pu)
        if i == 1:
            side[i], line[i] = 1, lower[i]
        else:
            on_upper = np.where(on_upper, ~(c[i] > upper[i]), c[i] < lower[i])
            side[i], line[i] = np.where(on_upper, 1, -1), np.where(on_upper, upper[i], lower[i])
    return line, side


def recursive_columns(h: np.ndarray, lw: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """``recursive.pack`` of a pack of whole series."""
    prev, up, down = c - lag(c, 1), h - lag(h, 1), lag(lw, 1) - lw
    tr = h - lw
    tr[1:] = np.maximum(tr[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(lw[1:] - c[:-1])))
    later = tr.copy()
    later[:1] = np.nan
    plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(down), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    rise, fall = np.maximum(prev, 0), np.maximum(-prev, 0)
    # (name, input, alpha, values needed)
    made = [(f"ema_{n}", seeded(c, n), 2 / (n + 1), 1) for n in (9, 20, 50, 100, 200, 12, 26)] + [("tr_20", seeded(tr, 20), 2 / 21, 1)]
    made += [(f"{k}_{n}", x, 1 / n, n) for n in (9, 14, 21) for k, x in (("rise", rise), ("fall", fall))]
    made += [(k, x, 1 / 14, 14) for k, x in (("later", later), ("plus", plus), ("minus", minus))]
    made += [("atr_14", tr, 1 / 14, 14), ("atr_21", tr, 1 / 21, 21), ("atr_10", tr, 1 / 10, 0)]
    a = averages(np.stack([x for _, x, _, _ in made], axis=1), [x for _, _, x, _ in made], [n for *_, n in made])
    a = {name: np.ascontiguousarray(a[:, i]) for i, (name, *_) in enumerate(made)}
    out = {k: a[k] for k in recursive.COLUMNS if k in a}
    out["macd"] = a["ema_12"] - a["ema_26"]
    out |= {f"rsi_{n}": 100 * a[f"rise_{n}"] / (a[f"rise_{n}"] + a[f"fall_{n}"]) for n in (9, 14, 21)}
    out["plus_di"], out["minus_di"] = 100 * a["plus"] / a["later"], 100 * a["minus"] / a["later"]
    dx = 100 * np.abs(out["plus_di"] - out["minus_di"]) / (out["plus_di"] + out["minus_di"])
    b = averages(np.stack([seeded(out["macd"], 9, 25), dx], axis=1), [2 / 10, 1 / 14], [1, 14])
    out["macd_signal"], out["adx_14"] = b[:, 0], b[:, 1]
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    r = out["rsi_14"]
    low = high = r
    for i in range(1, 14):  # any missing value in the window leaves it missing
        low, high = np.minimum(low, lag(r, i)), np.maximum(high, lag(r, i))
    raw = 100 * (r - low) / np.where(high > low, high - low, np.nan)
    for _ in range(2):
        raw = (lag(raw, 2) + lag(raw, 1) + raw) / 3
    out["stoch_rsi"] = raw
    out["kc_upper"], out["kc_lower"] = a["ema_20"] + 2 * a["tr_20"], a["ema_20"] - 2 * a["tr_20"]
    out["psar"] = parabolic_sar(h, lw)
    out["supertrend"], out["supertrend_dir"] = supertrend(h, lw, c, a["atr_10"])
    return out


def columns(x: dict[str, np.ndarray], starts: np.ndarray, lengths: np.ndarray, odd: np.ndarray, undated: np.ndarray) -> dict[str, np.ndarray]:
    """Rolling and recursive columns of series that lie one after another. ``odd`` series have a missing price or date; ``undated`` rows have no date and come
    last in a recurrence."""
    size, out = len(x["close"]), {}

    def put(name, at, values):
        out.setdefault(name, np.full(size, np.nan))[at] = values

    kind = np.ceil(np.log2(np.maximum(lengths, 1)))
    for k in np.unique(kind):
        some = np.flatnonzero(kind == k)
        some = np.concatenate((some[~odd[some]], some[odd[some]]))  # whole series first
        whole = int((~odd[some]).sum())
        rows = np.arange(lengths[some].max())[:, None]
        inside = rows < lengths[some]
        at = np.where(inside, starts[some] + rows, 0)
        m = {name: np.where(inside, v[at], np.nan) for name, v in x.items()}
        at = at[inside]
        for name, v in window_columns(m["high"], m["low"], m["close"], m["volume"]).items():
            put(name, at, v[inside])
        if whole:
            mine = inside[:, :whole]
            to = (starts[some[:whole]] + rows)[mine]
            for name, v in recursive_columns(*(np.ascontiguousarray(m[n][:, :whole]) for n in ("high", "low", "close"))).items():
                put(name, to, v[mine])
        for s in some[whole:]:
            to = np.arange(starts[s], starts[s] + lengths[s])
            to = np.concatenate((to[~undated[to]], to[undated[to]]))
            for name, v in recursive.pack(*(x[n][to] for n in ("high", "low", "close"))).items():
                put(name, to, v)
    return out


def back(x: np.ndarray, rn: np.ndarray, n: int) -> np.ndarray:
    """The value n rows before in series that lie one after another, whose rows are numbered from 1."""
    return np.where(rn > n, lag(x, n) if n < len(x) else np.nan, np.nan)


def extreme(pick, x: np.ndarray, rn: np.ndarray, n: int) -> np.ndarray:
    """``pick`` (np.fmax or np.fmin) over the last n rows, from those of half as many."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x, size = pick(x, back(x, rn, step)), size + step
    return x


def past_columns(h: np.ndarray, lo: np.ndarray, c: np.ndarray, rn: np.ndarray) -> dict[str, np.ndarray]:
    """``indicators.PAST_COLUMNS``, as ``indicators.momentum_252`` and ``williams_reversal`` define them."""
    hh, ll = extreme(np.fmax, h, rn, 10), extreme(np.fmin, lo, rn, 10)
    w = np.where(rn >= 10, divided(-100 * (hh - c), hh - ll), np.nan)
    at = np.arange(len(c))
    touched = np.concatenate(([-1], np.maximum.accumulate(np.where(w <= -100, at, -1))[:-1]))
    seen = touched > at - rn  # in the same series
    return {"r_252": divided(c, back(c, rn, 252)) - 1, "williams_r_10": w, "days_since_r100": np.where(seen, at - touched, np.nan),
            "williams_r_10_past": np.where(seen, w[touched], np.nan), "prev_close": back(c, rn, 1)}


def codes(t: pa.Table) -> np.ndarray:
    """A number for each row that tells its symbol."""
    return t.column("symbol").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's ``round`` gives: halves of the shortest decimal form go away from zero. Only numbers next to a half need that form."""
    unit = float(10 ** digits)
    y = x * unit
    k = np.rint(y)
    size = np.abs(y)
    out = k / unit + 0.0
    for i in np.flatnonzero(~((np.abs(y - k) < 0.5 - 1e-9 - size * 1e-15) & (size < 1 << 48)) & np.isfinite(x)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if abs(x[i]) < 1 << 53 else x[i]
    return out


def extended(t: pa.Table, names: tuple[str, ...], min_bars: int, digits: int | None = None, last: int | None = None, past: bool = False, looks: tuple = ()) -> pa.Table:
    """Rows of whole series, sorted by symbol and date, with ``rn`` and the columns ``names``, rounded if ``digits`` are given; series shorter than ``min_bars``
    are left out. With ``last`` only the last rows of each series are returned, with the values that the whole series gives. With ``past`` the columns of
    ``past_columns`` follow, and then one for each of ``looks``: (kind, column, n) is the value n rows before or the least or greatest of the n rows before."""
    code = codes(t)
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    lengths = np.diff(np.append(starts, len(code)))
    if (lengths < min_bars).any():
        t = t.filter(pa.array(np.repeat(lengths >= min_bars, lengths)))
        lengths = lengths[lengths >= min_bars]
        starts = np.cumsum(lengths) - lengths
    if not t.num_rows:
        return t
    x = {c: t.column(c).cast(pa.float64()).to_numpy() for c in ("high", "low", "close", "volume")}
    undated = pc.is_null(t.column("date")).to_numpy()
    odd = np.logical_or.reduceat(undated | ~(np.isfinite(x["high"]) & np.isfinite(x["low"]) & np.isfinite(x["close"])), starts)
    with np.errstate(all="ignore"):
        made = columns(x, starts, lengths, odd, undated)
        made["pct_from_ema200"] = divided(x["close"] - made["ema_200"], made["ema_200"]) * 100
        rn = np.arange(t.num_rows) - np.repeat(starts, lengths) + 1
        more = past_columns(x["high"], x["low"], x["close"], rn) if past else {}
        for kind, c, n in looks:
            v = made[c] if c in made else x[c] if c in x else t.column(c).cast(pa.float64()).to_numpy()
            more[look_back_column(kind, c, n)] = back(v, rn, n) if kind == "lag" else back(extreme(np.fmin if kind == "min" else np.fmax, v, rn, n), rn, 1)
        made = {c: made[c] for c in names} | more
        if last is not None:
            kept = rn > np.repeat(lengths, lengths) - last
            t, rn, made = t.filter(pa.array(kept)), rn[kept], {c: v[kept] for c, v in made.items()}
        if digits is not None:
            made |= {c: rounded(made[c], digits) for c in names}
    t = t.append_column("rn", pa.array(rn.astype(np.int32)))
    for c, v in made.items():
        t = t.append_column(c, pa.array(v, pa.int32() if c == "days_since_r100" else pa.float64(), from_pandas=True))
    return t


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one series each."""
    for t in whole_series(batches):
        code = codes(t)
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        for a, b in zip(starts, np.append(starts[1:], len(code)), strict=True):
            yield t.slice(a, b - a)


def whole_series(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end where a series ends; the batches are sorted by symbol."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held)
        code = codes(t)
        last = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
        if last:
            yield t.slice(0, last)
            held = t.slice(last).to_batches()
            size = t.num_rows - last
    if size:
        yield pa.Table.from_batches(held)
