"""Per-symbol recurrences that SQL windows cannot express.

All recursive columns of a symbol are computed in one pass over its sorted
arrays. A group is one daily series, so its length is bounded by the calendar.

Conventions. EMA(n): alpha 2/(n+1), seeded with the mean of the first n values
at row n, NULL before. Wilder smoothing(n): alpha 1/n, seeded with the first
value, NULL until n values have been seen. True range of the first bar is
high - low.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

COLUMNS = (
    "ema_9", "ema_20", "ema_50", "ema_100", "ema_200",
    "macd", "macd_signal", "macd_hist",
    "rsi_9", "rsi_14", "rsi_21", "stoch_rsi",
    "adx_14", "plus_di", "minus_di",
    "atr_14", "atr_21", "kc_upper", "kc_lower",
    "psar", "supertrend", "supertrend_dir",
)


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """EMA over the part of x that starts at its first finite value."""
    out = np.full(len(x), np.nan)
    first = int(np.argmax(np.isfinite(x))) if np.isfinite(x).any() else len(x)
    start = first + n - 1
    if start < len(x):
        seeded = np.concatenate(([x[first:start + 1].mean()], x[start + 1:]))
        out[start:] = pd.Series(seeded).ewm(alpha=2 / (n + 1), adjust=False).mean().to_numpy()
    return out


def wilder(x: np.ndarray, n: int, min_n: int | None = None) -> np.ndarray:
    s = pd.Series(x).ewm(alpha=1 / n, adjust=False, min_periods=n if min_n is None else min_n)
    return s.mean().to_numpy()


def true_range(high, low, close) -> np.ndarray:
    tr = high - low
    prev = close[:-1]
    tr[1:] = np.maximum(tr[1:], np.maximum(np.abs(high[1:] - prev), np.abs(low[1:] - prev)))
    return tr


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    d = np.diff(close, prepend=np.nan)
    up = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n)
    down = wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 100 * up / (up + down)


def stochastic_rsi(r: np.ndarray, n: int = 14, k: int = 3, d: int = 3) -> np.ndarray:
    s = pd.Series(r)
    lo, hi = s.rolling(n).min(), s.rolling(n).max()
    raw = 100 * (s - lo) / (hi - lo).where(hi > lo)
    return raw.rolling(k).mean().rolling(d).mean().to_numpy()


def directional(high, low, tr, n: int = 14):
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(down), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    t = tr.copy()
    t[:1] = np.nan
    with np.errstate(divide="ignore", invalid="ignore"):
        atr = wilder(t, n)
        pdi, mdi = 100 * wilder(plus, n) / atr, 100 * wilder(minus, n) / atr
        dx = 100 * np.abs(pdi - mdi) / (pdi + mdi)
    return wilder(dx, n), pdi, mdi


def supertrend(high, low, close, atr, mult: float = 3.0):
    """Ratcheted bands. Direction -1 is an up-trend (line on the lower band), 1 a down-trend."""
    mid = (high + low) / 2
    upper, lower = (mid + mult * atr).tolist(), (mid - mult * atr).tolist()
    c = close.tolist()
    n = len(c)
    line, side = np.full(n, np.nan), np.zeros(n)
    on_upper = False
    for i in range(1, n):
        pu, pl, pc = upper[i - 1], lower[i - 1], c[i - 1]
        if not (lower[i] > pl or pc < pl):
            lower[i] = pl
        if not (upper[i] < pu or pc > pu):
            upper[i] = pu
        if i == 1:
            d, value = 1, lower[i]
            on_upper = False
        else:
            d = (-1 if c[i] > upper[i] else 1) if on_upper else (1 if c[i] < lower[i] else -1)
            on_upper = d == 1
            value = upper[i] if on_upper else lower[i]
        side[i], line[i] = d, value
    return line, side


def parabolic_sar(high, low, step: float = 0.02, cap: float = 0.2) -> np.ndarray:
    """Long-side parabolic SAR; NULL during short phases. Starts long at the first low."""
    h, lw = high.tolist(), low.tolist()
    n = len(h)
    out = np.full(n, np.nan)
    if n == 0:
        return out
    long, sar, ep, af = True, lw[0], h[0], step
    for i in range(1, n):
        sar += af * (ep - sar)
        if long:
            sar = min(sar, lw[i - 1], lw[max(i - 2, 0)])
            if lw[i] < sar:
                long, sar, ep, af = False, ep, lw[i], step
            elif h[i] > ep:
                ep, af = h[i], min(af + step, cap)
        else:
            sar = max(sar, h[i - 1], h[max(i - 2, 0)])
            if h[i] > sar:
                long, sar, ep, af = True, ep, h[i], step
            elif lw[i] < ep:
                ep, af = lw[i], min(af + step, cap)
        if long:
            out[i] = sar
    return out


def pack(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> dict[str, np.ndarray]:
    """All recursive columns of one series."""
    out = {f"ema_{n}": ema(close, n) for n in (9, 20, 50, 100, 200)}
    out["macd"] = ema(close, 12) - ema(close, 26)
    out["macd_signal"] = ema(out["macd"], 9)
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    out.update({f"rsi_{n}": rsi(close, n) for n in (9, 14, 21)})
    out["stoch_rsi"] = stochastic_rsi(out["rsi_14"])
    tr = true_range(high, low, close)
    out["adx_14"], out["plus_di"], out["minus_di"] = directional(high, low, tr)
    out["atr_14"], out["atr_21"] = wilder(tr, 14), wilder(tr, 21)
    band = 2 * ema(tr, 20)
    out["kc_upper"], out["kc_lower"] = out["ema_20"] + band, out["ema_20"] - band
    out["psar"] = parabolic_sar(high, low)
    out["supertrend"], out["supertrend_dir"] = supertrend(high, low, close, wilder(tr, 10, 0))
    return out
