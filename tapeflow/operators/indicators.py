"""Technical indicator columns per (symbol, date).

One shuffle by symbol serves everything: a single Arrow pass over sorted series
computes rolling and recursive columns in packs (``tapeflow.operators.packs``).
Where only some rolling columns are asked, they are window functions in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeflow.functions.rules import look_back_column
from tapeflow.functions.windows import all_of, long_extreme, long_mean, previous, running, series, trailing
from tapeflow.operators import packs, recursive
from tapeflow.params import DEFAULTS

WINDOW_COLUMNS = (
    "sma_20", "sma_50", "sma_200",
    "ichimoku_tenkan", "ichimoku_kijun", "ichimoku_senkou_a", "ichimoku_senkou_b", "ichimoku_chikou",
    "stoch_k", "stoch_d", "williams_r", "cci_20", "roc_10", "roc_20", "mfi_14",
    "bb_upper", "bb_mid", "bb_lower", "bb_pct_b", "bb_width",
    "hist_vol_21", "hist_vol_63", "obv", "cmf_20", "volume_sma20", "volume_ratio",
    "pct_from_52w_high", "pct_from_52w_low",
)
INDICATORS = WINDOW_COLUMNS + recursive.COLUMNS + ("pct_from_ema200", "rs_nifty200")
PAST_COLUMNS = ("r_252", "williams_r_10", "days_since_r100", "williams_r_10_past", "prev_close")
BAR_COLUMNS = ("symbol", "date", "open", "high", "low", "close", "volume")


def window_columns(bars: DataFrame, bars_before: Column | None = None, obv_before: Column | None = None) -> DataFrame:
    """Window columns; bars must hold the columns of ``BAR_COLUMNS``.

    Where ``bars`` start in the middle of a series, the other arguments are the number of bars before and the balance volume at the first one."""
    w = series()
    bars_before = F.lit(0) if bars_before is None else bars_before
    obv_before = F.lit(0.0) if obv_before is None else obv_before
    c, h, lo, v = F.col("close"), F.col("high"), F.col("low"), F.col("volume").cast("double")
    rn = F.col("rn")

    def full(n, agg, x):
        return F.when(rn >= n, agg(x).over(trailing(w, n)))

    def from_(n, expr):
        return F.when(rn >= n, expr)

    tp = (h + lo + c) / 3
    span = h - lo
    b = bars.withColumns({
        "rn": (F.row_number().over(w) + bars_before).cast("int"), "tp": tp, "prev": F.lag("close").over(w), "ptp": F.lag(tp).over(w),
        "mfv": F.when(span > 0, ((c - lo) - (h - c)) / span * v).otherwise(0.0),
        # Short frames and a running sum from which the long frames follow.
        "_sum": F.sum("close").over(running(w)),
        "_h13": F.max("high").over(trailing(w, 13)), "_l13": F.min("low").over(trailing(w, 13)),
        "_c14h": F.max("close").over(trailing(w, 14)), "_c14l": F.min("close").over(trailing(w, 14)),
    })
    hh = {n: F.max("high").over(trailing(w, n)) for n in (9, 14)}
    ll = {n: F.min("low").over(trailing(w, n)) for n in (9, 14)}
    hh.update({n: long_extreme(F.greatest, "_h13", w, n, 13) for n in (26, 52)})
    ll.update({n: long_extreme(F.least, "_l13", w, n, 13) for n in (26, 52)})
    flow, mid = F.col("tp") * v, F.avg("close").over(trailing(w, 20))
    b = b.withColumns({
        "sma_20": from_(20, mid), "sma_50": from_(50, long_mean("_sum", w, 50)), "sma_200": from_(200, long_mean("_sum", w, 200)),
        "ichimoku_tenkan": from_(9, (hh[9] + ll[9]) / 2), "ichimoku_kijun": from_(26, (hh[26] + ll[26]) / 2),
        "_span_b": from_(52, (hh[52] + ll[52]) / 2), "ichimoku_chikou": F.lead("close", 26).over(w),
        "_k": from_(14, F.try_divide(100 * (c - ll[14]), hh[14] - ll[14])),
        "williams_r": from_(14, F.try_divide(-100 * (hh[14] - c), hh[14] - ll[14])),
        "roc_10": 100 * (F.try_divide(c, F.lag("close", 10).over(w)) - 1),
        "roc_20": 100 * (F.try_divide(c, F.lag("close", 20).over(w)) - 1),
        "_sd20": F.stddev_pop("close").over(trailing(w, 20)),
        "_tp20": F.avg("tp").over(trailing(w, 20)), "_tps": F.collect_list("tp").over(trailing(w, 20)),
        "_ret": F.ln(c / F.col("prev")),
        "_up": F.sum(F.when(F.col("tp") > F.col("ptp"), flow).otherwise(0.0)).over(trailing(w, 14)),
        "_dn": F.sum(F.when(F.col("tp") < F.col("ptp"), flow).otherwise(0.0)).over(trailing(w, 14)),
        "obv": F.sum(F.coalesce(F.signum(c - F.col("prev")), F.lit(0.0)) * v).over(running(w)) + obv_before,
        "cmf_20": from_(20, F.try_divide(F.sum("mfv").over(trailing(w, 20)), F.sum(v).over(trailing(w, 20)))),
        "volume_sma20": full(20, F.avg, v),
        "_hi252": long_extreme(F.greatest, "_c14h", w, 252, 14), "_lo252": long_extreme(F.least, "_c14l", w, 252, 14),
    })
    b = b.withColumns({
        "stoch_k": from_(16, F.avg("_k").over(trailing(w, 3))),
        "ichimoku_senkou_a": F.lag((F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2, 26).over(w),
        "ichimoku_senkou_b": F.lag("_span_b", 26).over(w),
        "_rs": F.sum("_ret").over(running(w)), "_rq": F.sum(F.col("_ret") * F.col("_ret")).over(running(w)),
    })

    def volatility(n):
        """Annualised sample deviation of the last n log returns, in percent."""
        first, second = (F.col(x) - F.coalesce(F.lag(x, n).over(w), F.lit(0.0)) for x in ("_rs", "_rq"))
        var = F.greatest(F.lit(0.0), second - first * first / n) / (n - 1)
        return F.sqrt(var) * float(np.sqrt(252)) * 100

    mad = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_tp20"))) / 20
    up, dn, sd = F.col("_up"), F.col("_dn"), F.col("_sd20")
    m = F.col("sma_20")
    b = b.withColumns({
        "stoch_d": from_(18, F.avg("stoch_k").over(trailing(w, 3))),
        "hist_vol_21": from_(22, volatility(21)), "hist_vol_63": from_(64, volatility(63)),
        "cci_20": from_(20, F.try_divide(F.col("tp") - F.col("_tp20"), 0.015 * mad)),
        "mfi_14": from_(15, F.try_divide(100 * up, up + dn)),
        "bb_upper": m + 2 * sd, "bb_mid": m, "bb_lower": m - 2 * sd,
        "bb_pct_b": F.when(m.isNotNull(), F.try_divide(c - (m - 2 * sd), 4 * sd)),
        "bb_width": F.when(m.isNotNull(), F.try_divide(100 * 4 * sd, m)),
        "volume_ratio": F.try_divide(v, F.col("volume_sma20")),
        "pct_from_52w_high": from_(50, (c / F.col("_hi252") - 1) * 100),
        "pct_from_52w_low": from_(50, (c / F.col("_lo252") - 1) * 100),
    })
    return b


def window_indicators(bars: DataFrame) -> DataFrame:
    """Rolling indicators only, without the recursive ones."""
    return window_columns(bars.select(*BAR_COLUMNS)).select(*BAR_COLUMNS, "rn", *WINDOW_COLUMNS)


def panel_indicators(df: DataFrame, min_bars: int = 0, digits: int | None = None, last: int | None = None, past: bool = False, looks: tuple = ()) -> DataFrame:
    """Append ``rn``, the rolling and the recursive columns and ``pct_from_ema200``, rounded if ``digits`` are given; all columns of ``df`` pass through
    unchanged. Symbols with fewer than ``min_bars`` bars are left out. With ``last`` only the last rows of each series leave the tasks. With ``past`` the
    ``PAST_COLUMNS`` follow, and then the look-backs ``looks`` of rules (``rules.look_backs``).

    Tasks take the sorted series in packs (``tapeflow.operators.packs``), so a bar costs a few array operations and crosses no second shuffle. The rows of a
    task are whole series in order of date."""
    names = WINDOW_COLUMNS + recursive.COLUMNS + ("pct_from_ema200",)
    more = (PAST_COLUMNS if past else ()) + tuple(look_back_column(*look) for look in looks)
    schema = T.StructType(df.schema.fields + [T.StructField("rn", T.IntegerType())] + [T.StructField(c, T.IntegerType() if c == "days_since_r100" else T.DoubleType()) for c in names + more])

    def compute(batches):
        for t in packs.whole_series(batches):
            yield from packs.extended(t, names, min_bars, digits, last, past, looks).to_batches(max_chunksize=packs.BATCH)

    return df.repartition("symbol").sortWithinPartitions("symbol", "date").mapInArrow(compute, schema)


def indicators(bars: DataFrame, min_bars: int = DEFAULTS.min_bars_indicators, digits: int | None = None, last: int | None = None) -> DataFrame:
    """All indicator columns for symbols with at least ``min_bars`` bars, rounded where the arrays are if ``digits`` are given; of the ``last`` bars only, if given.

    ``rs_nifty200`` is NULL here; ``relative_strength`` fills it from an index.
    """
    out = panel_indicators(bars.select(*BAR_COLUMNS), min_bars, digits, last=last)
    return out.select(*BAR_COLUMNS, "rn", *INDICATORS[:-1], F.lit(None).cast("double").alias("rs_nifty200"))


def finish(panel: DataFrame, *more: str) -> DataFrame:
    """The columns of the indicator table, from those of windows and recurrences."""
    out = panel.select(*BAR_COLUMNS, "rn", *WINDOW_COLUMNS, *recursive.COLUMNS, *more)
    e = F.col("ema_200")
    return out.withColumns({
        "pct_from_ema200": (F.col("close") - e) / e * 100,
        "rs_nifty200": F.lit(None).cast("double")})


def incremental(bars: DataFrame, days: int = 30, digits: int | None = None) -> DataFrame:
    """Rows of the last ``days`` bars per symbol, for an upsert into the stored table.

    Running sums and recursive averages remember the whole series, so they are
    computed on it; only the refreshed rows leave the tasks that do so.
    """
    return indicators(bars, digits=digits, last=days)


def index_returns(index: DataFrame, close: str = "nifty200_close", n: int = 20) -> DataFrame:
    """n-row return of the index. One row per date, so one ordered task is enough."""
    w = Window.orderBy("date")
    return index.select("date", (F.try_divide(F.col(close), F.lag(close, n).over(w)) - 1).alias("_idx_ret"))


def relative_strength(panel: DataFrame, index: DataFrame, close: str = "nifty200_close",
                      n: int = 20) -> DataFrame:
    """Fill ``rs_nifty200``: n-row return of the stock over that of the index on the same date."""
    w = series()
    own = F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1
    # The index side has one row per calendar day, which bounds the broadcast.
    j = panel.drop("rs_nifty200").withColumn("_ret_n", own).join(
        F.broadcast(index_returns(index, close, n)), "date", "left")
    return j.withColumn("rs_nifty200", F.try_divide("_ret_n", "_idx_ret")).drop("_ret_n", "_idx_ret")


def momentum_252(panel: DataFrame) -> DataFrame:
    return panel.withColumn("r_252", F.try_divide(F.col("close"), F.lag("close", 252).over(series())) - 1)


def williams_reversal(bars: DataFrame, n: int = 10) -> DataFrame:
    """williams_r_10, and the number of bars since it last touched -100.

    ``williams_r_10_past`` is the value at that last touch.
    """
    w = series()
    hh, ll = F.max("high").over(trailing(w, n)), F.min("low").over(trailing(w, n))
    out = bars.withColumn("_rn", F.row_number().over(w)).withColumn(
        "williams_r_10", F.when(F.col("_rn") >= n, F.try_divide(-100 * (hh - F.col("close")), hh - ll)))
    touch = F.when(F.col("williams_r_10") <= -100, F.struct("_rn", "williams_r_10"))
    last = F.last(touch, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (out.withColumn("_t", last)
            .withColumn("days_since_r100", F.col("_rn") - F.col("_t._rn"))
            .withColumn("williams_r_10_past", F.col("_t.williams_r_10")).drop("_rn", "_t"))


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Weekly OHLCV per symbol; the week is named by its Monday."""
    wk = bars.withColumn("week", F.to_date(F.date_trunc("week", "date")))
    return wk.groupBy("symbol", "week").agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def weekly_stage(bars: DataFrame) -> DataFrame:
    """30-week mean, its value 4 weeks before, and the 13-week mean volume."""
    w = series(order="week")
    rn = F.row_number().over(w)
    out = weekly_bars(bars).withColumn("_rn", rn)
    out = out.withColumns({
        "sma_30wk": F.when(F.col("_rn") >= 30, F.avg("close").over(trailing(w, 30))),
        "vol_13wk_avg": F.when(F.col("_rn") >= 13, F.avg("volume").over(trailing(w, 13)))})
    return out.withColumn("sma_30wk_4w_ago", F.lag("sma_30wk", 4).over(w)).drop("_rn")


def darvas_box(bars: DataFrame, confirm: int = 3) -> DataFrame:
    """Darvas box from confirmed highs and lows.

    A high is a box top once the next ``confirm`` bars stay below it; a low is
    a box bottom once the next ``confirm`` bars stay above it. Both are carried
    forward from the bar that confirms them, so nothing looks ahead.
    """
    w = series()
    back = previous(w, confirm - 1)
    top = F.lag("high", confirm).over(w)
    low = F.lag("low", confirm).over(w)
    hi_since = F.greatest(F.col("high"), F.max("high").over(back))
    lo_since = F.least(F.col("low"), F.min("low").over(back))
    out = bars.withColumns({
        "_t": F.when(hi_since < top, top), "_b": F.when(lo_since > low, low)})
    out = out.withColumns({
        "box_high": F.last("_t", ignorenulls=True).over(running(w)),
        "box_low": F.last("_b", ignorenulls=True).over(running(w))})
    ok = all_of([F.col("box_high").isNotNull(), F.col("box_low").isNotNull(), F.col("box_low") < F.col("box_high")])
    return out.withColumn("box_confirmed", F.coalesce(ok, F.lit(False))).drop("_t", "_b")


def anchored_vwap(bars: DataFrame) -> DataFrame:
    """VWAP since the last new 252-bar closing high (or the first bar)."""
    w = series()
    hi = F.max("close").over(trailing(w, 252))
    tpv = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")
    out = bars.withColumn("_new", F.when(F.col("close") >= hi, 1).otherwise(0))
    out = out.withColumn("_seg", F.sum("_new").over(running(w)))
    s = Window.partitionBy("symbol", "_seg").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("avwap_anchor", F.try_divide(F.sum(tpv).over(s), F.sum("volume").over(s))).drop("_new", "_seg")
