"""Queries over indicators."""

from pyspark.sql import functions as F

from tapeflow.operators import carried
from tapeflow.operators import indicators as I
from tapeflow.plans.fixture_sql import add_table
from tapeflow.plans.registry import query
from tapeflow.sources import testdata as td

DATE = "CAST(date AS VARCHAR) AS date"

add_table("win", "bars", """
SELECT *, (high + low + close) / 3 AS tp, lag(close) OVER w AS prev, lag((high + low + close) / 3) OVER w AS ptp
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""")

add_table("win2", "win", """
SELECT *,
  CASE WHEN rn >= 20 THEN avg(close) OVER r20 END AS sma_20,
  CASE WHEN rn >= 50 THEN avg(close) OVER r50 END AS sma_50,
  CASE WHEN rn >= 200 THEN avg(close) OVER r200 END AS sma_200,
  CASE WHEN rn >= 9 THEN (max(high) OVER r9 + min(low) OVER r9) / 2 END AS ichimoku_tenkan,
  CASE WHEN rn >= 26 THEN (max(high) OVER r26 + min(low) OVER r26) / 2 END AS ichimoku_kijun,
  CASE WHEN rn >= 52 THEN (max(high) OVER r52 + min(low) OVER r52) / 2 END AS span_b,
  lead(close, 26) OVER w AS ichimoku_chikou,
  CASE WHEN rn >= 14 THEN 100 * (close - min(low) OVER r14) / (max(high) OVER r14 - min(low) OVER r14) END AS k0,
  CASE WHEN rn >= 14 THEN -100 * (max(high) OVER r14 - close) / (max(high) OVER r14 - min(low) OVER r14) END AS williams_r,
  100 * (close / lag(close, 10) OVER w - 1) AS roc_10,
  100 * (close / lag(close, 20) OVER w - 1) AS roc_20,
  CASE WHEN rn >= 20 THEN stddev_pop(close) OVER r20 END AS sd,
  CASE WHEN rn >= 20 THEN avg(tp) OVER r20 END AS tp20,
  list(tp) OVER r20 AS tps,
  ln(close / prev) AS lr,
  sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER r14 AS up,
  sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) OVER r14 AS dn,
  sum(coalesce(sign(close - prev), 0) * CAST(volume AS DOUBLE)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv,
  CASE WHEN rn >= 20 THEN sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END) OVER r20
                          / CAST(sum(volume) OVER r20 AS DOUBLE) END AS cmf_20,
  CASE WHEN rn >= 20 THEN avg(volume) OVER r20 END AS volume_sma20,
  CASE WHEN rn >= 50 THEN (close / max(close) OVER r252 - 1) * 100 END AS pct_from_52w_high,
  CASE WHEN rn >= 50 THEN (close / min(close) OVER r252 - 1) * 100 END AS pct_from_52w_low
FROM win
WINDOW w AS (PARTITION BY symbol ORDER BY date),
  r9 AS (PARTITION BY symbol ORDER BY date ROWS 8 PRECEDING), r14 AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING),
  r20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), r26 AS (PARTITION BY symbol ORDER BY date ROWS 25 PRECEDING),
  r50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), r52 AS (PARTITION BY symbol ORDER BY date ROWS 51 PRECEDING),
  r200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), r252 AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)""")

add_table("win3", "win2", """
SELECT *,
  CASE WHEN rn >= 16 THEN avg(k0) OVER r3 END AS stoch_k,
  lag((ichimoku_tenkan + ichimoku_kijun) / 2, 26) OVER w AS ichimoku_senkou_a,
  lag(span_b, 26) OVER w AS ichimoku_senkou_b,
  CASE WHEN rn >= 22 THEN stddev_samp(lr) OVER r21 * sqrt(252) * 100 END AS hist_vol_21,
  CASE WHEN rn >= 64 THEN stddev_samp(lr) OVER r63 * sqrt(252) * 100 END AS hist_vol_63,
  CASE WHEN rn >= 20 THEN (tp - tp20) / (CAST(0.015 AS DOUBLE) * list_avg(list_transform(tps, lambda x: abs(x - tp20)))) END AS cci_20,
  CASE WHEN rn >= 15 THEN 100 * up / (up + dn) END AS mfi_14,
  sma_20 + 2 * sd AS bb_upper, sma_20 AS bb_mid, sma_20 - 2 * sd AS bb_lower,
  (close - (sma_20 - 2 * sd)) / (4 * sd) AS bb_pct_b, 100 * 4 * sd / sma_20 AS bb_width,
  volume / volume_sma20 AS volume_ratio
FROM win2
WINDOW w AS (PARTITION BY symbol ORDER BY date), r3 AS (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING),
  r21 AS (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING), r63 AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING)""")

add_table("win4", "win3", """
SELECT *, CASE WHEN rn >= 18 THEN avg(stoch_k) OVER (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING) END AS stoch_d
FROM win3""")


def rounded(df, cols, n=4):
    keys = [c for c in df.columns if c in ("symbol",)]
    out = [*keys]
    if "date" in df.columns:
        out.append(F.col("date").cast("string").alias("date"))
    return df.select(*out, *[(F.round(c, n) + 0.0).alias(c) for c in cols])


def rsql(cols, n=4):
    return ", ".join(f"round(CAST({c} AS DOUBLE), {n}) + 0.0 AS {c}" for c in cols)


GROUPS = {
    "simple_moving_averages": ("I-02 W-03", ["sma_20", "sma_50", "sma_200"]),
    "ichimoku_lines": ("I-07", ["ichimoku_tenkan", "ichimoku_kijun", "ichimoku_senkou_a", "ichimoku_senkou_b", "ichimoku_chikou"]),
    "stochastic_and_williams": ("I-08 I-10", ["stoch_k", "stoch_d", "williams_r"]),
    "commodity_channel": ("I-11", ["cci_20"]),
    "rate_of_change": ("I-12 W-01", ["roc_10", "roc_20"]),
    "money_flow": ("I-13 I-19", ["mfi_14", "cmf_20"]),
    "bollinger_bands": ("I-14", ["bb_upper", "bb_mid", "bb_lower", "bb_pct_b", "bb_width"]),
    "historical_volatility": ("I-17", ["hist_vol_21", "hist_vol_63"]),
    "volume_measures": ("I-18 I-20", ["obv", "volume_sma20", "volume_ratio"]),
    "distance_from_52w": ("I-21", ["pct_from_52w_high", "pct_from_52w_low"]),
}


def _register(name, ids, cols):
    @query(name, ids, f"SELECT symbol, {DATE}, {rsql(cols)} FROM win4", "win4")
    def run(spark, d):
        return rounded(I.window_indicators(td.bars(spark, d)), cols)


for _n, (_ids, _cols) in GROUPS.items():
    _register(_n, _ids, _cols)

# Recursive columns: one recursion over the row number carries all states.
add_table("fold_in", "bars", """
SELECT symbol, date, rn, high, low, close,
  lag(close) OVER w AS prev, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(high, 2) OVER w AS ph2, lag(low, 2) OVER w AS pl2,
  CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
  count(*) OVER (PARTITION BY symbol) AS n_bars,
  avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 8 PRECEDING) AS s9, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 11 PRECEDING) AS s12,
  avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS s20, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 25 PRECEDING) AS s26,
  avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS s50, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 99 PRECEDING) AS s100,
  avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING) AS s200
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""")


def _ema_step(e, s, n, x="b.close"):
    return (f"CASE WHEN b.rn < {n} THEN NULL WHEN b.rn = {n} THEN b.{s} "
            f"ELSE f.{e} + (CAST(2 AS DOUBLE) / {n + 1}) * ({x} - f.{e}) END")


def _wilder_step(e, x, n, first):
    return f"CASE WHEN b.rn = {first} THEN {x} WHEN b.rn > {first} THEN f.{e} + (CAST(1 AS DOUBLE) / {n}) * ({x} - f.{e}) END"


_UP, _DN = "greatest(b.close - b.prev, 0)", "greatest(b.prev - b.close, 0)"
_PLUS = "CASE WHEN b.high - b.ph > b.pl - b.low AND b.high > b.ph THEN b.high - b.ph ELSE 0 END"
_MINUS = "CASE WHEN b.pl - b.low > b.high - b.ph AND b.pl > b.low THEN b.pl - b.low ELSE 0 END"
_EMAS = [("e9", "s9", 9), ("e12", "s12", 12), ("e20", "s20", 20), ("e26", "s26", 26), ("e50", "s50", 50),
         ("e100", "s100", 100), ("e200", "s200", 200)]
_WILDERS = [(f"u{n}", _UP, n, 2) for n in (9, 14, 21)] + [(f"d{n}", _DN, n, 2) for n in (9, 14, 21)] + [
    ("dmp", _PLUS, 14, 2), ("dmm", _MINUS, 14, 2), ("datr", "b.tr", 14, 2),
    ("a10", "b.tr", 10, 1), ("a14", "b.tr", 14, 1), ("a21", "b.tr", 21, 1)]

add_table("fold", "fold_in", f"""
SELECT symbol, date, rn, close, {', '.join(f'CAST(NULL AS DOUBLE) AS {e}' for e, _, _ in _EMAS)},
  {', '.join((x.replace('b.', '') if first == 1 else 'CAST(NULL AS DOUBLE)') + f' AS {e}' for e, x, _, first in _WILDERS)}
FROM fold_in WHERE rn = 1
UNION ALL
SELECT b.symbol, b.date, b.rn, b.close, {', '.join(_ema_step(e, s, n) for e, s, n in _EMAS)},
  {', '.join(_wilder_step(e, x, n, first) for e, x, n, first in _WILDERS)}
FROM fold f JOIN fold_in b ON b.symbol = f.symbol AND b.rn = f.rn + 1""", recursive=True)

add_table("fold2", "fold fold_in", """
SELECT f.*, b.high, b.low, b.tr, b.n_bars, b.prev, b.ph, b.pl, b.ph2, b.pl2, e12 - e26 AS macd,
  CASE WHEN f.rn >= 15 THEN 100 * dmp / datr END AS plus_di, CASE WHEN f.rn >= 15 THEN 100 * dmm / datr END AS minus_di,
  CASE WHEN f.rn >= 10 THEN 100 * u9 / (u9 + d9) END AS rsi_9, CASE WHEN f.rn >= 15 THEN 100 * u14 / (u14 + d14) END AS rsi_14,
  CASE WHEN f.rn >= 22 THEN 100 * u21 / (u21 + d21) END AS rsi_21,
  avg(b.tr) OVER (PARTITION BY f.symbol ORDER BY f.rn ROWS 19 PRECEDING) AS tr20,
  avg(e12 - e26) OVER (PARTITION BY f.symbol ORDER BY f.rn ROWS 8 PRECEDING) AS macd9
FROM fold f JOIN fold_in b ON b.symbol = f.symbol AND b.rn = f.rn""")

# Second recursion: smoothings of smoothed series, supertrend and parabolic SAR.
add_table("fold3_in", "fold2", """
SELECT *, (high + low) / 2 + 3 * a10 AS ub, (high + low) / 2 - 3 * a10 AS lb,
  100 * abs(plus_di - minus_di) / (plus_di + minus_di) AS dx FROM fold2""")

add_table("fold3", "fold3_in", """
SELECT symbol, rn, CAST(NULL AS DOUBLE) AS macd_signal, CAST(NULL AS DOUBLE) AS ktr, CAST(NULL AS DOUBLE) AS adx,
  ub, lb, CAST(NULL AS DOUBLE) AS st, 0 AS dir, FALSE AS on_upper,
  TRUE AS is_long, low AS sar, high AS ep, CAST(0.02 AS DOUBLE) AS af
FROM fold3_in WHERE rn = 1
UNION ALL
SELECT symbol, rn, macd_signal, ktr, adx, ub, lb,
  CASE WHEN rn = 2 THEN lb WHEN dir = 1 THEN ub ELSE lb END, dir, rn > 2 AND dir = 1,
  CASE WHEN flip THEN NOT was_long ELSE was_long END,
  CASE WHEN flip THEN ep0 ELSE sar1 END,
  CASE WHEN flip THEN CASE WHEN was_long THEN low ELSE high END
       WHEN was_long THEN greatest(ep0, high) ELSE least(ep0, low) END,
  CASE WHEN flip THEN CAST(0.02 AS DOUBLE)
       WHEN (was_long AND high > ep0) OR (NOT was_long AND low < ep0) THEN least(af0 + CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE))
       ELSE af0 END
FROM (
  SELECT *, CASE WHEN was_long THEN low < sar1 ELSE high > sar1 END AS flip,
    CASE WHEN rn = 2 THEN 1 WHEN was_upper THEN CASE WHEN close > ub THEN -1 ELSE 1 END
         ELSE CASE WHEN close < lb THEN 1 ELSE -1 END END AS dir
  FROM (
    SELECT b.symbol, b.rn, b.close, b.high, b.low, f.on_upper AS was_upper, f.is_long AS was_long, f.ep AS ep0, f.af AS af0,
      CASE WHEN b.rn < 34 THEN NULL WHEN b.rn = 34 THEN b.macd9 ELSE f.macd_signal + CAST(0.2 AS DOUBLE) * (b.macd - f.macd_signal) END AS macd_signal,
      CASE WHEN b.rn < 20 THEN NULL WHEN b.rn = 20 THEN b.tr20 ELSE f.ktr + (CAST(2 AS DOUBLE) / 21) * (b.tr - f.ktr) END AS ktr,
      CASE WHEN b.rn = 15 THEN b.dx WHEN b.rn > 15 THEN f.adx + (CAST(1 AS DOUBLE) / 14) * (b.dx - f.adx) END AS adx,
      CASE WHEN b.ub < f.ub OR b.prev > f.ub THEN b.ub ELSE f.ub END AS ub,
      CASE WHEN b.lb > f.lb OR b.prev < f.lb THEN b.lb ELSE f.lb END AS lb,
      CASE WHEN f.is_long THEN least(f.sar + f.af * (f.ep - f.sar), b.pl, coalesce(b.pl2, b.pl))
           ELSE greatest(f.sar + f.af * (f.ep - f.sar), b.ph, coalesce(b.ph2, b.ph)) END AS sar1
    FROM fold3 f JOIN fold3_in b ON b.symbol = f.symbol AND b.rn = f.rn + 1))""", recursive=True)

add_table("rec", "fold3 fold3_in", """
SELECT i.symbol, i.date, i.rn, i.close, e9 AS ema_9, e20 AS ema_20, e50 AS ema_50, e100 AS ema_100, e200 AS ema_200,
  macd, macd_signal, macd - macd_signal AS macd_hist, rsi_9, rsi_14, rsi_21,
  CASE WHEN i.rn >= 28 THEN adx END AS adx_14, plus_di, minus_di,
  CASE WHEN i.rn >= 14 THEN a14 END AS atr_14, CASE WHEN i.rn >= 21 THEN a21 END AS atr_21,
  e20 + 2 * ktr AS kc_upper, e20 - 2 * ktr AS kc_lower,
  CASE WHEN is_long AND i.rn > 1 THEN sar END AS psar, st AS supertrend, CAST(dir AS DOUBLE) AS supertrend_dir,
  CASE WHEN i.rn >= 28 THEN 100 * (rsi_14 - min(rsi_14) OVER r14) / (max(rsi_14) OVER r14 - min(rsi_14) OVER r14) END AS k0
FROM fold3_in i JOIN fold3 f ON f.symbol = i.symbol AND f.rn = i.rn
WHERE n_bars >= 250
WINDOW r14 AS (PARTITION BY i.symbol ORDER BY i.rn ROWS 13 PRECEDING)""")

add_table("rec1", "rec", """
SELECT *, CASE WHEN rn >= 30 THEN avg(k0) OVER (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING) END AS k1 FROM rec""")

add_table("rec2", "rec1", """
SELECT *, CASE WHEN rn >= 32 THEN avg(k1) OVER (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING) END AS stoch_rsi,
  (close - ema_200) / ema_200 * 100 AS pct_from_ema200
FROM rec1""")

add_table("ind", "rec2 win4", """
SELECT w.symbol, w.date, w.rn, w.open, w.high, w.low, w.close, w.volume,
  sma_20, sma_50, sma_200, ichimoku_tenkan, ichimoku_kijun, ichimoku_senkou_a, ichimoku_senkou_b, ichimoku_chikou,
  stoch_k, stoch_d, williams_r, cci_20, roc_10, roc_20, mfi_14, bb_upper, bb_mid, bb_lower, bb_pct_b, bb_width,
  hist_vol_21, hist_vol_63, obv, cmf_20, volume_sma20, volume_ratio, pct_from_52w_high, pct_from_52w_low,
  ema_9, ema_20, ema_50, ema_100, ema_200, macd, macd_signal, macd_hist, rsi_9, rsi_14, rsi_21, stoch_rsi,
  adx_14, plus_di, minus_di, atr_14, atr_21, kc_upper, kc_lower, psar, supertrend, supertrend_dir, pct_from_ema200
FROM win4 w JOIN rec2 r ON r.symbol = w.symbol AND r.rn = w.rn""")

RECURSIVE_GROUPS = {
    "exponential_averages": ("I-01 I-22", ["ema_9", "ema_20", "ema_50", "ema_100", "ema_200", "pct_from_ema200"]),
    "macd_lines": ("I-03", ["macd", "macd_signal", "macd_hist"]),
    "wilder_rsi": ("I-04 I-09", ["rsi_9", "rsi_14", "rsi_21", "stoch_rsi"]),
    "directional_movement": ("I-05", ["adx_14", "plus_di", "minus_di"]),
    "atr_and_keltner": ("I-15 I-16", ["atr_14", "atr_21", "kc_upper", "kc_lower"]),
    "parabolic_sar": ("I-06", ["psar"]),
    "supertrend_line": ("I-23", ["supertrend", "supertrend_dir"]),
}


def _register_rec(name, ids, cols):
    @query(name, ids, f"SELECT symbol, {DATE}, {rsql(cols)} FROM rec2", "rec2")
    def run(spark, d):
        return rounded(I.indicators(td.bars(spark, d)), cols)


for _n, (_ids, _cols) in RECURSIVE_GROUPS.items():
    _register_rec(_n, _ids, _cols)

ALL = [c for c in I.INDICATORS if c != "rs_nifty200"]


@query("all_indicators", "I-26 S-13", f"SELECT symbol, {DATE}, {rsql(ALL)} FROM ind", "ind")
def all_indicators(spark, d):
    # A decimal a value and row is most of the time when Spark rounds, so the pass over the arrays does it.
    return I.indicators(td.bars(spark, d), digits=4).select("symbol", F.col("date").cast("string").alias("date"), *ALL)


@query("incremental_indicators", "I-26 W-10", f"SELECT symbol, {DATE}, {rsql(ALL)} FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30", "ind")
def incremental_indicators(spark, d):
    return I.incremental(td.bars(spark, d), days=30, digits=4).select("symbol", F.col("date").cast("string").alias("date"), *ALL)


CUTS = ("2000-06-30", "2001-08-31")


@query("refreshed_indicators", "I-26 S-13", f"SELECT symbol, {DATE}, {rsql(ALL)} FROM ind WHERE date > DATE '{CUTS[0]}'", "ind")
def refreshed_indicators(spark, d):
    """A state of the bars up to the first date, then two refreshes with the bars after it; the second also fills in lagging spans of the first."""
    bars = td.bars(spark, d)
    date = F.col("date")
    _, _, state = carried.refresh(carried.empty_state(bars), bars.filter(date <= CUTS[0]))
    first, _, state = carried.refresh(state, bars.filter((date > CUTS[0]) & (date <= CUTS[1])))
    second, spans, _ = carried.refresh(state, bars.filter(date > CUTS[1]))
    late = spans.withColumnRenamed(carried.LAGGING, "_late")
    mended = first.join(late, ["symbol", "date"], "left").withColumn(carried.LAGGING, F.coalesce("_late", carried.LAGGING)).drop("_late")
    return rounded(mended.unionByName(second), ALL)


add_table("rs", "bars market_index", """
SELECT b.*, (close / lag(close, 20) OVER w - 1) / idx AS rs_nifty200
FROM bars b LEFT JOIN (SELECT date, nifty200_close / lag(nifty200_close, 20) OVER (ORDER BY date) - 1 AS idx FROM market_index) m
  ON m.date = b.date
WINDOW w AS (PARTITION BY symbol ORDER BY b.date)""")


@query("relative_strength", "I-24 J-10", f"SELECT symbol, {DATE}, {rsql(['rs_nifty200'])} FROM rs", "rs")
def relative_strength(spark, d):
    out = I.relative_strength(td.bars(spark, d), td.market_index(spark, d))
    return rounded(out, ["rs_nifty200"])


@query("momentum_252", "I-27", f"""
SELECT symbol, {DATE}, round(close / lag(close, 252) OVER (PARTITION BY symbol ORDER BY date) - 1, 4) + 0.0 AS r_252 FROM bars""", "bars")
def momentum_252(spark, d):
    return rounded(I.momentum_252(td.bars(spark, d)), ["r_252"])


@query("williams_reversal", "I-28", f"""
SELECT symbol, {DATE}, {rsql(['williams_r_10'])}, CAST(rn - last_touch AS DOUBLE) AS days_since_r100, round(past, 4) + 0.0 AS williams_r_10_past
FROM (
  SELECT *, last_value(CASE WHEN williams_r_10 <= -100 THEN rn END IGNORE NULLS) OVER p AS last_touch,
         last_value(CASE WHEN williams_r_10 <= -100 THEN williams_r_10 END IGNORE NULLS) OVER p AS past
  FROM (SELECT *, CASE WHEN rn >= 10 THEN -100 * (max(high) OVER r - close) / (max(high) OVER r - min(low) OVER r) END AS williams_r_10
        FROM bars_raw2 WINDOW r AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING))
  WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "bars_raw2")
def williams_reversal(spark, d):
    return rounded(I.williams_reversal(td.bars_raw(spark, d)),
                   ["williams_r_10", "days_since_r100", "williams_r_10_past"])


add_table("bars_raw2", "bars_raw", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars_raw")
add_table("weekly", "bars", """
SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week, arg_min(open, date) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume
FROM bars GROUP BY 1, 2""")


@query("weekly_stage", "I-29", f"""
SELECT symbol, CAST(week AS VARCHAR) AS week, {rsql(['close', 'sma_30wk', 'vol_13wk_avg'])},
       round(lag(sma_30wk, 4) OVER (PARTITION BY symbol ORDER BY week), 4) + 0.0 AS sma_30wk_4w_ago
FROM (SELECT *, CASE WHEN row_number() OVER w >= 30 THEN avg(close) OVER (PARTITION BY symbol ORDER BY week ROWS 29 PRECEDING) END AS sma_30wk,
             CASE WHEN row_number() OVER w >= 13 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY week ROWS 12 PRECEDING) END AS vol_13wk_avg
      FROM weekly WINDOW w AS (PARTITION BY symbol ORDER BY week))""", "weekly")
def weekly_stage(spark, d):
    out = I.weekly_stage(td.bars(spark, d)).withColumn("week", F.col("week").cast("string"))
    cols = ["close", "sma_30wk", "vol_13wk_avg", "sma_30wk_4w_ago"]
    return out.select("symbol", "week", *[(F.round(c, 4) + 0.0).alias(c) for c in cols])


@query("darvas_boxes", "I-30", f"""
SELECT symbol, {DATE}, {rsql(['box_high', 'box_low'])}, coalesce(box_low < box_high, FALSE) AS box_confirmed
FROM (SELECT symbol, date, last_value(t IGNORE NULLS) OVER w AS box_high, last_value(b IGNORE NULLS) OVER w AS box_low
      FROM (SELECT *, CASE WHEN greatest(high, max(high) OVER p) < lag(high, 3) OVER w THEN lag(high, 3) OVER w END AS t,
                   CASE WHEN least(low, min(low) OVER p) > lag(low, 3) OVER w THEN lag(low, 3) OVER w END AS b
            FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date),
                 p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))
      WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))""", "bars")
def darvas_boxes(spark, d):
    out = I.darvas_box(td.bars(spark, d))
    return out.select("symbol", F.col("date").cast("string"), (F.round("box_high", 4) + 0.0).alias("box_high"),
                      (F.round("box_low", 4) + 0.0).alias("box_low"), "box_confirmed")


@query("anchored_vwap", "I-31", f"""
SELECT symbol, {DATE}, round(sum((high + low + close) / 3 * volume) OVER s / sum(volume) OVER s, 4) + 0.0 AS avwap_anchor
FROM (SELECT *, sum(CASE WHEN close >= hi THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS seg
      FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS hi FROM bars))
WINDOW s AS (PARTITION BY symbol, seg ORDER BY date ROWS UNBOUNDED PRECEDING)""", "bars")
def anchored_vwap(spark, d):
    return rounded(I.anchored_vwap(td.bars(spark, d)), ["avwap_anchor"])


@query("vix_percentile", "W-04 S-03 J-07 W-01", f"""
SELECT {DATE}, {rsql(['nifty200_1d_ret', 'nifty200_5d_ret', 'nifty200_20d_ret', 'india_vix_1d_chg', 'india_vix_pct252'])}
FROM (
  SELECT date, (nifty200_close / lag(nifty200_close, 1) OVER w - 1) * 100 AS nifty200_1d_ret,
    (nifty200_close / lag(nifty200_close, 5) OVER w - 1) * 100 AS nifty200_5d_ret,
    (nifty200_close / lag(nifty200_close, 20) OVER w - 1) * 100 AS nifty200_20d_ret,
    (india_vix / nullif(lag(india_vix, 1) OVER w, 0) - 1) * 100 AS india_vix_1d_chg,
    CASE WHEN len(vals) >= 50 THEN (len(list_filter(vals, lambda v: v < india_vix)) + (len(list_filter(vals, lambda v: v = india_vix)) + 1) / 2.0) / len(vals) * 100 END AS india_vix_pct252
  FROM (SELECT *, list(india_vix) OVER (ORDER BY date ROWS 251 PRECEDING) AS vals FROM market_index)
  WINDOW w AS (ORDER BY date))""", "market_index")
def vix_percentile(spark, d):
    from tapeflow.sources.tables import context_features, pivot_series
    long = td.market_index(spark, d).unpivot(["date"], ["nifty200_close", "india_vix"], "name", "close")
    wide = context_features(pivot_series(long, {"nifty200_close": "nifty200_close", "india_vix": "india_vix"}))
    cols = ["nifty200_1d_ret", "nifty200_5d_ret", "nifty200_20d_ret", "india_vix_1d_chg", "india_vix_pct252"]
    return rounded(wide, cols)

