"""Rule documents of the seeded strategies and the strategy catalogue."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.params import DEFAULTS

# The seeded rule documents. A condition's value is a literal or
# "indicator:NAME".
STRATEGIES = [
    {"strategy_id": "S001", "name": "EMA Crossover Momentum", "type": "trend_following",
     "timeframes": ["swing", "medium"], "best_cycles": ["bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "ema_9", "op": "crosses_above", "value": "indicator:ema_21"},
         {"indicator": "adx_14", "op": ">=", "value": 25},
         {"indicator": "rsi_14", "op": ">=", "value": 50},
         {"indicator": "rsi_14", "op": "<=", "value": 70},
         {"indicator": "close", "op": ">", "value": "indicator:ema_50"}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "ema_9", "op": "crosses_below", "value": "indicator:ema_21"},
         {"indicator": "rsi_14", "op": ">=", "value": 75}]},
     "stoploss_rules": {"type": "atr_based", "atr_period": 14, "multiplier": 2.0, "trailing": True},
     "parameters": {"ema_fast": 9, "ema_slow": 21, "adx_threshold": 25, "rsi_min": 50, "rsi_max": 70,
                    "rsi_exit": 75, "volume_min_ratio": 1.2, "atr_sl_mult": 2.0, "atr_target_mult": 3.0}},
    {"strategy_id": "S002", "name": "Supertrend Breakout", "type": "trend_following",
     "timeframes": ["swing", "medium"], "best_cycles": ["bull", "neutral"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "supertrend_dir", "op": "crosses_above", "value": 0},
         {"indicator": "volume_ratio", "op": ">=", "value": 1.5},
         {"indicator": "close", "op": ">", "value": "indicator:ema_20"}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "supertrend_dir", "op": "crosses_below", "value": 0}]},
     "stoploss_rules": {"type": "supertrend", "use_supertrend_as_sl": True, "atr_period": 10, "multiplier": 3.0},
     "parameters": {"atr_period": 10, "multiplier": 3.0, "volume_min_ratio": 1.5, "ema_filter": 20,
                    "atr_target_mult": 2.5}},
    {"strategy_id": "S003", "name": "RSI Mean Reversion", "type": "mean_reversion",
     "timeframes": ["swing"], "best_cycles": ["neutral", "bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "rsi_14", "op": "<=", "value": 35},
         {"indicator": "bb_pct_b", "op": "<=", "value": 0.1},
         {"indicator": "close", "op": ">", "value": "indicator:bb_lower"},
         {"indicator": "volume_ratio", "op": ">=", "value": 1.0}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "rsi_14", "op": ">=", "value": 55},
         {"indicator": "bb_pct_b", "op": ">=", "value": 0.5}]},
     "stoploss_rules": {"type": "atr_based", "atr_period": 14, "multiplier": 1.5, "trailing": False},
     "parameters": {"rsi_entry": 35, "rsi_exit": 55, "bb_pct_entry": 0.1, "bb_pct_exit": 0.5,
                    "atr_sl_mult": 1.5, "atr_target_mult": 2.5}},
    {"strategy_id": "S004", "name": "52-Week High Breakout", "type": "breakout",
     "timeframes": ["medium", "long_term"], "best_cycles": ["bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "pct_from_52w_high", "op": ">=", "value": -1.0},
         {"indicator": "volume_ratio", "op": ">=", "value": 2.0},
         {"indicator": "close", "op": ">", "value": "indicator:ema_50"},
         {"indicator": "adx_14", "op": ">=", "value": 20}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "pct_from_52w_high", "op": "<=", "value": -10.0},
         {"indicator": "close", "op": "<", "value": "indicator:ema_50"}]},
     "stoploss_rules": {"type": "trailing_pct", "trail_pct": 8.0},
     "parameters": {"near_high_threshold": -1.0, "volume_min_ratio": 2.0, "trail_stop_pct": 8.0,
                    "ema_filter": 50, "adx_min": 20, "atr_target_mult": 4.0}},
    {"strategy_id": "S005", "name": "VWAP Intraday Reversal", "type": "mean_reversion",
     "timeframes": ["intraday"], "best_cycles": ["bull", "neutral"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "pct_from_vwap", "op": "<=", "value": -1.5},
         {"indicator": "rsi_9", "op": "<=", "value": 35},
         {"indicator": "volume_ratio", "op": ">=", "value": 1.5}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "close", "op": ">=", "value": "indicator:vwap"},
         {"indicator": "time", "op": ">=", "value": "15:15"}]},
     "stoploss_rules": {"type": "fixed_pct", "pct": 1.0, "eod_force_exit": True},
     "parameters": {"vwap_dip_pct": -1.5, "rsi_entry": 35, "volume_min_ratio": 1.5, "sl_pct": 1.0,
                    "target_pct": 1.5}},
    {"strategy_id": "S006", "name": "Ichimoku Cloud Breakout", "type": "trend_following",
     "timeframes": ["medium", "long_term"], "best_cycles": ["bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "close", "op": ">", "value": "indicator:ichimoku_senkou_a"},
         {"indicator": "close", "op": ">", "value": "indicator:ichimoku_senkou_b"},
         {"indicator": "ichimoku_tenkan", "op": ">", "value": "indicator:ichimoku_kijun"},
         {"indicator": "ichimoku_chikou", "op": ">", "value": "indicator:close_26d_ago"}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "close", "op": "<", "value": "indicator:ichimoku_senkou_b"},
         {"indicator": "ichimoku_tenkan", "op": "<", "value": "indicator:ichimoku_kijun"}]},
     "stoploss_rules": {"type": "ichimoku", "use_cloud_bottom_as_sl": True},
     "parameters": {"tenkan_period": 9, "kijun_period": 26, "senkou_period": 52, "atr_target_mult": 3.0}},
    {"strategy_id": "S007", "name": "Turtle Trading 20-10", "type": "breakout",
     "timeframes": ["medium", "long_term"], "best_cycles": ["bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "close", "op": ">=", "value": "indicator:high_20d"},
         {"indicator": "adx_14", "op": ">=", "value": 15}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "close", "op": "<=", "value": "indicator:low_10d"}]},
     "stoploss_rules": {"type": "atr_based", "atr_period": 20, "multiplier": 2.0, "trailing": True},
     "parameters": {"entry_period": 20, "exit_period": 10, "atr_period": 20, "atr_sl_mult": 2.0, "adx_min": 15}},
    {"strategy_id": "S008", "name": "MACD Histogram Divergence", "type": "momentum",
     "timeframes": ["swing", "medium"], "best_cycles": ["neutral", "bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "macd_hist", "op": "bullish_divergence", "lookback": 10},
         {"indicator": "rsi_14", "op": ">=", "value": 40},
         {"indicator": "macd_hist", "op": ">", "value": "indicator:macd_hist_prev"},
         {"indicator": "volume_ratio", "op": ">=", "value": 1.0}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "macd_hist", "op": "<", "value": 0},
         {"indicator": "rsi_14", "op": ">=", "value": 70}]},
     "stoploss_rules": {"type": "atr_based", "atr_period": 14, "multiplier": 1.8, "trailing": False},
     "parameters": {"divergence_lookback": 10, "rsi_min": 40, "rsi_exit": 70, "atr_sl_mult": 1.8,
                    "atr_target_mult": 2.5}},
    {"strategy_id": "S009", "name": "Bollinger Band Squeeze Breakout", "type": "volatility_breakout",
     "timeframes": ["swing", "medium"], "best_cycles": ["bull", "neutral"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "bb_width", "op": "squeeze_breakout", "squeeze_lookback": 126},
         {"indicator": "close", "op": ">", "value": "indicator:bb_upper"},
         {"indicator": "volume_ratio", "op": ">=", "value": 1.8},
         {"indicator": "close", "op": ">", "value": "indicator:ema_20"}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "close", "op": "<", "value": "indicator:bb_mid"},
         {"indicator": "rsi_14", "op": ">=", "value": 78}]},
     "stoploss_rules": {"type": "atr_based", "atr_period": 14, "multiplier": 2.0, "trailing": True},
     "parameters": {"squeeze_lookback": 126, "volume_min_ratio": 1.8, "rsi_exit": 78, "atr_sl_mult": 2.0,
                    "atr_target_mult": 3.0}},
    {"strategy_id": "S010", "name": "Fundamental Value + Momentum", "type": "value_momentum",
     "timeframes": ["long_term"], "best_cycles": ["bear", "neutral"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "pe_vs_sector", "op": "<=", "value": 0.85},
         {"indicator": "roe", "op": ">=", "value": 15},
         {"indicator": "revenue_growth", "op": ">=", "value": 10},
         {"indicator": "close", "op": ">", "value": "indicator:ema_200"},
         {"indicator": "rs_nifty200", "op": ">", "value": 1.0}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "pe_vs_sector", "op": ">=", "value": 1.3},
         {"indicator": "roe", "op": "<=", "value": 10},
         {"indicator": "close", "op": "<", "value": "indicator:ema_200"},
         {"indicator": "time_held_months", "op": ">=", "value": 18}]},
     "stoploss_rules": {"type": "fixed_pct", "pct": 15.0, "trailing": False},
     "parameters": {"pe_discount": 0.85, "roe_min": 15.0, "revenue_growth_min": 10.0, "sl_pct": 15.0,
                    "max_hold_months": 18}},
    {"strategy_id": "S011", "name": "Gap and Go", "type": "momentum",
     "timeframes": ["intraday"], "best_cycles": ["bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "gap_pct", "op": ">=", "value": 1.5},
         {"indicator": "close", "op": ">=", "value": "indicator:prev_close"},
         {"indicator": "time", "op": ">=", "value": "09:25"},
         {"indicator": "volume_ratio", "op": ">=", "value": 2.0}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "return_pct", "op": ">=", "value": "indicator:gap_pct_x2"},
         {"indicator": "time", "op": ">=", "value": "15:15"},
         {"indicator": "close", "op": "<", "value": "indicator:prev_close"}]},
     "stoploss_rules": {"type": "prev_close", "eod_force_exit": True},
     "parameters": {"min_gap_pct": 1.5, "volume_min_ratio": 2.0, "target_mult": 2.0}},
    {"strategy_id": "S012", "name": "Sector Rotation Momentum", "type": "macro_rotation",
     "timeframes": ["medium", "long_term"], "best_cycles": ["neutral", "bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "sector_cycle", "op": "==", "value": "bull"},
         {"indicator": "rs_percentile", "op": ">=", "value": 70},
         {"indicator": "close", "op": ">", "value": "indicator:ema_50"},
         {"indicator": "rsi_14", "op": ">=", "value": 50},
         {"indicator": "adx_14", "op": ">=", "value": 20}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "sector_cycle", "op": "==", "value": "bear"},
         {"indicator": "rs_percentile", "op": "<=", "value": 40},
         {"indicator": "close", "op": "<", "value": "indicator:ema_50"}]},
     "stoploss_rules": {"type": "atr_based", "atr_period": 14, "multiplier": 2.5, "trailing": True},
     "parameters": {"rs_min_percentile": 70, "rs_exit_percentile": 40, "adx_min": 20, "ema_filter": 50,
                    "atr_sl_mult": 2.5, "atr_target_mult": 3.5}},
    {"strategy_id": "A1", "name": "Opening Range Breakout + VWAP", "type": "intraday_breakout",
     "timeframes": ["intraday"], "best_cycles": ["bull", "neutral"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "close_5m", "op": ">", "value": "indicator:orb_high"},
         {"indicator": "close_5m", "op": ">", "value": "indicator:vwap"},
         {"indicator": "volume_5m_ratio", "op": ">=", "value": 1.5},
         {"indicator": "time", "op": "<=", "value": "13:30"}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "time", "op": ">=", "value": "15:15"},
         {"indicator": "sl_hit", "op": "is_true", "value": 1}]},
     "stoploss_rules": {"type": "atr_based", "atr_period": 14, "multiplier": 1.0, "timeframe": "5min",
                        "eod_force_exit": True},
     "parameters": {"orb_period_minutes": 15, "volume_min_ratio": 1.5, "atr_sl_mult": 1.0,
                    "atr_target_mult": 1.5, "max_entry_time": "13:30", "force_exit_time": "15:15",
                    "min_liquidity_cr": 50}},
    {"strategy_id": "A4", "name": "Larry Williams %R Mean Reversion", "type": "mean_reversion",
     "timeframes": ["swing"], "best_cycles": ["neutral", "bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "williams_r_10_past", "op": "<=", "value": -100},
         {"indicator": "days_since_r100", "op": ">=", "value": 5},
         {"indicator": "williams_r_10", "op": ">=", "value": -85},
         {"indicator": "close", "op": ">", "value": "indicator:sma_200"}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "williams_r_10", "op": ">=", "value": -50}]},
     "stoploss_rules": {"type": "atr_based", "atr_period": 10, "multiplier": 1.0, "trailing": False},
     "parameters": {"williams_period": 10, "wait_days": 5, "entry_threshold": -85, "exit_threshold": -50,
                    "atr_sl_mult": 1.0, "atr_target_mult": 2.0}},
    {"strategy_id": "B1", "name": "Jesse Livermore Pivotal Points", "type": "price_action_breakout",
     "timeframes": ["swing", "medium"], "best_cycles": ["bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "close", "op": ">", "value": "indicator:pivot_major"},
         {"indicator": "pivot_range", "op": "<=", "value": 0.05},
         {"indicator": "pivot_duration", "op": ">=", "value": 15},
         {"indicator": "volume_ratio", "op": ">=", "value": 2.0},
         {"indicator": "follow_through", "op": "is_true", "value": 1}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "close", "op": "<", "value": "indicator:previous_sub_pivot"}]},
     "stoploss_rules": {"type": "pivot_based", "use_pivot_low": True},
     "parameters": {"min_consolidation_days": 15, "max_range_pct": 5.0, "volume_min_ratio": 2.0,
                    "initial_position_pct": 0.40, "pyramid_1_pct": 0.30, "pyramid_1_profit": 5.0,
                    "pyramid_2_pct": 0.30, "pyramid_2_profit": 10.0}},
    {"strategy_id": "B2", "name": "Stan Weinstein Stage 2 Breakout", "type": "trend_following",
     "timeframes": ["medium", "long_term"], "best_cycles": ["bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "close_weekly", "op": ">", "value": "indicator:sma_30wk"},
         {"indicator": "sma_30wk", "op": ">", "value": "indicator:sma_30wk_4w_ago"},
         {"indicator": "rs_line_new_high", "op": "is_true", "value": 1},
         {"indicator": "volume_weekly", "op": ">=", "value": "indicator:vol_13wk_avg"}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "close_weekly", "op": "<", "value": "indicator:sma_30wk"},
         {"indicator": "volume_weekly_high", "op": "is_true", "value": 1}]},
     "stoploss_rules": {"type": "ma_based", "use_ma": "sma_30wk", "trailing": True},
     "parameters": {"ma_period_weeks": 30, "volume_period_weeks": 13, "rs_lookback_weeks": 52}},
    {"strategy_id": "B3", "name": "IBD Base Pattern Breakout", "type": "base_breakout",
     "timeframes": ["swing", "medium"], "best_cycles": ["bull", "neutral"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "base_pattern_valid", "op": "is_true", "value": 1},
         {"indicator": "close", "op": ">=", "value": "indicator:pivot_buy_point"},
         {"indicator": "volume_ratio", "op": ">=", "value": 1.40},
         {"indicator": "rs_line_new_high", "op": "is_true", "value": 1}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "pnl_pct", "op": ">=", "value": 20},
         {"indicator": "pnl_pct", "op": "<=", "value": -8}]},
     "stoploss_rules": {"type": "fixed_pct", "pct": 8.0, "from_entry": True},
     "parameters": {"min_base_weeks": 4, "max_base_weeks": 65, "volume_breakout_mult": 1.40,
                    "pivot_offset_pct": 0.10, "hard_stop_pct": 8.0, "partial_profit_pct": 20.0}},
    {"strategy_id": "B4", "name": "Darvas Box Theory", "type": "box_breakout",
     "timeframes": ["swing", "medium"], "best_cycles": ["bull"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "close", "op": ">", "value": "indicator:box_high"},
         {"indicator": "box_confirmed", "op": "is_true", "value": 1},
         {"indicator": "volume_ratio", "op": ">=", "value": 1.3},
         {"indicator": "eps_growth_yoy", "op": ">=", "value": 20}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "close", "op": "<=", "value": "indicator:box_low"}]},
     "stoploss_rules": {"type": "box_based", "use_box_low": True, "trailing": True},
     "parameters": {"box_confirm_days": 3, "volume_min_ratio": 1.3, "eps_growth_min": 20.0}},
    {"strategy_id": "B5", "name": "Anchored VWAP Support/Resistance", "type": "vwap_bounce",
     "timeframes": ["swing"], "best_cycles": ["bull", "neutral"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "close", "op": ">=", "value": "indicator:avwap_anchor"},
         {"indicator": "close_prev", "op": "<=", "value": "indicator:avwap_anchor"},
         {"indicator": "volume_ratio", "op": ">=", "value": 1.2},
         {"indicator": "rsi_14", "op": ">=", "value": 40},
         {"indicator": "rsi_14", "op": "<=", "value": 60}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "close", "op": ">=", "value": "indicator:prior_swing_high"}]},
     "stoploss_rules": {"type": "atr_based", "atr_period": 14, "multiplier": 1.0, "below_avwap": True},
     "parameters": {"anchor_event_types": ["earnings", "52w_high", "ipo"], "volume_min_ratio": 1.2,
                    "rsi_min": 40, "rsi_max": 60, "atr_sl_mult": 1.0}},
    {"strategy_id": "C1", "name": "Time-Series Momentum (TSMOM)", "type": "momentum",
     "timeframes": ["medium", "long_term"], "best_cycles": ["bull", "neutral"],
     "entry_rules": {"logic": "AND", "conditions": [
         {"indicator": "r_252", "op": ">", "value": 0},
         {"indicator": "close", "op": ">", "value": "indicator:sma_200"}]},
     "exit_rules": {"logic": "OR", "conditions": [
         {"indicator": "r_252", "op": "<=", "value": 0},
         {"indicator": "close", "op": "<=", "value": "indicator:sma_200"}]},
     "stoploss_rules": {"type": "drawdown_based", "max_dd_pct": 25.0},
     "parameters": {"return_period": 252, "target_vol": 0.12, "rebalance_freq": "weekly",
                    "max_drawdown_exit": 25.0}},
]

RULES_SCHEMA = ("logic string, conditions array<struct<indicator string, op string, value string, "
                "lookback int, squeeze_lookback int>>")
STOP_SCHEMA = "type string, multiplier double, pct double, trail_pct double, trailing boolean"
CATALOG_SCHEMA = ("strategy_id string, name string, type string, timeframes string, best_cycles string, "
                  "entry_rules string, exit_rules string, stoploss_rules string, parameters string, "
                  "discovered_by string, generation int, is_active boolean")
JSON_COLUMNS = ("timeframes", "best_cycles", "entry_rules", "exit_rules", "stoploss_rules", "parameters")


def catalog(spark: SparkSession, docs: list[dict] = STRATEGIES) -> DataFrame:
    """Strategy table: one row per rule document, nested parts as JSON text."""
    rows = [(s["strategy_id"], s["name"], s["type"], *[json.dumps(s[c]) for c in JSON_COLUMNS],
             s.get("discovered_by", "seeded"), s.get("generation", 0), s.get("is_active", True)) for s in docs]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def documents(catalog_df: DataFrame) -> list[dict]:
    """Rule documents of a strategy table. They become plan text, so they are read here."""
    out = []
    for r in catalog_df.orderBy("strategy_id").toLocalIterator():
        doc = r.asDict()
        doc.update({c: json.loads(doc[c]) for c in JSON_COLUMNS if doc[c]})
        out.append(doc)
    return out


def parsed(catalog_df: DataFrame) -> DataFrame:
    """Catalogue with native arrays, rule structs and stop rules."""
    return catalog_df.withColumns({
        "timeframes": F.from_json("timeframes", "array<string>"),
        "best_cycles": F.from_json("best_cycles", "array<string>"),
        "entry_rules": F.from_json("entry_rules", RULES_SCHEMA),
        "exit_rules": F.from_json("exit_rules", RULES_SCHEMA),
        "stop": F.from_json("stoploss_rules", STOP_SCHEMA),
        "target_mult": F.get_json_object("parameters", "$.atr_target_mult").cast("double")})


def find(catalog_df: DataFrame, active_only: bool = False, type_: str | None = None, name: str | None = None,
         timeframe: str | None = None) -> DataFrame:
    """Catalogue lookup by activity, type, name and timeframe."""
    out = catalog_df
    if active_only:
        out = out.filter("is_active")
    if type_ is not None:
        out = out.filter(F.col("type") == type_)
    if name is not None:
        out = out.filter(F.col("name") == name)
    if timeframe is not None:
        out = out.filter(F.array_contains(F.from_json("timeframes", "array<string>"), timeframe))
    return out.orderBy("strategy_id")


def next_generation(catalog_df: DataFrame, template: str) -> DataFrame:
    """Number of the next generation of a template's discovered variants."""
    own = (F.col("discovered_by") == "genetic") & F.col("name").startswith(template)
    return catalog_df.agg((F.coalesce(F.max(F.when(own, F.col("generation"))), F.lit(0)) + 1).alias("generation"))


# Stop rule parts as columns, so that one expression serves literal rules (the
# CASE folds away) and rules read from a table alike.

def rule_parts(doc: dict) -> dict[str, Column]:
    sl = doc.get("stoploss_rules", {})
    return {"type": F.lit(sl.get("type", "atr_based")), "multiplier": F.lit(float(sl.get("multiplier", 2.0))),
            "pct": F.lit(float(sl.get("pct", 7.0))), "trail_pct": F.lit(float(sl.get("trail_pct", 8.0))),
            "target_mult": F.lit(float(doc.get("parameters", {}).get("atr_target_mult", 2.0)))}


def table_rule_parts(prefix: str = "") -> dict[str, Column]:
    """Same parts from the columns of ``parsed``."""
    s = F.col(f"{prefix}stop")
    return {"type": F.coalesce(s["type"], F.lit("atr_based")), "multiplier": F.coalesce(s["multiplier"], F.lit(2.0)),
            "pct": F.coalesce(s["pct"], F.lit(7.0)), "trail_pct": F.coalesce(s["trail_pct"], F.lit(8.0)),
            "target_mult": F.coalesce(F.col(f"{prefix}target_mult"), F.lit(2.0))}


def _positive(name: str, default: Column) -> Column:
    c = F.col(name)
    return F.when(c.isNull() | (c == 0), default).otherwise(c)


def stop_loss(parts: dict[str, Column], entry: Column, close: Column) -> Column:
    """Stop price of an entry, by the type of the stop rule, at 2 decimals."""
    atr = _positive("atr_14", close * 0.02)
    kind = parts["type"]
    cloud = F.least(_positive("ichimoku_senkou_b", entry * 0.92), _positive("ichimoku_senkou_a", entry * 0.92))
    raw = (F.when(kind == "atr_based", entry - atr * parts["multiplier"])
           .when(kind == "fixed_pct", entry * (1 - parts["pct"] / 100))
           .when(kind == "trailing_pct", entry * (1 - parts["trail_pct"] / 100))
           .when(kind == "supertrend", _positive("supertrend", entry - atr * 2.0))
           .when(kind == "ichimoku", cloud)
           .when(kind == "prev_close", F.coalesce("prev_close", entry * 0.99))
           .otherwise(entry * 0.95))
    return F.bround(raw, 2)


def target_price(parts: dict[str, Column], entry: Column, stop: Column) -> Column:
    """Larger of entry + ATR multiple and 1.5 times the risk, at 2 decimals."""
    atr = _positive("atr_14", entry * 0.02)
    return F.bround(F.greatest(entry + atr * parts["target_mult"], entry + (entry - stop) * DEFAULTS.min_risk_reward), 2)
