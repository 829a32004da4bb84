"""SQL text of rule documents, for the SQL twins of the rule queries."""

from __future__ import annotations

PANEL = set("""open high low close volume sma_20 sma_50 sma_200 ichimoku_tenkan ichimoku_kijun ichimoku_senkou_a
ichimoku_senkou_b stoch_k stoch_d williams_r cci_20 roc_10 roc_20 mfi_14 bb_upper bb_mid bb_lower bb_pct_b bb_width
hist_vol_21 hist_vol_63 obv cmf_20 volume_sma20 volume_ratio pct_from_52w_high pct_from_52w_low ema_9 ema_20 ema_50
ema_100 ema_200 macd macd_signal macd_hist rsi_9 rsi_14 rsi_21 stoch_rsi adx_14 plus_di minus_di atr_14 atr_21
kc_upper kc_lower psar supertrend supertrend_dir pct_from_ema200 rs_nifty200 prev_close r_252 williams_r_10
williams_r_10_past days_since_r100 sector_cycle rs_percentile pe_ratio pe_vs_sector roe revenue_growth""".split())

GAP = "CASE WHEN lag(close) OVER w <> 0 THEN (open - lag(close) OVER w) / lag(close) OVER w * 100 END"
DERIVED = {
    "ema_21": "coalesce(ema_20, 0)",
    "high_20d": "CASE WHEN rn > 20 THEN max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END",
    "low_10d": "CASE WHEN rn > 10 THEN min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END",
    "close_26d_ago": "lag(close, 26) OVER w",
    "macd_hist_prev": "CASE WHEN rn > 1 THEN coalesce(lag(macd_hist) OVER w, 0) END",
    "pct_from_vwap": "CAST(0 AS DOUBLE)",
    "gap_pct": GAP, "gap_pct_x2": f"2 * ({GAP})",
    "ichimoku_chikou": "close",
}
DEFAULT = {"rs_percentile": "coalesce(rs_nifty200, 50)", "roe": "0", "revenue_growth": "0"}


def operand(name: str) -> str | None:
    if name in DERIVED:
        return f"({DERIVED[name]})"
    if name in PANEL:
        return f"coalesce({name}, {DEFAULT[name]})" if name in DEFAULT else name
    return None


def condition(c: dict) -> str:
    lhs, v, op = operand(c["indicator"]), c.get("value"), c["op"]
    if isinstance(v, str) and v.startswith("indicator:"):
        rhs = operand(v.removeprefix("indicator:"))
    else:
        rhs = f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if v is not None else ""
    if lhs is None or rhs is None:
        return "FALSE"
    if op in ("crosses_above", "crosses_below"):
        a, b = ("<=", ">") if op == "crosses_above" else (">=", "<")
        before = f"lag({c['indicator']}) OVER w" if c["indicator"] in PANEL else "0"
        out = f"rn > 1 AND {before} {a} {rhs} AND {lhs} {b} {rhs}"
    elif op == "bullish_divergence":
        n = c["lookback"]
        f = f"(w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out = f"rn > {n} AND close < min(close) OVER {f} AND {lhs} > min({c['indicator']}) OVER {f}"
    elif op == "squeeze_breakout":
        n = c["squeeze_lookback"]
        out = f"rn > {n} AND {lhs} <= min(bb_width) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    elif op == "is_true":
        out = f"{lhs} <> 0"
    elif op == "==":
        out = f"{lhs} = {rhs}"
    else:
        out = f"{lhs} {op} {rhs}"
    return f"coalesce({out}, FALSE)"


def rules(r: dict) -> str:
    return "(" + f" {r['logic']} ".join(condition(c) for c in r["conditions"]) + ")"


def stop(doc: dict, entry: str) -> str:
    sl = doc["stoploss_rules"]
    atr = "coalesce(nullif(atr_14, 0), close * CAST(0.02 AS DOUBLE))"
    e92 = f"{entry} * CAST(0.92 AS DOUBLE)"
    raw = {
        "atr_based": f"{entry} - {atr} * {sl.get('multiplier', 2.0)}",
        "fixed_pct": f"{entry} * (1 - CAST({sl.get('pct', 7.0)} AS DOUBLE) / 100)",
        "trailing_pct": f"{entry} * (1 - CAST({sl.get('trail_pct', 8.0)} AS DOUBLE) / 100)",
        "supertrend": f"coalesce(nullif(supertrend, 0), {entry} - {atr} * 2)",
        "ichimoku": f"least(coalesce(nullif(ichimoku_senkou_b, 0), {e92}), coalesce(nullif(ichimoku_senkou_a, 0), {e92}))",
        "prev_close": f"coalesce(prev_close, {entry} * CAST(0.99 AS DOUBLE))",
    }.get(sl["type"], f"{entry} * CAST(0.95 AS DOUBLE)")
    return f"round_even({raw}, 2)"


def target(doc: dict, entry: str, stop_sql: str) -> str:
    mult = doc["parameters"].get("atr_target_mult", 2.0)
    atr = f"coalesce(nullif(atr_14, 0), {entry} * CAST(0.02 AS DOUBLE))"
    return f"round_even(greatest({entry} + {atr} * CAST({mult} AS DOUBLE), {entry} + ({entry} - {stop_sql}) * CAST(1.5 AS DOUBLE)), 2)"


def signal_rows(docs: list[dict]) -> str:
    """Rows (strategy_id, symbol, rn, …, entry, exit, stop, target, trail) of all documents."""
    buy = "close * CAST(1.001 AS DOUBLE)"
    parts = []
    for d in docs:
        sl = d["stoploss_rules"]
        trail = f"CAST({sl.get('trail_pct', 7) / 100} AS DOUBLE)" if sl.get("trailing") else "CAST(NULL AS DOUBLE)"
        s = stop(d, buy)
        parts.append(
            f"SELECT '{d['strategy_id']}' AS strategy_id, symbol, rn, date, close, cycle, {rules(d['entry_rules'])} AS entry, "
            f"{rules(d['exit_rules'])} AS exit, {s} AS stop, {target(d, buy, s)} AS target, {trail} AS trail "
            f"FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)")
    return "\nUNION ALL\n".join(parts)
