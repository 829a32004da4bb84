"""Thresholds, limits and other fixed values used by the operators.

Every operator takes a ``Params`` (or one of the smaller tuples below), so a
deployment overrides values by passing its own instance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

TIMEFRAMES = ("intraday", "swing", "medium", "long_term")
CYCLES = ("bull", "bear", "neutral")

# Regime labelling thresholds per scope.
REGIME_PARAMS = {
    "market": {"bear_drawdown": -0.15, "neutral_band": 0.07, "dma_period": 200,
               "rsi_period": 14, "bear_rsi_max": 45, "bull_rsi_min": 55,
               "min_duration_days": 20},
    "sector": {"bear_drawdown": -0.12, "neutral_band": 0.06, "dma_period": 50,
               "rsi_period": 14, "bear_rsi_max": 45, "bull_rsi_min": 55,
               "min_duration_days": 15},
    "stock": {"bear_drawdown": -0.20, "neutral_band": 0.10, "dma_period": 50,
              "rsi_period": 14, "bear_rsi_max": 45, "bull_rsi_min": 55,
              "min_duration_days": 10},
}

# Columns of the three regime classifiers.
MARKET_FEATURES = (
    "nifty200_above_50dma", "nifty200_above_200dma",
    "nifty200_dma50_pct", "nifty200_dma200_pct",
    "nifty200_1d_ret", "nifty200_5d_ret", "nifty200_20d_ret",
    "india_vix", "india_vix_1d_chg", "india_vix_pct252",
    "dxy", "brent_crude", "nasdaq_5d_ret", "dow_5d_ret",
    "us_10yr_yield", "usd_inr",
    "fii_10d_sum", "dii_net_buy_sell",
    "advance_decline_ratio", "pcr_nifty",
    "pct_above_50dma", "pct_above_200dma",
    "sector_it_5d", "sector_bank_5d",
)
SECTOR_FEATURES = (
    "index_close", "ret_5d", "ret_20d", "ret_60d",
    "above_50dma", "above_200dma", "rs_vs_nifty200_20d",
    "volume_ratio", "rsi_14", "macd_hist",
    "india_vix", "nifty200_20d_ret", "market_cycle_enc",
)
STOCK_FEATURES = (
    "pct_from_ema200", "pct_from_52w_high", "pct_from_52w_low",
    "above_50dma", "above_200dma", "ema50_vs_ema200",
    "rsi_14", "rsi_9", "adx_14", "macd_hist",
    "volume_ratio", "rs_nifty200",
    "india_vix", "market_cycle_enc", "sector_cycle_enc",
    "hist_vol_21",
)

# Ordered inputs of the per-timeframe signal models.
SIGNAL_FEATURES = {
    "intraday": (
        "rsi_9", "rsi_14", "stoch_k", "stoch_d", "williams_r",
        "macd", "macd_hist", "bb_pct_b", "volume_ratio", "atr_14",
        "pct_from_vwap", "gap_pct", "adx_14",
        "market_cycle_bull", "market_cycle_bear", "india_vix",
    ),
    "swing": (
        "rsi_9", "rsi_14", "rsi_21", "stoch_k", "stoch_d",
        "macd", "macd_signal", "macd_hist", "adx_14", "plus_di", "minus_di",
        "bb_pct_b", "bb_width", "atr_14", "supertrend_dir",
        "volume_ratio", "cmf_20", "mfi_14", "roc_10",
        "pct_from_52w_high", "pct_from_ema200",
        "above_50dma", "above_200dma", "ema50_vs_ema200", "rs_nifty200",
        "market_cycle_bull", "market_cycle_bear",
        "sector_cycle_bull", "sector_cycle_bear", "india_vix",
    ),
    "medium": (
        "rsi_14", "rsi_21", "adx_14", "macd_hist",
        "bb_pct_b", "atr_14", "supertrend_dir",
        "volume_ratio", "obv", "cmf_20",
        "pct_from_52w_high", "pct_from_52w_low", "pct_from_ema200",
        "above_50dma", "above_200dma", "ema50_vs_ema200",
        "ichimoku_above_cloud", "rs_nifty200",
        "hist_vol_21", "hist_vol_63",
        "market_cycle_bull", "market_cycle_bear", "market_cycle_neutral",
        "sector_cycle_bull", "sector_cycle_bear",
        "stock_cycle_bull", "stock_cycle_bear", "india_vix",
    ),
    "long_term": (
        "rsi_14", "adx_14", "macd_hist",
        "pct_from_52w_high", "pct_from_ema200",
        "above_200dma", "ema50_vs_ema200",
        "rs_nifty200", "hist_vol_63",
        "market_cycle_bull", "market_cycle_bear",
        "stock_cycle_bull", "stock_cycle_bear", "india_vix",
        "pe_ratio", "pb_ratio", "roe", "roce",
        "debt_equity", "promoter_holding",
        "eps_growth_yoy", "revenue_growth",
    ),
}


@dataclass(frozen=True)
class Params:
    """Defaults of the capital, signal, cost and trigger settings."""

    slots: dict = field(default_factory=lambda: {
        "intraday": 3, "swing": 5, "medium": 8, "long_term": 15})
    capital: dict = field(default_factory=lambda: {
        "intraday": 250_000.0, "swing": 500_000.0,
        "medium": 750_000.0, "long_term": 1_000_000.0})
    timeframe_ratios: dict = field(default_factory=lambda: {
        "intraday": 0.10, "swing": 0.20, "medium": 0.30, "long_term": 0.40})
    strategy_ratios: dict = field(default_factory=dict)
    signal_thresholds: dict = field(default_factory=lambda: {
        "bull": 0.65, "neutral": 0.75, "bear": 0.85})
    trigger_discount: dict = field(default_factory=lambda: {
        "intraday": 0.010, "swing": 0.015, "medium": 0.030, "long_term": 0.050})
    trigger_expiry_days: dict = field(default_factory=lambda: {
        "intraday": 5, "swing": 10, "medium": 30, "long_term": 90})
    total_capital: float = 2_500_000.0
    reserve_pct: float = 0.10
    max_per_stock: float = 200_000.0
    max_sector_pct: float = 0.25
    slippage_pct: float = 0.001
    brokerage: float = 20.0
    trade_capital: float = 100_000.0
    position_pct: float = 0.02
    risk_pct: float = 0.02
    target_vol: float = 0.12
    min_risk_reward: float = 1.5
    drawdown_alert_pct: float = 0.10
    gate_sharpe: float = 1.0
    gate_win_rate: float = 0.52
    gate_min_trades: int = 50
    min_bars_indicators: int = 250
    min_bars_replay: int = 200
    min_trades: int = 20
    warmup_rows: int = 50
    stcg_rate: float = 0.15
    ltcg_rate: float = 0.10
    ltcg_exempt: float = 100_000.0
    ltcg_days: int = 365
    stale_hours: int = 25


DEFAULTS = Params()


def check_ratios(ratios: dict, exact: bool = False) -> dict:
    """Validate allocation ratios: their sum is at most 1, or 1 within 0.01."""
    total = sum(ratios.values())
    if exact and abs(total - 1.0) > 0.01:
        raise ValueError(f"ratios sum to {total:.2f}, must equal 1.0")
    if not exact and total > 1.0:
        raise ValueError(f"ratios sum to {total:.2f}, must be at most 1.0")
    return dict(ratios)
