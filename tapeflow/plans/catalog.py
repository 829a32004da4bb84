"""Imports every query module so that the registry is complete."""

from tapeflow.plans import q_indicators, q_portfolio, q_regimes, q_signals, q_strategies, q_streaming, q_trades  # noqa: F401
from tapeflow.plans.registry import COVERS, QUERIES, oracles  # noqa: F401
