"""Queries over the tradebook: FIFO matches, closed trades, open lots."""

from pyspark.sql import functions as F

from tapeflow.plans.registry import query
from tapeflow.sources import testdata as td


@query("fifo_matched_trades", "J-09 S-08 H-14", """
SELECT symbol, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date,
       qty, timeframe, tax_type, CAST(holding_days AS INTEGER) AS holding_days, entry_price, exit_price
FROM closed""", "closed")
def fifo_matched_trades(spark, d):
    return td.closed_trades(spark, d).select(
        "symbol", F.col("entry_date").cast("string"), F.col("exit_date").cast("string"),
        "qty", "timeframe", "tax_type", "holding_days", "entry_price", "exit_price")


@query("fifo_open_lots", "J-09", """
SELECT holding_id, symbol, timeframe, qty, avg_cost, CAST(entry_date AS VARCHAR) AS entry_date, strategy_id
FROM holdings""", "holdings")
def fifo_open_lots(spark, d):
    return td.holdings(spark, d).select(
        "holding_id", "symbol", "timeframe", "qty", "avg_cost",
        F.col("entry_date").cast("string"), "strategy_id")
