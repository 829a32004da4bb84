"""First-in first-out matching of buys against sells.

Shares of a symbol are put on a number line: every lot covers the interval
[c0, c1) of the cumulative quantity of its side. A buy and a sell match where
their intervals overlap. Both steps stay balanced when one symbol holds a
large part of all trades: cumulative quantities are built per time slice and
offset by the (small) slice totals, and the overlap is swept inside buckets of
the number line, so neither step ever sorts a whole symbol in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.scalars import infer_timeframe, tax_type

LOTS_PER_BUCKET = 64


def cumulative(trades: DataFrame, keys: list[str], qty: str, order: list[str],
               slices: list[str], group: str = "symbol") -> DataFrame:
    """Add [c0, c1) of the running quantity per key, plus per-``group`` totals.

    ``slices`` must cut the order into consecutive ranges, outer ones first
    (date, then a range within the date). Totals per slice are pre-aggregated
    before the shuffle and offset level by level: dates are ordered per key,
    ranges only within their date, so no level orders a whole hot symbol.
    """
    outer, rest = slices[0], slices[1:]
    per_slice = trades.groupBy(*keys, *slices).agg(
        F.sum(qty).alias("_q"), F.count(F.lit(1)).alias("_n"))
    per_outer = per_slice.groupBy(*keys, outer).agg(
        F.sum("_q").alias("_q"), F.sum("_n").alias("_n")) if rest else per_slice
    before = Window.partitionBy(*keys).orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    is_sell = F.col("trade_type") == "SELL"
    offsets = (per_outer
               .withColumn("_base", F.coalesce(F.sum("_q").over(before), F.lit(0)))
               .withColumn("_sold", F.coalesce(F.sum(F.when(is_sell, F.col("_q"))).over(whole), F.lit(0)))
               .withColumn("_bought", F.coalesce(F.sum(F.when(~is_sell, F.col("_q"))).over(whole), F.lit(0)))
               .withColumn("_lots", F.sum("_n").over(whole))
               .drop("_q", "_n"))
    if rest:
        within = Window.partitionBy(*keys, outer).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
        inner = per_slice.withColumn("_in", F.coalesce(F.sum("_q").over(within), F.lit(0))).drop("_q", "_n")
        offsets = (inner.join(offsets, [*keys, outer])
                   .withColumn("_base", F.col("_base") + F.col("_in")).drop("_in"))
    inside = (Window.partitionBy(*keys, *slices).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (trades.join(offsets, keys + slices)
            .withColumn("c1", F.col("_base") + F.sum(qty).over(inside))
            .withColumn("c0", F.col("c1") - F.col(qty))
            .drop("_base"))


def _with_positions(trades, qty, order, slices):
    t = trades.filter(F.col(qty) > 0)
    return cumulative(t, ["symbol", "trade_type"], qty, order, slices)


def fifo_matches(trades: DataFrame, qty: str = "quantity",
                 order: list[str] = ("trade_date", "order_execution_time", "trade_id"),
                 slices: list[str] = ("trade_date",)) -> DataFrame:
    """Match sells to the oldest unmatched buys, one row per matched piece.

    Output: symbol, entry_date, entry_price, exit_date, exit_price, qty.
    Sells beyond the bought quantity and unsold buys are left out.
    """
    t = _with_positions(trades, qty, list(order), list(slices))
    matched = F.least("_bought", "_sold")
    t = t.filter(F.col("c0") < matched).withColumn("c1", F.least(F.col("c1"), matched))
    # The bucket width follows the mean lot size, so all buckets together add
    # at most 1/LOTS_PER_BUCKET extra rows per side.
    width = F.greatest(F.lit(1), F.ceil(
        LOTS_PER_BUCKET * (F.col("_bought") + F.col("_sold")) / F.col("_lots")))
    t = t.withColumn("_w", width)
    first, last = F.floor(F.col("c0") / F.col("_w")), F.floor((F.col("c1") - 1) / F.col("_w"))
    lot = F.struct(F.col("trade_date").alias("date"), F.col("price"), F.col("c0"), F.col("c1"))
    is_buy = F.col("trade_type") == "BUY"
    ends = (t.withColumn("_b", F.explode(F.sequence(first, last)))
            .select("symbol", "_b", F.least(F.col("c1"), (F.col("_b") + 1) * F.col("_w")).alias("end"),
                    (F.col("_b") * F.col("_w")).alias("_start"),
                    F.when(is_buy, lot).alias("buy"), F.when(~is_buy, lot).alias("sell")))
    # Both sides cover the matched range without gaps. Going down the line, the
    # owner of a piece on each side is the last lot end seen on that side.
    down = Window.partitionBy("symbol", "_b").orderBy(F.col("end").desc(), F.col("buy").isNull())
    seen = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ends.select(
        "symbol", "_start",
        (F.col("end") - F.coalesce(F.lead("end").over(down), F.col("_start"))).alias("piece"),
        F.last("buy", ignorenulls=True).over(seen).alias("buy"),
        F.last("sell", ignorenulls=True).over(seen).alias("sell"))
    # A match that crosses a bucket edge is reported by the bucket it starts in.
    start = F.greatest("buy.c0", "sell.c0")
    return (swept
            .filter((F.col("piece") > 0) & F.col("buy").isNotNull() & F.col("sell").isNotNull()
                    & (start >= F.col("_start")))
            .select("symbol",
                    F.col("buy.date").alias("entry_date"), F.col("buy.price").alias("entry_price"),
                    F.col("sell.date").alias("exit_date"), F.col("sell.price").alias("exit_price"),
                    (F.least("buy.c1", "sell.c1") - start).alias("qty")))


def open_lots(trades: DataFrame, qty: str = "quantity",
              order: list[str] = ("trade_date", "order_execution_time", "trade_id"),
              slices: list[str] = ("trade_date",)) -> DataFrame:
    """Buys, or the rest of a buy, that no sell used up (``open_qty``)."""
    t = _with_positions(trades, qty, list(order), list(slices))
    left = F.col("c1") - F.greatest(F.col("c0"), F.col("_sold"))
    return (t.filter((F.col("trade_type") == "BUY") & (F.col("c1") > F.col("_sold")))
            .withColumn("open_qty", left).drop("_sold", "_bought", "_lots"))


def closed_trades(matches: DataFrame) -> DataFrame:
    """Profit, holding period, timeframe and tax class of every match."""
    days = F.datediff("exit_date", "entry_date")
    return (matches
            .withColumn("booked_pnl", (F.col("exit_price") - F.col("entry_price")) * F.col("qty"))
            .withColumn("booked_pnl_pct",
                        F.coalesce((F.try_divide("exit_price", "entry_price") - 1) * 100, F.lit(0.0)))
            .withColumn("holding_days", days)
            .withColumn("timeframe", infer_timeframe(F.col("holding_days")))
            .withColumn("tax_type", tax_type(F.col("holding_days")))
            .withColumn("exit_reason", F.lit("tradebook_import")))
