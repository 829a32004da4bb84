"""Position sizing, available capital and sector exposure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.scalars import lookup
from tapeflow.params import DEFAULTS
from tapeflow.session import shared_folder, stored


def simple_size(proposals: DataFrame, p=DEFAULTS) -> DataFrame:
    """Fixed fractional size from (timeframe, price): slot share or risk share, at least one share."""
    cap = lookup(F.col("timeframe"), p.capital, 500_000.0)
    slots = lookup(F.col("timeframe"), p.slots, 5)
    d = proposals.withColumn("_cap", cap).withColumn("per_slot_capital", F.col("_cap") / slots)
    money = F.least("per_slot_capital", F.col("_cap") * p.risk_pct)
    ok = F.col("price") > 0
    qty = F.when(ok, F.greatest(F.lit(1), F.floor(money / F.col("price")))).otherwise(0)
    d = d.withColumn("qty", qty)
    value = F.col("qty") * F.col("price")
    return (d.withColumn("value_inr", F.when(ok, F.bround(value, 2)).otherwise(0.0))
            .withColumn("capital_used_pct", F.when(ok, F.bround(value / F.col("_cap") * 100, 2)).otherwise(0.0))
            .withColumn("per_slot_capital", F.bround("per_slot_capital", 2)).drop("_cap"))


def deployed_by_strategy(positions: DataFrame) -> DataFrame:
    return (positions.filter("is_active").groupBy("strategy_id")
            .agg(F.sum(F.col("qty") * F.col("avg_cost")).alias("deployed")))


def _strategy_ratio(p):
    tf = lookup(F.col("timeframe"), p.timeframe_ratios, 0.20)
    if not p.strategy_ratios:
        return tf
    return F.coalesce(F.nullif(lookup(F.col("strategy_id"), p.strategy_ratios, 0.0), F.lit(0.0)), tf)


def available_capital(proposals: DataFrame, positions: DataFrame, p=DEFAULTS) -> DataFrame:
    """Capital of the strategy (or its timeframe) less what it has deployed, not below 0."""
    j = proposals.join(deployed_by_strategy(positions), "strategy_id", "left")
    left = p.total_capital * _strategy_ratio(p) - F.coalesce("deployed", F.lit(0.0))
    return j.withColumn("capital_available", F.greatest(F.lit(0.0), left)).drop("deployed")


def ratio_size(proposals: DataFrame, positions: DataFrame, p=DEFAULTS, mode: str = "ratio") -> DataFrame:
    """Share quantity for (strategy_id, timeframe, price, confidence) proposals.

    Strategy capital, less the reserve, capped per stock and by what is left,
    scaled by confidence, less fees, rounded down to whole shares. In mode
    ``volatility_scaled`` the value is scaled by target over actual volatility
    (column hist_vol, in percent), at most 1.
    """
    d = available_capital(proposals, positions, p)
    ratio = _strategy_ratio(p) if mode == "ratio" else lookup(F.col("timeframe"), p.timeframe_ratios, 0.20)
    conf = F.coalesce("confidence", F.lit(1.0)) if "confidence" in proposals.columns else F.lit(1.0)
    d = d.withColumn("strategy_capital", p.total_capital * ratio)
    value = F.least(F.col("strategy_capital") * (1 - p.reserve_pct), F.lit(p.max_per_stock), F.col("capital_available")) * conf
    if mode == "volatility_scaled":
        value = value * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(p.target_vol * 100), F.col("hist_vol")), F.lit(1.0)))
    d = d.withColumn("_value", value)
    fees = F.col("_value") * p.slippage_pct + p.brokerage
    entry = F.col("price") * (1 + p.slippage_pct)
    net = F.col("_value") - fees
    d = d.withColumns({"_net": net, "_entry": entry, "_fees": fees})
    shares = F.floor(F.col("_net") / F.col("_entry"))
    error = (F.when(F.col("price") <= 0, "invalid_price").when(F.col("_net") <= 0, "insufficient_after_fees")
             .when(shares < 1, "insufficient_for_1_share"))
    d = d.withColumn("error", error).withColumn("qty", F.when(error.isNull(), shares).otherwise(0))
    worth = F.col("qty") * F.col("_entry")
    ok = F.col("error").isNull()
    return d.withColumns({
        "value_inr": F.when(ok, F.bround(worth, 2)).otherwise(0.0),
        "capital_used_pct": F.when(ok, F.bround(worth / p.total_capital * 100, 2)),
        "fees_total": F.when(ok, F.bround("_fees", 2)),
        "slippage_inr": F.when(ok, F.bround(F.col("_value") * p.slippage_pct, 2)),
        "effective_entry": F.when(ok, F.bround("_entry", 2)),
        "capital_available": F.bround("capital_available", 2), "strategy_capital": F.bround("strategy_capital", 2),
    }).drop("_value", "_net", "_entry", "_fees")


def _shares(value: Column, price: Column, p) -> Column:
    """Whole shares that a value buys after fees."""
    net, cost = value - (value * p.slippage_pct + p.brokerage), price * (1 + p.slippage_pct)
    q = F.floor(net / cost)
    return F.when((price > 0) & (net > 0), F.when(q * cost > net, q - 1).otherwise(q)).otherwise(0)


def sequential_size(proposals: DataFrame, positions: DataFrame, order: str, p=DEFAULTS, chunk: int = 10_000) -> DataFrame:
    """Add ``qty`` to proposals that are filled one after another within a strategy: what is bought at ``price`` lowers the capital of
    the rows after it in ``order``.

    While the capital left is at least the cap of an order, its cost does not depend on the orders before, so what was spent before an order is a sum: totals of
    ranges of the order, then running sums inside a range. Only from the first order that finds less than its cap the rest is folded, ``chunk`` orders of a strategy at
    a time, and the next round sums on from there. Spending never falls, so orders that what is left cannot pay a share of leave all later rounds; a round ends with a timeframe
    running out, or with a chunk. Nulls in a price, and prices of 0 or less, buy nothing.
    """
    spark = proposals.sparkSession
    d = available_capital(proposals, positions, p)
    conf = F.coalesce("confidence", F.lit(1.0)) if "confidence" in proposals.columns else F.lit(1.0)
    cap = F.least(p.total_capital * _strategy_ratio(p) * (1 - p.reserve_pct), F.lit(p.max_per_stock))
    rows = d.select("strategy_id", F.col(order).alias("at"), "price", F.col("capital_available").alias("left"), cap.alias("cap"), conf.alias("conf"))
    rows = rows.withColumn("full", _shares(F.col("cap") * F.col("conf"), F.col("price"), p)).filter("full >= 1")
    rows = stored(rows.repartitionByRange("strategy_id", "at").withColumn("range", F.spark_partition_id()), "orders")
    by = Window.partitionBy("strategy_id")

    def fill(t: pd.DataFrame) -> pd.DataFrame:
        t, spent, out = t.sort_values("at"), None, []
        for r in t.itertuples():
            spent = r.spent if spent is None else spent
            value = min(r.cap, max(0.0, r.left - spent)) * r.conf
            net = value - (value * p.slippage_pct + p.brokerage)
            n = int(net // (r.price * (1 + p.slippage_pct))) if net > 0 else 0
            spent += n * r.price
            out.append((r.strategy_id, r.at, n, spent))
        return pd.DataFrame(out, columns=["strategy_id", "at", "qty", "spent"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("strategy_id", "at")}
    schema = f"strategy_id {kinds['strategy_id']}, at {kinds['at']}, qty bigint, spent double"
    state, out, round_ = rows.select("strategy_id").distinct().select("*", F.lit(None).cast(kinds["at"]).alias("done"), F.lit(0.0).alias("base")), shared_folder(spark, "filled"), 0
    while True:
        can = _shares(F.least("cap", F.col("left") - F.col("base")) * F.col("conf"), F.col("price"), p) >= 1
        live = rows.join(state, "strategy_id").filter((F.col("done").isNull() | (F.col("at") > F.col("done"))) & can).withColumn("cost", F.col("full") * F.col("price"))
        totals = live.groupBy("strategy_id", "range").agg(F.sum("cost").alias("cost"))
        before = totals.select("strategy_id", "range", F.coalesce(F.sum("cost").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
        inside = Window.partitionBy("strategy_id", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        run = stored(live.join(before, ["strategy_id", "range"]).withColumn("spent", F.col("base") + F.col("before") + F.coalesce(F.sum("cost").over(inside), F.lit(0.0)))
                     .select("strategy_id", "at", "price", "left", "cap", "conf", "full", "spent"), "spent")
        short = run.filter(F.col("left") - F.col("spent") < F.col("cap")).groupBy("strategy_id").agg(F.min("at").alias("first"))
        both = run.join(short, "strategy_id", "left")
        ample = both.filter(F.col("first").isNull() | (F.col("at") < F.col("first"))).select("strategy_id", "at", F.col("full").alias("qty"), "spent", F.lit(False).alias("tail"))
        rest = both.filter(F.col("at") >= F.col("first")).withColumn("nth", F.row_number().over(by.orderBy("at"))).filter(F.col("nth") <= chunk)
        tail = rest.groupBy("strategy_id").applyInPandas(fill, schema).withColumn("tail", F.lit(True))
        path = f"{out}/round={round_}"
        ample.unionByName(tail).write.parquet(path)
        round_ += 1
        got = spark.read.schema(schema + ", tail boolean").parquet(path).filter("tail")
        if got.isEmpty():
            break
        state = got.groupBy("strategy_id").agg(F.max("at").alias("done"), F.max_by("spent", "at").alias("base"))
    filled = spark.read.schema(schema).parquet(*[f"{out}/round={i}" for i in range(round_)])
    bought = filled.select(F.col("at").alias(order), "qty")
    return d.join(bought, order, "left").withColumn("qty", F.coalesce("qty", F.lit(0)).cast("bigint"))


def ratio_totals(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the allocation ratios (column ``ratio``) per group, and whether it is at most 1 and 1 within 0.01."""
    total = F.sum("ratio")
    return ratios.groupBy(*keys).agg(total.alias("total"), (total <= 1.0).alias("fits"), (F.abs(total - 1.0) <= 0.01).alias("exact"))


def sector_exposure(proposals: DataFrame, positions: DataFrame, stocks: DataFrame, p=DEFAULTS) -> DataFrame:
    """Whether a proposal (symbol, value_inr) keeps its sector within the limit."""
    dim = stocks.select("symbol", "sector")
    held = (positions.filter("is_active").join(dim, "symbol").groupBy("sector")
            .agg(F.sum(F.col("qty") * F.col("avg_cost")).alias("_held")))
    j = proposals.join(dim, "symbol", "left").join(held, "sector", "left")
    cur = F.coalesce("_held", F.lit(0.0)) / p.total_capital
    new = (F.coalesce("_held", F.lit(0.0)) + F.col("value_inr")) / p.total_capital
    known = F.col("sector").isNotNull()
    return j.withColumns({
        "allowed": F.when(known, new <= p.max_sector_pct).otherwise(True),
        "current_exposure_pct": F.when(known, F.bround(cur * 100, 2)), "new_exposure_pct": F.when(known, F.bround(new * 100, 2)),
        "limit_pct": F.lit(p.max_sector_pct * 100), "sector": F.coalesce("sector", F.lit("Unknown"))}).drop("_held")
