"""Corporate actions: factors, back-adjustment of prices, positions and triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.windows import all_of

ACTION_TYPES = ("split", "bonus", "dividend", "rights")
PRICE_ACTIONS = ("split", "bonus")
PRICES = ("open", "high", "low", "close")


def adjustment_factor(action_type: Column, ratio: Column) -> Column:
    """1 + ratio for splits, bonuses and rights (ratio optional there), 1 for dividends."""
    return (F.when(action_type.isin("split", "bonus"), 1 + ratio)
            .when(action_type == "dividend", F.lit(1.0))
            .when(action_type == "rights", 1 + F.coalesce(ratio, F.lit(0.0))))


def record_actions(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Append new actions, unprocessed. Unknown types and missing ratios are errors."""
    kind, ratio = F.col("action_type"), F.col("ratio")
    ok_type = kind.isin(*ACTION_TYPES)
    ok_ratio = ~kind.isin(*PRICE_ACTIONS) | ratio.isNotNull()
    checked = (new
               .withColumn("action_type", F.when(ok_type, kind).otherwise(
                   F.raise_error(F.concat(F.lit("unknown action_type: "), kind)).cast("string")))
               .withColumn("adjustment_factor", F.when(ok_ratio, adjustment_factor(kind, ratio)).otherwise(
                   F.raise_error(F.concat(kind, F.lit(" requires ratio"))).cast("double")))
               .withColumn("action_id", F.concat_ws(
                   "_", "symbol", "action_type", F.col("ex_date").cast("string"),
                   F.substring(F.sha2(F.concat_ws("|", "symbol", "action_type", F.col("ex_date").cast("string"),
                                                  F.coalesce(ratio.cast("string"), F.lit(""))), 256), 1, 8)))
               .withColumn("processed", F.lit(0)))
    return registry.unionByName(checked, allowMissingColumns=True)


def find_actions(actions: DataFrame, symbol=None, processed=None, from_date=None, to_date=None) -> DataFrame:
    conds = []
    if symbol is not None:
        conds.append(F.col("symbol") == symbol)
    if processed is not None:
        conds.append(F.col("processed") == (1 if processed else 0))
    if from_date is not None:
        conds.append(F.col("ex_date") >= F.lit(from_date).cast("date"))
    if to_date is not None:
        conds.append(F.col("ex_date") <= F.lit(to_date).cast("date"))
    return actions.filter(all_of(conds)).orderBy(F.desc("ex_date"), "action_id")


def cumulative_factor(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Add ``factor``: product of the price factors with an ex-date after the bar.

    Actions and bars of a symbol are put in one descending sequence, so the
    range condition needs one sort and no join; rows never multiply.
    """
    per_day = (actions.filter(F.col("action_type").isin(*PRICE_ACTIONS))
               .groupBy("symbol", F.col("ex_date").alias("date"))
               .agg(F.product("adjustment_factor").alias("_f"))
               .withColumn("_is_action", F.lit(1)))
    both = bars.withColumn("_f", F.lit(1.0)).withColumn("_is_action", F.lit(0)).unionByName(
        per_day, allowMissingColumns=True)
    # On an ex-date the bar comes first: only later actions touch it.
    w = Window.partitionBy("symbol").orderBy(F.desc("date"), "_is_action").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (both.withColumn("factor", F.product("_f").over(w))
            .filter("_is_action = 0").drop("_f", "_is_action"))


def back_adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Divide OHLC before each ex-date by the factor; volume stays as it is."""
    f = cumulative_factor(bars, actions)
    return f.withColumns({c: F.col(c) / F.col("factor") for c in PRICES})


def _symbol_factor(actions: DataFrame) -> DataFrame:
    return (actions.filter(F.col("action_type") != "dividend")
            .groupBy("symbol").agg(F.product("adjustment_factor").alias("_f")))


def adjust_positions(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """Open positions: quantity times factor, truncated; cost, target and stop divided."""
    j = positions.join(_symbol_factor(actions), "symbol", "left")
    f = F.when(F.col("is_active"), F.coalesce("_f", F.lit(1.0))).otherwise(F.lit(1.0))
    return (j.withColumn("qty", (F.col("qty") * f).cast("bigint"))
            .withColumns({c: F.col(c) / f for c in ("avg_cost", "target", "stop_loss")})
            .drop("_f"))


def adjust_triggers(triggers: DataFrame, actions: DataFrame) -> DataFrame:
    """Divide the prices of pending and eligible triggers by the factor."""
    j = triggers.join(_symbol_factor(actions), "symbol", "left")
    f = F.when(F.col("status").isin("pending", "eligible"), F.coalesce("_f", F.lit(1.0))).otherwise(F.lit(1.0))
    cols = [c for c in ("trigger_price", "buy_below_price", "current_price") if c in triggers.columns]
    return j.withColumns({c: F.col(c) / f for c in cols}).drop("_f")


def apply_actions(actions: DataFrame, bars: DataFrame, indicators: DataFrame,
                  positions: DataFrame, triggers: DataFrame) -> dict[str, DataFrame]:
    """Apply every unprocessed action once and return the new snapshots.

    Indicators are dropped only where prices changed, to be computed again.
    """
    todo = actions.filter(F.col("processed") == 0)
    touched = todo.filter(F.col("action_type").isin(*PRICE_ACTIONS)).select("symbol").distinct()
    return {
        "bars": back_adjust(bars, todo).drop("factor"),
        "indicators": indicators.join(touched, "symbol", "left_anti"),
        "positions": adjust_positions(positions, todo),
        "triggers": adjust_triggers(triggers, todo),
        "actions": actions.withColumn("processed", F.lit(1)),
    }


def impact_summary(actions: DataFrame, bars: DataFrame, positions: DataFrame,
                   triggers: DataFrame) -> DataFrame:
    """Per action: price rows before the ex-date, positions and triggers before and after.

    Counts come from one count per (symbol, date), summed up in date order, so
    the bars are not joined to the actions.
    """
    a = actions.select("action_id", "symbol", "action_type", "ex_date", "adjustment_factor")
    per_day = bars.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("_n"))
    seq = per_day.withColumn("_is_action", F.lit(1)).unionByName(
        a.select("symbol", F.col("ex_date").alias("date"), "action_id", F.lit(0).alias("_is_action")),
        allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("date", "_is_action").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    counts = (seq.withColumn("price_row_count", F.coalesce(F.sum("_n").over(w), F.lit(0)))
              .filter("_is_action = 0").select("action_id", "price_row_count"))
    f = F.col("adjustment_factor")
    pos = (positions.filter("is_active").join(a.select("action_id", "symbol", "adjustment_factor"), "symbol")
           .groupBy("action_id").agg(
               F.count(F.lit(1)).alias("positions"),
               F.sum("qty").alias("qty"), F.sum((F.col("qty") * f).cast("bigint")).alias("new_qty"),
               F.avg("avg_cost").alias("avg_cost"), F.avg(F.col("avg_cost") / f).alias("new_cost")))
    trg = (triggers.filter(F.col("status").isin("pending", "eligible"))
           .join(a.select("action_id", "symbol", "adjustment_factor"), "symbol")
           .groupBy("action_id").agg(
               F.count(F.lit(1)).alias("triggers"),
               F.avg("trigger_price").alias("trigger_price"),
               F.avg(F.col("trigger_price") / f).alias("new_trigger_price"),
               F.avg("buy_below_price").alias("buy_below"),
               F.avg(F.col("buy_below_price") / f).alias("new_buy_below")))
    return (a.join(counts, "action_id", "left").join(pos, "action_id", "left")
            .join(trg, "action_id", "left")
            .fillna(0, ["price_row_count", "positions", "triggers"]))
