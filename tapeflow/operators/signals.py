"""Signals from the latest bars: rules, levels, confidence, watchlist and log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.rules import Panel, entry_signal
from tapeflow.functions.scalars import threshold_for
from tapeflow.functions.windows import latest
from tapeflow.operators.strategies import rule_parts, stop_loss, target_price
from tapeflow.params import DEFAULTS, SIGNAL_FEATURES


def confidence(market_cycle: Column) -> Column:
    """Score of indicator alignment, between 0.30 and 0.95."""
    def bonus(cond, v):
        return F.when(cond, v).otherwise(0.0)

    def val(name, default):
        c = F.coalesce(F.col(name), F.lit(default))
        return F.when(c == 0, default).otherwise(c)

    rsi = val("rsi_14", 50.0)
    score = (0.5 + bonus((rsi > 50) & (rsi < 70), 0.05) + bonus(val("adx_14", 20.0) > 25, 0.05)
             + bonus(F.coalesce("supertrend_dir", F.lit(0.0)) == -1, 0.05)
             + bonus(F.coalesce("macd_hist", F.lit(0.0)) > 0, 0.05) + bonus(val("volume_ratio", 1.0) > 1.2, 0.03)
             + F.when(market_cycle == "bull", 0.07).when(market_cycle == "bear", -0.10).otherwise(0.0))
    return F.bround(F.least(F.lit(0.95), F.greatest(F.lit(0.30), score)), 4)


def entries(panel: DataFrame, docs: list[dict], min_bars: int = 10) -> DataFrame:
    """Latest row per symbol with one struct per (strategy, timeframe) whose entry rules hold.

    Rules look back over the whole panel, so their flags are compiled before the
    latest row is picked; history excludes the current row. Levels only need that row.
    """
    ctx = Panel.of(panel)
    close = F.col("close")
    flags = panel.withColumns({f"_e{i}": entry_signal(d, ctx) for i, d in enumerate(docs)})
    last = latest(flags.filter(F.col("rn") >= min_bars), ["symbol"], "date")
    cols = {}
    for i, d in enumerate(docs):
        parts = rule_parts(d)
        stop = stop_loss(parts, close, close)
        cols[f"_s{i}"] = F.when(F.col(f"_e{i}"), F.array(*[
            F.struct(F.lit(i).alias("seq"), F.lit(d["strategy_id"]).alias("strategy_id"), F.lit(d["name"]).alias("strategy_name"),
                     F.lit(tf).alias("timeframe"), stop.alias("stop_loss"), target_price(parts, close, stop).alias("target_price"))
            for tf in d["timeframes"]]))
    hits = last.withColumns(cols)
    empty = F.array().cast("array<struct<seq:int,strategy_id:string,strategy_name:string,timeframe:string,stop_loss:double,target_price:double>>")
    hits = hits.withColumn("_hits", F.flatten(F.array(*[F.coalesce(c, empty) for c in cols])))
    return hits.drop(*cols, *[f"_e{i}" for i in range(len(docs))])


def generate(latest_hits: DataFrame, regime: DataFrame, generated_at: str, patterns: DataFrame | None = None,
             model_confidence: Column | None = None, timeframe: str | None = None, p=DEFAULTS) -> DataFrame:
    """Signals that pass risk, reward and the confidence threshold of the market regime."""
    market = regime.filter("scope = 'market'").agg(F.coalesce(F.first("cycle"), F.lit("neutral")).alias("cycle_context"))  # one row
    stock = regime.filter("scope = 'stock'").select(F.col("scope_id").alias("symbol"), F.col("cycle").alias("stock_cycle"))
    h = latest_hits.crossJoin(F.broadcast(market)).drop("stock_cycle").join(stock, "symbol", "left")
    if patterns is not None:
        h = h.join(patterns.select("symbol", F.col("state_label").alias("pattern_state")), "symbol", "left")
    else:
        h = h.withColumn("pattern_state", F.lit(None).cast("string"))
    rule = confidence(F.col("cycle_context"))
    h = h.withColumn("confidence", F.coalesce(model_confidence, rule) if model_confidence is not None else rule)
    h = h.filter((F.col("close") > 0) & (F.col("confidence") >= threshold_for(F.col("cycle_context"), p)))
    s = h.withColumn("_h", F.explode("_hits"))
    if timeframe is not None:
        s = s.filter(F.col("_h.timeframe") == timeframe)
    risk = F.col("close") - F.col("_h.stop_loss")
    rr = F.when(risk > 0, (F.col("_h.target_price") - F.col("close")) / risk)
    s = s.withColumn("_rr", rr).filter(F.col("_rr") >= p.min_risk_reward)
    return s.select(
        "symbol", F.col("_h.timeframe").alias("timeframe"), F.lit("buy").alias("signal_type"),
        F.col("_h.strategy_id").alias("strategy_id"), F.col("_h.strategy_name").alias("strategy_name"),
        F.bround("close", 2).alias("entry_price"), F.col("_h.target_price").alias("target_price"),
        F.col("_h.stop_loss").alias("stop_loss"), F.bround("_rr", 2).alias("risk_reward"), "confidence", "cycle_context",
        F.coalesce("stock_cycle", F.lit("neutral")).alias("stock_cycle"), F.coalesce("sector_cycle", F.lit("neutral")).alias("sector_cycle"),
        "pattern_state", F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        reasoning(F.col("_h.strategy_name")).alias("reasoning"),
        F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"), F.col("_h.seq").alias("seq"))


def reasoning(name: Column) -> Column:
    return F.format_string(
        "%s | Market: %s | RSI: %.1f | ADX: %.1f | Vol Ratio: %.1fx", name, F.upper("cycle_context"),
        F.coalesce("rsi_14", F.lit(0.0)), F.coalesce("adx_14", F.lit(0.0)), F.coalesce("volume_ratio", F.lit(1.0)))


def supersede(log: DataFrame) -> DataFrame:
    """Active flag: only the last signal per (symbol, timeframe), the last strategy winning."""
    w = Window.partitionBy("symbol", "timeframe").orderBy(F.desc("generated_at"), F.desc("seq"))
    return log.withColumn("is_active", F.row_number().over(w) == 1)


def watchlist(log: DataFrame, timeframe: str | None = None, signal_type: str | None = None) -> DataFrame:
    """Active signals, best first."""
    out = supersede(log).filter("is_active")
    if timeframe is not None:
        out = out.filter(F.col("timeframe") == timeframe)
    if signal_type is not None:
        out = out.filter(F.col("signal_type") == signal_type)
    return out.orderBy(F.desc("confidence"), "symbol", "timeframe")


def history(log: DataFrame, n: int | None = None) -> DataFrame:
    """Latest n signals per (symbol, timeframe), or all of them."""
    return log if n is None else latest(log, ["symbol", "timeframe"], ["generated_at", "seq"], n)


def counts(log: DataFrame) -> DataFrame:
    """Signals per timeframe and type."""
    return log.groupBy("timeframe").pivot("signal_type", ["buy", "sell", "hold"]).count().fillna(0)


def top_setups(watch: DataFrame, n: int = 3, timeframe: str = "intraday") -> DataFrame:
    """First n active buys of a timeframe by confidence, with their rank."""
    top = (watch.filter((F.col("timeframe") == timeframe) & F.col("is_active") & (F.col("signal_type") == "buy"))
           .orderBy(F.desc("confidence"), "symbol").limit(n))
    rank = F.row_number().over(Window.orderBy(F.desc("confidence"), "symbol"))  # at most n rows
    return top.select(rank.alias("rank"), "symbol", F.col("entry_price").alias("entry"), F.col("target_price").alias("target"),
                      F.col("stop_loss").alias("sl"), F.col("confidence").alias("conf"), F.col("strategy_id").alias("strategy"))


def feature_vectors(panel: DataFrame, timeframe: str) -> DataFrame:
    """Ordered model inputs per row; missing values are 0.

    Uses market_cycle, sector_cycle and stock_cycle columns where present.
    """
    have = set(panel.columns)

    def num(name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)

    def hot(scope, cycle):
        c = f"{scope}_cycle"
        return F.when(F.col(c) == cycle, 1.0).otherwise(0.0) if c in have else F.lit(0.0)

    def flag(cond):
        return F.when(cond, 1.0).otherwise(0.0)

    derived = {f"{s}_cycle_{c}": hot(s, c) for s in ("market", "sector", "stock") for c in ("bull", "bear", "neutral")}
    derived["above_50dma"] = flag(num("close") > num("sma_50"))
    derived["above_200dma"] = flag(num("close") > num("sma_200"))
    derived["ema50_vs_ema200"] = F.coalesce(F.try_divide(num("ema_50") - num("ema_200"), num("ema_200")) * 100, F.lit(0.0))
    derived["ichimoku_above_cloud"] = flag(num("close") > F.greatest(num("ichimoku_senkou_a"), num("ichimoku_senkou_b")))
    names = SIGNAL_FEATURES.get(timeframe, SIGNAL_FEATURES["swing"])
    cols = [derived.get(n, num(n)).alias(n) for n in names]
    return panel.select("symbol", "date", *cols, F.array(*[derived.get(n, num(n)) for n in names]).alias("features"))
