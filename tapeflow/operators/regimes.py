"""Bull, bear and neutral labels for market, sectors and stocks.

All scopes are labelled in one job over long rows (scope, scope_id, date,
close); the market has a NULL ``scope_id``, so lookups compare null-safely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.scalars import decode_cycle, is_stale, lookup, threshold_for
from tapeflow.functions.windows import latest, long_extreme, long_mean, run_length_filter, running, series, simple_rsi, trailing
from tapeflow.params import DEFAULTS, REGIME_PARAMS

LABEL_VERSION = "v1_labeller"


def _per_scope(scope: Column, name: str) -> Column:
    return lookup(scope, {s: p[name] for s, p in REGIME_PARAMS.items()})


def label_columns(df: DataFrame, scope: Column, keys: list[str]) -> DataFrame:
    """Add dma, rsi, drawdown, above_dma, fwd_20d, cycle_int and cycle to price rows."""
    w = series(*keys)
    c = F.col("close")
    df = simple_rsi(df, "close", w, "rsi")
    dmas = sorted({p["dma_period"] for p in REGIME_PARAMS.values()})
    df = df.withColumns({"_rn": F.row_number().over(w), "_sum": F.sum("close").over(running(w))})
    period = _per_scope(scope, "dma_period")
    dma = F.coalesce(*[
        F.when((period == n) & (F.col("_rn") >= n), long_mean("_sum", w, n)) for n in dmas])
    peak = F.max("close").over(running(w))
    df = df.withColumns({
        "dma": dma, "drawdown": (c - peak) / peak,
        "fwd_20d": F.try_divide(F.lead("close", 20).over(w), c) - 1})
    above = F.coalesce(c > F.col("dma"), F.lit(False))
    rsi = F.coalesce("rsi", F.lit(50.0))
    bear = (F.col("drawdown") <= _per_scope(scope, "bear_drawdown")) & ~above & (rsi < _per_scope(scope, "bear_rsi_max"))
    bull = (F.col("drawdown") >= -_per_scope(scope, "neutral_band")) & above & (rsi > _per_scope(scope, "bull_rsi_min"))
    df = df.withColumns({
        "above_dma": above.cast("int"),
        "cycle_int": F.when(bull, 1).when(bear, -1).otherwise(0)})
    df = run_length_filter(df, "cycle_int", keys, _per_scope(scope, "min_duration_days"))
    return df.withColumn("cycle", decode_cycle(F.col("cycle_int"))).drop("_rn", "_sum")


def label(prices: DataFrame) -> DataFrame:
    """Labels for long price rows (scope, scope_id, date, close)."""
    p = prices.filter(F.col("close").isNotNull())
    return label_columns(p, F.col("scope"), ["scope", "scope_id"])


def label_stocks(panel: DataFrame) -> DataFrame:
    """Add the stock-level label columns to a (symbol, date) panel without a join."""
    return label_columns(panel, F.lit("stock"), ["symbol"])


def scope_prices(index: DataFrame, sectors: DataFrame, bars: DataFrame, from_date: str | None = None) -> DataFrame:
    """Closing prices of all three scopes as long rows."""
    out = (index.select(F.lit("market").alias("scope"), F.lit(None).cast("string").alias("scope_id"), "date",
                        F.col("nifty200_close").alias("close"))
           .unionByName(sectors.select(F.lit("sector").alias("scope"), F.col("sector").alias("scope_id"), "date", "close"))
           .unionByName(bars.select(F.lit("stock").alias("scope"), F.col("symbol").alias("scope_id"), "date", "close")))
    return out.filter(F.col("date") >= F.lit(from_date).cast("date")) if from_date else out


def cycle_rows(labels: DataFrame) -> DataFrame:
    """Rows of the cycle table. Labels carry no confidence."""
    return labels.select("date", "scope", "scope_id", "cycle", F.lit(None).cast("double").alias("confidence"),
                         F.lit(LABEL_VERSION).alias("model_version"))


def label_stats(labels: DataFrame) -> DataFrame:
    """Rows, members and class counts per scope."""
    return labels.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("scope_id").alias("members"),
        *[F.count_if(F.col("cycle") == c).alias(c) for c in ("bull", "bear", "neutral")])


def sector_series_from_members(bars: DataFrame, stocks: DataFrame, base: float = 100.0) -> DataFrame:
    """Sector index as the compounded equal-weight mean return of its members."""
    ret = F.try_divide(F.col("close"), F.lag("close").over(series())) - 1
    r = bars.withColumn("_r", ret).join(stocks.select("symbol", "sector"), "symbol")
    daily = r.groupBy("sector", "date").agg(F.avg("_r").alias("_r"))
    w = running(series("sector"))
    return daily.withColumn("close", base * F.exp(F.sum(F.log1p(F.coalesce("_r", F.lit(0.0)))).over(w))).drop("_r")


def of_scope(cycles: DataFrame, scope: str, scope_id: str | None = None) -> DataFrame:
    return cycles.filter((F.col("scope") == scope) & F.col("scope_id").eqNullSafe(F.lit(scope_id)))


def current_cycle(cycles: DataFrame, scope: str = "market", scope_id: str | None = None) -> DataFrame:
    """Latest row of a scope, or neutral with confidence 0 when there is none."""
    row = (of_scope(cycles, scope, scope_id).orderBy(F.desc("date")).limit(1)
           .select("cycle", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "date"))
    one = cycles.sparkSession.range(1).select(F.lit(scope).alias("scope"))
    return one.join(row, F.lit(True), "left").select(
        "scope", F.coalesce("cycle", F.lit("neutral")).alias("cycle"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "date")


def cycle_history(cycles: DataFrame, scope: str, scope_id: str | None, as_of: str, days: int = 365) -> DataFrame:
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    return (of_scope(cycles, scope, scope_id).filter(F.col("date") >= start)
            .select("date", "cycle", "confidence").orderBy("date"))


def current_regime(cycles: DataFrame) -> DataFrame:
    """Latest market row, and the sector and stock rows of their scope's last date."""
    last = cycles.groupBy("scope").agg(F.max("date").alias("_last"))
    # At most one row per scope.
    return (cycles.join(F.broadcast(last), "scope").filter(F.col("date") == F.col("_last")).drop("_last")
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.0))))


def market_state(cycles: DataFrame, classified_at: Column | None = None, now: Column | None = None, p=DEFAULTS) -> DataFrame:
    """Market regime with its signal threshold and, given times, staleness."""
    m = current_cycle(cycles)
    out = m.withColumn("threshold", threshold_for(F.col("cycle"), p))
    if classified_at is not None:
        out = out.withColumn("stale", is_stale(classified_at, now, p))
    return out


def sector_tally(cycles: DataFrame) -> DataFrame:
    """Sectors per cycle: how many and which."""
    now = current_regime(cycles).filter("scope = 'sector'")
    return now.groupBy("cycle").agg(
        F.count(F.lit(1)).alias("sectors"),
        F.array_join(F.sort_array(F.collect_list("scope_id")), ",").alias("names"))


def with_dimension(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left lookup with a default for misses. Join strategy is left to the optimizer."""
    out = df.join(dim.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def breadth(panel: DataFrame) -> DataFrame:
    """Advance/decline ratio, share above moving averages, new 52-week extremes per date."""
    w = series()
    prev = F.lag("close").over(w)
    c = F.col("close")
    rn = F.row_number().over(w)
    p = panel.select("symbol", "date", "close", prev.alias("prev"), rn.alias("rn"), F.sum("close").over(running(w)).alias("_sum"),
                     F.max("close").over(trailing(w, 14)).alias("_hi"), F.min("close").over(trailing(w, 14)).alias("_lo"))
    p = p.select("date", "close", "prev", "rn", long_mean("_sum", w, 50).alias("s50"), long_mean("_sum", w, 200).alias("s200"),
                 long_extreme(F.greatest, "_hi", w, 252, 14).alias("hi"), long_extreme(F.least, "_lo", w, 252, 14).alias("lo"))
    ok50, ok200, r = F.col("rn") >= 50, F.col("rn") >= 200, F.col("rn")
    return p.groupBy("date").agg(
        F.try_divide(F.count_if(c > F.col("prev")), F.count_if(c < F.col("prev"))).alias("advance_decline_ratio"),
        (F.avg(F.when(ok50, F.when(c > F.col("s50"), 1.0).otherwise(0.0))) * 100).alias("pct_above_50dma"),
        (F.avg(F.when(ok200, F.when(c > F.col("s200"), 1.0).otherwise(0.0))) * 100).alias("pct_above_200dma"),
        F.count_if((r >= 50) & (c >= F.col("hi"))).alias("new_52w_highs"),
        F.count_if((r >= 50) & (c <= F.col("lo"))).alias("new_52w_lows"))


def feature_frame(bars: DataFrame, indicators: DataFrame, cycles: DataFrame) -> DataFrame:
    """Bars with indicators and stock labels by date, gaps filled forward."""
    from tapeflow.functions.windows import forward_fill
    ind = indicators.drop("open", "high", "low", "close", "volume")
    lab = cycles.filter("scope = 'stock'").select(F.col("scope_id").alias("symbol"), "date", "cycle")
    j = bars.join(ind, ["symbol", "date"], "left").join(lab, ["symbol", "date"], "left")
    j = j.withColumn("cycle", F.coalesce("cycle", F.lit("neutral")))
    w = series()
    j = j.withColumn("prev_close", F.lag("close").over(w))
    fill = [c for c in j.columns if c not in ("symbol", "date", "cycle")]
    return forward_fill(j, fill, w)


def as_of_latest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
                 cols: list[str]) -> DataFrame:
    """Latest row of ``right`` at or before each row of ``left``: one sort, no range join."""
    r = right.select(*keys, F.col(right_time).alias(left_time), F.struct(right_time, *cols).alias("_r"),
                     F.lit(0).alias("_side"))
    u = left.withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(left_time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return u.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in [right_time, *cols] if c not in left.columns])


def latest_fundamentals(fundamentals: DataFrame) -> DataFrame:
    return latest(fundamentals, ["symbol"], "period_end")
