"""Queries over regime labels, context and breadth."""

from pyspark.sql import functions as F

from tapeflow.functions.windows import latest
from tapeflow.operators import regimes as R
from tapeflow.plans.fixture_sql import add_table
from tapeflow.plans.q_indicators import DATE, rounded, rsql
from tapeflow.plans.registry import query
from tapeflow.sources import tables as S
from tapeflow.sources import testdata as td

add_table("scoped", "market_index sector_index bars", """
SELECT 'market' AS scope, NULL AS scope_id, date, nifty200_close AS close FROM market_index
UNION ALL SELECT 'sector', sector, date, close FROM sector_index
UNION ALL SELECT 'stock', symbol, date, close FROM bars""")
add_table("lab1", "scoped", """
SELECT *, close - lag(close) OVER w AS delta, row_number() OVER w AS rn,
  (close - max(close) OVER u) / max(close) OVER u AS drawdown,
  lead(close, 20) OVER w / close - 1 AS fwd_20d
FROM scoped WINDOW w AS (PARTITION BY scope, scope_id ORDER BY date), u AS (PARTITION BY scope, scope_id ORDER BY date ROWS UNBOUNDED PRECEDING)""")
add_table("lab2", "lab1", """
SELECT *, CASE WHEN rn >= 15 THEN avg(greatest(delta, 0)) OVER r14 END AS gain, CASE WHEN rn >= 15 THEN avg(greatest(-delta, 0)) OVER r14 END AS loss,
  CASE WHEN scope = 'market' THEN CASE WHEN rn >= 200 THEN avg(close) OVER r200 END ELSE CASE WHEN rn >= 50 THEN avg(close) OVER r50 END END AS dma
FROM lab1 WINDOW r14 AS (PARTITION BY scope, scope_id ORDER BY date ROWS 13 PRECEDING),
  r50 AS (PARTITION BY scope, scope_id ORDER BY date ROWS 49 PRECEDING), r200 AS (PARTITION BY scope, scope_id ORDER BY date ROWS 199 PRECEDING)""")
add_table("lab3", "lab2", """
SELECT *, 100 - 100 / (1 + gain / nullif(loss, 0)) AS rsi, coalesce(close > dma, FALSE) AS above,
  CASE scope WHEN 'market' THEN -0.15 WHEN 'sector' THEN -0.12 ELSE -0.20 END AS bear_dd,
  CASE scope WHEN 'market' THEN 0.07 WHEN 'sector' THEN 0.06 ELSE 0.10 END AS band,
  CASE scope WHEN 'market' THEN 20 WHEN 'sector' THEN 15 ELSE 10 END AS min_len
FROM lab2""")
add_table("lab4", "lab3", """
SELECT *, CASE WHEN drawdown >= -band AND above AND coalesce(rsi, 50) > 55 THEN 1
               WHEN drawdown <= bear_dd AND NOT above AND coalesce(rsi, 50) < 45 THEN -1 ELSE 0 END AS raw FROM lab3""")
add_table("lab5", "lab4", """
SELECT *, sum(chg) OVER (PARTITION BY scope, scope_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS run
FROM (SELECT *, CASE WHEN raw IS NOT DISTINCT FROM lag(raw) OVER (PARTITION BY scope, scope_id ORDER BY date) THEN 0 ELSE 1 END AS chg FROM lab4)""")
add_table("labels", "lab5", """
SELECT scope, scope_id, date, close, rsi, drawdown, fwd_20d, dma, CAST(above AS INTEGER) AS above_dma, cycle_int,
  CASE cycle_int WHEN 1 THEN 'bull' WHEN -1 THEN 'bear' ELSE 'neutral' END AS cycle
FROM (SELECT *, CASE WHEN raw <> 0 AND count(*) OVER (PARTITION BY scope, scope_id, run) < min_len THEN 0 ELSE raw END AS cycle_int FROM lab5)""")
add_table("regime", "labels", """
SELECT scope, scope_id, date, cycle, CAST(0 AS DOUBLE) AS confidence
FROM labels QUALIFY date = max(date) OVER (PARTITION BY scope)""")


def labels(spark, d, of=None):
    return R.label(R.scope_prices(td.market_index(spark, d, of), td.sector_index(spark, d, of), td.bars(spark, d) if of is None else of))


def cycles(spark, d, of=None):
    return R.cycle_rows(labels(spark, d, of))


def sector_prices(spark, d):
    return td.sector_index(spark, d).select(F.lit("sector").alias("scope"), F.col("sector").alias("scope_id"), "date", "close")


@query("regime_days_by_symbol", "R-01 W-07 W-03", """
SELECT scope_id AS symbol, cycle, count(*) AS days FROM labels WHERE scope = 'stock' GROUP BY 1, 2""", "labels")
def regime_days_by_symbol(spark, d):
    lab = R.label_stocks(td.bars(spark, d))
    return lab.groupBy("symbol", "cycle").agg(F.count(F.lit(1)).alias("days"))


@query("regime_labels", "R-01 R-02 W-05 W-06 W-07 W-08 F-07", f"""
SELECT scope, scope_id, {DATE}, cycle, cycle_int, above_dma, {rsql(['rsi', 'drawdown', 'fwd_20d'])} FROM labels""", "labels")
def regime_labels(spark, d):
    return labels(spark, d).select(
        "scope", "scope_id", F.col("date").cast("string"), "cycle", "cycle_int", "above_dma",
        *[(F.round(c, 4) + 0.0).alias(c) for c in ("rsi", "drawdown", "fwd_20d")])


@query("regime_label_stats", "R-02 A-25", """
SELECT scope, count(*) AS n_rows, count(DISTINCT scope_id) AS members, count(*) FILTER (cycle = 'bull') AS bull,
  count(*) FILTER (cycle = 'bear') AS bear, count(*) FILTER (cycle = 'neutral') AS neutral FROM labels GROUP BY 1""", "labels")
def regime_label_stats(spark, d):
    return R.label_stats(labels(spark, d))


@query("current_regime", "W-13 W-09", f"SELECT scope, scope_id, {DATE}, cycle, confidence FROM regime", "regime")
def current_regime(spark, d):
    return R.current_regime(cycles(spark, d)).select("scope", "scope_id", F.col("date").cast("string"), "cycle", "confidence")


@query("market_state", "W-14 P-03 J-08", """
SELECT scope, cycle, confidence, CAST(date AS VARCHAR) AS date, CASE cycle WHEN 'bull' THEN 0.65 WHEN 'bear' THEN 0.85 ELSE 0.75 END::DOUBLE AS threshold,
  date_diff('hour', CAST(date AS TIMESTAMP), TIMESTAMP '2001-11-05 18:30:00') > 25 AS stale
FROM regime WHERE scope = 'market'""", "regime")
def market_state(spark, d):
    m = td.market_index(spark, d).select(F.lit("market").alias("scope"), F.lit(None).cast("string").alias("scope_id"),
                                         "date", F.col("nifty200_close").alias("close"))
    out = R.market_state(R.cycle_rows(R.label(m)), F.col("date").cast("timestamp"), F.lit("2001-11-05 18:30:00").cast("timestamp"))
    return out.withColumn("date", F.col("date").cast("string"))


@query("sector_cycle_history", "R-08 P-03", """
SELECT CAST(date AS VARCHAR) AS date, cycle FROM labels
WHERE scope = 'sector' AND scope_id = 'ASIA' AND date >= DATE '2001-11-05' - 365""", "labels")
def sector_cycle_history(spark, d):
    c = R.cycle_rows(R.label(sector_prices(spark, d)))
    return R.cycle_history(c, "sector", "ASIA", td.AS_OF, 365).select(F.col("date").cast("string"), "cycle")


@query("sector_tally", "A-18", """
SELECT cycle, count(*) AS sectors, string_agg(scope_id, ',' ORDER BY scope_id) AS names FROM regime WHERE scope = 'sector' GROUP BY 1""", "regime")
def sector_tally(spark, d):
    return R.sector_tally(R.cycle_rows(R.label(sector_prices(spark, d))))


@query("market_breadth", "A-22 P-04", f"""
SELECT {DATE}, {rsql(['advance_decline_ratio', 'pct_above_50dma', 'pct_above_200dma'], 6)}, new_52w_highs, new_52w_lows FROM (
SELECT date, count(*) FILTER (close > prev) / nullif(count(*) FILTER (close < prev), 0) AS advance_decline_ratio,
  avg(CASE WHEN rn >= 50 THEN CAST(close > s50 AS INTEGER) END) * 100 AS pct_above_50dma,
  avg(CASE WHEN rn >= 200 THEN CAST(close > s200 AS INTEGER) END) * 100 AS pct_above_200dma,
  count(*) FILTER (rn >= 50 AND close >= hi) AS new_52w_highs, count(*) FILTER (rn >= 50 AND close <= lo) AS new_52w_lows
FROM (SELECT *, lag(close) OVER w AS prev, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS s50,
        avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING) AS s200,
        max(close) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS hi,
        min(close) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS lo
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) GROUP BY date)""", "bars")
def market_breadth(spark, d):
    b = R.breadth(td.bars(spark, d))
    cols = ("advance_decline_ratio", "pct_above_50dma", "pct_above_200dma")
    return b.select(F.col("date").cast("string"), *[(F.round(c, 6) + 0.0).alias(c) for c in cols], "new_52w_highs", "new_52w_lows")


@query("market_context", "S-03 J-07 G-08 U-01", f"""
SELECT {DATE}, {rsql(['nifty200_close', 'india_vix', 'sector_africa_close', 'sector_america_close', 'sector_asia_close', 'sector_europe_close', 'sector_middle_east_close'])}
FROM context""", "context")
def market_context(spark, d):
    c = td.market_context(spark, d)
    return rounded(c, [x for x in c.columns if x != "date"])


@query("market_overview_row", "G-08 W-09", f"""
SELECT {DATE}, {rsql(['nifty200_close', 'india_vix'])} FROM market_index ORDER BY date DESC LIMIT 1""", "market_index")
def market_overview_row(spark, d):
    r = td.market_index(spark, d).orderBy(F.desc("date")).limit(1)
    return rounded(r, ["nifty200_close", "india_vix"])


@query("member_sector_index", "J-08 A-22", f"""
SELECT sector, {DATE}, round(100 * exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING)), 4) + 0.0 AS close
FROM (SELECT sector, date, avg(r) AS r FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars)
      JOIN stocks USING (symbol) GROUP BY 1, 2)""", "bars stocks")
def member_sector_index(spark, d):
    s = R.sector_series_from_members(td.bars(spark, d), td.stocks(spark, d))
    return s.select("sector", F.col("date").cast("string"), (F.round("close", 4) + 0.0).alias("close"))


@query("feature_frame", "J-01 W-02", f"""
SELECT symbol, {DATE}, cycle, {rsql(['prev_close', 'sma_50', 'roc_20', 'ichimoku_chikou'])} FROM (
SELECT b.symbol, b.date, l.cycle, lag(b.close) OVER w AS prev_close, sma_50, roc_20, last_value(ichimoku_chikou IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS ichimoku_chikou
FROM bars b JOIN win4 w4 ON w4.symbol = b.symbol AND w4.date = b.date JOIN labels l ON l.scope = 'stock' AND l.scope_id = b.symbol AND l.date = b.date
WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date))""", "bars win4 labels")
def feature_frame(spark, d):
    from tapeflow.operators.indicators import window_indicators
    bars = td.bars(spark, d)
    ind = window_indicators(bars).select("symbol", "date", "sma_50", "roc_20", "ichimoku_chikou")
    c = R.cycle_rows(R.label(bars.select(F.lit("stock").alias("scope"), F.col("symbol").alias("scope_id"), "date", "close")))
    f = R.feature_frame(bars, ind, c)
    return f.select("symbol", F.col("date").cast("string"), "cycle",
                    *[(F.round(x, 4) + 0.0).alias(x) for x in ("prev_close", "sma_50", "roc_20", "ichimoku_chikou")])


@query("fundamentals_as_of", "J-17", f"""
SELECT b.symbol, CAST(b.date AS VARCHAR) AS date, CAST(f.period_end AS VARCHAR) AS period_end, f.pe_ratio, f.roe
FROM bars b ASOF LEFT JOIN fundamentals f ON f.symbol = b.symbol AND b.date >= f.period_end""", "bars fundamentals")
def fundamentals_as_of(spark, d):
    out = R.as_of_latest(td.bars(spark, d).select("symbol", "date"), td.fundamentals(spark, d),
                         ["symbol"], "date", "period_end", ["pe_ratio", "roe"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("date", "period_end")})


@query("latest_fundamentals", "J-17 W-09", """
SELECT symbol, CAST(period_end AS VARCHAR) AS period_end, pe_ratio, roe FROM fundamentals
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) = 1""", "fundamentals")
def latest_fundamentals(spark, d):
    return R.latest_fundamentals(td.fundamentals(spark, d)).select("symbol", F.col("period_end").cast("string"), "pe_ratio", "roe")


@query("latest_prices", "J-06", f"SELECT symbol, CAST(price_date AS VARCHAR) AS price_date, round(price, 4) AS price FROM last_price", "last_price")
def latest_prices(spark, d):
    from tapeflow.operators.portfolio import latest_prices as lp
    return lp(td.bars(spark, d)).select("symbol", F.col("price_date").cast("string"), F.round("price", 4).alias("price"))


@query("last_ten_bars", "W-10 G-07", f"""
SELECT symbol, {DATE}, round(close, 4) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 10""", "bars")
def last_ten_bars(spark, d):
    return latest(td.bars(spark, d), ["symbol"], "date", 10).select("symbol", F.col("date").cast("string"), F.round("close", 4).alias("close"))


@query("bar_watermarks", "S-04", """
SELECT symbol, CAST(max(date) AS VARCHAR) AS last_date, count(*) AS price_count FROM bars_raw GROUP BY 1""", "bars_raw")
def bar_watermarks(spark, d):
    return S.watermarks(td.bars_raw(spark, d)).withColumn("last_date", F.col("last_date").cast("string"))


@query("cleaned_bars", "S-01 P-01 F-03", f"""
SELECT symbol, {DATE}, open, high, low, close, close AS adj_close, volume, 'file' AS source FROM bars_raw
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""", "bars_raw")
def cleaned_bars(spark, d):
    b = S.clean_bars(td.bars_raw(spark, d)).filter(F.col("date").between("1996-01-01", "1999-12-31"))
    return b.withColumn("date", F.col("date").cast("string"))


@query("upserted_bars", "S-05 S-02 S-13", """
SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN date >= DATE '2001-10-31' THEN close * 2 ELSE close END AS close, volume FROM bars_raw""", "bars_raw")
def upserted_bars(spark, d):
    b = td.bars_raw(spark, d).select("symbol", "date", "close", "volume")
    delta = b.filter(F.col("date") >= F.date_sub(F.lit(td.AS_OF).cast("date"), 5)).withColumn("close", F.col("close") * 2)
    return S.upsert(b, delta, ["symbol", "date"]).withColumn("date", F.col("date").cast("string"))


@query("inserted_if_absent", "S-06 J-13 U-03", """
SELECT symbol, CAST(min(date) AS VARCHAR) AS date FROM bars_raw GROUP BY symbol
UNION ALL SELECT symbol, '1970-01-01' FROM stocks WHERE symbol NOT IN (SELECT symbol FROM bars_raw)""", "bars_raw stocks")
def inserted_if_absent(spark, d):
    old = td.bars_raw(spark, d).groupBy("symbol").agg(F.min("date").cast("string").alias("date"))
    new = td.stocks(spark, d).select("symbol", F.lit("1970-01-01").alias("date"))
    return S.insert_absent(old, new, ["symbol"])


@query("inserted_new_symbols", "S-06 U-03", """
SELECT symbol, CAST(min(date) AS VARCHAR) AS date FROM bars_raw WHERE CAST(substr(symbol, 2) AS BIGINT) % 3 <> 0 GROUP BY symbol
UNION ALL SELECT symbol, '1970-01-01' FROM stocks WHERE k % 3 = 0""", "bars_raw stocks")
def inserted_new_symbols(spark, d):
    """Two thirds of the symbols are known, the others are inserted."""
    old = td.bars_raw(spark, d).filter(F.expr("cast(substring(symbol, 2) as bigint)") % 3 != 0).groupBy("symbol").agg(F.min("date").cast("string").alias("date"))
    new = td.stocks(spark, d).select("symbol", F.lit("1970-01-01").alias("date"))
    return S.insert_absent(old, new, ["symbol"])


@query("sectors_of_universe", "S-11 O-01", "SELECT DISTINCT sector FROM stocks ORDER BY sector", "stocks")
def sectors_of_universe(spark, d):
    from tapeflow.sources.universe import sectors
    return sectors(td.stocks(spark, d))


@query("symbols_of_sector", "S-11 P-01", "SELECT symbol FROM stocks WHERE sector = 'ASIA'", "stocks")
def symbols_of_sector(spark, d):
    from tapeflow.sources.universe import symbols_in_sector
    return symbols_in_sector(td.stocks(spark, d), "ASIA")


@query("table_row_counts", "A-17", """
SELECT 'bars' AS name, count(*) AS n FROM bars_raw UNION ALL SELECT 'stocks', count(*) FROM stocks
UNION ALL SELECT 'tradebook', count(*) FROM tradebook UNION ALL SELECT 'fundamentals', count(*) FROM fundamentals""", "bars_raw stocks tradebook fundamentals")
def table_row_counts(spark, d):
    return S.row_counts({"bars": td.bars_raw(spark, d), "stocks": td.stocks(spark, d), "tradebook": td.tradebook(spark, d),
                         "fundamentals": td.fundamentals(spark, d)})
