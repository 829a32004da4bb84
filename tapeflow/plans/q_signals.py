"""Queries over signals, features, classifiers, patterns, pages and reports."""

from dataclasses import replace

from pyspark.sql import functions as F

from tapeflow.functions.rules import look_back
from tapeflow.functions.windows import series, time_folds
from tapeflow.operators import classify as C
from tapeflow.operators import indicators as I
from tapeflow.operators import patterns as HM
from tapeflow.operators import regimes as R
from tapeflow.operators import signals as SG
from tapeflow.operators import state_blocks as SB
from tapeflow.operators import strategies as ST
from tapeflow.params import DEFAULTS, SIGNAL_FEATURES
from tapeflow.plans import forest_sql, reports, rule_sql
from tapeflow.plans.fixture_sql import add_table
from tapeflow.plans.q_indicators import DATE, rounded, rsql
from tapeflow.plans.q_regimes import cycles
from tapeflow.plans.q_strategies import panel
from tapeflow.plans.registry import query
from tapeflow.session import stored
from tapeflow.sources import broker_csv, html_fields
from tapeflow.sources import testdata as td
from tapeflow.sources.tables import import_log

DOCS = ST.STRATEGIES
NOW = "2001-11-05 18:30:00"
# The market is neutral on the last date, where no rule score reaches the
# default threshold; this one lets the queries below produce rows.
EASY = replace(DEFAULTS, signal_thresholds={"bull": 0.5, "neutral": 0.5, "bear": 0.3})

CONF = """round_even(least(0.95, greatest(0.30, CAST(0.5 AS DOUBLE) + CASE WHEN coalesce(nullif(rsi_14, 0), 50) > 50 AND coalesce(nullif(rsi_14, 0), 50) < 70 THEN 0.05 ELSE 0 END
  + CASE WHEN coalesce(nullif(adx_14, 0), 20) > 25 THEN 0.05 ELSE 0 END + CASE WHEN supertrend_dir = -1 THEN 0.05 ELSE 0 END
  + CASE WHEN macd_hist > 0 THEN 0.05 ELSE 0 END + CASE WHEN volume_ratio > 1.2 THEN 0.03 ELSE 0 END
  + CASE m.cycle WHEN 'bull' THEN 0.07 WHEN 'bear' THEN -0.10 ELSE 0 END)), 4)"""


def _hits():
    parts = []
    for i, d in enumerate(DOCS):
        s = rule_sql.stop(d, "close")
        for tf in d["timeframes"]:
            parts.append(f"SELECT symbol, date, rn, {i} AS seq, '{d['strategy_id']}' AS strategy_id, '{d['name']}' AS strategy_name, '{tf}' AS timeframe, "
                         f"{rule_sql.rules(d['entry_rules'])} AS entry, {s} AS stop_loss, {rule_sql.target(d, 'close', s)} AS target_price "
                         "FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)")
    return "\nUNION ALL\n".join(parts)


add_table("sig_hits", "panel", f"SELECT * FROM ({_hits()}) QUALIFY date = max(date) OVER (PARTITION BY symbol)")
add_table("sig_log", "sig_hits panel regime", f"""
SELECT h.symbol, timeframe, strategy_id, strategy_name, seq, round_even(p.close, 2) AS entry_price, target_price, stop_loss,
  round_even((target_price - p.close) / (p.close - stop_loss), 2) AS risk_reward, {CONF} AS confidence, m.cycle AS cycle_context, p.sector, p.sector_cycle, p.rsi_14, p.adx_14, p.volume_ratio
FROM sig_hits h JOIN panel p ON p.symbol = h.symbol AND p.date = h.date CROSS JOIN (SELECT cycle FROM regime WHERE scope = 'market') m
WHERE entry AND p.close > stop_loss AND (target_price - p.close) / (p.close - stop_loss) >= 1.5
  AND {CONF} >= CASE m.cycle WHEN 'bear' THEN 0.3 ELSE 0.5 END""")


def latest_regime(spark, d, of):
    """The current regime of every scope, stored: a row a scope and symbol, whose labels need not share the disk with the panel."""
    return stored(R.current_regime(cycles(spark, d, of)), "regime")


MODEL_CONF = f"coalesce(p.rsi_14 / 100, {CONF})"  # any column may stand for a model's confidence


@query("model_confidence_signals", "G-03", f"""
SELECT h.symbol, timeframe, strategy_id, round_even({MODEL_CONF}, 4) + 0.0 AS confidence
FROM sig_hits h JOIN panel p ON p.symbol = h.symbol AND p.date = h.date CROSS JOIN (SELECT cycle FROM regime WHERE scope = 'market') m
WHERE entry AND p.close > stop_loss AND (target_price - p.close) / (p.close - stop_loss) >= 1.5
  AND {MODEL_CONF} >= CASE m.cycle WHEN 'bear' THEN 0.3 ELSE 0.5 END""", "sig_hits panel regime")
def model_confidence_signals(spark, d):
    b = td.stored_bars(spark, d)
    regime = latest_regime(spark, d, b)
    hits = SG.entries(panel(spark, d, b, last=look_back(DOCS) + 1), DOCS)  # the latest row and what its rules look back on
    s = SG.generate(hits, regime, NOW, model_confidence=F.col("rsi_14") / 100, p=EASY)
    return s.select("symbol", "timeframe", "strategy_id", (F.bround("confidence", 4) + 0.0).alias("confidence"))


def signal_log(spark, d, p=EASY, timeframe=None, of=None):
    b = td.stored_bars(spark, d) if of is None else of
    regime = latest_regime(spark, d, b)
    hits = SG.entries(panel(spark, d, b, last=look_back(DOCS) + 1), DOCS)  # the latest row and what its rules look back on
    return SG.generate(hits, regime, NOW, timeframe=timeframe, p=p)


@query("signals", "G-01 G-02 G-03 G-04 P-14 J-08 J-12", """
SELECT symbol, timeframe, strategy_id, entry_price, target_price, stop_loss, risk_reward, confidence, cycle_context, sector, sector_cycle,
  format('{} | Market: {} | RSI: {:.1f} | ADX: {:.1f} | Vol Ratio: {:.1f}x', strategy_name, upper(cycle_context), rsi_14, adx_14, volume_ratio) AS reasoning
FROM sig_log""", "sig_log")
def signals(spark, d):
    return signal_log(spark, d).select("symbol", "timeframe", "strategy_id", "entry_price", "target_price", "stop_loss", "risk_reward",
                                       "confidence", "cycle_context", "sector", "sector_cycle", "reasoning")


@query("default_threshold_signals", "G-01 W-14", """
SELECT count(*) AS n FROM sig_log WHERE confidence >= CASE cycle_context WHEN 'bull' THEN 0.65 WHEN 'bear' THEN 0.85 ELSE 0.75 END""", "sig_log")
def default_threshold_signals(spark, d):
    return signal_log(spark, d, DEFAULTS).agg(F.count(F.lit(1)).alias("n"))


@query("active_watchlist", "G-05 W-17 G-06", """
SELECT symbol, timeframe, strategy_id, confidence FROM sig_log QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY seq DESC) = 1""", "sig_log")
def active_watchlist(spark, d):
    return SG.watchlist(signal_log(spark, d)).select("symbol", "timeframe", "strategy_id", "confidence")


@query("signal_history", "G-06 W-10", "SELECT symbol, timeframe, strategy_id FROM sig_log QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY seq DESC) <= 100", "sig_log")
def signal_history(spark, d):
    return SG.history(signal_log(spark, d), 100).select("symbol", "timeframe", "strategy_id")


@query("signal_counts", "A-19", "SELECT timeframe, count(*) AS buy, CAST(0 AS BIGINT) AS sell, CAST(0 AS BIGINT) AS hold FROM sig_log GROUP BY 1", "sig_log")
def signal_counts(spark, d):
    return SG.counts(signal_log(spark, d))


@query("top_setups", "W-15 O-02 Z-02", """
SELECT CAST(row_number() OVER (ORDER BY confidence DESC, symbol) AS INTEGER) AS rank, symbol, confidence AS conf, strategy_id AS strategy FROM (
  SELECT * FROM (SELECT * FROM sig_log QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY seq DESC) = 1)
  WHERE timeframe = 'medium' ORDER BY confidence DESC, symbol LIMIT 3)""", "sig_log")
def top_setups(spark, d):
    t = SG.top_setups(SG.supersede(signal_log(spark, d)), 3, "medium")
    return t.select("rank", "symbol", "conf", "strategy")


@query("rule_confidence", "G-02", f"SELECT symbol, CAST(date AS VARCHAR) AS date, {CONF} AS confidence FROM ind CROSS JOIN (SELECT 'bull' AS cycle) m", "ind")
def rule_confidence(spark, d):
    x = I.indicators(td.bars(spark, d))
    return x.select("symbol", F.col("date").cast("string"), SG.confidence(F.lit("bull")).alias("confidence"))


def _feature_sql(tf):
    derived = {
        "above_50dma": "CAST(coalesce(close > coalesce(sma_50, 0), FALSE) AS INTEGER)", "above_200dma": "CAST(coalesce(close > coalesce(sma_200, 0), FALSE) AS INTEGER)",
        "ema50_vs_ema200": "coalesce((coalesce(ema_50, 0) - ema_200) / ema_200 * 100, 0)",
        "ichimoku_above_cloud": "CAST(close > greatest(coalesce(ichimoku_senkou_a, 0), coalesce(ichimoku_senkou_b, 0)) AS INTEGER)"}
    for s, col in (("market", "'bull'"), ("sector", "sector_cycle"), ("stock", "cycle")):
        for c in ("bull", "bear", "neutral"):
            derived[f"{s}_cycle_{c}"] = f"CAST({col} = '{c}' AS INTEGER)"
    cols = rule_sql.PANEL
    out = []
    for n in SIGNAL_FEATURES[tf]:
        e = derived.get(n, f"coalesce({n}, 0)" if n in cols else "0")
        out.append(f"round(CAST({e} AS DOUBLE), {8 if n == 'pe_vs_sector' else 4}) + 0.0 AS {n}")
    return f"SELECT symbol, CAST(date AS VARCHAR) AS date, {', '.join(out)} FROM panel"


def _features(tf):
    @query(f"features_{tf}", "R-13 F-06", _feature_sql(tf), "panel")
    def run(spark, d):
        p = panel(spark, d).withColumn("market_cycle", F.lit("bull")).withColumn("stock_cycle", F.col("cycle"))
        return rounded(SG.feature_vectors(p, tf), list(SIGNAL_FEATURES[tf]))


for _tf in ("swing", "medium", "long_term", "intraday"):
    _features(_tf)


# Classifiers

def sector_long(spark, d, of=None):
    return td.sector_index(spark, d, of)


def market_rows(spark, d, of=None):
    f = C.market_features(td.market_context(spark, d, of))
    m = td.market_index(spark, d, of).select(F.lit("market").alias("scope"), F.lit(None).cast("string").alias("scope_id"), "date", F.col("nifty200_close").alias("close"))
    return C.dataset(f, R.cycle_rows(R.label(m)), "market", C.MARKET_FEATURES)


def sector_rows(spark, d, of=None):
    s = sector_long(spark, d, of)
    lab = R.cycle_rows(R.label(s.select(F.lit("sector").alias("scope"), F.col("sector").alias("scope_id"), "date", "close")))
    return C.dataset(C.sector_features(s, td.market_index(spark, d, of)), lab, "sector", C.SECTOR_FEATURES, "sector")


def stock_rows(spark, d, of=None):
    """Labels and relative strength come before the indicator pass, so that all of it is one shuffle by symbol and wide rows are not dealt out.
    Labels do not see bars without a price."""
    b = td.stored_bars(spark, d) if of is None else of
    index, priced = td.market_index(spark, d, b), F.col("close").isNotNull()
    x = I.relative_strength(b, index).withColumn("_priced", priced)
    x = R.label_columns(x, F.lit("stock"), ["symbol", "_priced"])
    x = I.panel_indicators(x.select(*I.BAR_COLUMNS, "rs_nifty200", F.when(priced, F.col("cycle")).alias("cycle")), DEFAULTS.min_bars_indicators)
    return C.dataset(C.stock_features(x, index), None, "stock", C.STOCK_FEATURES, "symbol")


def regime_rows(spark, d):
    """Training rows of the market, the sectors and the stocks, stored: growing a forest and classifying by it read them several times."""
    b = td.stored_bars(spark, d)
    return [stored(rows(spark, d, b), f"{scope}-rows") for scope, rows in (("market", market_rows), ("sector", sector_rows), ("stock", stock_rows))]


MF = ["nifty200_above_50dma", "nifty200_above_200dma", "nifty200_dma50_pct", "nifty200_dma200_pct", "nifty200_1d_ret", "nifty200_5d_ret", "nifty200_20d_ret", "india_vix"]


@query("market_training_rows", "J-02 R-03", f"""
SELECT {DATE}, cycle, {rsql(MF)} FROM (SELECT m.date, l.cycle, india_vix, CAST(coalesce(c > m50, FALSE) AS INTEGER) AS nifty200_above_50dma, CAST(coalesce(c > m200, FALSE) AS INTEGER) AS nifty200_above_200dma,
  coalesce((c / m50 - 1) * 100, 0) AS nifty200_dma50_pct, coalesce((c / m200 - 1) * 100, 0) AS nifty200_dma200_pct,
  coalesce(r1, 0) AS nifty200_1d_ret, coalesce(r5, 0) AS nifty200_5d_ret, coalesce(r20, 0) AS nifty200_20d_ret
FROM (SELECT *, nifty200_close AS c, CASE WHEN row_number() OVER w >= 50 THEN avg(nifty200_close) OVER (ORDER BY date ROWS 49 PRECEDING) END AS m50,
    CASE WHEN row_number() OVER w >= 200 THEN avg(nifty200_close) OVER (ORDER BY date ROWS 199 PRECEDING) END AS m200,
    (nifty200_close / lag(nifty200_close, 1) OVER w - 1) * 100 AS r1, (nifty200_close / lag(nifty200_close, 5) OVER w - 1) * 100 AS r5, (nifty200_close / lag(nifty200_close, 20) OVER w - 1) * 100 AS r20
  FROM market_index WINDOW w AS (ORDER BY date)) m JOIN labels l ON l.date = m.date AND l.scope = 'market')""", "market_index labels")
def market_training_rows(spark, d):
    m = market_rows(spark, d)
    return m.select(F.col("date").cast("string"), "cycle", *[(F.round(c, 4) + 0.0).alias(c) for c in MF])


SF = ["index_close", "ret_5d", "ret_20d", "ret_60d", "above_50dma", "rsi_14", "india_vix"]


@query("sector_training_rows", "J-03 R-03 U-01 W-08", f"""
SELECT sector, {DATE}, cycle, {rsql(SF)} FROM (SELECT l.scope_id AS sector, l.date, l.cycle, l.close AS index_close, coalesce(rsi, 0) AS rsi_14, m.india_vix,
  coalesce((l.close / lag(l.close, 5) OVER w - 1) * 100, 0) AS ret_5d, coalesce((l.close / lag(l.close, 20) OVER w - 1) * 100, 0) AS ret_20d,
  coalesce((l.close / lag(l.close, 60) OVER w - 1) * 100, 0) AS ret_60d, above_dma AS above_50dma
FROM labels l JOIN market_index m ON m.date = l.date WHERE l.scope = 'sector' WINDOW w AS (PARTITION BY l.scope_id ORDER BY l.date))""", "labels market_index")
def sector_training_rows(spark, d):
    s = sector_rows(spark, d)
    return s.select("sector", F.col("date").cast("string"), "cycle", *[(F.round(c, 4) + 0.0).alias(c) for c in SF])


KF = ["pct_from_ema200", "above_50dma", "above_200dma", "ema50_vs_ema200", "rsi_14", "adx_14", "macd_hist", "volume_ratio", "rs_nifty200", "india_vix", "hist_vol_21"]


@query("stock_training_rows", "J-04 J-05 P-04 R-03 R-05", f"""
SELECT symbol, {DATE}, cycle, {rsql(KF)} FROM (SELECT i.symbol, i.date, l.cycle, coalesce(i.pct_from_ema200, 0) AS pct_from_ema200, CASE WHEN i.close > sma_50 THEN 1 ELSE 0 END AS above_50dma,
  CASE WHEN i.close > sma_200 THEN 1 ELSE 0 END AS above_200dma, coalesce((ema_50 - ema_200) / nullif(ema_200, 0) * 100, 0) AS ema50_vs_ema200, rsi_14, coalesce(adx_14, 0) AS adx_14,
  coalesce(macd_hist, 0) AS macd_hist, coalesce(volume_ratio, 0) AS volume_ratio, coalesce(rs.rs_nifty200, 0) AS rs_nifty200, m.india_vix, coalesce(hist_vol_21, 0) AS hist_vol_21
FROM ind i JOIN rs ON rs.symbol = i.symbol AND rs.date = i.date JOIN market_index m ON m.date = i.date
JOIN labels l ON l.scope = 'stock' AND l.scope_id = i.symbol AND l.date = i.date WHERE rsi_14 IS NOT NULL)""", "ind rs market_index labels")
def stock_training_rows(spark, d):
    s = stock_rows(spark, d)
    return s.select("symbol", F.col("date").cast("string"), "cycle", *[(F.round(c, 4) + 0.0).alias(c) for c in KF])


@query("label_class_distribution", "A-25", "SELECT cycle, count(*) AS n FROM labels WHERE scope = 'sector' GROUP BY 1", "labels")
def label_class_distribution(spark, d):
    return C.class_distribution(sector_rows(spark, d))


@query("time_folds", "W-16", """
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM (
  SELECT date, CASE WHEN p < total - 5 * (total // 6) THEN 0 ELSE (p - (total - 5 * (total // 6))) // (total // 6) + 1 END AS fold
  FROM (SELECT date, row_number() OVER (ORDER BY date, symbol) - 1 AS p, count(*) OVER () AS total FROM bars)) GROUP BY 1""", "bars")
def time_fold_sizes(spark, d):
    f = time_folds(td.bars(spark, d).select("date", "symbol"), ["date", "symbol"], 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"))


@query("market_regime_forest", "R-04 R-05 R-07")
def market_regime_forest(spark, d):
    rows = market_rows(spark, d)
    return C.predict(C.node_table(C.train(rows)), rows).withColumn("probabilities", F.to_json("probabilities"))


@query("regime_validation", "R-04 W-16")
def regime_validation(spark, d):
    """The F1 and size of each fold, and the importance of each feature in the forest of all rows."""
    rows = market_rows(spark, d)
    folds = C.weighted_f1(C.confusion(C.fold_predictions(rows))).select(F.lit("fold").alias("part"), F.col("fold").cast("string").alias("name"), "n_test", F.col("f1").alias("value"))
    weights = list(C.importances(C.train(rows), C.feature_columns(rows)).items())
    used = spark.createDataFrame(weights, "name string, value double").select(F.lit("feature").alias("part"), "name", F.lit(None).cast("bigint").alias("n_test"), "value")
    return folds.unionByName(used)


@query("classified_regimes", "R-06 R-04 S-05 A-25")
def classified_regimes(spark, d):
    m, s, k = regime_rows(spark, d)
    models = [C.node_table(C.train(x)) for x in (m, s, k)]
    return C.classify_all(*models, m, s, k, td.stocks(spark, d))


# The same steps with forests of random cuts, which SQL can grow as well.

TREES, CUTS, FOREST_SEED = 12, 4, 7
_NAMES, _SHAPE = C.CYCLE_NAMES, (TREES, CUTS)


def _forest_rows(cols, table, more=""):
    return f"SELECT 0 AS k, cycle, {more}[{', '.join(f'coalesce({c}, 0)::DOUBLE' for c in cols)}] AS x FROM {table}"


def _over(select, *parts):
    """A query over common tables of its own."""
    return "SELECT * FROM (WITH " + ",\n".join(p for part in parts for p in ([part] if isinstance(part, str) else part)) + f" {select})"


add_table("market_rows", "market_index labels", """
SELECT m.date, l.cycle, india_vix, CAST(coalesce(c > m50, FALSE) AS INTEGER) AS nifty200_above_50dma, CAST(coalesce(c > m200, FALSE) AS INTEGER) AS nifty200_above_200dma,
  (c / m50 - 1) * 100 AS nifty200_dma50_pct, (c / m200 - 1) * 100 AS nifty200_dma200_pct, nifty200_1d_ret, nifty200_5d_ret, nifty200_20d_ret
FROM (SELECT *, nifty200_close AS c, CASE WHEN row_number() OVER w >= 50 THEN avg(nifty200_close) OVER (ORDER BY date ROWS 49 PRECEDING) END AS m50,
    CASE WHEN row_number() OVER w >= 200 THEN avg(nifty200_close) OVER (ORDER BY date ROWS 199 PRECEDING) END AS m200,
    (nifty200_close / lag(nifty200_close, 1) OVER w - 1) * 100 AS nifty200_1d_ret, (nifty200_close / lag(nifty200_close, 5) OVER w - 1) * 100 AS nifty200_5d_ret,
    (nifty200_close / lag(nifty200_close, 20) OVER w - 1) * 100 AS nifty200_20d_ret
  FROM market_index WINDOW w AS (ORDER BY date)) m JOIN labels l ON l.date = m.date AND l.scope = 'market'""")
add_table("sector_rows", "labels market_index", """
SELECT l.scope_id AS sector, l.date, l.cycle, l.close AS index_close, rsi AS rsi_14, m.india_vix, m.r20 AS nifty200_20d_ret, above_dma AS above_50dma,
  (l.close / lag(l.close, 5) OVER w - 1) * 100 AS ret_5d, (l.close / lag(l.close, 20) OVER w - 1) * 100 AS ret_20d, (l.close / lag(l.close, 60) OVER w - 1) * 100 AS ret_60d,
  CASE WHEN row_number() OVER w >= 200 AND l.close > avg(l.close) OVER (PARTITION BY l.scope_id ORDER BY l.date ROWS 199 PRECEDING) THEN 1 ELSE 0 END AS above_200dma
FROM labels l JOIN (SELECT *, (nifty200_close / lag(nifty200_close, 20) OVER (ORDER BY date) - 1) * 100 AS r20 FROM market_index) m ON m.date = l.date
WHERE l.scope = 'sector' WINDOW w AS (PARTITION BY l.scope_id ORDER BY l.date)""")
add_table("stock_rows", "ind rs market_index labels", """
SELECT i.symbol, i.date, l.cycle, i.pct_from_ema200, i.pct_from_52w_high, i.pct_from_52w_low, CASE WHEN i.close > sma_50 THEN 1 ELSE 0 END AS above_50dma,
  CASE WHEN i.close > sma_200 THEN 1 ELSE 0 END AS above_200dma, (ema_50 - ema_200) / nullif(ema_200, 0) * 100 AS ema50_vs_ema200, rsi_14, rsi_9, adx_14, macd_hist, volume_ratio,
  rs.rs_nifty200 AS rs_nifty200, m.india_vix, hist_vol_21
FROM ind i JOIN rs ON rs.symbol = i.symbol AND rs.date = i.date JOIN market_index m ON m.date = i.date
JOIN labels l ON l.scope = 'stock' AND l.scope_id = i.symbol AND l.date = i.date WHERE rsi_14 IS NOT NULL""")

SECTOR_COLS = ["index_close", "ret_5d", "ret_20d", "ret_60d", "above_50dma", "above_200dma", "0", "1", "rsi_14", "0", "india_vix", "nifty200_20d_ret", "0"]
STOCK_COLS = ["pct_from_ema200", "pct_from_52w_high", "pct_from_52w_low", "above_50dma", "above_200dma", "ema50_vs_ema200", "rsi_14", "rsi_9", "adx_14", "macd_hist", "volume_ratio",
              "rs_nifty200", "india_vix", "{m}", "{s}", "hist_vol_21"]
_MARKET = [f"mr AS ({_forest_rows(MF, 'market_rows', 'date, ')})", *forest_sql.grown("mf", "mr", len(MF), _NAMES, *_SHAPE, FOREST_SEED)]


@query("random_tree_regimes", "R-07 R-05", _over(
    f"SELECT {DATE}, cycle, {rsql(['confidence', 'p0', 'p1', 'p2'], 6)} FROM p", _MARKET, forest_sql.scored("p", "mr", "date", "mf", _NAMES, *_SHAPE)), "market_rows")
def random_tree_regimes(spark, d):
    rows = market_rows(spark, d)
    p = C.predict(C.random_forest(rows, *_SHAPE, FOREST_SEED), rows)
    p = p.select("date", "cycle", "confidence", *[F.col("probabilities")[c].alias(f"p{i}") for i, c in enumerate(_NAMES)])
    return p.select(F.col("date").cast("string"), "cycle", *[(F.round(c, 6) + 0.0).alias(c) for c in ("confidence", "p0", "p1", "p2")])


@query("random_tree_validation", "R-04 W-16 A-25", _over(
    """SELECT CAST(k AS INTEGER) AS fold, CAST(sum(support) AS BIGINT) AS n_test, round(sum(support * 2.0::DOUBLE * hits / (support + coalesce(claimed, 0))) / sum(support), 6) + 0.0 AS f1
FROM c LEFT JOIN g USING (k, truth) GROUP BY 1""",
    f"""r0 AS (SELECT *, CASE WHEN p < total - 5 * (total // 6) THEN 0 ELSE (p - (total - 5 * (total // 6))) // (total // 6) + 1 END AS fold
  FROM (SELECT date, cycle, x, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS total FROM ({_forest_rows(MF, 'market_rows', 'date, ')})))""",
    "r AS (SELECT ks.k, cycle, x FROM r0 JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) ks ON fold < ks.k)", "q AS (SELECT fold AS k, date, cycle AS truth, x FROM r0 WHERE fold > 0)",
    forest_sql.grown("f", "r", len(MF), _NAMES, *_SHAPE, FOREST_SEED), forest_sql.scored("p", "q", "date, truth", "f", _NAMES, *_SHAPE),
    "c AS (SELECT k, truth, sum(CASE WHEN cycle = truth THEN 1 ELSE 0 END) AS hits, count(*) AS support FROM p GROUP BY 1, 2)",
    "g AS (SELECT k, cycle AS truth, count(*) AS claimed FROM p GROUP BY 1, 2)"), "market_rows")
def random_tree_validation(spark, d):
    found = C.fold_predictions(market_rows(spark, d), fit=lambda r: C.random_forest(r, *_SHAPE, FOREST_SEED))
    return C.weighted_f1(C.confusion(found)).select("fold", "n_test", (F.round("f1", 6) + 0.0).alias("f1"))


_ENCODED = "CASE cycle WHEN 'bull' THEN 1.0 WHEN 'bear' THEN -1.0 ELSE 0.0 END"
_LAST_STOCKS = f"""(SELECT * FROM stock_rows QUALIFY date = max(date) OVER (PARTITION BY symbol))
  LEFT JOIN (SELECT symbol, se FROM stocks JOIN (SELECT sector, {_ENCODED} AS se FROM sp) USING (sector)) USING (symbol), (SELECT {_ENCODED} AS me FROM mp)"""


@query("random_tree_classes", "R-06 R-05 S-05 J-08", _over(
    f"""SELECT {DATE}, scope, scope_id, cycle, {rsql(['confidence'], 6)} FROM (SELECT date, 'market' AS scope, NULL::VARCHAR AS scope_id, cycle, confidence FROM mp
  UNION ALL SELECT date, 'sector', sector, cycle, confidence FROM sp UNION ALL SELECT date, 'stock', symbol, cycle, confidence FROM kp)""",
    _MARKET, "mq AS (SELECT * FROM mr QUALIFY date = max(date) OVER ())", forest_sql.scored("mp", "mq", "date", "mf", _NAMES, *_SHAPE),
    f"sr AS ({_forest_rows(SECTOR_COLS, 'sector_rows', 'date, sector, ')})", forest_sql.grown("sf", "sr", len(SECTOR_COLS), _NAMES, *_SHAPE, FOREST_SEED),
    "sq AS (SELECT * FROM sr QUALIFY date = max(date) OVER (PARTITION BY sector))", forest_sql.scored("sp", "sq", "date, sector", "sf", _NAMES, *_SHAPE),
    f"kr AS ({_forest_rows([c.format(m='0', s='0') for c in STOCK_COLS], 'stock_rows')})", forest_sql.grown("kf", "kr", len(STOCK_COLS), _NAMES, *_SHAPE, FOREST_SEED),
    f"kq AS ({_forest_rows([c.format(m='me', s='se') for c in STOCK_COLS], _LAST_STOCKS, 'date, symbol, ')})",
    forest_sql.scored("kp", "kq", "date, symbol", "kf", _NAMES, *_SHAPE)), "market_rows sector_rows stock_rows stocks")
def random_tree_classes(spark, d):
    m, s, k = regime_rows(spark, d)
    models = [C.random_forest(x, *_SHAPE, FOREST_SEED) for x in (m, s, k)]
    c = C.classify_all(*models, m, s, k, td.stocks(spark, d))
    return c.select(F.col("date").cast("string"), "scope", "scope_id", "cycle", (F.round("confidence", 6) + 0.0).alias("confidence"))


# Patterns

@query("pattern_states", "R-09 R-10 R-11 F-06")
def pattern_states(spark, d):
    p = HM.pattern_rows(HM.name_states(HM.fit_states(td.bars(spark, d))))
    return p.withColumns({c: F.to_json(c) for c in ("state_labels", "transition_matrix")})


# The state model by blocks, under the models that rounds start from

add_table("state_x", "bars", """
SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, date, rn, coalesce(close / lag(close) OVER w - 1, 0) AS ret,
  coalesce(CASE WHEN rn >= 20 THEN ln(nullif(volume, 0) / avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)) END, 0) AS vol
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))""")
add_table("state_first", "state_x", """
SELECT symbol, part, floor_ret, floor_vol, avg(ret) AS mr, avg(vol) AS mv, var_pop(ret) + floor_ret AS vr, var_pop(vol) + floor_vol AS vv FROM (
  SELECT *, ntile(3) OVER (PARTITION BY symbol ORDER BY ret, date) AS part, 1e-3 * greatest(var_pop(ret) OVER (PARTITION BY symbol), 1e-12) AS floor_ret,
    1e-3 * greatest(var_pop(vol) OVER (PARTITION BY symbol), 1e-12) AS floor_vol FROM state_x WHERE n >= 200) GROUP BY 1, 2, 3, 4""")
add_table("state_d", "state_x state_first", """
SELECT *, greatest(d1, d2, d3) AS top, exp(d1 - greatest(d1, d2, d3)) AS e1, exp(d2 - greatest(d1, d2, d3)) AS e2, exp(d3 - greatest(d1, d2, d3)) AS e3 FROM (
  SELECT symbol, date, rn, n, ret, vol, max(CASE WHEN part = 1 THEN d END) AS d1, max(CASE WHEN part = 2 THEN d END) AS d2, max(CASE WHEN part = 3 THEN d END) AS d3 FROM (
    SELECT x.*, part, -0.5 * (ln(2 * pi() * vr) + (ret - mr) * (ret - mr) / vr + ln(2 * pi() * vv) + (vol - mv) * (vol - mv) / vv) AS d FROM state_x x JOIN state_first USING (symbol))
  GROUP BY 1, 2, 3, 4, 5, 6)""")
_T = [[0.9 if i == j else 0.05 for j in range(3)] for i in range(3)]


def _three(text):
    return ", ".join(text(i) for i in range(3))


add_table("state_fwd", "state_d", f"""
SELECT symbol, rn, e1 / (e1 + e2 + e3) AS a1, e2 / (e1 + e2 + e3) AS a2, e3 / (e1 + e2 + e3) AS a3, ln((e1 + e2 + e3) / 3) + top AS score FROM state_d WHERE rn = 1
UNION ALL SELECT symbol, rn, r1 / (r1 + r2 + r3), r2 / (r1 + r2 + r3), r3 / (r1 + r2 + r3), score + ln(r1 + r2 + r3) + top FROM (
  SELECT d.symbol, d.rn, score, top, {_three(lambda j: f"({' + '.join(f'a{i + 1} * {_T[i][j]}::DOUBLE' for i in range(3))}) * e{j + 1} AS r{j + 1}")}
  FROM state_fwd f JOIN state_d d ON d.symbol = f.symbol AND d.rn = f.rn + 1)""", recursive=True)
add_table("state_bwd", "state_d", f"""
SELECT symbol, rn, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2, 1.0::DOUBLE AS b3 FROM state_d WHERE rn = n
UNION ALL SELECT symbol, rn, r1 / greatest(r1, r2, r3), r2 / greatest(r1, r2, r3), r3 / greatest(r1, r2, r3) FROM (
  SELECT d.symbol, d.rn - 1 AS rn, {_three(lambda i: ' + '.join(f"{_T[i][j]}::DOUBLE * e{j + 1} * b{j + 1}" for j in range(3)) + f" AS r{i + 1}")}
  FROM state_bwd b JOIN state_d d ON d.symbol = b.symbol AND d.rn = b.rn WHERE d.rn > 1)""", recursive=True)
_XI = [[f"p.a{i + 1} * {_T[i][j]}::DOUBLE * e{j + 1} * b{j + 1}" for j in range(3)] for i in range(3)]


@query("state_model_round", "R-09", f"""
SELECT symbol, state, {rsql(['score'], 3)}, {rsql(['start', 'mean_ret', 'mean_vol', 'var_ret', 'var_vol', 'to_0', 'to_1', 'to_2'], 7)} FROM (
SELECT g.symbol, part - 1 AS state, g.score, g0 AS start, sr / w AS mean_ret, sv / w AS mean_vol, greatest(qr / w - (sr / w) * (sr / w), 0) + floor_ret AS var_ret,
  greatest(qv / w - (sv / w) * (sv / w), 0) + floor_vol AS var_vol, {_three(lambda j: f"m{j + 1} / (m1 + m2 + m3) AS to_{j}")}
FROM (SELECT symbol, part, sum(g) AS w, sum(g * ret) AS sr, sum(g * vol) AS sv, sum(g * ret * ret) AS qr, sum(g * vol * vol) AS qv, max(CASE WHEN rn = 1 THEN g END) AS g0, max(CASE WHEN rn = n THEN score END) AS score
  FROM (SELECT symbol, rn, n, ret, vol, score, unnest([1, 2, 3]) AS part, unnest([a1 * b1, a2 * b2, a3 * b3]) / (a1 * b1 + a2 * b2 + a3 * b3) AS g
    FROM state_fwd JOIN state_bwd USING (symbol, rn) JOIN state_d USING (symbol, rn)) GROUP BY 1, 2) g
JOIN (SELECT symbol, part, sum(x1 / total) AS m1, sum(x2 / total) AS m2, sum(x3 / total) AS m3 FROM (
    SELECT symbol, total, unnest([1, 2, 3]) AS part, {_three(lambda j: f"unnest([{', '.join(f'x{i + 1}{j + 1}' for i in range(3))}]) AS x{j + 1}")} FROM (
      SELECT d.symbol, {', '.join(f'{_XI[i][j]} AS x{i + 1}{j + 1}' for i in range(3) for j in range(3))}, {' + '.join(_XI[i][j] for i in range(3) for j in range(3))} AS total
      FROM state_d d JOIN state_fwd p ON p.symbol = d.symbol AND p.rn = d.rn - 1 JOIN state_bwd b ON b.symbol = d.symbol AND b.rn = d.rn)) GROUP BY 1, 2) m USING (symbol, part)
JOIN state_first USING (symbol, part))""", "state_fwd state_bwd state_first state_d")
def state_model_round(spark, d):
    """What one round of expectation-maximisation makes of the first models, and the log-likelihood of those."""
    x = HM.features(td.bars(spark, d))
    score, better = SB.one_round(SB.blocks(x), SB.first_models(x))
    per = F.inline(F.array(*[F.struct(
        F.lit(i).alias("state"), F.element_at("start", i + 1).alias("start"), *[F.element_at(a, 2 * i + j + 1).alias(f"{n}_{c}") for a, n in (("mean", "mean"), ("var", "var")) for j, c in enumerate(SB.SERIES)],
        *[F.element_at("trans", 3 * i + j + 1).alias(f"to_{j}") for j in range(3)]) for i in range(3)]))
    out = better.join(score, "symbol").select("symbol", "score", per)
    return out.select("symbol", "state", (F.round("score", 3) + 0.0).alias("score"), *[(F.round(c, 7) + 0.0).alias(c) for c in ("start", "mean_ret", "mean_vol", "var_ret", "var_vol", "to_0", "to_1", "to_2")])


def _move(i, j):
    return f"s{i + 1} + ln({_T[i][j]}::DOUBLE)"


add_table("state_best", "state_d", f"""
SELECT symbol, rn, ln(1 / 3.0::DOUBLE) + d1 AS s1, ln(1 / 3.0::DOUBLE) + d2 AS s2, ln(1 / 3.0::DOUBLE) + d3 AS s3, 0 AS p1, 0 AS p2, 0 AS p3 FROM state_d WHERE rn = 1
UNION ALL SELECT d.symbol, d.rn, {_three(lambda j: f"greatest({_three(lambda i: _move(i, j))}) + d{j + 1}")},
  {_three(lambda j: f"CASE WHEN {_move(0, j)} >= {_move(1, j)} AND {_move(0, j)} >= {_move(2, j)} THEN 0 WHEN {_move(1, j)} >= {_move(2, j)} THEN 1 ELSE 2 END")}
FROM state_best b JOIN state_d d ON d.symbol = b.symbol AND d.rn = b.rn + 1""", recursive=True)
add_table("state_path", "state_best state_d", """
SELECT b.symbol, b.rn, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 0 WHEN s2 >= s3 THEN 1 ELSE 2 END AS state FROM state_best b JOIN state_d d ON d.symbol = b.symbol AND d.rn = b.rn WHERE d.rn = d.n
UNION ALL SELECT p.symbol, p.rn - 1, CASE p.state WHEN 0 THEN p1 WHEN 1 THEN p2 ELSE p3 END FROM state_path p JOIN state_best b ON b.symbol = p.symbol AND b.rn = p.rn WHERE p.rn > 1""", recursive=True)
add_table("state_named", "state_path state_d", """
SELECT symbol, date, rn, n, state, CASE WHEN states = 3 THEN CASE place WHEN 3 THEN 'Trending Up' WHEN 1 THEN 'Declining' ELSE 'Consolidating' END
  WHEN m > 0.001 THEN 'Trending Up' WHEN m < -0.001 THEN 'Declining' ELSE 'Consolidating' END AS state_label
FROM state_path JOIN state_d USING (symbol, rn) JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY m, state) AS place, count(*) OVER (PARTITION BY symbol) AS states
  FROM (SELECT symbol, state, avg(ret) AS m FROM state_path JOIN state_d USING (symbol, rn) GROUP BY 1, 2)) USING (symbol, state)""")


def _named_paths(spark, d):
    x = HM.features(td.bars(spark, d))
    b, m = SB.blocks(x), SB.first_models(x)
    score = SB.weighed(b, m).groupBy("symbol").agg(F.first("score").alias("score"))
    return HM.name_states(SB.state_rows(b, m.join(score, "symbol")))


@query("state_paths", "R-09 R-10 R-11", f"SELECT symbol, {DATE}, state, state_label FROM state_named", "state_named")
def state_paths(spark, d):
    return _named_paths(spark, d).select("symbol", F.col("date").cast("string"), "state", "state_label")


@query("current_states", "R-11 W-09", f"SELECT symbol, state AS current_state, state_label, 3 AS n_states, {rsql(['score'], 3)} FROM state_named JOIN state_fwd USING (symbol, rn) WHERE rn = n", "state_named state_fwd")
def current_states(spark, d):
    return HM.current_states(_named_paths(spark, d)).withColumn("score", F.round("score", 3) + 0.0)


@query("pattern_statistics", "R-12 A-16 J-11")
def pattern_statistics(spark, d):
    n = HM.name_states(HM.fit_states(td.bars(spark, d)))
    return HM.state_statistics(n, ["symbol", "state", "state_label"])


@query("return_statistics_by_cycle", "A-16 R-12 J-11", f"""
SELECT cycle, count(*) AS count, {rsql(['mean_ret', 'vol', 'win_rate', 'sharpe'])} FROM (
SELECT cycle, 1, avg(r) * 100 AS mean_ret, stddev_samp(r) * 100 AS vol, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS win_rate, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, count(*) AS n
FROM (SELECT cycle, close / lag(close) OVER (PARTITION BY scope_id ORDER BY date) - 1 AS r FROM labels WHERE scope = 'stock') WHERE r IS NOT NULL GROUP BY 1) GROUP BY ALL""".replace("count(*) AS count,", "n AS count,"), "labels")
def return_statistics_by_cycle(spark, d):
    lab = R.label_stocks(td.bars(spark, d))
    lab = lab.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(series())) - 1)
    s = HM.state_statistics(lab, ["cycle"])
    return s.select("cycle", "count", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean_ret", "vol", "win_rate", "sharpe")])


# Files and pages

@query("imported_tradebook", "S-08 J-09 F-02 F-03", "SELECT symbol, qty, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date, timeframe FROM closed", "closed")
def imported_tradebook(spark, d):
    t = td.tradebook(spark, d)
    # The file form: text columns, day-first dates, an execution time that follows the trade order.
    raw = t.select(F.lower("symbol").alias("Tradingsymbol"), F.date_format("trade_date", "dd-MM-yyyy").alias("Trade Date"),
                   F.lower("trade_type").alias("Trade Type"), F.col("quantity").cast("string").alias("Quantity"), F.col("price").cast("string").alias("Price"),
                   F.format_string("%012d", "seq.l_orderkey").alias("Order Execution Time"),
                   F.format_string("%02d-%012d-%018.4f-%06.1f", "seq.l_linenumber", "seq.l_partkey", "seq.l_extendedprice", "seq.l_quantity").alias("Trade ID"))
    closed, _ = broker_csv.import_tradebook(raw)
    return closed.select("symbol", "qty", F.col("entry_date").cast("string"), F.col("exit_date").cast("string"), "timeframe")


@query("import_audit", "S-14", "SELECT 'tradebook' AS import_type, 'tradebook.csv' AS filename, count(*) AS rows_imported, 'closed trades' AS notes FROM closed", "closed")
def import_audit(spark, d):
    return import_log(spark, "tradebook", "tradebook.csv", td.closed_trades(spark, d), "closed trades").drop("imported_at")


@query("imported_holdings", "S-07 A-14 F-01 F-02 U-03", "SELECT symbol, CAST(2 * sum(qty) AS BIGINT) AS qty, round(sum(avg_cost * qty) / sum(qty), 4) + 0.0 AS avg_cost FROM holdings GROUP BY 1", "holdings")
def imported_holdings(spark, d):
    h = stored(td.holdings(spark, d).select("symbol", "qty", "avg_cost", "entry_date", "is_active"), "holdings")  # read by both imports and the file
    raw = h.select(F.concat(F.lit(" "), F.lower("symbol")).alias("Stock"), F.format_string("%,d", "qty").alias("Shares"),
                   F.concat(F.lit("₹"), F.col("avg_cost").cast("string")).alias("Average Cost"))
    held = h.select("symbol", F.lit("long_term").alias("timeframe"), "qty", "avg_cost", "entry_date", "is_active")
    once = stored(broker_csv.import_holdings(held, raw, "long_term", td.AS_OF, "file-1"), "holdings-once")
    out = broker_csv.import_holdings(once, raw, "long_term", td.AS_OF, "file-1")  # the same file again adds nothing
    return out.select("symbol", "qty", (F.round("avg_cost", 4) + 0.0).alias("avg_cost"))


@query("holdings_file_check", "S-09", "SELECT FALSE AS valid, 'Avg cost' AS missing_cols, count(*) AS row_count FROM holdings", "holdings")
def holdings_file_check(spark, d):
    raw = td.holdings(spark, d).select(F.col("symbol").alias(" Scrip "), F.col("qty").cast("string").alias("Holding Qty"))
    return broker_csv.validation_report(raw)


@query("page_titles", "S-10", """
SELECT page_id, replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, len(regexp_extract_all(html, '<a [^>]*href="')) AS links FROM pages""")
def page_titles(spark, d):
    return html_fields.titles_and_links(td.table(spark, d, "pages")).select("page_id", F.trim("title").alias("title"), "links")


@query("page_fundamentals", "S-10 F-02", """
SELECT page_id, CAST(page_id % 90 + 5 AS DOUBLE) AS pe_ratio, CAST(page_id % 7 + 1 AS DOUBLE) AS pb_ratio, CAST(1000 + page_id AS DOUBLE) AS revenue_cr,
  round((CAST(1000 + page_id AS DOUBLE) / (900 + page_id) - 1) * 100, 6) + 0.0 AS revenue_growth, CAST(page_id % 60 AS DOUBLE) + 0.5 AS promoter_holding FROM pages""")
def page_fundamentals(spark, d):
    # The driver's pages carry no ratio tables, so each page gets one derived from its id.
    pid = F.col("page_id")
    extra = F.concat(
        F.lit('<ul id="top-ratios"><li><span class="name">Stock P/E</span><span class="value">₹'), (pid % 90 + 5).cast("string"),
        F.lit('</span></li><li><span class="name">Price to book value</span><span class="value">'), (pid % 7 + 1).cast("string"),
        F.lit('</span></li></ul><section id="profit-loss"><table><tr><td>Sales</td><td>'), F.format_number(900 + pid, 0),
        F.lit("</td><td>"), F.format_number(1000 + pid, 0),
        F.lit('</td></tr></table></section><section id="shareholding"><table><tbody><tr><td>Promoters</td><td>'),
        (pid % 60).cast("string"), F.lit(".5%</td></tr></tbody></table></section>"))
    pages = td.table(spark, d, "pages").withColumn("html", F.concat("html", extra))
    f = html_fields.fundamentals(pages)
    return f.select("page_id", "pe_ratio", "pb_ratio", "revenue_cr", (F.round("revenue_growth", 6) + 0.0).alias("revenue_growth"), "promoter_holding")


# Reports

def stored_log(spark, d, of=None):
    """The signal log, stored: several sections of a report read it, and it is at most a few rows a symbol."""
    return stored(signal_log(spark, d, of=of), "signals")


@query("eod_report", "Z-01 A-18 A-19")
def eod_report(spark, d):
    b = td.stored_bars(spark, d)
    return reports.lines(reports.eod_report(cycles(spark, d, b), stored_log(spark, d, b), n=10))


@query("eod_sections", "Z-01 A-18 A-19", """
SELECT 'regime' AS part, scope AS name, cycle AS value FROM regime WHERE scope = 'market'
UNION ALL SELECT 'sectors', cycle, string_agg(scope_id, ',' ORDER BY scope_id) FROM regime WHERE scope = 'sector' GROUP BY cycle
UNION ALL SELECT 'counts', timeframe, CAST(count(*) AS VARCHAR) FROM sig_log GROUP BY timeframe
UNION ALL SELECT 'top', symbol || '/' || timeframe, strategy_id FROM (SELECT * FROM sig_log QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY seq DESC) = 1)""", "regime sig_log")
def eod_sections(spark, d):
    """All sections of the end-of-day report as rows: the market's cycle, the sectors of each cycle, buy signals by timeframe, and the watch list."""
    b = td.stored_bars(spark, d)
    r = reports.eod_report(cycles(spark, d, b), stored_log(spark, d, b))
    parts = {"regime": ("scope", "cycle"), "sectors": ("cycle", "names"), "counts": ("timeframe", "buy"), "top": (F.concat_ws("/", "symbol", "timeframe"), "strategy_id")}
    out = None
    for part, (name, value) in parts.items():
        one = r[part].select(F.lit(part).alias("part"), (F.col(name) if isinstance(name, str) else name).alias("name"), F.col(value).cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("morning_report", "Z-02 H-05 W-15")
def morning_report(spark, d):
    return reports.lines(reports.morning_report(td.bars_raw(spark, d), td.positions(spark, d), stored_log(spark, d), n=5, tracked_limit=20))

