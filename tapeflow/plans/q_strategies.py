"""Queries over rules, replay, metrics and the strategy catalogue."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeflow.functions.rules import Panel, condition, explain_rules
from tapeflow.operators import replay as P
from tapeflow.operators import strategies as ST
from tapeflow.operators import sweep as SW
from tapeflow.plans import fixture_sql, rule_sql
from tapeflow.plans.fixture_sql import add_table
from tapeflow.plans.q_indicators import DATE, rsql
from tapeflow.params import DEFAULTS
from tapeflow.plans.registry import query
from tapeflow.session import stored
from tapeflow.sources import testdata as td

DOCS = ST.STRATEGIES

add_table("panel0", "ind rs labels stocks bars", """
SELECT i.*, lag(i.close) OVER w AS prev_close, i.close / lag(i.close, 252) OVER w - 1 AS r_252, rs.rs_nifty200, s.sector, l.cycle,
  CASE WHEN i.rn >= 10 THEN -100 * (max(i.high) OVER r10 - i.close) / (max(i.high) OVER r10 - min(i.low) OVER r10) END AS williams_r_10
FROM ind i JOIN rs ON rs.symbol = i.symbol AND rs.date = i.date JOIN stocks s ON s.symbol = i.symbol
JOIN labels l ON l.scope = 'stock' AND l.scope_id = i.symbol AND l.date = i.date
WINDOW w AS (PARTITION BY i.symbol ORDER BY i.date), r10 AS (PARTITION BY i.symbol ORDER BY i.date ROWS 9 PRECEDING)""")
add_table("panel1", "panel0 labels fundamentals", """
SELECT p.*, coalesce(l.cycle, 'neutral') AS sector_cycle, f.pe_ratio, f.roe, f.revenue_growth,
  CAST(NULL AS DOUBLE) AS williams_r_10_past, CAST(NULL AS DOUBLE) AS days_since_r100,
  CASE WHEN rs_nifty200 IS NOT NULL THEN percent_rank() OVER (PARTITION BY p.date, p.sector, rs_nifty200 IS NULL ORDER BY rs_nifty200) * 100 END AS rs_percentile
FROM panel0 p LEFT JOIN (SELECT scope_id, date, cycle FROM labels WHERE scope = 'sector') l ON l.scope_id = p.sector AND l.date = p.date
ASOF LEFT JOIN fundamentals f ON f.symbol = p.symbol AND p.date >= f.period_end""")
add_table("panel", "panel1", """
SELECT *, coalesce(pe_ratio, 20) / coalesce(avg(pe_ratio) OVER (PARTITION BY date, sector), 20) AS pe_vs_sector FROM panel1""")
add_table("sigs", "panel", "SELECT * FROM (" + rule_sql.signal_rows(DOCS) + ")")
add_table("walked", "sigs", """
SELECT strategy_id, symbol, rn, date, close, cycle, FALSE AS open_, CAST(NULL AS DOUBLE) AS bought, CAST(NULL AS DOUBLE) AS stop,
  CAST(NULL AS DOUBLE) AS target, CAST(NULL AS DATE) AS entry_date, CAST(NULL AS VARCHAR) AS why, CAST(NULL AS DOUBLE) AS level, CAST(NULL AS DOUBLE) AS x_bought, CAST(NULL AS DATE) AS x_entry
FROM sigs WHERE rn = 50
UNION ALL
SELECT strategy_id, symbol, rn, date, close, cycle,
  CASE WHEN was_open THEN why IS NULL ELSE entry END,
  CASE WHEN was_open THEN CASE WHEN why IS NULL THEN bought END WHEN entry THEN close * CAST(1.001 AS DOUBLE) END,
  CASE WHEN was_open THEN CASE WHEN why IS NULL THEN CASE WHEN trail IS NULL THEN old_stop ELSE greatest(old_stop, close * (1 - trail)) END END WHEN entry THEN new_stop END,
  CASE WHEN was_open THEN CASE WHEN why IS NULL THEN old_target END WHEN entry THEN new_target END,
  CASE WHEN was_open THEN CASE WHEN why IS NULL THEN entry_date END WHEN entry THEN date END,
  why, CASE why WHEN 'stop_loss' THEN old_stop WHEN 'target' THEN old_target WHEN 'signal' THEN close END, bought, entry_date
FROM (
  SELECT s.strategy_id, s.symbol, s.rn, s.date, s.close, s.cycle, s.entry, s.trail, s.stop AS new_stop, s.target AS new_target,
    w.open_ AS was_open, w.bought, w.stop AS old_stop, w.target AS old_target, w.entry_date,
    CASE WHEN w.open_ THEN CASE WHEN s.close <= w.stop THEN 'stop_loss' WHEN s.close >= w.target THEN 'target' WHEN s.exit THEN 'signal' END END AS why
  FROM walked w JOIN sigs s ON s.strategy_id = w.strategy_id AND s.symbol = w.symbol AND s.rn = w.rn + 1)""", recursive=True)
add_table("trades", "walked", """
SELECT strategy_id, symbol, x_entry AS entry_date, date AS exit_date, x_bought AS entry_price, level * CAST(0.999 AS DOUBLE) AS exit_price,
  (level * CAST(0.999 AS DOUBLE) - x_bought) / x_bought * 100 AS pnl_pct,
  (level * CAST(0.999 AS DOUBLE) - x_bought) * (2000 / x_bought) - 40 AS pnl_inr,
  date_diff('day', x_entry, date) AS holding_days, why AS exit_reason, cycle
FROM walked WHERE why IS NOT NULL""")


def panel(spark, d, of=None, **some):
    b, st = td.stored_bars(spark, d) if of is None else of, td.stocks(spark, d)
    sectors = stored(td.sector_index(spark, d, b), "sector-index")
    return P.rule_panel(b, td.market_index(spark, d, b), st, sectors, td.fundamentals(spark, d), **some)


def trades(spark, d, docs=DOCS, **some):
    return P.backtest(panel(spark, d, **some), docs, whole=True)


@query("rule_panel", "P-11 J-01 I-24 J-17", f"""
SELECT symbol, {DATE}, cycle, sector, sector_cycle, {rsql(['prev_close', 'r_252', 'rs_nifty200', 'rs_percentile', 'roe', 'williams_r_10', 'macd_hist', 'supertrend'])}, {rsql(['pe_vs_sector'], 8)}
FROM panel""", "panel")
def rule_panel(spark, d):
    p = panel(spark, d)
    cols = ("prev_close", "r_252", "rs_nifty200", "rs_percentile", "roe", "williams_r_10", "macd_hist", "supertrend")
    return p.select("symbol", F.col("date").cast("string"), "cycle", "sector", "sector_cycle", *[(F.round(c, 4) + 0.0).alias(c) for c in cols],
                    (F.round("pe_vs_sector", 8) + 0.0).alias("pe_vs_sector"))


@query("rule_signals", "P-05 P-06 P-07 P-08 P-09 P-10 P-11 T-01 T-02 J-12", """
SELECT strategy_id, symbol, CAST(date AS VARCHAR) AS date, entry, exit, CASE WHEN entry THEN stop END AS stop, CASE WHEN entry THEN target END AS target
FROM sigs WHERE entry OR exit""", "sigs")
def rule_signals(spark, d):
    s = P.signal_columns(panel(spark, d), DOCS)
    rows = F.array(*[F.struct(F.lit(doc["strategy_id"]).alias("strategy_id"), F.col(f"entry_{i}").alias("entry"), F.col(f"exit_{i}").alias("exit"),
                              F.col(f"stop_{i}").alias("stop"), F.col(f"target_{i}").alias("target")) for i, doc in enumerate(DOCS)])
    return (s.select("symbol", F.col("date").cast("string").alias("date"), F.explode(rows).alias("r"))
            .select("symbol", "date", "r.*").filter("entry or exit"))


@query("crossing_conditions", "P-07 P-08 P-09", f"""
SELECT symbol, {DATE}, {rule_sql.condition(DOCS[0]['entry_rules']['conditions'][0])} AS ema_up,
  {rule_sql.condition(DOCS[1]['entry_rules']['conditions'][0])} AS st_up,
  {rule_sql.condition(DOCS[7]['entry_rules']['conditions'][0])} AS divergence,
  {rule_sql.condition(DOCS[8]['entry_rules']['conditions'][0])} AS squeeze
FROM (SELECT i.*, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM ind i) WINDOW w AS (PARTITION BY symbol ORDER BY date)""", "ind")
def crossing_conditions(spark, d):
    from tapeflow.operators.indicators import indicators
    x = indicators(td.bars(spark, d))
    ctx = Panel.of(x)
    pick = {"ema_up": DOCS[0], "st_up": DOCS[1], "divergence": DOCS[7], "squeeze": DOCS[8]}
    return x.select("symbol", F.col("date").cast("string").alias("date"),
                    *[condition(doc["entry_rules"]["conditions"][0], ctx).alias(n) for n, doc in pick.items()])


@query("strategy_trades", "T-03 T-04 T-06 J-12", f"""
SELECT strategy_id, symbol, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date, exit_reason, cycle,
  CAST(holding_days AS INTEGER) AS holding_days, {rsql(['entry_price', 'exit_price', 'pnl_pct', 'pnl_inr'], 6)} FROM trades""", "trades")
def strategy_trades(spark, d):
    t = trades(spark, d)
    return t.select("strategy_id", "symbol", F.col("entry_date").cast("string"), F.col("exit_date").cast("string"), "exit_reason", "cycle", "holding_days",
                    *[(F.round(c, 6) + 0.0).alias(c) for c in ("entry_price", "exit_price", "pnl_pct", "pnl_inr")])


METRIC_SQL = """
SELECT strategy_id, symbol, count(*) AS total_trades, count(*) FILTER (pnl_pct > 0) AS winning_trades, count(*) FILTER (pnl_pct <= 0) AS losing_trades,
  count(*) FILTER (pnl_pct > 0) / count(*) AS win_rate,
  coalesce(avg(pnl_pct) / nullif(stddev_pop(pnl_pct), 0) * sqrt(252), 0) AS sharpe_ratio,
  coalesce(avg(pnl_pct) / nullif(coalesce(stddev_pop(pnl_pct) FILTER (pnl_pct < 0), CAST(1e-9 AS DOUBLE)), 0) * sqrt(252), 0) AS sortino_ratio,
  max((peak - eq) / peak) * 100 AS max_drawdown,
  CASE WHEN sum(greatest(-pnl_inr, 0)) > 0 THEN sum(greatest(pnl_inr, 0)) / sum(greatest(-pnl_inr, 0)) ELSE sum(greatest(pnl_inr, 0)) END AS profit_factor,
  sum(pnl_inr) / 100000 * 100 AS total_return, coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0) AS avg_win_pct,
  coalesce(avg(pnl_pct) FILTER (pnl_pct <= 0), 0) AS avg_loss_pct, avg(pnl_pct) AS expectancy
FROM (SELECT *, max(eq) OVER (PARTITION BY strategy_id, symbol ORDER BY exit_date ROWS UNBOUNDED PRECEDING) AS peak
      FROM (SELECT *, 100000 + sum(pnl_inr) OVER (PARTITION BY strategy_id, symbol ORDER BY exit_date ROWS UNBOUNDED PRECEDING) AS eq FROM trades))
GROUP BY 1, 2"""
add_table("metrics_all", "trades", METRIC_SQL)
METRICS = ["win_rate", "sharpe_ratio", "sortino_ratio", "max_drawdown", "profit_factor", "total_return", "avg_win_pct", "avg_loss_pct", "expectancy"]


def metric_select(df):
    return df.select("strategy_id", "symbol", "total_trades", "winning_trades", "losing_trades",
                     *[(F.col(c) + 0.0).alias(c) for c in METRICS], "passes_gates")


@query("trade_metrics", "A-01 A-02 A-03 P-13", f"""
SELECT strategy_id, symbol, total_trades, winning_trades, losing_trades, {', '.join(f'round_even({c}, 4) + 0.0 AS {c}' for c in METRICS)},
  sharpe_ratio >= 1.0 AND win_rate >= 0.52 AND total_trades >= 50 AS passes_gates
FROM metrics_all WHERE total_trades >= 5""", "metrics_all")
def trade_metrics(spark, d):
    return metric_select(P.trade_metrics(trades(spark, d), min_trades=5))


@query("cycle_breakdown", "A-04", f"""
SELECT strategy_id, symbol, cycle, count(*) AS n_trades, round_even(count(*) FILTER (pnl_pct > 0) / count(*), 4) + 0.0 AS win_rate,
  round_even(avg(pnl_pct), 4) + 0.0 AS avg_return,
  CASE WHEN count(*) = 1 THEN round(avg(pnl_pct) / 1e-9 * sqrt(252) / 1e7, 3)
    ELSE round_even(avg(pnl_pct) / CASE WHEN stddev_pop(pnl_pct) = 0 THEN 1e-9 ELSE stddev_pop(pnl_pct) END * sqrt(252), 4) END + 0.0 AS sharpe FROM trades GROUP BY 1, 2, 3""", "trades")
def cycle_breakdown(spark, d):
    b = P.cycle_breakdown(trades(spark, d))
    return b.select("strategy_id", "symbol", "cycle", "n_trades", *[(F.col(c) + 0.0).alias(c) for c in ("win_rate", "avg_return")],
                    # The ratio of a single trade divides by 1e-9; it is shown in units of 1e7.
                    (F.when(F.col("n_trades") == 1, F.round(F.col("sharpe") / 1e7, 3)).otherwise(F.col("sharpe")) + 0.0).alias("sharpe"))


@query("strategy_rollup", "A-05 T-05 J-12", """
SELECT s.strategy_id, count(m.symbol) AS ok, (SELECT count(*) FROM stocks) - count(m.symbol) AS failed, round(coalesce(avg(m.sharpe_ratio), 0), 3) + 0.0 AS avg_sharpe,
  round(coalesce(avg(m.win_rate), 0), 3) + 0.0 AS avg_win_rate,
  coalesce(avg(m.sharpe_ratio), 0) >= 1.0 AND coalesce(avg(m.win_rate), 0) >= 0.52 AS is_active
FROM (VALUES """ + ", ".join(f"('{s['strategy_id']}')" for s in DOCS) + """) s(strategy_id)
LEFT JOIN (SELECT * FROM metrics_all WHERE total_trades >= 5) m ON m.strategy_id = s.strategy_id GROUP BY 1""", "metrics_all stocks")
def strategy_rollup(spark, d):
    n = td.stocks(spark, d).agg(F.count(F.lit(1)).alias("symbols"))
    attempted = ST.catalog(spark).select("strategy_id").crossJoin(F.broadcast(n))
    r = P.strategy_rollup(P.trade_metrics(trades(spark, d), min_trades=5), attempted)
    return r.select("strategy_id", "ok", "failed", *[(F.round(c, 3) + 0.0).alias(c) for c in ("avg_sharpe", "avg_win_rate")], "is_active")


RUN_ID = "substr(sha256(strategy_id || '|' || symbol || '|1995-01-01|" + td.AS_OF + "'), 1, 12) AS run_id"


@query("backtest_results", "F-05 F-06 T-07 S-05", f"""
SELECT strategy_id, symbol, {RUN_ID}, CASE strategy_id {' '.join(f"WHEN '{s['strategy_id']}' THEN '{s['timeframes'][0]}'" for s in DOCS)} END AS timeframe, total_trades,
  {', '.join(f'round_even({c}, 4) + 0.0 AS {c}' for c in METRICS)} FROM metrics_all WHERE total_trades >= {DEFAULTS.min_trades}""", "metrics_all")
def backtest_results(spark, d):
    r = P.explore(P.result_rows(trades(spark, d), DOCS, "1995-01-01", td.AS_OF))
    return r.select("strategy_id", "symbol", "run_id", "timeframe", "total_trades", *[(F.col(c) + 0.0).alias(c) for c in METRICS])


@query("backtest_trade_log", "W-12 F-05", f"""
SELECT strategy_id, symbol, {RUN_ID}, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date, exit_reason FROM trades
QUALIFY row_number() OVER (PARTITION BY strategy_id, symbol ORDER BY exit_date DESC, entry_date DESC) <= 500""", "trades")
def backtest_trade_log(spark, d):
    log = P.trade_log(trades(spark, d), "1995-01-01", td.AS_OF, n=500)
    return log.select("strategy_id", "symbol", "run_id", F.col("entry_date").cast("string"), F.col("exit_date").cast("string"), "exit_reason")


@query("best_backtests", "T-07 O-01 O-02", f"""
SELECT strategy_id, symbol, total_trades, sh + 0.0 AS sharpe_ratio FROM (
  SELECT *, round_even(sharpe_ratio, 4) AS sh FROM metrics_all WHERE total_trades >= 5 AND round_even(sharpe_ratio, 4) >= 0.5)
ORDER BY sh DESC NULLS LAST, strategy_id, symbol LIMIT 200""", "metrics_all")
def best_backtests(spark, d):
    m = P.trade_metrics(trades(spark, d), min_trades=5)
    return P.explore(m, min_sharpe=0.5, limit=200).select("strategy_id", "symbol", "total_trades", (F.col("sharpe_ratio") + 0.0).alias("sharpe_ratio"))


@query("sampled_backtest", "T-06 O-03", f"""
SELECT strategy_id, symbol, total_trades, winning_trades, losing_trades, {', '.join(f'round_even({c}, 4) + 0.0 AS {c}' for c in METRICS)},
  sharpe_ratio >= 1.0 AND win_rate >= 0.52 AND total_trades >= 50 AS passes_gates
FROM metrics_all WHERE total_trades >= 5 AND symbol IN (SELECT symbol FROM (SELECT DISTINCT symbol FROM stocks) ORDER BY md5('42|' || symbol), symbol LIMIT 30)""", "metrics_all stocks")
def sampled_backtest(spark, d):
    from tapeflow.sources.universe import sample_symbols
    pick = sample_symbols(td.stocks(spark, d), 30)
    return metric_select(P.trade_metrics(trades(spark, d, only=pick), min_trades=5))


@query("rule_explanations", "P-12 K-03", """
SELECT symbol, rule_num, passed, CASE WHEN actual IS NULL THEN indicator || ' missing'
   ELSE format('{}={:.2f} {} {} → {}', indicator, actual, op, ref, CASE WHEN passed THEN '✓' ELSE '✗' END) END AS reason
FROM (
  SELECT symbol, 1 AS rule_num, 'rsi_14' AS indicator, rsi_14 AS actual, '<=' AS op, '35' AS ref, coalesce(rsi_14 <= 35, FALSE) AS passed FROM last_ind
  UNION ALL SELECT symbol, 2, 'bb_pct_b', bb_pct_b, '<=', '0.1', coalesce(bb_pct_b <= 0.1, FALSE) FROM last_ind
  UNION ALL SELECT symbol, 3, 'close', close, '>', format('bb_lower={:.2f}', bb_lower), coalesce(close > bb_lower, FALSE) FROM last_ind
  UNION ALL SELECT symbol, 4, 'volume_ratio', volume_ratio, '>=', '1.0', coalesce(volume_ratio >= 1.0, FALSE) FROM last_ind)""", "last_ind")
def rule_explanations(spark, d):
    from tapeflow.functions.windows import latest
    from tapeflow.operators.indicators import indicators
    x = indicators(td.bars(spark, d))
    x = x.withColumn("checks", explain_rules(DOCS[2]["entry_rules"], Panel.of(x)))
    return (latest(x.select("symbol", "date", "checks"), ["symbol"], "date").select("symbol", F.explode("checks").alias("c"))
            .select("symbol", "c.rule_num", "c.passed", "c.reason"))


add_table("last_ind", "ind", "SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")


@query("next_generations", "T-10", """
SELECT t AS template, coalesce(max(CASE WHEN p_partkey % 3 = 0 AND 'T' || (p_partkey % 5) = t THEN p_size END), 0) + 1 AS generation
FROM part, (SELECT unnest(['T0', 'T1', 'T2', 'T3', 'T4', 'T5']) AS t) GROUP BY 1""")
def next_generations(spark, d):
    # A table of discovered strategies from the parts: origin, name and generation of each.
    k = F.col("p_partkey")
    found = td.table(spark, d, "part").select(
        F.when(k % 3 == 0, "genetic").otherwise("seed").alias("discovered_by"), F.concat(F.lit("T"), (k % 5).cast("string"), F.lit(" variant "), k.cast("string")).alias("name"),
        F.col("p_size").alias("generation"))
    out = None
    for t in ("T0", "T1", "T2", "T3", "T4", "T5"):
        one = ST.next_generation(found, t).select(F.lit(t).alias("template"), "generation")
        out = one if out is None else out.unionByName(one)
    return out


@query("active_strategies", "S-12 T-09 P-14", "SELECT c.strategy_id, c.name, c.type, count(holding_id) AS positions, coalesce(sum(qty), 0)::BIGINT AS shares FROM (VALUES " + ", ".join(
    f"('{s['strategy_id']}', '{s['name']}', '{s['type']}')" for s in DOCS if "swing" in s["timeframes"]) + """) c(strategy_id, name, type)
LEFT JOIN positions p ON p.strategy_id = c.strategy_id GROUP BY 1, 2, 3""", "positions")
def active_strategies(spark, d):
    """Active swing strategies of the catalogue with what is held by their rules."""
    c = ST.find(ST.catalog(spark), active_only=True, timeframe="swing").select("strategy_id", "name", "type")
    held = td.positions(spark, d).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("positions"), F.sum("qty").cast("bigint").alias("shares"))
    return c.join(held, "strategy_id", "left").fillna(0, ["positions", "shares"])


def variant_catalog(spark, d):
    """A catalogue with a variant for each part: nested rules as JSON text, their values drawn from the part."""
    size = F.col("p_size")
    return td.table(spark, d, "part").select(
        F.concat(F.lit("V"), "p_partkey").alias("strategy_id"), F.concat_ws("_", F.lit("Turtle"), F.lower("p_type"), F.col("p_partkey").cast("string")).alias("name"),
        F.lower("p_type").alias("type"), F.when(size % 2 == 0, '["swing", "medium"]').otherwise('["intraday"]').alias("timeframes"), F.lit('["bull"]').alias("best_cycles"),
        F.format_string('{"logic": "AND", "conditions": [{"indicator": "rsi_14", "op": "<=", "value": %d}, {"indicator": "adx_14", "op": ">", "value": %d}]}', size, size % 7).alias("entry_rules"),
        F.lit('{"logic": "OR", "conditions": []}').alias("exit_rules"), F.format_string('{"type": "atr_based", "multiplier": %.1f}', size / F.lit(10.0)).alias("stoploss_rules"),
        F.format_string('{"atr_target_mult": %.2f}', size / F.lit(4.0)).alias("parameters"), F.lit("genetic").alias("discovered_by"), (size % 11).alias("generation"), (F.col("p_partkey") % 3 != 0).alias("is_active"))


@query("catalogue_lookup", "S-12 T-09", """
SELECT 'V' || p_partkey AS strategy_id, lower(p_type) AS type, CAST(p_size AS VARCHAR) AS rsi_limit, CAST(p_size % 7 AS VARCHAR) AS adx_limit, round(p_size / 10.0, 1)::DOUBLE AS multiplier, p_size / 4.0::DOUBLE AS target_mult
FROM part WHERE p_partkey % 3 <> 0 AND p_size % 2 = 0 AND lower(p_type) = 'economy'""")
def catalogue_lookup(spark, d):
    """Active swing strategies of one type, with the values of their parsed rules."""
    c = ST.parsed(ST.find(variant_catalog(spark, d), active_only=True, type_="economy", timeframe="swing"))
    limit = [F.element_at(F.col("entry_rules.conditions"), i)["value"].cast("string") for i in (1, 2)]
    return c.select("strategy_id", "type", limit[0].alias("rsi_limit"), limit[1].alias("adx_limit"), F.col("stop.multiplier").alias("multiplier"), "target_mult")


@query("next_variant", "T-10 T-09", """
SELECT lower(p_type) AS type, max(p_size % 11) + 1 AS generation FROM part GROUP BY 1""")
def next_variant(spark, d):
    """The next generation of each type's discovered variants."""
    c = variant_catalog(spark, d)
    own = (F.col("discovered_by") == "genetic") & F.col("name").startswith("Turtle")
    return c.groupBy("type").agg((F.coalesce(F.max(F.when(own, F.col("generation"))), F.lit(0)) + 1).alias("generation"))


POINT = ["(p_size % 9) * 0.1", "(p_partkey % 13) * 0.15", "(p_partkey % 7) * 0.1", "length(p_name) * 0.5", "(p_size % 4) * 0.25"]


@query("spread_points", "J-16", f"""
SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, [{', '.join(f'CAST({c} AS DOUBLE)' for c in POINT)}] AS v FROM part) a
WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r2, [{', '.join(f'CAST({c} AS DOUBLE)' for c in POINT)}] AS u FROM part) b
  WHERE brand = p_brand AND r2 < rn AND {' AND '.join(f'abs(v[{i + 1}] - u[{i + 1}]) < 0.2' for i in range(len(POINT)))})""")
def spread_points(spark, d):
    """The parts of a brand as parameter points, without those near one with a smaller key."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = td.table(spark, d, "part").select("p_partkey", "p_brand", F.array(*[F.expr(f"cast({c} as double)") for c in POINT]).alias("point"), rank.alias("rank"))
    return SW.without_near_duplicates(rows.withColumn("template", F.col("p_brand"))).select("p_partkey", "p_brand")


def _drawn(per_template: int, seed: int = 42) -> list[dict]:
    """The documents of the candidates that ``sweep.candidates`` draws, for SQL text."""
    out, by_name = [], {s["name"]: s for s in DOCS}
    for t, space in SW.PARAMETER_SPACES.items():
        seen = set()
        for k in range(1, per_template + 1):
            params = {}
            for n, lo, hi, step in space:
                draw = int(hashlib.md5(f"{seed}-{t}-{n}-{k}".encode()).hexdigest()[:8], 16)
                params[n] = round(lo + draw % (int(round((hi - lo) / step)) + 1) * step, 4)
            if tuple(params.values()) not in seen:
                seen.add(tuple(params.values()))
                out.append(SW.build(by_name[t], params, f"{t}#{k:03d}"))
    return out


SWEPT = 3
add_table("sweep_sigs", "panel", "SELECT * FROM (" + rule_sql.signal_rows(_drawn(SWEPT)) + ")")
add_table("sweep_walked", "sweep_sigs", fixture_sql.TABLES["walked"][1].replace("walked", "sweep_walked").replace("FROM sigs", "FROM sweep_sigs").replace("JOIN sigs", "JOIN sweep_sigs"), recursive=True)
add_table("sweep_trades", "sweep_walked", fixture_sql.TABLES["trades"][1].replace("walked", "sweep_walked"))
add_table("sweep_metrics", "sweep_trades", METRIC_SQL.replace("FROM trades", "FROM sweep_trades"))


@query("sweep_fitness", "T-08 P-13", f"""
SELECT strategy_id AS candidate_id, round(avg(round_even(sharpe_ratio, 4)), 3) + 0.0 AS sharpe, round(avg(round_even(win_rate, 4)), 3) + 0.0 AS win_rate, CAST(sum(total_trades) AS BIGINT) AS n_trades,
  avg(round_even(sharpe_ratio, 4)) >= {DEFAULTS.gate_sharpe} AND avg(round_even(win_rate, 4)) >= {DEFAULTS.gate_win_rate} AND sum(total_trades) >= {DEFAULTS.gate_min_trades} AS passes
FROM sweep_metrics WHERE total_trades >= 5 GROUP BY 1""", "sweep_metrics")
def sweep_fitness(spark, d):
    """Fitness and gates of a few candidates of each template over all symbols."""
    f = SW.fitness(panel(spark, d), SW.candidates(spark, SWEPT), 5, whole=True)
    return f.select("candidate_id", *[(F.round(c, 3) + 0.0).alias(c) for c in ("sharpe", "win_rate")], "n_trades",
                    ((F.col("sharpe") >= DEFAULTS.gate_sharpe) & (F.col("win_rate") >= DEFAULTS.gate_win_rate) & (F.col("n_trades") >= DEFAULTS.gate_min_trades)).alias("passes"))


@query("parameter_sweep", "T-08 J-16 P-13")
def parameter_sweep(spark, d):
    p = panel(spark, d)
    cand = SW.candidates(spark)
    return SW.evaluate(p, cand, min_symbol_trades=5, whole=True)

