"""Queries over positions, profit, tax, sizing, reviews, actions and triggers."""

from pyspark.sql import functions as F

from tapeflow.operators import actions as A
from tapeflow.operators import portfolio as PF
from tapeflow.operators import regimes as R
from tapeflow.operators import sizing as SZ
from tapeflow.operators import strategies as ST
from tapeflow.operators import triggers as TR
from tapeflow.functions import scalars as SC
from tapeflow.plans import rule_sql
from tapeflow.plans.fixture_sql import add_table
from tapeflow.plans.q_indicators import DATE
from tapeflow.plans.q_regimes import cycles
from tapeflow.plans.registry import query
from tapeflow.sources import testdata as td

AS_OF = td.AS_OF
NOW = f"DATE '{AS_OF}'"
TFS = "(VALUES ('intraday'), ('swing'), ('medium'), ('long_term')) t(timeframe)"


def r(cols, n=2):
    return [(F.round(c, n) + 0.0).alias(c) for c in cols]


add_table("priced", "positions last_price", """
SELECT p.*, coalesce(l.price, p.avg_cost) AS current, (coalesce(l.price, p.avg_cost) / p.avg_cost - 1) * 100 AS pnl_pct
FROM positions p LEFT JOIN last_price l ON l.symbol = p.symbol WHERE p.is_active""")


@query("booked_pnl", "A-06", f"""
SELECT timeframe, round(coalesce(sum(booked_pnl), 0), 0) + 0.0 AS booked_pnl FROM {TFS} LEFT JOIN closed USING (timeframe) GROUP BY 1""", "closed")
def booked_pnl(spark, d):
    return PF.booked_pnl(td.closed_trades(spark, d)).select("timeframe", *r(["booked_pnl"], 0))


@query("notional_pnl", "A-07 J-15", f"""
SELECT timeframe, round(coalesce(sum((current - avg_cost) * qty), 0), 3) + 0.0 AS notional_pnl, count(holding_id) AS open_positions,
  round(coalesce(sum(avg_cost * qty), 0), 3) + 0.0 AS invested FROM {TFS} LEFT JOIN priced USING (timeframe) GROUP BY 1""", "priced")
def notional_pnl(spark, d):
    n = PF.notional_pnl(td.positions(spark, d), PF.latest_prices(td.bars(spark, d)))
    return n.select("timeframe", *r(["notional_pnl", "invested"], 3), "open_positions")


add_table("summary", "closed priced", f"""
SELECT coalesce(timeframe, 'total') AS timeframe, sum(b) AS booked, sum(n) AS notional, CAST(sum(c) AS BIGINT) AS open_positions, sum(i) AS invested
FROM (SELECT t.timeframe, coalesce((SELECT sum(booked_pnl) FROM closed c WHERE c.timeframe = t.timeframe), 0) AS b,
        coalesce((SELECT sum((current - avg_cost) * qty) FROM priced p WHERE p.timeframe = t.timeframe), 0) AS n,
        (SELECT count(*) FROM priced p WHERE p.timeframe = t.timeframe) AS c,
        coalesce((SELECT sum(avg_cost * qty) FROM priced p WHERE p.timeframe = t.timeframe), 0) AS i FROM {TFS})
GROUP BY ROLLUP (timeframe)""")


@query("pnl_summary", "A-08", """
SELECT timeframe, round(booked, 0) + 0.0 AS booked_pnl, round_even(notional, 2) + 0.0 AS notional_pnl, round(booked + notional, 0) + 0.0 AS total_pnl,
  open_positions, round_even(invested, 2) + 0.0 AS invested, CASE WHEN timeframe = 'total' THEN round_even((booked + notional) / 2500000 * 100, 2) END AS total_pnl_pct,
  CASE WHEN timeframe = 'total' THEN round_even(2500000 - invested, 2) END AS cash_available,
  CASE WHEN timeframe = 'total' THEN round_even(invested / 2500000 * 100, 2) END AS capital_utilisation FROM summary""", "summary")
def pnl_summary(spark, d):
    s = PF.pnl_summary(td.closed_trades(spark, d), td.positions(spark, d), PF.latest_prices(td.bars(spark, d)))
    return s.select("timeframe", *r(["booked_pnl", "total_pnl"], 0), "notional_pnl", "open_positions", "invested",
                    "total_pnl_pct", "cash_available", "capital_utilisation")


@query("pnl_snapshot", "A-09 H-15", """
SELECT '2001-11-04' AS snapshot_date, timeframe, round(booked, 0) + 0.0 AS booked_pnl, open_positions,
  round(round_even(invested, 2) + round_even(notional, 2), 2) + 0.0 AS portfolio_value,
  CASE WHEN timeframe = 'total' THEN (SELECT count(*) FROM closed WHERE exit_date = DATE '2001-11-04') END AS closed_trades FROM summary""", "summary closed")
def pnl_snapshot(spark, d):
    s = PF.snapshot(td.closed_trades(spark, d), td.positions(spark, d), PF.latest_prices(td.bars(spark, d)), "2001-11-04")
    return s.select(F.col("snapshot_date").cast("string"), "timeframe", *r(["booked_pnl"], 0), *r(["portfolio_value"]), "open_positions", "closed_trades")


@query("pnl_history", "H-12 Z-03", """
SELECT CAST(exit_date AS VARCHAR) AS date, round(booked, 1) + 0.0 AS booked_pnl FROM (
  SELECT exit_date, sum(sum(booked_pnl)) OVER (ORDER BY exit_date) AS booked FROM closed GROUP BY 1) WHERE exit_date >= DATE '2001-11-05' - 90""", "closed")
def pnl_history(spark, d):
    from pyspark.sql import Window
    day = td.closed_trades(spark, d).groupBy(F.col("exit_date").alias("snapshot_date")).agg(F.sum("booked_pnl").alias("_d"))
    w = Window.orderBy("snapshot_date")  # one row per date
    snaps = day.select("snapshot_date", F.lit("total").alias("timeframe"), F.sum("_d").over(w).alias("booked_pnl"),
                       *[F.lit(0.0).alias(c) for c in ("notional_pnl", "total_pnl", "portfolio_value")])
    return PF.pnl_history(snaps, AS_OF).select(F.col("date").cast("string"), *r(["booked_pnl"], 1))


@query("tax_breakdown", "A-10 Z-03", """
SELECT round(sg, 0) + 0.0 AS stcg_gains, round(sl, 0) + 0.0 AS stcg_losses, round(lg, 0) + 0.0 AS ltcg_gains, round(ll, 0) + 0.0 AS ltcg_losses,
  round(sg + sl, 0) + 0.0 AS net_stcg, round(lg + ll, 0) + 0.0 AS net_ltcg, round(greatest(0, sg + sl) * 0.15, 0) + 0.0 AS estimated_stcg_tax,
  round(greatest(0, lg + ll - 100000) * 0.10, 0) + 0.0 AS estimated_ltcg_tax
FROM (SELECT coalesce(sum(booked_pnl) FILTER (tax_type = 'STCG' AND booked_pnl > 0), 0) AS sg, coalesce(sum(booked_pnl) FILTER (tax_type = 'STCG' AND booked_pnl < 0), 0) AS sl,
  coalesce(sum(booked_pnl) FILTER (tax_type = 'LTCG' AND booked_pnl > 0), 0) AS lg, coalesce(sum(booked_pnl) FILTER (tax_type = 'LTCG' AND booked_pnl < 0), 0) AS ll FROM closed)""", "closed")
def tax_breakdown(spark, d):
    t = PF.tax_breakdown(td.closed_trades(spark, d))
    return t.select(*r(t.columns, 0))


@query("closed_trade_summary", "A-11 P-02", """
SELECT count(*) AS trades, count(*) FILTER (booked_pnl > 0) AS winners, count(*) FILTER (booked_pnl <= 0) AS losers,
  round_even(count(*) FILTER (booked_pnl > 0) / count(*), 4) + 0.0 AS win_rate, round(sum(booked_pnl), 0) + 0.0 AS total_pnl,
  round(sum(booked_pnl) FILTER (tax_type = 'STCG'), 0) + 0.0 AS stcg_pnl, round(sum(booked_pnl) FILTER (tax_type = 'LTCG'), 0) + 0.0 AS ltcg_pnl,
  round_even(avg(booked_pnl_pct) FILTER (booked_pnl > 0), 2) + 0.0 AS avg_win, round_even(avg(booked_pnl_pct) FILTER (booked_pnl <= 0), 2) + 0.0 AS avg_loss
FROM closed WHERE timeframe = 'long_term' AND exit_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'""", "closed")
def closed_trade_summary(spark, d):
    s = PF.closed_summary(td.closed_trades(spark, d), "long_term", "1998-01-01", "2000-12-31")
    return s.select("trades", "winners", "losers", "win_rate", *r(["total_pnl", "stcg_pnl", "ltcg_pnl"], 0), "avg_win", "avg_loss")


@query("recent_trades", "Z-03 O-02", """
SELECT symbol, CAST(exit_date AS VARCHAR) AS exit_date, CAST(entry_date AS VARCHAR) AS entry_date, qty FROM closed
ORDER BY exit_date DESC, symbol, closed.entry_date, entry_price, exit_price, qty LIMIT 50""", "closed")
def recent_trades(spark, d):
    return PF.recent_trades(td.closed_trades(spark, d), 50).select("symbol", F.col("exit_date").cast("string"), F.col("entry_date").cast("string"), "qty")


@query("merged_positions", "A-14 S-07", """
SELECT symbol, timeframe, CAST(sum(qty) AS BIGINT) AS qty, round(sum(avg_cost * qty) / sum(qty), 4) + 0.0 AS avg_cost FROM holdings GROUP BY 1, 2""", "holdings")
def merged_positions(spark, d):
    return PF.merge_cost(td.holdings(spark, d)).select("symbol", "timeframe", "qty", *r(["avg_cost"], 4))


@query("deployed_capital", "A-12", """
SELECT CASE WHEN GROUPING(strategy_id) = 0 THEN 'strategy' WHEN GROUPING(timeframe) = 0 THEN 'timeframe' WHEN GROUPING(sector) = 0 THEN 'sector' ELSE 'total' END AS dimension,
  coalesce(strategy_id, timeframe, sector, 'total') AS member, round(sum(qty * avg_cost), 0) + 0.0 AS deployed
FROM holdings JOIN stocks USING (symbol) GROUP BY GROUPING SETS ((strategy_id), (timeframe), (sector), ())""", "holdings stocks")
def deployed_capital(spark, d):
    c = PF.deployed_capital(td.holdings(spark, d), td.stocks(spark, d))
    return c.select("dimension", "member", *r(["deployed"], 0))


@query("capital_summary", "A-12 A-21", """
SELECT CAST(2500000 AS DOUBLE) AS total_capital, CAST(250000 AS DOUBLE) AS reserve_cash, round_even(s, 2) AS deployed_capital,
  round_even(2500000 - s, 2) AS cash_available, round_even(s / 2500000 * 100, 2) AS utilization_pct FROM (SELECT sum(qty * avg_cost) AS s FROM positions)""", "positions")
def capital_summary(spark, d):
    return PF.capital_summary(td.positions(spark, d))


@query("slot_capacity", "A-13", f"""
SELECT timeframe, used, max, greatest(0, max - used) AS available, used / max AS pct_full, max > used AS can_add
FROM (SELECT timeframe, count(holding_id) AS used, CASE timeframe WHEN 'intraday' THEN 3 WHEN 'swing' THEN 5 WHEN 'medium' THEN 8 ELSE 15 END AS max
      FROM {TFS} LEFT JOIN positions USING (timeframe) GROUP BY 1)""", "positions")
def slot_capacity(spark, d):
    return PF.capacity(td.positions(spark, d))


def proposals(spark, d):
    return TR.create_triggers(td.trigger_seeds(spark, d)).select(
        "trigger_id", "symbol", "strategy_id", "timeframe", F.col("trigger_price").alias("price"))


SIZE_TF = "CASE timeframe WHEN 'intraday' THEN 0.10 WHEN 'swing' THEN 0.20 WHEN 'medium' THEN 0.30 ELSE 0.40 END::DOUBLE"
add_table("avail", "triggers positions", f"""
SELECT t.*, trigger_price AS price, greatest(0, 2500000 * {SIZE_TF} - coalesce(d.v, 0)) AS available
FROM triggers t LEFT JOIN (SELECT strategy_id, sum(qty * avg_cost) AS v FROM positions GROUP BY 1) d ON d.strategy_id = t.strategy_id""")
add_table("sized", "avail", f"""
SELECT *, CASE WHEN v - (v * 0.001 + 20) <= 0 THEN 0 ELSE CAST(floor((v - (v * CAST(0.001 AS DOUBLE) + 20)) / (price * CAST(1.001 AS DOUBLE))) AS BIGINT) END AS qty
FROM (SELECT *, least(2500000 * {SIZE_TF} * 0.9, 200000, available) AS v FROM avail)""")


@query("ratio_totals", "H-13", """
SELECT timeframe, round(sum(v) / 500000, 6) + 0.0 AS total, sum(v) / 500000 <= 1.0 AS fits, abs(sum(v) / 500000 - 1.0) <= 0.01 AS exact
FROM (SELECT timeframe, qty * avg_cost AS v FROM positions) GROUP BY 1""", "positions")
def ratio_totals(spark, d):
    shares = td.positions(spark, d).select("timeframe", (F.col("qty") * F.col("avg_cost") / 500000).alias("ratio"))
    return SZ.ratio_totals(shares, ["timeframe"]).select("timeframe", *r(["total"], 6), "fits", "exact")


@query("available_capital", "A-21", "SELECT trigger_id, round(available, 3) + 0.0 AS capital_available FROM avail", "avail")
def available_capital(spark, d):
    a = SZ.available_capital(proposals(spark, d), td.positions(spark, d))
    return a.select("trigger_id", *r(["capital_available"], 3))


@query("ratio_position_size", "H-06 F-04 H-13", """
SELECT trigger_id, qty, round_even(qty * price * CAST(1.001 AS DOUBLE), 2) + 0.0 AS value_inr FROM sized""", "sized")
def ratio_position_size(spark, d):
    return SZ.ratio_size(proposals(spark, d), td.positions(spark, d)).select("trigger_id", "qty", "value_inr")


@query("simple_position_size", "H-03", """
SELECT trigger_id, greatest(1, CAST(floor(least(cap / slots, cap * 0.02) / trigger_price) AS BIGINT)) AS qty, round_even(cap / slots, 2) AS per_slot_capital
FROM (SELECT *, CASE timeframe WHEN 'intraday' THEN 250000 WHEN 'swing' THEN 500000 WHEN 'medium' THEN 750000 ELSE 1000000 END::DOUBLE AS cap,
  CASE timeframe WHEN 'intraday' THEN 3 WHEN 'swing' THEN 5 WHEN 'medium' THEN 8 ELSE 15 END AS slots FROM triggers)""", "triggers")
def simple_position_size(spark, d):
    return SZ.simple_size(proposals(spark, d)).select("trigger_id", "qty", "per_slot_capital")


@query("sector_exposure", "A-20 J-08", """
SELECT trigger_id, s.sector, coalesce(held, 0) / 2500000 + qty * price * 1.001 / 2500000 <= 0.25 AS allowed, round(coalesce(held, 0) / 2500000 * 100, 2) + 0.0 AS current_exposure_pct
FROM sized z JOIN stocks s ON s.symbol = z.symbol
LEFT JOIN (SELECT sector, sum(qty * avg_cost) AS held FROM positions JOIN stocks USING (symbol) GROUP BY 1) h ON h.sector = s.sector""", "sized stocks positions")
def sector_exposure(spark, d):
    pos, st = td.positions(spark, d), td.stocks(spark, d)
    s = SZ.sector_exposure(SZ.ratio_size(proposals(spark, d), pos), pos, st)
    return s.select("trigger_id", "sector", "allowed", "current_exposure_pct")


@query("opening_gaps", "W-11 H-05 A-24 U-02", """
SELECT symbol, side, gap_pct FROM (
  SELECT symbol, CASE WHEN gap_pct >= 1 THEN 'up' WHEN gap_pct <= -1 THEN 'down' END AS side, gap_pct FROM (
    SELECT symbol, round_even((open - prev) / prev * 100, 2) + 0.0 AS gap_pct
    FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars_raw)
    WHERE symbol IN (SELECT symbol FROM holdings UNION SELECT * FROM (SELECT symbol FROM stocks ORDER BY symbol LIMIT 20))
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)) WHERE side IS NOT NULL""", "bars_raw holdings stocks")
def opening_gaps(spark, d):
    watch = td.stocks(spark, d).select("symbol", F.lit("intraday").alias("timeframe"), F.lit(True).alias("is_active"), F.lit(0.5).alias("confidence"))
    held = td.holdings(spark, d)
    tracked = PF.tracked_symbols(held, watch, limit=20)
    g = PF.gap_lists(td.bars_raw(spark, d), tracked)
    return g.select("symbol", "side", (F.col("gap_pct") + 0.0).alias("gap_pct"))


@query("exit_candidates", "H-04", f"""
SELECT timeframe, 'ml_score' AS perspective, min(holding_id) AS holding_id FROM priced GROUP BY 1
UNION ALL SELECT timeframe, 'tax_efficiency', arg_min(holding_id, (-(CASE WHEN d > 365 THEN 0 WHEN d >= 330 THEN 3 ELSE 1 END + CASE WHEN pnl_pct < 0 THEN 2 ELSE 0 END), holding_id))
  FROM (SELECT *, date_diff('day', entry_date, {NOW}) AS d FROM priced) GROUP BY 1
UNION ALL SELECT timeframe, 'pnl_lock', arg_min(holding_id, (-pnl_pct, holding_id)) FROM priced GROUP BY 1""", "priced")
def exit_candidates(spark, d):
    pos = td.positions(spark, d)
    scores = pos.select("symbol", "timeframe", F.lit(0.5).alias("confidence"))
    c = PF.exit_candidates(pos, PF.latest_prices(td.bars(spark, d)), scores, AS_OF)
    return c.select("timeframe", "perspective", "holding_id")


@query("scored_exit_candidates", "H-04", """
SELECT timeframe, 'ml_score' AS perspective, arg_min(holding_id, (score, holding_id)) AS holding_id, min(score) AS score FROM (
  SELECT *, ((CAST(substr(symbol, 2) AS BIGINT) * 37) % 101) / 101.0::DOUBLE AS score FROM priced) GROUP BY 1""", "priced")
def scored_exit_candidates(spark, d):
    """The weakest signal of each timeframe, by scores that differ from symbol to symbol."""
    pos = td.positions(spark, d)
    scores = pos.select("symbol", "timeframe", ((F.expr("cast(substring(symbol, 2) as bigint)") * 37 % 101) / 101.0).alias("confidence"))
    c = PF.exit_candidates(pos, PF.latest_prices(td.bars(spark, d)), scores, AS_OF)
    return c.filter("perspective = 'ml_score'").select("timeframe", "perspective", "holding_id", F.col("signal_score").alias("score"))


@query("preclose_actions", "H-07", """
SELECT holding_id, CASE WHEN current <= coalesce(stop_loss, 0) THEN 'EXIT_NOW' WHEN current < avg_cost THEN 'REVIEW_EXIT'
  WHEN pnl_pct >= 0.5 THEN 'TRAILING_SL_UPDATED' ELSE 'MONITOR' END AS action,
  round(CASE WHEN current <= coalesce(stop_loss, 0) THEN NULL WHEN current < avg_cost THEN avg_cost WHEN pnl_pct >= 0.5 THEN round_even(current * CAST(0.995 AS DOUBLE), 2) END, 4) + 0.0 AS new_sl
FROM priced WHERE timeframe = 'intraday'""", "priced")
def preclose_actions(spark, d):
    a = PF.preclose_actions(td.positions(spark, d), PF.latest_prices(td.bars(spark, d)))
    return a.select("holding_id", "action", *r(["new_sl"], 4))


@query("updated_targets", "H-02 S-05", """
SELECT holding_id, timeframe, round(target, 4) + 0.0 AS target, round(CASE WHEN timeframe <> 'intraday' OR current <= stop_loss THEN stop_loss WHEN current < avg_cost THEN avg_cost
  WHEN pnl_pct >= 0.5 THEN round_even(current * CAST(0.995 AS DOUBLE), 2) ELSE stop_loss END, 4) + 0.0 AS stop_loss FROM priced""", "priced")
def updated_targets(spark, d):
    pos = td.positions(spark, d)
    a = PF.preclose_actions(pos, PF.latest_prices(td.bars(spark, d)))
    changes = a.select("holding_id", F.lit(None).cast("double").alias("new_target"), F.col("new_sl").alias("new_stop_loss"))
    return PF.update_targets(pos, changes).select("holding_id", "timeframe", *r(["target", "stop_loss"], 4))


def latest_ind(spark, d):
    from tapeflow.functions.windows import latest
    from tapeflow.operators.indicators import indicators
    return latest(indicators(td.bars(spark, d)), ["symbol"], "date")


def _levels():
    parts = []
    for doc in ST.STRATEGIES:
        stop = rule_sql.stop(doc, "avg_cost")
        parts.append(f"SELECT *, {stop} AS st, {rule_sql.target(doc, 'avg_cost', stop)} AS tg FROM eod_in WHERE strategy_id = '{doc['strategy_id']}'")
    return " UNION ALL ".join(parts)


add_table("eod_in", "priced last_ind", """
SELECT p.holding_id, p.symbol, p.strategy_id, p.avg_cost, p.stop_loss, p.target, p.current AS close, i.atr_14, i.supertrend, i.ichimoku_senkou_a, i.ichimoku_senkou_b,
  CAST(NULL AS DOUBLE) AS prev_close FROM priced p JOIN last_ind i ON i.symbol = p.symbol""")


@query("eod_stop_targets", "H-08 T-01 T-02", f"""
SELECT holding_id, round_even(greatest(stop_loss, st), 2) AS new_sl, tg AS new_target FROM ({_levels()})
WHERE abs(greatest(stop_loss, st) - stop_loss) > 0.01 OR abs(tg - target) > 1""", "eod_in")
def eod_stop_targets(spark, d):
    r = PF.eod_review(td.positions(spark, d), PF.latest_prices(td.bars(spark, d)), latest_ind(spark, d), ST.parsed(ST.catalog(spark)))
    return r.select("holding_id", "new_sl", "new_target")


add_table("review", "priced last_ind fundamentals regime", """
SELECT p.*, i.rsi_14, i.close, i.sma_200, f.roe, coalesce(s.cycle, 'neutral') AS stock_cycle, m.cycle AS market_cycle
FROM priced p LEFT JOIN last_ind i ON i.symbol = p.symbol
LEFT JOIN (SELECT symbol, arg_max(roe, period_end) AS roe FROM fundamentals GROUP BY 1) f ON f.symbol = p.symbol
LEFT JOIN (SELECT scope_id, cycle FROM regime WHERE scope = 'stock') s ON s.scope_id = p.symbol
CROSS JOIN (SELECT cycle FROM regime WHERE scope = 'market') m
WHERE timeframe = 'long_term'""")
REC = """CASE WHEN pnl_pct < -15 OR (stock_cycle = 'bear' AND market_cycle = 'bear') OR (NOT coalesce(close > sma_200, FALSE) AND coalesce(rsi_14, 50) < 40 AND market_cycle = 'bear') THEN 'EXIT'
  WHEN pnl_pct BETWEEN -20 AND -10 AND roe >= 15 AND market_cycle <> 'bear' AND close > sma_200 THEN 'AVERAGE_DOWN' ELSE 'HOLD' END"""


def review_frame(spark, d):
    return PF.review_frame(td.positions(spark, d), PF.latest_prices(td.bars(spark, d)), latest_ind(spark, d),
                           td.fundamentals(spark, d), R.current_regime(cycles(spark, d)))


@query("investment_review", "H-09 H-10", f"""
SELECT holding_id, symbol, round((current - avg_cost) * qty, 3) + 0.0 AS pnl, {REC} AS recommendation,
  CAST(date_diff('day', entry_date, {NOW}) AS INTEGER) AS holding_days FROM review""", "review")
def investment_review(spark, d):
    m = PF.monthly_review(review_frame(spark, d), latest_ind(spark, d), ST.parsed(ST.catalog(spark)), AS_OF)
    return m.select("holding_id", "symbol", *r(["pnl"], 3), "recommendation", "holding_days")


@query("review_totals", "A-23", """
SELECT count(*) AS holdings, round(sum(avg_cost * qty), 3) + 0.0 AS invested, round(sum((current - avg_cost) * qty), 3) + 0.0 AS pnl,
  round(sum((current - avg_cost) * qty) / sum(avg_cost * qty) * 100, 4) + 0.0 AS pnl_pct FROM priced WHERE timeframe = 'long_term'""", "priced")
def review_totals(spark, d):
    c = PF.with_price(PF.find_positions(td.positions(spark, d), timeframe="long_term"), PF.latest_prices(td.bars(spark, d)))
    t = PF.review_totals(c.withColumn("pnl", (F.col("current") - F.col("avg_cost")) * F.col("qty")))
    return t.select("holdings", *r(["invested", "pnl"], 3), *r(["pnl_pct"], 4))


@query("drawdown_alerts", "H-11", f"""
SELECT holding_id, round((current - avg_cost) / avg_cost * 100, 4) + 0.0 AS drawdown_pct, {REC} AS recommendation FROM review
WHERE (current - avg_cost) / avg_cost <= -0.10""", "review")
def drawdown_alerts(spark, d):
    a = PF.drawdown_alerts(review_frame(spark, d))
    return a.select("holding_id", *r(["drawdown_pct"], 4), "recommendation")


@query("portfolio_page", "Z-04 J-15", f"""
SELECT timeframe, holding_id, round((current - avg_cost) * qty, 3) + 0.0 AS pnl, date_diff('day', entry_date, {NOW}) > 365 AS is_ltcg FROM priced""", "priced")
def portfolio_page(spark, d):
    c = PF.page_rows(td.positions(spark, d), PF.latest_prices(td.bars(spark, d)), AS_OF)
    return c.select("timeframe", "holding_id", *r(["pnl"], 3), "is_ltcg")


@query("closed_positions", "H-01 J-13", f"""
SELECT holding_id, symbol, round((current - avg_cost) * qty, 3) + 0.0 AS booked_pnl, CASE WHEN date_diff('day', entry_date, {NOW}) > 365 THEN 'LTCG' ELSE 'STCG' END AS tax_type
FROM priced WHERE current <= stop_loss OR current >= target""", "priced")
def closed_positions(spark, d):
    pos = td.positions(spark, d)
    c = PF.with_price(pos, PF.latest_prices(td.bars(spark, d)))
    hit = c.filter("current <= stop_loss or current >= target")
    exits = hit.select("holding_id", F.col("current").alias("exit_price"),
                       F.when(F.col("current") <= F.col("stop_loss"), "stop_loss").otherwise("target").alias("exit_reason"))
    _, trades = PF.close_positions(pos, exits, AS_OF)
    return trades.select(F.concat(F.lit("H"), F.expr("substring(symbol, 2)")).alias("holding_id"), "symbol", *r(["booked_pnl"], 3), "tax_type")


# Corporate actions

@query("adjustment_factors", "C-01 C-07 C-08", "SELECT action_id, symbol, action_type, CAST(ex_date AS VARCHAR) AS ex_date, adjustment_factor, processed FROM actions", "actions")
def adjustment_factors(spark, d):
    a = A.find_actions(td.corporate_actions(spark, d))
    return a.select("action_id", "symbol", "action_type", F.col("ex_date").cast("string"), "adjustment_factor", "processed")


@query("recorded_actions", "C-08 C-01", """
SELECT action_id, symbol, action_type, CAST(ex_date AS VARCHAR) AS ex_date, adjustment_factor, processed FROM actions
UNION ALL SELECT symbol || '_' || action_type || '_' || ex || '_' || substr(sha256(symbol || '|' || action_type || '|' || ex || '|' || coalesce(CAST(ratio AS VARCHAR), '')), 1, 8),
  symbol, action_type, ex, adjustment_factor, 0 FROM (SELECT *, CAST(CAST(ex_date + 400 AS DATE) AS VARCHAR) AS ex FROM actions)""", "actions")
def recorded_actions(spark, d):
    a = td.corporate_actions(spark, d)
    new = a.select("symbol", "action_type", F.date_add("ex_date", 400).alias("ex_date"), "ratio", "cash_amount")
    out = A.record_actions(a, new)
    return out.select("action_id", "symbol", "action_type", F.col("ex_date").cast("string"), "adjustment_factor", "processed")


@query("unprocessed_splits", "C-07 P-02", """
SELECT action_id, CAST(ex_date AS VARCHAR) AS ex_date FROM actions WHERE processed = 0 AND ex_date BETWEEN DATE '1998-02-01' AND DATE '1998-06-30'""", "actions")
def unprocessed_splits(spark, d):
    a = A.find_actions(td.corporate_actions(spark, d), processed=False, from_date="1998-02-01", to_date="1998-06-30")
    return a.select("action_id", F.col("ex_date").cast("string"))


add_table("factors", "bars actions", """
SELECT b.*, coalesce((SELECT product(adjustment_factor) FROM actions a WHERE a.symbol = b.symbol AND a.ex_date > b.date AND action_type IN ('split', 'bonus')), 1) AS factor FROM bars b""")


@query("back_adjusted_bars", "C-02 A-15 J-14", f"""
SELECT symbol, {DATE}, factor, round(open / factor, 4) + 0.0 AS open, round(close / factor, 4) + 0.0 AS close FROM factors""", "factors")
def back_adjusted_bars(spark, d):
    b = A.back_adjust(td.bars(spark, d), td.corporate_actions(spark, d))
    return b.select("symbol", F.col("date").cast("string"), "factor", *r(["open", "close"], 4))


@query("adjusted_positions", "C-03", """
SELECT holding_id, CAST(floor(qty * f) AS BIGINT) AS qty, round(avg_cost / f, 4) + 0.0 AS avg_cost, round(stop_loss / f, 4) + 0.0 AS stop_loss
FROM positions p JOIN (SELECT symbol, CASE action_type WHEN 'dividend' THEN 1 ELSE adjustment_factor END AS f FROM actions) a ON a.symbol = p.symbol""", "positions actions")
def adjusted_positions(spark, d):
    p = A.adjust_positions(td.positions(spark, d), td.corporate_actions(spark, d))
    return p.select("holding_id", "qty", *r(["avg_cost", "stop_loss"], 4))


@query("adjusted_triggers", "C-04", """
SELECT trigger_id, round(trigger_price / f, 4) + 0.0 AS trigger_price, round(buy_below_price / f, 4) + 0.0 AS buy_below_price
FROM triggers t JOIN (SELECT symbol, CASE action_type WHEN 'dividend' THEN 1 ELSE adjustment_factor END AS f FROM actions) a ON a.symbol = t.symbol""", "triggers actions")
def adjusted_triggers(spark, d):
    t = A.adjust_triggers(TR.create_triggers(td.trigger_seeds(spark, d)), td.corporate_actions(spark, d))
    return t.select("trigger_id", *r(["trigger_price", "buy_below_price"], 4))


@query("applied_actions", "C-05", """
SELECT 'bars' AS part, count(*) AS n FROM bars
UNION ALL SELECT 'indicators', count(*) FROM bars WHERE symbol NOT IN (SELECT symbol FROM actions WHERE processed = 0 AND action_type IN ('split', 'bonus'))
UNION ALL SELECT 'positions', count(*) FROM positions UNION ALL SELECT 'processed', count(*) FROM actions""", "bars actions positions")
def applied_actions(spark, d):
    b = td.bars(spark, d)
    out = A.apply_actions(td.corporate_actions(spark, d), b, b.select("symbol", "date"), td.positions(spark, d), TR.create_triggers(td.trigger_seeds(spark, d)))
    n = F.count(F.lit(1)).alias("n")
    parts = {"bars": out["bars"], "indicators": out["indicators"], "positions": out["positions"], "processed": out["actions"].filter("processed = 1")}
    res = None
    for k, df in parts.items():
        one = df.agg(n).select(F.lit(k).alias("part"), "n")
        res = one if res is None else res.unionByName(one)
    return res


add_table("actions2", "actions", """
SELECT action_id, symbol, action_type, ex_date, adjustment_factor, processed FROM actions
UNION ALL SELECT action_id || '-b', symbol, 'bonus', CAST(ex_date + 400 AS DATE), 1.5::DOUBLE, 0 FROM actions WHERE CAST(substr(symbol, 2) AS BIGINT) % 3 <> 0
UNION ALL SELECT action_id || '-c', symbol, 'split', CAST(ex_date + 900 AS DATE), 2.0::DOUBLE, 0 FROM actions WHERE CAST(substr(symbol, 2) AS BIGINT) % 2 = 0""")
add_table("factors2", "bars actions2", """
SELECT b.*, coalesce((SELECT product(adjustment_factor) FROM actions2 a WHERE a.symbol = b.symbol AND a.ex_date > b.date AND a.processed = 0 AND action_type IN ('split', 'bonus')), 1) AS factor FROM bars b""")


def several_actions(spark, d):
    """Up to three actions a symbol: the given ones, a bonus 400 days and a split 900 days later."""
    a = td.corporate_actions(spark, d).select("action_id", "symbol", "action_type", "ex_date", "adjustment_factor", "processed")
    k = F.expr("cast(substring(symbol, 2) as bigint)")

    def later(tag, kind, days, factor, which):
        return a.filter(which).select(F.concat("action_id", F.lit(tag)).alias("action_id"), "symbol", F.lit(kind).alias("action_type"), F.date_add("ex_date", days).alias("ex_date"),
                                      F.lit(factor).alias("adjustment_factor"), F.lit(0).alias("processed"))

    return a.unionByName(later("-b", "bonus", 400, 1.5, k % 3 != 0)).unionByName(later("-c", "split", 900, 2.0, k % 2 == 0))


def _applied(spark, d):
    b = td.bars(spark, d)
    return A.apply_actions(several_actions(spark, d), b, b.select("symbol", "date"), td.positions(spark, d), TR.create_triggers(td.trigger_seeds(spark, d)))


@query("applied_bars", "C-05 C-02 A-15", f"""
SELECT symbol, {DATE}, round(open / factor, 4) + 0.0 AS open, round(high / factor, 4) + 0.0 AS high, round(low / factor, 4) + 0.0 AS low, round(close / factor, 4) + 0.0 AS close, volume FROM factors2""", "factors2")
def applied_bars(spark, d):
    """Prices after several unprocessed actions a symbol."""
    return _applied(spark, d)["bars"].select("symbol", F.col("date").cast("string"), *r(["open", "high", "low", "close"], 4), "volume")


@query("applied_holdings", "C-05 C-03 C-04", """
SELECT * FROM (WITH f AS (SELECT symbol, product(adjustment_factor) AS f FROM actions2 WHERE processed = 0 AND action_type <> 'dividend' GROUP BY 1)
SELECT 'position' AS part, holding_id AS id, CAST(floor(qty * coalesce(f, 1)) AS BIGINT) AS qty, round(avg_cost / coalesce(f, 1), 4) + 0.0 AS price FROM positions LEFT JOIN f USING (symbol)
UNION ALL SELECT 'trigger', trigger_id, NULL, round(buy_below_price / coalesce(f, 1), 4) + 0.0 FROM triggers LEFT JOIN f USING (symbol)
UNION ALL SELECT 'indicator rows', symbol, count(*), NULL FROM bars WHERE symbol NOT IN (SELECT symbol FROM actions2 WHERE processed = 0 AND action_type IN ('split', 'bonus')) GROUP BY symbol
UNION ALL SELECT 'processed', action_id, 1, NULL FROM actions2)""", "actions2 positions triggers bars")
def applied_holdings(spark, d):
    """Positions, triggers, kept indicator rows and actions after several unprocessed actions a symbol."""
    out = _applied(spark, d)
    none = F.lit(None)
    return (out["positions"].select(F.lit("position").alias("part"), F.col("holding_id").alias("id"), "qty", *r(["avg_cost"], 4)).withColumnRenamed("avg_cost", "price")
            .unionByName(out["triggers"].select(F.lit("trigger").alias("part"), F.col("trigger_id").alias("id"), none.cast("bigint").alias("qty"), (F.round("buy_below_price", 4) + 0.0).alias("price")))
            .unionByName(out["indicators"].groupBy("symbol").agg(F.count(F.lit(1)).alias("qty")).select(F.lit("indicator rows").alias("part"), F.col("symbol").alias("id"), "qty", none.cast("double").alias("price")))
            .unionByName(out["actions"].select(F.lit("processed").alias("part"), F.col("action_id").alias("id"), F.col("processed").cast("bigint").alias("qty"), none.cast("double").alias("price"))))


@query("action_impact", "C-06", """
SELECT a.action_id, (SELECT count(*) FROM bars b WHERE b.symbol = a.symbol AND b.date < a.ex_date) AS price_row_count,
  (SELECT count(*) FROM positions p WHERE p.symbol = a.symbol) AS positions, (SELECT count(*) FROM triggers t WHERE t.symbol = a.symbol) AS triggers FROM actions a""", "actions bars positions triggers")
def action_impact(spark, d):
    i = A.impact_summary(td.corporate_actions(spark, d), td.bars(spark, d), td.positions(spark, d), TR.create_triggers(td.trigger_seeds(spark, d)))
    return i.select("action_id", "price_row_count", "positions", "triggers")


# Triggers

def triggers(spark, d):
    return TR.create_triggers(td.trigger_seeds(spark, d))


def prices_at(spark, d, day):
    return PF.latest_prices(td.bars(spark, d).filter(F.col("date") <= F.lit(day).cast("date")))


@query("created_triggers", "K-01", """
SELECT trigger_id, round(buy_below_price, 4) + 0.0 AS buy_below_price, CAST(expiry_date AS VARCHAR) AS expiry_date, status FROM triggers""", "triggers")
def created_triggers(spark, d):
    return triggers(spark, d).select("trigger_id", *r(["buy_below_price"], 4), F.col("expiry_date").cast("string"), "status")


add_table("checked", "triggers bars", """
SELECT t.*, p.price AS cur, CASE WHEN p.price IS NULL THEN 'pending' WHEN DATE '1999-01-15' > expiry_date THEN 'expired' WHEN p.price <= buy_below_price THEN 'eligible' ELSE 'pending' END AS new_status
FROM triggers t LEFT JOIN (SELECT symbol, arg_max(close, date) AS price FROM bars WHERE date <= DATE '1999-01-15' GROUP BY 1) p ON p.symbol = t.symbol""")


@query("checked_triggers", "K-02 J-06", """
SELECT trigger_id, new_status AS status, CASE WHEN new_status <> 'expired' THEN round((cur - buy_below_price) / buy_below_price * 100, 4) + 0.0 END AS distance_pct FROM checked""", "checked")
def checked_triggers(spark, d):
    t = TR.check_triggers(triggers(spark, d), prices_at(spark, d, "1999-01-15"), "1999-01-15")
    return t.select("trigger_id", "status", *r(["distance_pct"], 4))


@query("trigger_check_counts", "K-02", "SELECT count(*) FILTER (new_status = 'pending') AS pending, count(*) FILTER (new_status = 'eligible') AS eligible, count(*) FILTER (new_status = 'expired') AS expired FROM checked", "checked")
def trigger_check_counts(spark, d):
    t = triggers(spark, d)
    return TR.check_counts(t, TR.check_triggers(t, prices_at(spark, d, "1999-01-15"), "1999-01-15"))


@query("trigger_list", "K-04 P-02 O-01", f"""
SELECT trigger_id, CAST(date_diff('day', trigger_date, {NOW}) AS INTEGER) AS days_old FROM triggers WHERE timeframe = 'swing' AND status = 'pending'
ORDER BY trigger_date DESC, trigger_id DESC LIMIT 100""", "triggers")
def trigger_list(spark, d):
    return TR.find_triggers(triggers(spark, d), AS_OF, "pending", "swing", limit=100).select("trigger_id", "days_old")


@query("cancelled_triggers", "K-05", """
SELECT trigger_id, CASE WHEN timeframe = 'swing' THEN 'cancelled' ELSE status END AS status FROM triggers""", "triggers")
def cancelled_triggers(spark, d):
    t = triggers(spark, d)
    return TR.set_status(t, t.filter("timeframe = 'swing'").select("trigger_id"), "cancelled").select("trigger_id", "status")


@query("confirmed_buys", "K-05 H-01", """
SELECT * FROM (WITH RECURSIVE o AS (
  SELECT c.trigger_id, c.strategy_id, c.cur, a.available, 2500000 * SIZE * 0.9 AS cap, row_number() OVER (PARTITION BY c.strategy_id ORDER BY c.trigger_id) AS rn
  FROM checked c JOIN avail a USING (trigger_id) WHERE c.new_status = 'eligible'),
f AS (
  SELECT strategy_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS trigger_id, CAST(NULL AS DOUBLE) AS cur, CAST(0 AS BIGINT) AS qty, CAST(0 AS DOUBLE) AS spent
  FROM o GROUP BY 1
  UNION ALL SELECT strategy_id, rn, trigger_id, cur, q, spent + q * cur FROM (
    SELECT *, CASE WHEN v - (v * CAST(0.001 AS DOUBLE) + 20) <= 0 THEN 0 ELSE CAST(floor((v - (v * CAST(0.001 AS DOUBLE) + 20)) / (cur * CAST(1.001 AS DOUBLE))) AS BIGINT) END AS q FROM (
      SELECT o.strategy_id, o.rn, CAST(o.trigger_id AS VARCHAR) AS trigger_id, o.cur, f.spent, least(o.cap, 200000, greatest(0, o.available - f.spent)) AS v
      FROM f JOIN o ON o.strategy_id = f.strategy_id AND o.rn = f.rn + 1)))
SELECT trigger_id, round(cur, 4) + 0.0 AS avg_cost, qty FROM f WHERE qty >= 1)""".replace("SIZE", SIZE_TF.replace("timeframe", "c.timeframe")), "checked avail")
def confirmed_buys(spark, d):
    t = TR.check_triggers(triggers(spark, d), prices_at(spark, d, "1999-01-15"), "1999-01-15")
    orders = t.select("trigger_id", F.lit(None).cast("double").alias("override_price"), F.lit("scheduled").alias("note"))
    _, new = TR.confirm_buys(t, orders, td.positions(spark, d), latest_ind(spark, d), ST.parsed(ST.catalog(spark)), "1999-01-15")
    return new.select(F.expr("substring(holding_id, 3)").alias("trigger_id"), *r(["avg_cost"], 4), "qty")


@query("validated_triggers", "K-03 P-12", """
SELECT z.trigger_id, z.strategy_id, coalesce(g.entry, FALSE) AS all_passed, z.qty > 0 AS capital_fit,
  coalesce(held, 0) / 2500000 + round_even(z.qty * price * CAST(1.001 AS DOUBLE), 2) / 2500000 <= 0.25 AS sector_fit
FROM sized z JOIN stocks s ON s.symbol = z.symbol
LEFT JOIN (SELECT strategy_id, symbol, entry FROM sigs QUALIFY date = max(date) OVER (PARTITION BY symbol)) g ON g.symbol = z.symbol AND g.strategy_id = z.strategy_id
LEFT JOIN (SELECT sector, sum(qty * avg_cost) AS held FROM positions JOIN stocks USING (symbol) GROUP BY 1) h ON h.sector = s.sector""", "sized stocks sigs positions")
def validated_triggers(spark, d):
    from tapeflow.functions.rules import look_back
    from tapeflow.plans.q_strategies import panel
    from tapeflow.session import stored
    docs = ST.STRATEGIES
    # The latest row and what its rules look back on; a row a symbol is stored, so the panel is off the disk before the rest begins.
    last = stored(TR.latest_checks(panel(spark, d, last=look_back(docs) + 1), docs), "checks")
    v = TR.validate(triggers(spark, d), last, docs, td.positions(spark, d), td.stocks(spark, d))
    return v.select("trigger_id", "strategy_id", "all_passed", "capital_fit", "sector_fit")


@query("formatted_money", "F-08 F-01 F-04", """
SELECT holding_id, CASE WHEN abs(v) >= 100000 THEN '₹' || format('{:,.2f}', v / 100000) || 'L' WHEN abs(v) >= 1000 THEN '₹' || format('{:,.2f}', v) ELSE '₹' || format('{:.2f}', v) END AS pnl_text,
  CASE WHEN pnl_pct >= 0 THEN '+' ELSE '' END || format('{:.1f}%', pnl_pct) AS pct_text FROM (SELECT *, (current - avg_cost) * qty * 1000 AS v FROM priced)""", "priced")
def formatted_money(spark, d):
    c = PF.page_rows(td.positions(spark, d), PF.latest_prices(td.bars(spark, d)), AS_OF)
    return c.select("holding_id", SC.format_money(F.col("pnl") * 1000).alias("pnl_text"), SC.format_percent(F.col("pnl_pct")).alias("pct_text"))

