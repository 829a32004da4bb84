import datetime
import random

import pytest
from pyspark.sql import functions as F

from tapeflow.functions import rules
from tapeflow.functions import scalars as SC
from tapeflow.functions.windows import rank_percentile, run_length_filter, series
from tapeflow.operators import actions, portfolio, sizing, triggers
from tapeflow.operators import strategies as ST
from tapeflow.operators import sweep
from tapeflow.params import DEFAULTS, check_ratios
from tapeflow.sources import broker_csv, html_fields, tables

D = datetime.date


def bars(spark, closes, symbol="A", **extra):
    rows = [(symbol, D(2020, 1, 1) + datetime.timedelta(days=i), float(c), i + 1) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, rn int")
    return df.withColumns({**{c: F.col("close") for c in ("open", "high", "low")}, **extra})


def test_run_length_filter_keeps_long_runs(spark):
    vals = [0, 1, 1, 0, -1, -1, -1, 1, 1, 1, 1, 0]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(vals)], "k string, date int, v int")
    out = run_length_filter(df, "v", ["k"], F.lit(3)).orderBy("date")
    assert [r.v for r in out.collect()] == [0, 0, 0, 0, -1, -1, -1, 1, 1, 1, 1, 0]


def test_rank_percentile_averages_ties(spark):
    df = bars(spark, [1, 2, 2, 0])
    out = df.withColumn("p", rank_percentile(F.col("close"), series(), 3, 3)).orderBy("date").collect()
    assert [r.p for r in out][:2] == [None, None]
    assert out[2].p == pytest.approx(2.5 / 3 * 100) and out[3].p == pytest.approx(1 / 3 * 100)


def test_conditions_on_missing_values_are_false(spark):
    df = bars(spark, [1, 2, 3]).withColumn("rsi_14", F.lit(None).cast("double"))
    p = rules.Panel.of(df)
    conds = [{"indicator": "rsi_14", "op": "<", "value": 50}, {"indicator": "unknown", "op": ">", "value": 1},
             {"indicator": "time", "op": ">=", "value": "15:15"}, {"indicator": "close", "op": ">", "value": "indicator:vwap"}]
    out = df.select(*[rules.condition(c, p).alias(f"c{i}") for i, c in enumerate(conds)])
    assert all(v is False for r in out.collect() for v in r)


def test_crossing_uses_the_current_right_side(spark):
    df = bars(spark, [1, 3, 2, 4]).withColumn("ema_20", F.lit(2.0))
    up = {"indicator": "close", "op": "crosses_above", "value": "indicator:ema_21"}
    got = [r.x for r in df.withColumn("x", rules.condition(up, rules.Panel.of(df))).orderBy("date").collect()]
    assert got == [False, True, False, True]


def test_empty_rule_sets(spark):
    df = bars(spark, [1])
    p = rules.Panel.of(df)
    r = df.select(rules.compile_rules({"conditions": []}, p, "AND").alias("a"), rules.compile_rules({"conditions": []}, p, "OR").alias("o")).first()
    assert (r.a, r.o) == (True, False)


def test_seeded_rules_see_no_future(spark):
    df = bars(spark, range(1, 40)).withColumn("ichimoku_chikou", F.lit(-1.0))
    c = {"indicator": "ichimoku_chikou", "op": ">", "value": "indicator:close_26d_ago"}
    out = df.withColumn("x", rules.condition(c, rules.Panel.of(df))).orderBy("date").collect()
    assert [r.x for r in out] == [False] * 26 + [True] * 13


def test_adjustment_factors_and_checks(spark):
    a = spark.createDataFrame([("X", "bonus", D(2020, 1, 3), 1.0, None), ("X", "split", D(2020, 1, 3), 2.0, None), ("X", "rights", D(2020, 1, 3), None, None),
                               ("X", "dividend", D(2020, 1, 3), None, 5.0)], "symbol string, action_type string, ex_date date, ratio double, cash_amount double")
    out = {r.action_type: r.adjustment_factor for r in actions.record_actions(a.filter("1 = 0"), a).collect()}
    assert out == {"bonus": 2.0, "split": 3.0, "rights": 1.0, "dividend": 1.0}
    for bad in (("X", "merger", D(2020, 1, 3), 1.0, None), ("X", "bonus", D(2020, 1, 3), None, None)):
        with pytest.raises(Exception, match="unknown action_type|requires ratio"):
            actions.record_actions(a.filter("1 = 0"), spark.createDataFrame([bad], a.schema)).collect()


def test_bonus_halves_earlier_prices_only(spark):
    b = bars(spark, [300, 300, 150])
    a = spark.createDataFrame([("A", "bonus", D(2020, 1, 3), 2.0), ("A", "rights", D(2020, 1, 3), 9.0)], "symbol string, action_type string, ex_date date, adjustment_factor double")
    out = actions.back_adjust(b, a).orderBy("date").collect()
    assert [r.close for r in out] == [150, 150, 150] and [r.factor for r in out] == [2, 2, 1]
    assert all(r.close * r.factor == o for r, o in zip(out, [300, 300, 150]))


def test_trigger_discount_and_states(spark):
    hits = spark.createDataFrame([(t, "A", "S001", t, D(2020, 1, 1), 100.0) for t in DEFAULTS.trigger_discount],
                                 "trigger_id string, symbol string, strategy_id string, timeframe string, trigger_date date, trigger_price double")
    t = triggers.create_triggers(hits)
    assert {r.timeframe: (round(r.buy_below_price, 6), (r.expiry_date - r.trigger_date).days) for r in t.collect()} == {
        "intraday": (99.0, 5), "swing": (98.5, 10), "medium": (97.0, 30), "long_term": (95.0, 90)}
    px = spark.createDataFrame([("A", 96.0)], "symbol string, price double")
    got = {r.timeframe: r.status for r in triggers.check_triggers(t, px, "2020-01-08").collect()}
    assert got == {"intraday": "expired", "swing": "eligible", "medium": "eligible", "long_term": "pending"}
    none = triggers.check_triggers(t, px.filter("1 = 0"), "2030-01-01")
    assert {r.status for r in none.collect()} == {"pending"}
    bad = triggers.check_triggers(t, px, "2020-01-08", hits.filter("timeframe = 'medium'").select("trigger_id"))
    assert {r.status for r in bad.filter("timeframe = 'medium'").collect()} == {"invalidated"}


def test_position_size_by_hand(spark):
    pos = spark.createDataFrame([("A", "S001", "swing", 10, 100.0, True)], "symbol string, strategy_id string, timeframe string, qty bigint, avg_cost double, is_active boolean")
    prop = spark.createDataFrame([("S001", "swing", 1250.50, 0.85), ("S001", "swing", 0.0, 1.0), ("S001", "swing", 1e7, 1.0)], "strategy_id string, timeframe string, price double, confidence double")
    rows = sizing.ratio_size(prop, pos).orderBy("price").collect()
    value = min(500_000 * 0.9, 200_000, 500_000 - 1000) * 0.85
    want = int((value - value * 0.001 - 20) / (1250.50 * 1.001))
    assert [r.error for r in rows] == ["invalid_price", None, "insufficient_for_1_share"]
    assert rows[1].qty == want and rows[1].capital_available == 499_000


def test_ratio_checks():
    check_ratios({"S001": 0.5, "S002": 0.5})
    with pytest.raises(ValueError):
        check_ratios({"S001": 0.9, "S002": 0.2})
    with pytest.raises(ValueError):
        check_ratios({"swing": 0.5}, exact=True)


def test_close_position_books_long_term_gain(spark):
    pos = spark.createDataFrame([("H1", "A", "swing", 10, 100.0, D(2018, 1, 1), "S001", True), ("H2", "A", "swing", 1, 100.0, D(2018, 1, 1), "S001", True)],
                                "holding_id string, symbol string, timeframe string, qty bigint, avg_cost double, entry_date date, strategy_id string, is_active boolean")
    ex = spark.createDataFrame([("H1", 120.0, "target")], "holding_id string, exit_price double, exit_reason string")
    after, trades = portfolio.close_positions(pos, ex, "2020-01-01")
    t = trades.collect()
    assert len(t) == 1 and t[0].booked_pnl == 200 and t[0].tax_type == "LTCG" and t[0].holding_days == 730
    assert {r.holding_id: r.is_active for r in after.collect()} == {"H1": False, "H2": True}


def test_upsert_replaces_by_key_and_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("A", None, 1, 2000), ("B", "x", 2, 2000), ("C", "y", 3, 2001)], "k string, s string, v int, year int")
    tables.upsert_table(spark, path, old, ["k", "s"], "year")
    before = {p: (tmp_path / "t" / "year=2001").stat().st_mtime_ns for p in ["2001"]}
    tables.upsert_table(spark, path, spark.createDataFrame([("A", None, 9, 2000), ("D", "z", 4, 2000)], old.schema), ["k", "s"], "year")
    got = {(r.k, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {("A", 9), ("B", 2), ("C", 3), ("D", 4)}
    assert before["2001"] == (tmp_path / "t" / "year=2001").stat().st_mtime_ns


def test_strategy_catalogue(spark):
    c = ST.catalog(spark)
    assert c.count() == 20 and len(ST.documents(c)) == 20
    assert ST.find(c, type_="momentum").count() == 3 and ST.find(c, timeframe="intraday").count() == 3
    assert ST.next_generation(c, "Turtle").first()[0] == 1
    d = ST.parsed(c).filter("strategy_id = 'S009'").first()
    assert d.entry_rules.conditions[0].squeeze_lookback == 126 and d.stop.trailing is True


def test_sweep_candidates_are_distinct_and_patched(spark):
    c = sweep.candidates(spark, per_template=5)
    rows = c.collect()
    assert len({(r.template, tuple(r.point)) for r in rows}) == len(rows) and len({r.template for r in rows}) == 6
    doc = sweep.build(ST.STRATEGIES[2], {"rsi_entry": 30, "bb_pct_entry": 0.2, "atr_sl_mult": 2.2}, "X")
    assert doc["entry_rules"]["conditions"][0]["value"] == 30 and doc["entry_rules"]["conditions"][1]["value"] == 0.2
    assert doc["exit_rules"] == ST.STRATEGIES[2]["exit_rules"] and doc["stoploss_rules"]["multiplier"] == 2.2


def test_near_duplicates_keep_the_best(spark):
    r = spark.createDataFrame([("a", "T", [1.0, 2.0], 1), ("b", "T", [1.1, 2.1], 2), ("c", "T", [5.0, 2.0], 3)], "candidate_id string, template string, point array<double>, rank int")
    assert {x.candidate_id for x in sweep.without_near_duplicates(r).collect()} == {"a", "c"}


@pytest.mark.parametrize(("size", "share"), [(3, 0.9), (12, 0.8), (20, 0.9), (5, 0.0)])
def test_near_duplicates_equal_all_pairs(spark, size, share):
    r = random.Random(size)
    base = [[round(r.uniform(-1, 1), 1) for _ in range(size)] for _ in range(12)]
    rows = []
    for t in ("T", "U"):
        for k in range(60):
            p = [v + r.choice([0.0, 0.0, 0.1, 0.19, -0.15]) for v in r.choice(base)]
            for i in r.sample(range(size), r.randint(0, 3)):
                p[i] += r.choice([0.2, 1.0, -0.4])
            rows.append((f"{t}{k}", t, p, k + 1))
    old = [("T", base[0]), ("U", base[1])]
    schema = "candidate_id string, template string, point array<double>, rank int"

    def close(a, b):
        return sum(abs(x - y) < 0.2 for x, y in zip(a, b)) / size > share

    want = {c for c, t, p, k in rows if not any(close(p, q) for _, u, q, j in rows if u == t and j < k) and not any(u == t and close(p, q) for u, q in old)}
    got = sweep.without_near_duplicates(spark.createDataFrame(rows, schema), spark.createDataFrame(old, "template string, point array<double>"), share=share)
    assert {x.candidate_id for x in got.collect()} == want and 0 < len(want) < len(rows)
    assert sweep.without_near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_holdings_file(spark, tmp_path):
    f = tmp_path / "h.csv"
    f.write_text(' Symbol ,Quantity,Average Cost,LTP\n tcs ,"1,000",₹2.50,3\nTCS,1000,3.5,4\nTotal,5,1,1\nINFY,0,1,1\nWIPRO,3,abc,1\n', encoding="utf-8")
    df = broker_csv.read_csv(spark, str(f))
    v = broker_csv.validate(df)
    assert v["valid"] and v["row_count"] == 5 and len(v["preview"]) == 5
    none = spark.createDataFrame([], "symbol string, timeframe string, qty bigint, avg_cost double, entry_date date, is_active boolean")
    out = broker_csv.import_holdings(none, df, "swing", "2020-01-01").collect()
    assert [(r.symbol, r.qty, r.avg_cost) for r in out] == [("TCS", 2000, 3.0)]
    assert not broker_csv.validate(df.drop(" Symbol "))["valid"]


def test_tradebook_file(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("Symbol,Trade Date,Trade Type,Quantity,Price\nA,01-02-2020,buy,10,5\nA,05/03/2020,SELL,4,6\nA,never,SELL,4,6\n")
    closed, open_ = broker_csv.import_tradebook(broker_csv.read_csv(spark, str(f)))
    c = closed.collect()
    assert len(c) == 1 and c[0].qty == 4 and c[0].booked_pnl == 4 and c[0].timeframe == "medium" and c[0].exit_date == D(2020, 3, 5)
    assert [(r.qty, r.avg_cost) for r in open_.collect()] == [(6, 5.0)]


def test_html_fundamentals(spark):
    html = """<ul id="top-ratios"><li><span class="name">Market Cap</span><span class="value">₹ <b>1,234</b> Cr.</span></li>
    <li><span class="name">Stock P/E</span><span class="number">23.5</span></li><li><span class="name">High / Low</span><span class="value">9 / 8</span></li>
    <li><span class="name">ROE</span><span class="value">15.2 %</span></li></ul>
    <section id="quarters"><table><tr><th>x</th></tr><tr><td>EPS in Rs</td><td>1</td><td>2.5</td></tr></table></section>
    <section id="profit-loss"><table><tr><td>Sales +</td><td>50</td><td>100</td><td>150</td></tr><tr><td>Net Profit</td><td>1</td><td>2</td><td>15</td></tr></table></section>
    <section id="shareholding"><table><tbody><tr><td>Promoters</td><td>40%</td><td>51.5%</td></tr><tr><td>FIIs</td><td>1%</td><td>9%</td></tr></tbody></table></section>"""
    pages = spark.createDataFrame([(1, html), (2, "<p>nothing<br></p>"), (3, None)], "page_id bigint, html string")
    out = html_fields.fundamentals(pages).collect()
    assert [r.page_id for r in out] == [1]
    r = out[0]
    assert (r.pe_ratio, r.roe, r.eps, r.revenue_cr, r.promoter_holding, r.fii_holding) == (23.5, 15.2, 2.5, 150, 51.5, 9)
    assert r.revenue_growth == pytest.approx(50) and r.net_profit_margin == pytest.approx(10)


def test_scalars(spark):
    df = spark.createDataFrame([("₹2,345.67", 250000.0, -1234.5), ("23.5 %", None, 12.0), ("n/a", -999999.0, 0.0)], "t string, a double, b double")
    out = df.select(SC.clean_number(F.col("t")).alias("n"), SC.format_money(F.col("a")).alias("m"), SC.format_money(F.col("b")).alias("k"), SC.format_percent(F.col("b")).alias("p")).collect()
    assert [r.n for r in out] == [2345.67, 23.5, None]
    assert [r.m for r in out] == ["₹2.50L", "–", "₹-10.00L"]
    assert out[0].k == "₹-1,234.50" and out[1].p == "+12.0%"


def test_context_pivot_and_bar_cleaning(spark):
    long = spark.createDataFrame([(D(2020, 1, 1), "nifty200", 10.0), (D(2020, 1, 2), "nifty200", 11.0), (D(2020, 1, 2), "dxy", 90.0)], "date date, name string, close double")
    w = tables.context_features(tables.pivot_series(long)).orderBy("date").collect()
    assert w[1].nifty200_1d_ret == pytest.approx(10) and w[0].dxy is None and w[1].dxy == 90
    raw = spark.createDataFrame([("A", D(2020, 1, 1), None, 5.0), ("A", D(2020, 1, 2), 4.0, None)], "symbol string, date date, open double, close double")
    out = tables.clean_bars(raw).collect()
    assert len(out) == 1 and out[0].open == 5 and out[0].volume == 0 and out[0].adj_close == 5


def test_open_position_is_appended(spark):
    pos = spark.createDataFrame([], "holding_id string, symbol string, timeframe string, qty bigint, avg_cost double, entry_date date, target double, stop_loss double, strategy_id string, is_active boolean")
    new = spark.createDataFrame([("A", "swing", 3, 10.0, 12.0, 9.0, "S001")], "symbol string, timeframe string, qty bigint, avg_cost double, target double, stop_loss double, strategy_id string")
    r = portfolio.open_positions(pos, new, "2020-01-01").first()
    assert r.is_active and r.entry_date == D(2020, 1, 1) and len(r.holding_id) == 64


def test_recommendation_order(spark):
    rows = [(-16.0, "bull", "bull", 50.0, 1.0, 2.0, 0.0), (1.0, "bear", "bear", 50.0, 1.0, 2.0, 0.0), (1.0, "bull", "bear", 30.0, 1.0, 2.0, 0.0),
            (-12.0, "bull", "neutral", 50.0, 3.0, 2.0, 20.0), (-12.0, "bull", "neutral", 50.0, 3.0, 2.0, 10.0)]
    df = spark.createDataFrame(rows, "pnl_pct double, stock_cycle string, market_cycle string, rsi_14 double, close double, sma_200 double, roe double")
    assert [r.recommendation for r in portfolio.recommend(df).collect()] == ["EXIT", "EXIT", "EXIT", "AVERAGE_DOWN", "HOLD"]


def test_pattern_tables(spark, small):
    from tapeflow.operators import patterns
    from tapeflow.sources import testdata as td
    named = patterns.name_states(patterns.fit_states(td.bars(spark, small))).persist()
    p = patterns.pattern_rows(named)
    cur = {r.symbol: r.current_state for r in patterns.current_states(named).collect()}
    assert patterns.state_history(named).count() == named.count()
    hist = patterns.state_history(named, 500)
    assert hist.groupBy("symbol").count().agg(F.max("count")).first()[0] <= 500
    assert p.count() == named.select("symbol").distinct().count()
    last = {r.symbol: r.state for r in hist.groupBy("symbol").agg(F.max_by("state", "date").alias("state")).collect()}
    assert cur == last and len(cur) > 0
    named.unpersist()


def test_model_confidence_overrides_the_rule_score(spark):
    from tapeflow.operators import signals
    df = bars(spark, [10.0] * 12, sector=F.lit("X"), sector_cycle=F.lit("bull"), atr_14=F.lit(0.5), rsi_14=F.lit(60.0), adx_14=F.lit(30.0),
              supertrend_dir=F.lit(-1.0), macd_hist=F.lit(1.0), volume_ratio=F.lit(2.0), supertrend=F.lit(9.0), ichimoku_senkou_a=F.lit(1.0),
              ichimoku_senkou_b=F.lit(1.0), prev_close=F.lit(10.0))
    doc = {"strategy_id": "T", "name": "Test", "timeframes": ["swing"], "parameters": {}, "stoploss_rules": {"type": "atr_based"},
           "entry_rules": {"logic": "AND", "conditions": [{"indicator": "rsi_14", "op": ">", "value": 50}]}}
    hits = signals.entries(df, [doc])
    regime = spark.createDataFrame([("market", None, "neutral"), ("stock", "A", "bull")], "scope string, scope_id string, cycle string")
    assert signals.generate(hits, regime, "2020-01-12 18:00:00").count() == 0
    got = signals.generate(hits, regime, "2020-01-12 18:00:00", model_confidence=F.lit(0.8)).collect()
    assert [(r.entry_price, r.stop_loss, r.target_price, r.risk_reward, r.stock_cycle) for r in got] == [(10.0, 9.0, 11.5, 1.5, "bull")]


def test_drawdown_batch_reports_the_first_price_of_a_day(spark):
    from tapeflow.streaming import alerts
    ts = datetime.datetime
    t = spark.createDataFrame([("A", ts(2020, 1, 1, 10), 95.0), ("A", ts(2020, 1, 1, 11), 80.0), ("A", ts(2020, 1, 1, 12), 70.0)], "symbol string, ts timestamp, price double")
    pos = spark.createDataFrame([("H", "A", "long_term", 100.0, True)], "holding_id string, symbol string, timeframe string, avg_cost double, is_active boolean")
    assert [r.ts.hour for r in alerts.drawdown_batch(t, pos).collect()] == [11]


def _orders(spark, n, symbols=("A", "NO_BARS")):
    sid = ST.STRATEGIES[0]["strategy_id"]
    trg = spark.createDataFrame([(f"{i:02d}", symbols[i % len(symbols)], sid, "swing", 100.0, 100.0, "eligible") for i in range(n)],
                                "trigger_id string, symbol string, strategy_id string, timeframe string, buy_below_price double, current_price double, status string")
    orders = trg.select("trigger_id", F.lit(None).cast("double").alias("override_price"), F.lit("n").alias("note"))
    ind = spark.createDataFrame([("A", 2.0)], "symbol string, atr_14 double")
    held = spark.createDataFrame([], "symbol string, timeframe string, strategy_id string, qty bigint, avg_cost double, is_active boolean")
    return triggers.confirm_buys(trg, orders, held, ind, ST.parsed(ST.catalog(spark)), "2020-01-31")


def test_buys_without_indicators_get_default_levels(spark):
    after, new = _orders(spark, 2)
    got = {r.symbol: r for r in new.collect()}
    assert set(got) == {"A", "NO_BARS"} and all(r.stop_loss < 100 < r.target for r in got.values())
    assert {r.status for r in after.collect()} == {"bought"}


def test_buys_of_a_batch_share_the_strategy_capital(spark):
    _, new = _orders(spark, 12)
    rows = new.orderBy("holding_id").collect()
    spent = sum(r.qty * r.avg_cost for r in rows)
    allowance = DEFAULTS.total_capital * DEFAULTS.timeframe_ratios["swing"]
    assert 0.9 * allowance < spent <= allowance
    assert [r.holding_id for r in rows] == [f"T-{i:02d}" for i in range(len(rows))]  # first come, first served


def test_recommendation_without_indicators(spark):
    df = spark.createDataFrame([(-12.0, None, "neutral", None, None, None, 20.0)],
                               "pnl_pct double, stock_cycle string, market_cycle string, rsi_14 double, close double, sma_200 double, roe double")
    assert portfolio.recommend(df).first().recommendation == "AVERAGE_DOWN"


def test_skipped_labels_do_not_end_the_search(spark):
    html = '<ul id="top-ratios"><li><span class="name">Price to book value</span><span class="value">3.5</span></li><li><span class="name">Book Value</span><span class="value">40</span></li></ul>'
    f = {r.field: r.value for r in html_fields.fields(spark.createDataFrame([(1, html)], "page_id bigint, html string")).collect()}
    assert f["pb_ratio"] == 3.5


def test_dedupe_without_an_order_is_stable(spark):
    df = spark.createDataFrame([("A", i, -i) for i in range(50)], "k string, x int, y int")
    assert {tuple(tables.dedupe(df.repartition(n), ["k"]).first()) for n in (1, 3, 7)} == {("A", 0, 0)}


def test_upsert_refuses_a_key_that_changes_its_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("A", 1, 2000)], "k string, x int, year int")
    tables.upsert_table(spark, path, old, ["k"], "year")
    with pytest.raises(ValueError):
        tables.upsert_table(spark, path, spark.createDataFrame([("A", 2, 2001)], old.schema), ["k"], "year")


def test_partial_bars_merge_to_the_bars_of_all_ticks(spark):
    from tapeflow.streaming import bars as B
    base = datetime.datetime(2024, 1, 1, 9, 15)
    ticks = spark.createDataFrame([("A", base + datetime.timedelta(seconds=(i * 37) % 900), float(100 + (i * 7) % 13), 1 + i % 3, i) for i in range(200)],
                                  "symbol string, ts timestamp_ntz, price double, volume bigint, seq bigint")
    parts = [B.partial_bars(ticks.where(F.col("seq") % 3 == k)) for k in range(3)]
    merged = B.merged_bars(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, B.tick_bars(ticks).collect()))


def test_limits_are_explicit(spark):
    from tapeflow.operators import replay
    df = spark.createDataFrame([("s", f"x{i}", float(i)) for i in range(300)], "strategy_id string, symbol string, sharpe_ratio double")
    assert replay.explore(df).count() == 300 and replay.explore(df, limit=200).count() == 200


def test_page_fields_need_no_shuffle(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for df in (html_fields.fundamentals(pages), html_fields.titles_and_links(pages)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_replay_sends_few_columns_to_python(spark, small):
    from tapeflow.operators import replay
    n = 70  # more flags than one long holds
    df = spark.createDataFrame([("A", D(2020, 1, 1), 1.0, "bull", *([True, False] * n), *([1.0, 2.0] * n))],
                               "symbol string, date date, close double, cycle string, " + ", ".join(f"{k}_{i} boolean" for i in range(n) for k in ("entry", "exit")) + ", "
                               + ", ".join(f"{k}_{i} double" for i in range(n) for k in ("stop", "target")))
    p = replay._packed(df, n)
    assert p.columns == ["symbol", "date", "close", "cycle", "entry", "exit", "levels"]
    r = p.first()
    assert r.entry == [2 ** 62 - 1, 2 ** 8 - 1] and r.exit == [0, 0] and r.levels == [1.0] * n + [2.0] * n


def test_checks_are_written_for_latest_rows_only(spark):
    cols = {c: F.col("close") + i for i, c in enumerate(("rsi_14", "adx_14", "macd_hist", "volume_ratio", "ema_20", "ema_50", "sma_200"))}
    df = bars(spark, [10.0, 9.0, 12.0, 8.5, 13.0] * 6, **cols)
    df = df.unionByName(df.where("rn < 9").withColumn("symbol", F.lit("B")))
    docs = ST.STRATEGIES
    got = triggers.latest_checks(df, docs)
    every = triggers.rule_checks(df, docs).select(*got.columns).collect()
    assert sorted(got.collect(), key=lambda r: r.symbol) == [max((r for r in every if r.symbol == s), key=lambda r: r.date) for s in ("A", "B")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("format_string") < plan.index("row_number()")
