"""What the rule panel writes to disk, and that values made in the indicator pass are those of the windows."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeflow.functions.rules import look_back_column, look_backs
from tapeflow.operators import indicators as I
from tapeflow.operators import replay as P
from tapeflow.operators.strategies import STRATEGIES
from tapeflow.session import stored


def bars_of(spark, lengths: dict, seed: int = 3):
    rng, rows = np.random.default_rng(seed), []
    for symbol, n in lengths.items():
        c = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
        c[n // 2:n // 2 + 12] = c[n // 2]  # equal prices: no range
        o = np.concatenate((c[:1], c[:-1]))
        rows.append(pd.DataFrame({"symbol": symbol, "date": pd.date_range("2000-01-03", periods=n).date, "open": o, "high": np.maximum(o, c) * 1.005,
                                  "low": np.minimum(o, c) * 0.995, "close": c, "volume": rng.integers(0, 90, n)}))
    return spark.createDataFrame(pd.concat(rows), "symbol string, date date, open double, high double, low double, close double, volume long")


@pytest.fixture(scope="module")
def tables(spark):
    bars = bars_of(spark, {"A": 420, "B": 300, "C": 270, "D": 260, None: 255, "short": 20}).localCheckpoint()
    stocks = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y"), ("C", "x")], "symbol string, sector string")  # C has two rows, D none
    index = bars.groupBy("date").agg(F.avg("close").alias("nifty200_close"))
    sectors = bars.join(stocks, "symbol").groupBy("date", "sector").agg(F.avg("close").alias("close"))
    reports = spark.createDataFrame([("A", "2000-02-01", 9.0), ("A", "2000-05-01", 30.0), ("B", "2000-03-01", 14.0)], "symbol string, period string, pe_ratio double").select(
        "symbol", F.col("period").cast("date").alias("period_end"), "pe_ratio", (F.col("pe_ratio") * 2).alias("roe"), (F.col("pe_ratio") + 1).alias("revenue_growth"))
    return bars, index, stocks, sectors, reports


@pytest.fixture(scope="module")
def panel(tables):
    return P.rule_panel(*tables).localCheckpoint()


def test_look_back_columns_equal_the_windows(panel):
    held = [look_back_column(*x) for x in look_backs(STRATEGIES, panel.columns)]
    assert len(held) > 5 and set(held) <= set(panel.columns)
    one = panel.filter("symbol is null or symbol <> 'C'")  # its dates come twice

    def shown(df):
        return sorted(map(str, P.signal_columns(df, STRATEGIES).collect()))

    assert shown(one) == shown(one.drop(*held))
    assert one.count() == 420 + 300 + 260 + 255


def test_past_columns_equal_the_windows(panel):
    one = panel.filter("symbol is null or symbol <> 'C'")
    w = I.series()
    want = I.williams_reversal(I.momentum_252(one.drop(*I.PAST_COLUMNS))).withColumn("prev_close", F.lag("close").over(w))
    assert dict(want.dtypes)["days_since_r100"] == dict(panel.dtypes)["days_since_r100"] == "int"
    got, want = (df.select("symbol", "date", *[F.round(c, 9).alias(c) for c in I.PAST_COLUMNS]) for df in (one, want))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got.filter("williams_r_10 is null and prev_close is not null").count() > 0 and got.filter("r_252 is not null").count() == 168 + 48 + 8 + 3


def test_cross_section_of_the_panel(panel):
    """A bar has a row for each row of its symbol among the stocks, ranked in the sector of that row."""
    assert panel.filter("symbol = 'C'").groupBy("sector").count().collect() and panel.filter("symbol = 'C'").count() == 540
    assert {r.sector for r in panel.filter("symbol = 'D' or symbol is null").select("sector").distinct().collect()} == {"Unknown"}
    t = panel.select("symbol", "date", "sector", "rs_nifty200", "rs_percentile", "pe_ratio", "pe_vs_sector").toPandas()
    groups = t.groupby(["sector", "date"])
    rs = t["rs_nifty200"]
    least, n = groups["rs_nifty200"].rank(method="min"), groups["rs_nifty200"].transform("count")
    want = ((least - 1) / (n - 1).where(n > 1, 1) * 100).where(rs.notna())
    np.testing.assert_allclose(t["rs_percentile"].to_numpy(float), want.to_numpy(float))
    pe = t["pe_ratio"].fillna(20.0) / groups["pe_ratio"].transform("mean").fillna(20.0)
    np.testing.assert_allclose(t["pe_vs_sector"].to_numpy(float), pe.to_numpy(float))
    assert panel.filter("symbol = 'A' and date = '2000-05-01'").first().pe_ratio == 30.0 and panel.filter("symbol = 'A' and date = '2000-04-30'").first().pe_ratio == 9.0


def test_wide_rows_are_never_dealt_out(tables):
    """Windows of past values and rules moved some 40 columns a bar to disk once more after the indicator pass."""
    p = P.rule_panel(*tables)
    for df in (P.backtest(p, STRATEGIES, whole=True), P.signal_columns(p, STRATEGIES)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        above = plan[:plan.rindex("MapInArrow")]
        assert "Exchange" not in above and "Window" not in above
        assert plan.count("Exchange hashpartitioning(symbol") == 1  # bars, ranks and reports meet once


def test_trades_of_whole_partitions(panel, tables):
    rows = [sorted(map(str, P.backtest(p, STRATEGIES, whole=whole).filter("symbol is null or symbol <> 'C'").collect()))
            for p, whole in ((P.rule_panel(*tables), True), (panel.repartition(3), False))]
    assert rows[0] == rows[1] and len(rows[0]) > 5


def test_stored_steps_leave_no_shuffle_files(spark):
    from tapeflow.session import RELEASE
    before = spark.conf.get(RELEASE)
    dirs = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    old = files()
    out = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert not [f for f in files() - old if f.endswith(".data")] and spark.conf.get(RELEASE) == before
    assert out.count() == 7


def test_a_sweep_does_not_copy_the_panel(spark, panel):
    """Every chunk of candidates took a copy of all rows through a shuffle."""
    from tapeflow.operators import sweep as SW
    cand = SW.candidates(spark, 4)
    df = SW.fitness(panel, cand, 1, chunk=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "FlatMapGroups" not in plan and plan.count("MapInArrow") == 1
    got = [sorted(map(str, x.select("candidate_id", F.round("sharpe", 9), F.round("win_rate", 9), "n_trades").collect())) for x in (df, SW.fitness(panel, cand, 1))]
    assert got[0] == got[1] and len(got[0]) > 2


def test_latest_checks_and_entries_leave_one_row_a_symbol(panel, tables):
    """Windows dealt out all rows of the panel, or the last 127 of each symbol, to judge the latest one."""
    from tapeflow.operators import signals, triggers
    one = panel.filter("symbol is null or symbol <> 'C'")
    for judge in (signals.entries, triggers.latest_checks):
        plan = judge(P.rule_panel(*tables, last=1), STRATEGIES)._jdf.queryExecution().executedPlan().toString()
        above = plan[:plan.rindex("MapInArrow")]
        assert "lag(" not in above and "min(" not in above and above.count("Exchange") == 1 and "WindowGroupLimit" in above[above.rindex("Exchange"):]
        last = P.rule_panel(*tables, last=1).filter("symbol is null or symbol <> 'C'")
        got, want = (sorted(map(str, judge(x, STRATEGIES).select("symbol", "date", F.to_json(F.struct("*"))).collect())) for x in (last, one))
        assert len(got) == 4 and got == want


def test_stock_training_rows_are_one_shuffle(spark, tables):
    """The wide indicator rows were dealt out for relative strength and again to meet their labels."""
    from tapeflow.operators import classify as C
    from tapeflow.operators import regimes as R
    from tapeflow.plans.q_signals import stock_rows
    from tapeflow.sources import testdata as td
    b = tables[0].withColumn("close", F.when((F.col("symbol") != "B") | (F.dayofmonth("date") != 7), F.col("close"))).localCheckpoint()
    df = stock_rows(spark, None, b)
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.rindex("MapInArrow")]
    assert "Exchange hashpartitioning" not in above and "SortMergeJoin" not in above and plan.count("Exchange hashpartitioning(symbol") == 1
    index = td.market_index(spark, None, b)
    lab = R.cycle_rows(R.label(b.select(F.lit("stock").alias("scope"), F.col("symbol").alias("scope_id"), "date", "close")))
    want = C.dataset(C.stock_features(I.relative_strength(I.indicators(b), index), index), lab, "stock", C.STOCK_FEATURES, "symbol")
    got, want = (x.select("symbol", "date", "cycle", *[F.round(c, 9).alias(c) for c in C.feature_columns(want)]) for x in (df, want))
    assert df.columns == ["date", "symbol", "cycle", *C.feature_columns(df)] and got.count() > 800
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_rows_without_a_date_are_walked_last(spark):
    rows = spark.createDataFrame([("A", None, 1.0), ("A", "2000-01-05", 3.0), ("A", "2000-01-04", 2.0), (None, "2000-01-04", 5.0), (None, None, 4.0)], "symbol string, day string, x double").select(
        "symbol", F.col("day").cast("date").alias("date"), "x")
    for df, whole in ((rows, False), (rows.coalesce(1).sortWithinPartitions("symbol", "date"), True)):
        got = P.by_series(df, lambda t: t.select(["symbol"]).slice(0, 1).append_column("xs", P.pa.array([t.column("x").to_pylist()])), "symbol string, xs array<double>", whole).collect()
        assert {r.symbol: r.xs for r in got} == {"A": [2.0, 3.0, 1.0], None: [5.0, 4.0]}
