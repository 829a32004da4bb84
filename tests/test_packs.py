"""The packed indicator pass against the recursion of one series, the window functions and Spark's rounding."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeflow.operators import indicators as I
from tapeflow.operators import packs, recursive

COLUMNS = ("high", "low", "close", "volume")


def walk(n: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    o = np.concatenate((c[:1], c[:-1]))
    return {"high": np.maximum(o, c) * 1.005, "low": np.minimum(o, c) * 0.995, "close": c, "volume": rng.integers(0, 90, n).astype(float)}


def packed(some: list[dict]) -> list[dict]:
    lengths = np.array([len(s["close"]) for s in some])
    starts = np.cumsum(lengths) - lengths
    x = {c: np.concatenate([s[c] for s in some]) for c in COLUMNS}
    odd = np.array([not all(np.isfinite(s[c]).all() for c in COLUMNS[:3]) for s in some])
    with np.errstate(all="ignore"):
        out = packs.columns(x, starts, lengths, odd, np.zeros(len(x["close"]), bool))
    return [{c: v[a:a + n] for c, v in out.items()} for a, n in zip(starts, lengths, strict=True)]


def test_pack_equals_the_recursion():
    some = [walk(n, n) for n in (1, 2, 13, 14, 15, 40, 199, 200, 300, 301)] + [{c: np.full(60, 5.0) for c in COLUMNS}, walk(70, 1)]
    some[-1]["close"][3] = np.nan
    for s, got in zip(some, packed(some), strict=True):
        want = recursive.pack(*(s[c].copy() for c in COLUMNS[:3]))
        for c in recursive.COLUMNS:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_a_step_is_shared_by_all_series(monkeypatch):
    """Whole series never take the loop of one series, whose calls grew with their number."""
    monkeypatch.setattr(recursive, "pack", lambda *a: pytest.fail("one series at a time"))
    packed([walk(n, n) for n in range(260, 300)])


def test_panel_equals_the_windows(spark):
    rows = []
    for k, n in enumerate((30, 70, 270, 300)):
        s = walk(n, 50 + k)
        t = pd.DataFrame({"symbol": f"S{k}" if k else None, "date": pd.date_range("2000-01-03", periods=n).date, "open": s["close"], **s})
        t["volume"] = t["volume"].astype("int64")
        rows.append(t)
    bars = spark.createDataFrame(pd.concat(rows), "symbol string, date date, open double, high double, low double, close double, volume long")
    gone = F.dayofmonth("date") == 7
    bars = bars.withColumn("volume", F.when(~gone, F.col("volume"))).withColumn("close", F.when(~(gone & (F.col("symbol") == "S1")), F.col("close")))
    bars = bars.withColumn("date", F.when(~((F.col("symbol") == "S2") & (F.col("date") == "2000-03-01")), F.col("date"))).localCheckpoint()
    names = ["symbol", "date", "rn", *I.WINDOW_COLUMNS]
    got, want = (df.select(*names).toPandas().sort_values(["symbol", "rn"]).reset_index(drop=True) for df in (I.panel_indicators(bars), I.window_columns(bars)))
    assert len(got) == len(want) == 670
    for c in names[:3]:
        assert got[c].equals(want[c]), c
    for c in I.WINDOW_COLUMNS:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-7, err_msg=c)
    assert {r.symbol for r in I.indicators(bars, 250).select("symbol").distinct().collect()} == {"S2", "S3"}


def test_rounding_is_that_of_spark(spark):
    x = [0.00005, 0.00015, 1.00005, 2.67505, -0.00005, -0.0, 0.15625, 1234.56785, 123456789.12345, 1e14 + 0.5, 3e18, 0.1 + 0.2, 1e-30] + [k / 1e5 for k in range(1, 3000, 7)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 4) + 0.0).collect()]
    assert packs.rounded(np.array(x), 4).tolist() == want


def test_tables_end_with_a_series():
    import pyarrow as pa
    t = pa.table({"symbol": [None] * 3 + ["a"] * 5 + ["b"] * 9 + ["c"] * 2, "i": list(range(19))})
    cut = [x.to_pydict() for x in packs.whole_series(iter(t.to_batches(max_chunksize=2)), 4)]
    assert [i for c in cut for i in c["i"]] == list(range(19))
    assert all(not set(a["symbol"]) & set(b["symbol"]) for a, b in zip(cut, cut[1:], strict=False)) and len(cut) > 2


def test_last_rows_are_those_of_the_whole_series(spark):
    rows = []
    for k, n in enumerate((30, 70, 270)):
        s = walk(n, 70 + k)
        t = pd.DataFrame({"symbol": f"S{k}" if k else None, "date": pd.date_range("2000-01-03", periods=n).date, "open": s["close"], **s})
        t["volume"] = t["volume"].astype("int64")
        rows.append(t)
    bars = spark.createDataFrame(pd.concat(rows), "symbol string, date date, open double, high double, low double, close double, volume long").localCheckpoint()

    def shown(df):
        return df.select("symbol", "date", "rn", *I.INDICATORS).toPandas().sort_values(["symbol", "rn"]).reset_index(drop=True)

    whole = shown(I.indicators(bars, 0, 4))
    size = whole.groupby("symbol", dropna=False)["rn"].transform("max")
    pd.testing.assert_frame_equal(shown(I.indicators(bars, 0, 4, 40)), whole[whole["rn"] > size - 40].reset_index(drop=True))
    # Rows that are not asked never leave the pass, so no window follows it.
    plan = I.incremental(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and len(shown(I.incremental(bars))) == 30  # one series is long enough


def test_latest_signals_need_the_last_rows_only(spark, small):
    from tapeflow.functions.rules import look_back
    from tapeflow.operators import signals
    from tapeflow.operators.strategies import STRATEGIES
    from tapeflow.plans.q_strategies import panel

    n = look_back(STRATEGIES)
    assert n == 126

    def shown(p):
        hits = signals.entries(p, STRATEGIES).select("symbol", "date", "rn", "days_since_r100", "prev_close", F.to_json(F.struct("_hits")).alias("hits"))
        return sorted(map(str, hits.collect()))

    assert shown(panel(spark, small, last=n + 1)) == shown(panel(spark, small))
    kept = panel(spark, small, last=n + 1).groupBy("symbol").count().agg(F.max("count")).first()[0]
    assert kept == n + 1
