"""Indicators continued from carried state equal the full run."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeflow.operators import carried as K
from tapeflow.operators import indicators as I
from tapeflow.operators import recursive


def arrays(seed, n):
    r = random.Random(seed)
    close = [100.0]
    for _ in range(n - 1):
        close.append(close[-1] if r.random() < 0.15 else close[-1] * (1 + r.gauss(0, 0.02)))
    close = np.array(close)
    if seed % 2:
        close[n // 3:n // 3 + 40] = close[n // 3]  # flat, so that ratios are undefined
    spread = np.array([0 if r.random() < 0.2 else r.random() * 0.02 for _ in range(n)])
    return close * (1 + spread), close * (1 - spread), close


@pytest.mark.parametrize("seed", range(6))
def test_recurrences_in_pieces_equal_one_pass(seed):
    h, lo, c = arrays(seed, 420)
    want = recursive.pack(h.copy(), lo.copy(), c.copy())
    r = random.Random(seed)
    n, carry, got = 0, None, []
    while n < len(c):
        m = min(len(c), n + r.choice([1, 1, 2, 7, 60, 200]))
        state = K.Carry(carry)
        got.append(K.pack(state, n, {k: x[:n] for k, x in (("high", h), ("low", lo), ("close", c))}, h[n:m], lo[n:m], c[n:m]))
        assert not carry or state.at == len(carry)
        n, carry = m, state.new
    for k in recursive.COLUMNS:
        assert np.allclose(np.concatenate([g[k] for g in got]), want[k], rtol=1e-9, atol=1e-9, equal_nan=True), k


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for i, (s, n, skip) in enumerate([("A", 420, 0), ("B", 330, 60), ("C", 200, 0), ("D", 260, 160), ("E", 5, 415)]):
        h, lo, c = arrays(i, n)
        for k in range(n):
            rows.append((s, datetime.date(2020, 1, 1) + datetime.timedelta(skip + k), float(c[k]), float(h[k]), float(lo[k]), float(c[k]), (k * 37 + i) % 500))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume bigint").repartition(4).cache()


def values(df, columns):
    return {(r.symbol, r.date): [r[c] for c in columns] for r in df.collect()}


def close_to(got, want):
    assert sorted(got) == sorted(want)
    for k, row in want.items():
        for c, a, b in zip(I.INDICATORS, got[k], row):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-7, abs=1e-7)), (k, c, a, b)


def test_refreshes_equal_the_full_run(bars):
    want = values(I.indicators(bars), I.INDICATORS)
    cuts = [datetime.date(2020, 1, 1) + datetime.timedelta(d) for d in (0, 275, 276, 300, 310, 500)]
    state, got, longest = K.empty_state(bars), {}, 0
    for a, b in zip(cuts, cuts[1:]):
        rows, spans, state = K.refresh(state, bars.filter((F.col("date") >= a) & (F.col("date") < b)))
        assert set(rows.columns) == set(I.indicators(bars).columns)
        new = values(rows, I.INDICATORS)
        assert not set(new) & set(got)
        at = I.INDICATORS.index(K.LAGGING)
        for r in spans.collect():
            assert got[r.symbol, r.date][at] is None or got[r.symbol, r.date][at] == r[K.LAGGING]
            got[r.symbol, r.date][at] = r[K.LAGGING]
        got |= new
        longest = max(longest, state.agg(F.max(F.size("tail"))).first()[0])
    close_to(got, want)
    assert longest == K.TAIL
    assert {r.symbol: r.n for r in state.collect()} == {"A": 420, "B": 330, "C": 200, "D": 260, "E": 5}


def test_a_symbol_that_grows_long_enough_returns_all_its_rows(bars):
    cut = datetime.date(2020, 1, 1) + datetime.timedelta(300)
    rows, _, state = K.refresh(K.empty_state(bars), bars.filter(F.col("date") < cut))
    assert {r.symbol for r in rows.select("symbol").distinct().collect()} == {"A"} and state.count() == 4
    rows, _, _ = K.refresh(state, bars.filter(F.col("date") >= cut))
    n = {r.symbol: r["count"] for r in rows.groupBy("symbol").count().collect()}
    assert n == {"A": 120, "B": 330, "D": 260}


def test_nothing_new_and_late_bars(bars):
    a = bars.filter("symbol in ('A', 'E')")
    _, _, state = K.refresh(K.empty_state(bars), a)
    rows, spans, same = K.refresh(state, a.limit(0))
    assert rows.count() == spans.count() == 0 and sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, state.collect()), key=str)
    late = a.filter("symbol = 'A'").orderBy("date").limit(3)
    rows, _, same = K.refresh(state, late)
    assert rows.count() == 0 and same.count() == 2 and K.late_bars(state, late).count() == 3
    assert K.refresh(K.empty_state(bars), a.limit(0))[2].count() == 0


def test_a_refresh_reads_new_bars_and_state_only(spark, bars, tmp_path):
    """No scan of earlier bars: what a refresh reads is the state and the new bars, and its rows come from what it stored."""
    cut = datetime.date(2021, 2, 1)
    _, _, state = K.refresh(K.empty_state(bars), bars.filter(F.col("date") < cut))
    state.write.parquet(str(tmp_path / "state"))
    bars.filter(F.col("date") >= cut).write.parquet(str(tmp_path / "new"))
    read = {}
    stored = K.stored
    try:
        K.stored = lambda df, purpose: (read.update(files=df.inputFiles()), stored(df, purpose))[1]
        rows, _, _ = K.refresh(spark.read.parquet(str(tmp_path / "state")), spark.read.parquet(str(tmp_path / "new")))
    finally:
        K.stored = stored
    assert {f.split("/")[-2] for f in read["files"]} == {"state", "new"}
    assert all("/carried-" in f for f in rows.inputFiles()) and rows.count() > 0
