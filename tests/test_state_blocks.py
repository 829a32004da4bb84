"""The block form of the hidden-state model against plain loops over one series."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeflow.operators import patterns as P
from tapeflow.operators import state_blocks as S

SIZES = {"A": 900, "B": 260, "C": 199, "D": 200}


@pytest.fixture(scope="module")
def x(spark):
    rows = []
    for s, n in SIZES.items():
        r, state, day = random.Random(s), 0, datetime.date(2001, 3, 5)
        for _ in range(n):
            state = r.choice([0, 1, 2]) if r.random() < 0.06 else state
            rows.append((s, day, r.gauss([-0.02, 0.0, 0.015][state], [0.02, 0.004, 0.01][state]), r.gauss([0.6, 0.0, 0.2][state], 0.3)))
            day += datetime.timedelta(r.choice([1, 1, 1, 3, 40 if r.random() < 0.02 else 1]))
    return spark.createDataFrame(rows, "symbol string, date date, ret double, vol double").repartition(5).cache()


def series(x, s):
    return np.array([(r.ret, r.vol) for r in x.where(F.col("symbol") == s).orderBy("date").collect()])


def loop_forward(dens, start, trans):
    """Scaled forward pass, one bar after the other: weights and log-likelihood."""
    a, ll, out = start, 0.0, []
    for t, d in enumerate(dens):
        a = (a if t == 0 else a @ trans) * np.exp(d - d.max())
        ll += np.log(a.sum()) + d.max()
        a = a / a.sum()
        out.append(a)
    return np.array(out), ll


def loop_round(x, start, trans, mean, var, floor):
    dens = P._log_density(x, mean, var)
    a, ll = loop_forward(dens, start, trans)
    e = np.exp(dens - dens.max(1, keepdims=True))
    b, g, moves = np.ones(len(start)), np.zeros_like(a), np.zeros_like(trans)
    for t in range(len(x) - 1, -1, -1):
        g[t] = a[t] * b / (a[t] * b).sum()
        if t:
            m = a[t - 1][:, None] * trans * (e[t] * b)[None, :]
            moves += m / m.sum()
            b = trans @ (e[t] * b)
            b = b / b.max()
    w = np.maximum(g.sum(0), 1e-12)[:, None]
    mean = g.T @ x / w
    return ll, g[0] / g[0].sum(), moves / moves.sum(1, keepdims=True), mean, np.maximum(g.T @ (x * x) / w - mean * mean, 0) + floor


def loop_path(dens, start, trans):
    best, back = np.log(start) + dens[0], []
    for d in dens[1:]:
        m = best[:, None] + np.log(trans)
        back.append(m.argmax(0))
        best = m.max(0) + d
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def model(r, k=3):
    return (np.array(r.start), np.array(r.trans).reshape(k, k), np.array(r["mean"]).reshape(k, 2), np.array(r["var"]).reshape(k, 2), np.array(r.floor))


def test_a_series_spreads_over_tasks(x):
    b = S.blocks(x, 64)
    assert b.where("symbol = 'A'").count() > 10 and b.where("head").count() == 3
    assert b.agg(F.max(F.size("ret"))).first()[0] <= 64
    assert {r.symbol: r.n for r in b.groupBy("symbol").agg(F.sum(F.size("ret")).alias("n")).collect()} == {s: n for s, n in SIZES.items() if n >= 200}


@pytest.mark.parametrize("width", [32, 100_000])
def test_round_equals_the_loop(x, width):
    b, first = S.blocks(x, width), S.first_models(x)
    score, better = S.one_round(b, first)
    got = {r.symbol: r for r in better.join(score, "symbol").collect()}
    assert sorted(got) == ["A", "B", "D"]
    for r in first.collect():
        ll, *want = loop_round(series(x, r.symbol), *model(r))
        assert got[r.symbol].score == pytest.approx(ll, rel=1e-12)
        for a, w in zip(model(got[r.symbol]), want):
            assert np.allclose(a, w, rtol=1e-9, atol=1e-12)


def test_fit_rises_and_equals_the_fit_of_one_group(x):
    b = S.blocks(x, 64)
    got = {r.symbol: r for r in S.fitted(b, S.first_models(x), n_iter=6, tol=1e-2).collect()}
    for s in ("A", "B", "D"):
        scores = got[s].scores
        assert len(scores) >= 2 and all(q >= p - 1e-9 for p, q in zip(scores, scores[1:])) and got[s].score == scores[-1]
        _, trans, score = P.fit(series(x, s), n_iter=6, tol=1e-2)
        assert got[s].score == pytest.approx(score, rel=1e-9) and np.allclose(model(got[s])[1], trans, atol=1e-9)


def test_series_that_converge_leave_the_rounds(x):
    got = S.fitted(S.blocks(x, 128), S.first_models(x), n_iter=9, tol=40.0).collect()
    assert len(got) == 3 and len({len(r.scores) for r in got}) > 1
    for r in got:
        assert r.scores[-1] - r.scores[-2] < 40.0 and all(q - p >= 40.0 for p, q in zip(r.scores, r.scores[1:-1]))


@pytest.mark.parametrize("width", [16, 300])
def test_path_equals_the_loop(x, width):
    first = S.first_models(x)
    found = S.best_paths(S.blocks(x, width), first)
    for r in first.collect():
        start, trans, mean, var, _ = model(r)
        own = series(x, r.symbol)
        got = found.where(F.col("symbol") == r.symbol).orderBy("date").collect()
        assert [g.state for g in got] == loop_path(P._log_density(own, mean, var), start, trans)
        assert [g.ret for g in got] == own[:, 0].tolist()


def test_columns_and_empty(spark, x):
    b, first = S.blocks(x), S.first_models(x)
    out = S.state_rows(b, S.fitted(b, first, n_iter=1))
    assert set(out.columns) == {f.split()[0] for f in P.STATE_SCHEMA.split(", ")}
    named = P.pattern_rows(P.name_states(out)).collect()
    assert len(named) == 3 and all(len(r.transition_matrix) == 3 and sum(r.transition_matrix[0]) == pytest.approx(1) for r in named)
    none = x.limit(0)
    assert S.best_paths(S.blocks(none), S.first_models(none)).count() == 0
    assert S.fitted(S.blocks(none), S.first_models(none)).count() == 0
