import numpy as np

from tapeflow.operators import patterns, recursive
from tapeflow.operators.replay import walk


def series(seed, n):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return close * (1 + rng.uniform(0, 0.01, n)), close * (1 - rng.uniform(0, 0.01, n)), close


def test_ema_is_seeded_with_the_mean():
    x = np.arange(1.0, 11.0)
    got = recursive.ema(x, 4)
    assert np.isnan(got[:3]).all() and got[3] == 2.5
    assert np.isclose(got[4], 2.5 + 0.4 * (5 - 2.5))
    assert np.isnan(recursive.ema(x[:3], 4)).all()


def test_wilder_and_rsi_by_hand():
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose(recursive.wilder(x, 2)[1:], [1.5, 2.75])
    up = np.linspace(1, 40, 40)
    assert np.allclose(recursive.rsi(up, 14)[14:], 100)


def test_supertrend_follows_its_bands():
    h, lo, c = series(3, 400)
    line, side = recursive.supertrend(h, lo, c, recursive.wilder(recursive.true_range(h, lo, c), 10, 0))
    assert np.isnan(line[0]) and side[0] == 0 and side[1] == 1
    up, down = side[2:] == -1, side[2:] == 1
    assert up.any() and down.any()
    assert (c[2:][up] >= line[2:][up]).all() and (c[2:][down] <= line[2:][down]).all()


def test_sar_is_below_price_in_long_phases():
    h, lo, c = series(4, 400)
    sar = recursive.parabolic_sar(h, lo)
    ok = np.isfinite(sar)
    assert 0 < ok.sum() < 400
    assert (sar[ok] <= h[ok]).all()


def naive_walk(close, entry, exit_, stop, target, trail, warmup):
    out, pos = [], None
    for i in range(warmup, len(close)):
        if pos is None:
            if entry[i]:
                pos = [i, stop[i], target[i]]
            continue
        if close[i] <= pos[1]:
            out.append((pos[0], i, pos[1], 0))
        elif close[i] >= pos[2]:
            out.append((pos[0], i, pos[2], 1))
        elif exit_[i]:
            out.append((pos[0], i, close[i], 2))
        else:
            if trail is not None:
                pos[1] = max(pos[1], close[i] * (1 - trail))
            continue
        pos = None
    return out


def test_walk_equals_row_by_row_replay():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        _, _, close = series(seed, 900)
        entry, exit_ = rng.random(900) < 0.05, rng.random(900) < 0.01
        stop, target = np.where(entry, close * 0.93, np.nan), np.where(entry, close * 1.1, np.nan)
        for trail in (None, 0.05):
            a = walk(close, entry, exit_, stop, target, trail, 50)
            b = naive_walk(close, entry, exit_, stop, target, trail, 50)
            assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b]
            assert np.allclose([x[2] for x in a], [x[2] for x in b])
            assert all(p[1] < q[0] for p, q in zip(a, a[1:]))


def loop_posteriors(dens, start, trans):
    e = np.exp(dens)
    n, k = e.shape
    alpha, scale = np.empty((n, k)), np.empty(n)
    a = start * e[0]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ trans) * e[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = trans @ (e[t + 1] * beta[t + 1]) / scale[t + 1]
    return alpha * beta, np.log(scale).sum()


def test_forward_backward_equals_the_plain_loop():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (257, 2))
    mu, var = rng.normal(0, 1, (3, 2)), rng.uniform(0.5, 2, (3, 2))
    dens = patterns._log_density(x, mu, var)
    start, trans = np.array([0.2, 0.3, 0.5]), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.3, 0.6]])
    g, counts, ll = patterns._forward_backward(dens, start, trans)
    g2, ll2 = loop_posteriors(dens, start, trans)
    assert np.allclose(g, g2) and np.isclose(ll, ll2) and np.isclose(counts.sum(), 256)


def test_states_of_a_clear_series():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.002, 150) for m in (-0.02, 0.0, 0.02)])
    path, trans, _ = patterns.fit(np.column_stack([x, rng.normal(0, 1, 450)]))
    assert [len(set(path[i:i + 140])) for i in (5, 155, 305)] == [1, 1, 1]
    assert np.allclose(trans.sum(axis=1), 1)


def pattern_series(seed, n):
    rng = np.random.default_rng(seed)
    state = np.cumsum(rng.random(n) < 0.06) % 3
    return np.column_stack([rng.normal(np.array([-0.02, 0.0, 0.015])[state], np.array([0.02, 0.004, 0.01])[state]), rng.normal(np.array([0.6, 0.0, 0.2])[state], 0.3)])


def test_series_fitted_together_equal_each_alone():
    xs = [pattern_series(i, 200 + 37 * i) for i in range(9)] + [np.zeros((210, 2))]
    for n_iter in (3, 100):
        for x, (path, trans, score) in zip(xs, patterns.fit_many(xs, n_iter=n_iter), strict=True):
            want = patterns.fit(x, n_iter=n_iter)
            assert path.tolist() == want[0].tolist() and np.allclose(trans, want[1], atol=1e-9) and abs(score - want[2]) < 1e-6


def test_states_of_a_pack(spark, monkeypatch):
    """Series that go over several batches, one without a name, one too short; packs hold several series."""
    import datetime

    import pyarrow as pa
    rows = [(s, datetime.date(2001, 1, 1) + datetime.timedelta(d), *pattern_series(i, n)[d].tolist()) for i, (s, n) in enumerate([(None, 205), ("A", 260), ("B", 150), ("C", 200)]) for d in range(n)]
    t = pa.table(dict(zip(("symbol", "date", "ret", "vol"), zip(*rows), strict=True)))
    packs = list(patterns._packs(t.to_batches(max_chunksize=90), 200))
    assert [[(p.column("symbol")[0].as_py(), p.num_rows) for p in pack] for pack in packs] == [[(None, 205), ("A", 260), ("C", 200)]]
    x = spark.createDataFrame(rows, "symbol string, date date, ret double, vol double")
    monkeypatch.setattr(patterns, "features", lambda bars: bars)
    got = patterns.fit_states(x.repartition(3)).collect()
    for i, s in [(0, None), (1, "A"), (3, "C")]:
        own = sorted((r for r in got if r.symbol == s), key=lambda r: r.date)
        path, trans, score = patterns.fit(np.array([r[2:] for r in rows if r[0] == s]))
        assert [r.state for r in own] == path.tolist() and np.allclose(own[0].transition_matrix, trans, atol=1e-9) and abs(own[-1].score - score) < 1e-6
    assert len(got) == 665
