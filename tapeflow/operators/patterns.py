"""Hidden-state patterns per symbol: a diagonal Gaussian hidden Markov model.

A task takes its symbols (daily series, bounded by the calendar) in packs of bounded size and fits a pack at a time: each step in time is
one operation over all series of the pack, and series that have converged leave it. ``fit`` is the same for one series, where forward
and backward passes are vectorised prefix products of scaled matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.windows import latest, series, trailing

STATE_SCHEMA = ("symbol string, date date, ret double, state int, n_states int, score double, "
                "transition_matrix array<array<double>>")
MIN_BARS = 200
N_ITER = 100
TOL = 1e-2
PACK_SERIES, PACK_BARS = 512, 1 << 17  #: of a pack, at most (a longer series is a pack of its own)


def features(bars: DataFrame) -> DataFrame:
    """Daily return and log volume against its 20-day mean; missing values are 0."""
    w = series()
    rn = F.row_number().over(w)
    v = F.when(rn >= 20, F.ln(F.nullif(F.col("volume"), F.lit(0)) / F.avg("volume").over(trailing(w, 20))))
    return bars.select("symbol", "date",
                       F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)).alias("ret"),
                       F.coalesce(v, F.lit(0.0)).alias("vol"))


def _log_density(x, mu, var):
    d = x[:, None, :] - mu
    return -0.5 * (np.log(2 * np.pi * var) + d * d / var).sum(axis=2)


def _prefix_products(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All products m[0] @ ... @ m[t], scaled to maximum 1, and the logarithms of the scales.

    Matrix products are associative, so doubling steps give all of them in
    log2(n) vectorised passes.
    """
    p, scale = m.copy(), np.zeros(len(m))
    d = 1
    while d < len(m):
        p[d:] = p[:-d] @ p[d:]
        scale[d:] = scale[:-d] + scale[d:]
        top = p.max(axis=(1, 2))
        p /= top[:, None, None]
        scale += np.log(top)
        d *= 2
    return p, scale


def _forward_backward(dens, start, trans):
    """State posteriors, expected transition counts and log-likelihood."""
    top = dens.max(axis=1, keepdims=True)
    e = np.exp(dens - top)
    step = trans[None, :, :] * e[1:, None, :]
    fwd, scale = _prefix_products(step)
    a0 = start * e[0]
    alpha = np.vstack([a0[None, :], a0 @ fwd])
    # Suffix products are prefix products of the transposed steps in reverse.
    bwd, _ = _prefix_products(step[::-1].transpose(0, 2, 1))
    beta = np.vstack([bwd[::-1].transpose(0, 2, 1).sum(axis=2), np.ones((1, dens.shape[1]))])
    beta /= beta.max(axis=1, keepdims=True)
    g = alpha * beta
    g /= g.sum(axis=1, keepdims=True)
    right = e[1:] * beta[1:]
    norm = ((alpha[:-1] @ trans) * right).sum(axis=1)
    counts = trans * ((alpha[:-1] / norm[:, None]).T @ right)
    return g, counts, float(np.log(alpha[-1].sum()) + scale[-1] + top.sum())


def _viterbi(dens, start, trans):
    n, _ = dens.shape
    lt = np.log(np.maximum(trans, 1e-300))
    best = np.log(np.maximum(start, 1e-300)) + dens[0]
    back = np.zeros(dens.shape, dtype=np.int64)
    for t in range(1, n):
        m = best[:, None] + lt
        back[t] = m.argmax(axis=0)
        best = m.max(axis=0) + dens[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit(x: np.ndarray, k: int = 3, n_iter: int = N_ITER, tol: float = TOL):
    """State path, transition matrix and log-likelihood. Starts from return quantiles."""
    order = np.argsort(x[:, 0], kind="stable")
    parts = np.array_split(order, k)
    floor = 1e-3 * np.maximum(x.var(axis=0), 1e-12)
    mu = np.array([x[p].mean(axis=0) for p in parts])
    var = np.array([x[p].var(axis=0) for p in parts]) + floor
    start, trans = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))
    last = -np.inf
    for _ in range(n_iter):
        g, counts, ll = _forward_backward(_log_density(x, mu, var), start, trans)
        if ll - last < tol:
            break
        last = ll
        w = np.maximum(g.sum(axis=0), 1e-12)[:, None]
        mu = g.T @ x / w
        var = np.maximum(g.T @ (x * x) / w - mu * mu, 0) + floor
        start = g[0] / g[0].sum()
        rows = counts.sum(axis=1, keepdims=True)
        trans = np.where(rows > 0, counts / np.maximum(rows, 1e-300), 1 / k)
    dens = _log_density(x, mu, var)
    _, _, score = _forward_backward(dens, start, trans)
    return _viterbi(dens, start, trans), trans, score


def _expected(dens: np.ndarray, inside: np.ndarray, start: np.ndarray, trans: np.ndarray, sums: bool = True):
    """``_forward_backward`` of many series: posteriors, expected transition counts (both None without ``sums``) and log-likelihoods.

    Axes are time, state and series. Past the end of a series every state weighs 1, so that nothing changes there."""
    top = dens.max(axis=1)
    e = np.where(inside[:, None], np.exp(dens - top[:, None]), 1.0)
    alpha, scale = np.empty_like(dens), np.empty_like(top)
    a = start
    for t in range(len(dens)):
        a = (a if t == 0 else (a[:, None] * trans).sum(axis=0)) * e[t]
        scale[t] = a.sum(axis=0)
        a = a / scale[t]
        alpha[t] = a
    ll = np.where(inside, np.log(scale) + top, 0.0).sum(axis=0)
    if not sums:
        return None, None, ll
    beta = np.empty_like(dens)
    beta[-1] = 1.0
    for t in range(len(dens) - 1, 0, -1):
        b = (trans * (e[t] * beta[t])).sum(axis=1)
        beta[t - 1] = b / b.max(axis=0)
    g = alpha * beta
    g /= g.sum(axis=1, keepdims=True)
    g *= inside[:, None]
    right = e[1:] * beta[1:]
    move = np.einsum("tis,ijs->tjs", alpha[:-1], trans) * right
    right *= (inside[1:] / move.sum(axis=1))[:, None]
    return g, trans * np.einsum("tis,tjs->ijs", alpha[:-1], right), ll


def _paths(dens: np.ndarray, inside: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """``_viterbi`` of many series: the states by time and series."""
    n, _, m = dens.shape
    lt, every = np.log(np.maximum(trans, 1e-300)), np.arange(m)
    best = np.log(np.maximum(start, 1e-300)) + dens[0]
    back = np.zeros(dens.shape, dtype=np.int8)
    for t in range(1, n):
        x = best[:, None] + lt
        back[t] = x.argmax(axis=0)
        best = np.where(inside[t], x.max(axis=0) + dens[t], best)
    path = np.empty((n, m), dtype=np.int64)
    state = best.argmax(axis=0)
    for t in range(n - 1, -1, -1):
        path[t] = state
        state = np.where(inside[t], back[t, state, every], state)
    return path


def _many_densities(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """``_log_density`` by time, state and series, from axes time, feature, series and state, feature, series."""
    d = x[:, None] - mu
    return -0.5 * (np.log(2 * np.pi * var) + d * d / var).sum(axis=2)


def fit_many(series_: list[np.ndarray], k: int = 3, n_iter: int = N_ITER, tol: float = TOL) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """``fit`` of each series, all at once."""
    size = np.array([len(x) for x in series_])
    inside = np.arange(size.max())[:, None] < size
    m = len(series_)
    x = np.zeros((len(inside), 2, m))
    mu, var, floor = np.empty((k, 2, m)), np.empty((k, 2, m)), np.empty((2, m))
    for i, own in enumerate(series_):
        x[:len(own), :, i] = own
        floor[:, i] = 1e-3 * np.maximum(own.var(axis=0), 1e-12)
        for j, part in enumerate(np.array_split(np.argsort(own[:, 0], kind="stable"), k)):
            mu[j, :, i], var[j, :, i] = own[part].mean(axis=0), own[part].var(axis=0) + floor[:, i]
    start = np.full((k, m), 1 / k)
    off = 0.1 / max(k - 1, 1)
    trans = np.repeat((np.full((k, k), off) + np.eye(k) * (0.9 - off))[:, :, None], m, axis=2)
    score, last, open_ = np.empty(m), np.full(m, -np.inf), np.arange(m)
    for _ in range(n_iter):
        n = size[open_].max()
        y, own = x[:n, :, open_], inside[:n, open_]
        g, counts, ll = _expected(_many_densities(y, mu[:, :, open_], var[:, :, open_]), own, start[:, open_], trans[:, :, open_])
        over = ll - last[open_] < tol
        score[open_[over]] = ll[over]
        w = np.maximum(g.sum(axis=0), 1e-12)[:, None]
        mean = np.einsum("tks,tfs->kfs", g, y) / w
        square = np.einsum("tks,tfs->kfs", g, y * y) / w
        rows = counts.sum(axis=1, keepdims=True)
        on, at = ~over, open_[~over]
        last[at], mu[:, :, at] = ll[on], mean[:, :, on]
        var[:, :, at] = (np.maximum(square - mean * mean, 0) + floor[:, open_])[:, :, on]
        start[:, at] = (g[0] / g[0].sum(axis=0))[:, on]
        trans[:, :, at] = np.where(rows > 0, counts / np.maximum(rows, 1e-300), 1 / k)[:, :, on]
        open_ = at
        if not len(open_):
            break
    dens = _many_densities(x, mu, var)
    if len(open_):
        score[open_] = _expected(dens[:, :, open_], inside[:, open_], start[:, open_], trans[:, :, open_], sums=False)[2]
    path = _paths(dens, inside, start, trans)
    return [(path[:n, i], trans[:, :, i], float(score[i])) for i, n in enumerate(size)]


def _series(batches):
    """Whole series (tables) out of rows in the order of symbol and date; the last one of a batch may go on in the next."""
    name, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, lo = pc.run_end_encode(batch.column("symbol")), 0
        for symbol, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if parts and symbol != name:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(lo, hi - lo))
            name, lo = symbol, hi
    if parts:
        yield pa.Table.from_batches(parts)


def _packs(batches, min_bars: int):
    """Lists of series of at least ``min_bars``."""
    pack, bars = [], 0
    for t in _series(batches):
        if t.num_rows < min_bars:
            continue
        pack.append(t)
        bars += t.num_rows
        if len(pack) == PACK_SERIES or bars >= PACK_BARS:
            yield pack
            pack, bars = [], 0
    if pack:
        yield pack


def fit_states(bars: DataFrame, k: int = 3, min_bars: int = MIN_BARS) -> DataFrame:
    """Most likely state of every bar, with the model's transition matrix and score."""
    names = [f.split()[0] for f in STATE_SCHEMA.split(", ")]

    def run(batches):
        for pack in _packs(batches, max(min_bars, 1)):
            fits = fit_many([np.column_stack([t.column("ret").to_numpy(), t.column("vol").to_numpy()]) for t in pack], k)
            for t, (path, trans, score) in zip(pack, fits, strict=True):
                n = t.num_rows
                inner = pa.ListArray.from_arrays(pa.array(np.arange(n * k + 1, dtype=np.int32) * k), pa.array(np.tile(trans.ravel(), n)))
                matrix = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), inner)
                own = [t.column(c).combine_chunks() for c in ("symbol", "date", "ret")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(path, pa.int32()), pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, score)), matrix], names=names)

    rows = features(bars).repartition("symbol").sortWithinPartitions("symbol", F.asc_nulls_last("date"))
    return rows.mapInArrow(run, STATE_SCHEMA)


def name_states(states: DataFrame) -> DataFrame:
    """Add ``state_label`` from the mean return of each state.

    With three states: highest Trending Up, lowest Declining, middle
    Consolidating. Otherwise by the sign of the mean beyond 0.001.
    """
    mean = F.avg("ret").over(Window.partitionBy("symbol", "state"))
    w = Window.partitionBy("symbol")
    named = states.repartition("symbol").withColumn("_m", mean)  # one exchange serves both windows
    named = named.withColumn("_r", F.dense_rank().over(w.orderBy("_m", "state")))
    named = named.withColumn("_n", F.max("_r").over(w))
    three = F.when(F.col("_r") == 3, "Trending Up").when(F.col("_r") == 1, "Declining").otherwise("Consolidating")
    other = F.when(F.col("_m") > 0.001, "Trending Up").when(F.col("_m") < -0.001, "Declining").otherwise("Consolidating")
    return named.withColumn("state_label", F.when(F.col("_n") == 3, three).otherwise(other)).drop("_m", "_r", "_n")


def current_states(named: DataFrame) -> DataFrame:
    """Last state per symbol with its name."""
    return named.groupBy("symbol").agg(F.max_by("state", "date").alias("current_state"),
                                       F.max_by("state_label", "date").alias("state_label"),
                                       F.first("n_states").alias("n_states"), F.first("score").alias("score"))


def pattern_rows(named: DataFrame) -> DataFrame:
    """Pattern table: current state, names and transition matrix. The states themselves stay a long table."""
    names = F.map_from_entries(F.collect_set(F.struct(F.col("state").cast("string"), "state_label")))
    return named.groupBy("symbol").agg(
        F.first("n_states").alias("n_states"), names.alias("state_labels"), F.first("transition_matrix").alias("transition_matrix"),
        F.max_by("state", "date").alias("current_state"), F.first("score").alias("score"))


def state_history(named: DataFrame, n: int | None = None) -> DataFrame:
    """(symbol, date, state); with ``n`` the last n of each symbol."""
    out = named.select("symbol", "date", "state")
    return out if n is None else latest(out, ["symbol"], "date", n)


def state_statistics(rows: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """Count, mean, sample deviation, win rate and Sharpe of returns per state."""
    r = F.col(ret)
    sd = F.stddev_samp(r)
    return rows.filter(r.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), (F.avg(r) * 100).alias("mean_ret"), (sd * 100).alias("vol"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.when(sd > 0, F.avg(r) / sd * float(np.sqrt(252))).otherwise(0.0).alias("sharpe"))
