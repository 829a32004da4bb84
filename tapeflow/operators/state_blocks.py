"""The hidden-state model of ``patterns`` for series of any length: blocks of a series are rows, rounds are Spark jobs.

A series is cut into blocks of calendar time. The chain's step from one bar to the next is a matrix, and steps compose, so a block is summed up by one small matrix: a
(+, x) product for likelihoods and a (max, +) product for the best path. Each round of expectation-maximisation is then

1. one matrix per block, from the bars of the block alone,
2. a scan over the matrices of a series, as short as it has blocks: forward weights before each block, backward weights after it,
3. posteriors and sufficient statistics inside each block, summed per series in Spark,

and the best path is found likewise, with back-pointers over blocks in step 2 and inside blocks in step 3. Blocks of one series are handled by different
tasks and no task holds a series. Models are stored tables of a row per series, so a lost executor costs one step. Series that
have converged leave the rounds.

Defined results: series shorter than ``min_bars`` have no model; equal scores of a path go to the smaller state; missing returns and volumes are 0
(``patterns.features``); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.operators.patterns import MIN_BARS, N_ITER, TOL
from tapeflow.session import shared_folder, stored

WIDTH = 256  #: days of a block
MODEL = "symbol string, start array<double>, trans array<double>, mean array<double>, var array<double>, floor array<double>"
SERIES = ["ret", "vol"]


def blocks(x: DataFrame, width: int = WIDTH, min_bars: int = MIN_BARS) -> DataFrame:
    """(symbol, block, head, date, ret, vol) with arrays in the order of time, stored; ``head`` marks the first block of a series."""
    size = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first")).filter(F.col("n") >= min_bars)
    b = x.groupBy("symbol", F.floor(F.unix_date("date") / width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("date", *SERIES))).alias("bars"))
    own = b.join(size.select("symbol", "first"), "symbol")
    return stored(own.select("symbol", "block", (F.element_at("bars", 1)["date"] == F.col("first")).alias("head"), *[F.col(f"bars.{c}").alias(c) for c in ("date", *SERIES)]), "state-blocks")


def first_models(x: DataFrame, k: int = 3, min_bars: int = MIN_BARS) -> DataFrame:
    """Models that rounds start from: states are equal parts of the returns, ordered by size."""
    part = x.select("symbol", *SERIES, F.ntile(k).over(Window.partitionBy("symbol").orderBy("ret", "date")).alias("part"), F.lit(1).alias("one"))
    agg = [F.count("one").alias("n"), *[F.var_pop(c).alias(f"v_{c}") for c in SERIES]]
    for i in range(k):
        own = F.col("part") == i + 1
        agg += [f(F.when(own, F.col(c))).alias(f"{n}_{i}_{c}") for c in SERIES for n, f in (("m", F.avg), ("s", F.var_pop))]
    m = part.groupBy("symbol").agg(*agg).filter(F.col("n") >= min_bars)
    floor = {c: F.greatest(F.col(f"v_{c}"), F.lit(1e-12)) * 1e-3 for c in SERIES}
    off = 0.1 / max(k - 1, 1)
    trans = (np.full((k, k), off) + np.eye(k) * (0.9 - off)).ravel().tolist()
    return m.select("symbol", F.array(*[F.lit(1 / k)] * k).alias("start"), F.array(*[F.lit(t) for t in trans]).alias("trans"),
                    F.array(*[F.col(f"m_{i}_{c}") for i in range(k) for c in SERIES]).alias("mean"),
                    F.array(*[F.col(f"s_{i}_{c}") + floor[c] for i in range(k) for c in SERIES]).alias("var"), F.array(*floor.values()).alias("floor"))


class _Blocks:
    """The blocks of an Arrow batch as padded arrays, with the models of their series."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        def lists(name, width):
            return np.array(batch.column(name).flatten()).reshape(-1, *width)
        self.n, self.head = batch.num_rows, batch.column("head").to_numpy(zero_copy_only=False)
        self.start, self.trans = lists("start", (k,)), lists("trans", (k, k))
        mean, var = lists("mean", (k, 2)), lists("var", (k, 2))
        cut = batch.column("ret").offsets.to_numpy()
        self.size = np.diff(cut)
        self.length = int(self.size.max())
        self.inside = np.arange(self.length) < self.size[:, None]
        self.x = np.zeros((self.n, self.length, 2))
        for i, c in enumerate(SERIES):
            self.x[self.inside, i] = batch.column(c).flatten().to_numpy()
        d = self.x[:, :, None, :] - mean[:, None]
        self.density = -0.5 * (np.log(2 * np.pi * var)[:, None] + d * d / var[:, None]).sum(3)
        self.top = self.density.max(2)
        self.weight = np.exp(self.density - self.top[:, :, None])

    def step(self, t: int) -> np.ndarray:
        """Step matrices into bar t; the first bar of a series is entered with the start weights from anywhere."""
        first = (self.head & (t == 0))[:, None, None]
        return np.where(first, self.start[:, None, :], self.trans) * self.weight[:, t, None, :]


def _rows(batches, make: Callable[[pa.RecordBatch], list]):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(*make(batch))


def _nested(a: np.ndarray) -> pa.Array:
    a = a.reshape(len(a), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def _products(k: int):
    """The scaled product of all steps of each block."""
    def make(batch):
        b = _Blocks(batch, k)
        op, scale = np.broadcast_to(np.eye(k), (b.n, k, k)).copy(), np.zeros(b.n)
        for t in range(b.length):
            new, use = op @ b.step(t), b.inside[:, t]
            top = new.max((1, 2))
            op[use] = (new / top[:, None, None])[use]
            scale[use] += (np.log(top) + b.top[:, t])[use]
        return [batch.column("symbol"), batch.column("block"), _nested(op), pa.array(scale)], ["symbol", "block", "op", "scale"]
    return lambda batches: _rows(batches, make)


def _scan(k: int):
    """Weights before and after each block of a series, and the log-likelihood of the series."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        op = np.array(t.column("op").combine_chunks().flatten()).reshape(-1, k, k)
        n, total = len(op), float(t.column("scale").to_numpy().sum())
        before, after = np.full((n, k), 1 / k), np.ones((n, k))
        for i in range(n):
            a = before[i] @ op[i]
            total += np.log(a.sum())
            if i + 1 < n:
                before[i + 1] = a / a.sum()
        for i in range(n - 1, 0, -1):
            b = op[i] @ after[i]
            after[i - 1] = b / b.max()
        return pa.table([t.column("symbol"), t.column("block"), _nested(before), _nested(after), pa.array([total] * n)], names=["symbol", "block", "before", "after", "score"])
    return run


def _statistics(k: int):
    """Sums over the bars of each block: state weights, weighted values and squares, transitions, and the weights of a series' first bar."""
    def make(batch):
        b = _Blocks(batch, k)
        a, c = (np.array(batch.column(x).flatten()).reshape(-1, k) for x in ("before", "after"))
        fwd = np.zeros((b.n, b.length + 1, k))
        fwd[:, 0] = a
        for t in range(b.length):
            new = (fwd[:, t, None, :] @ b.step(t))[:, 0]
            fwd[:, t + 1] = np.where(b.inside[:, t, None], new / new.sum(1, keepdims=True), fwd[:, t])
        w, s1, s2 = np.zeros((b.n, k)), np.zeros((b.n, k, 2)), np.zeros((b.n, k, 2))
        moves, first = np.zeros((b.n, k, k)), np.zeros((b.n, k))
        for t in range(b.length - 1, -1, -1):
            use = b.inside[:, t, None]
            g = fwd[:, t + 1] * c
            g = np.where(use, g / g.sum(1, keepdims=True), 0.0)
            w += g
            x = b.x[:, t, None, :]
            s1 += g[:, :, None] * x
            s2 += g[:, :, None] * x * x
            entered = b.head & (t == 0)
            step = b.step(t)
            m = fwd[:, t, :, None] * step * c[:, None, :]
            moves += np.where((use[:, 0] & ~entered)[:, None, None], m / m.sum((1, 2), keepdims=True), 0.0)
            first[entered] = g[entered]
            back = (step @ c[:, :, None])[:, :, 0]
            c = np.where(use, back / back.max(1, keepdims=True), c)
        v = np.concatenate([y.reshape(b.n, -1) for y in (w, s1, s2, moves, first)], axis=1)
        return [batch.column("symbol"), _nested(v)], ["symbol", "v"]
    return lambda batches: _rows(batches, make)


def _improved(k: int, stats: DataFrame, models: DataFrame) -> DataFrame:
    """Models that the sums imply."""
    size = k + 4 * k + k * k + k
    total = stats.groupBy("symbol").agg(F.array(*[F.sum(F.element_at("v", i + 1)) for i in range(size)]).alias("v")).join(models.select("symbol", "floor"), "symbol")

    def v(i):
        return F.element_at("v", i + 1)

    weight = [F.greatest(v(i), F.lit(1e-12)) for i in range(k)]
    mean = [v(k + 2 * i + j) / weight[i] for i in range(k) for j in range(2)]
    square = [v(3 * k + 2 * i + j) / weight[i] for i in range(k) for j in range(2)]
    var = [F.greatest(s - m * m, F.lit(0.0)) + F.element_at("floor", n % 2 + 1) for n, (s, m) in enumerate(zip(square, mean, strict=True))]
    at, first = 5 * k, 5 * k + k * k
    row = [sum((v(at + k * i + j) for j in range(1, k)), v(at + k * i)) for i in range(k)]
    trans = [F.when(row[i] > 0, v(at + k * i + j) / F.greatest(row[i], F.lit(1e-300))).otherwise(1 / k) for i in range(k) for j in range(k)]
    begin = sum((v(first + i) for i in range(1, k)), v(first))
    return total.select("symbol", F.array(*[v(first + i) / begin for i in range(k)]).alias("start"), F.array(*trans).alias("trans"), F.array(*mean).alias("mean"), F.array(*var).alias("var"), "floor")


def weighed(bars: DataFrame, models: DataFrame, k: int = 3) -> DataFrame:
    """(symbol, block, before, after, score) for blocks of bars under the models."""
    ops = bars.join(models, "symbol").mapInArrow(_products(k), "symbol string, block bigint, op array<double>, scale double")
    return ops.groupBy("symbol").applyInArrow(_scan(k), "symbol string, block bigint, before array<double>, after array<double>, score double")


def one_round(bars: DataFrame, models: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Scores (symbol, score) of the models on their blocks, and the models that one round makes of them."""
    w = stored(weighed(bars, models, k), "state-weights")
    stats = bars.join(models, "symbol").join(w.select("symbol", "block", "before", "after"), ["symbol", "block"]).mapInArrow(_statistics(k), "symbol string, v array<double>")
    return w.groupBy("symbol").agg(F.first("score").alias("score")), _improved(k, stats, models)


def fitted(bars: DataFrame, models: DataFrame, k: int = 3, n_iter: int = N_ITER, tol: float = TOL) -> DataFrame:
    """Models after expectation-maximisation, with ``score`` and ``scores``, the log-likelihood before each round. A series stops when a
    round gains less than ``tol``."""
    spark = bars.sparkSession
    done = shared_folder(spark, "state-models")
    names = models.columns
    now = stored(models.withColumn("scores", F.array().cast("array<double>")), "state-round")
    for r in range(n_iter + 1):
        score, better = one_round(bars, now.select(*names), k)
        if r == n_iter:
            score, better = weighed(bars, now.select(*names), k).groupBy("symbol").agg(F.first("score").alias("score")), now.select(*names)
        seen = stored(now.join(score, "symbol").withColumn("scores", F.array_append("scores", F.col("score"))), "state-scores")
        last = F.try_element_at("scores", F.lit(-2))
        over = F.lit(True) if r == n_iter else F.coalesce(F.col("score") - last < tol, F.lit(False))
        seen.filter(over).write.parquet(f"{done}/round={r}")
        open_ = seen.filter(~over).select("symbol", "scores")
        if r == n_iter or open_.isEmpty():
            break
        now = stored(better.join(open_, "symbol"), "state-round")
    return spark.read.schema(seen.schema).parquet(*[f"{done}/round={i}" for i in range(r + 1)])


def _best_products(k: int):
    """The best score through each block for every state before and state at its end."""
    def make(batch):
        b = _Blocks(batch, k)
        start, trans = (np.log(np.maximum(x, 1e-300)) for x in (b.start, b.trans))
        op = np.full((b.n, k, k), -np.inf)
        op[:, np.arange(k), np.arange(k)] = 0.0
        for t in range(b.length):
            into = np.where((b.head & (t == 0))[:, None, None], start[:, None, :], trans)
            new = (op[:, :, :, None] + into[:, None]).max(2) + b.density[:, t, None, :]
            op = np.where(b.inside[:, t, None, None], new, op)
        return [batch.column("symbol"), batch.column("block"), _nested(op)], ["symbol", "block", "op"]
    return lambda batches: _rows(batches, make)


def _ends(k: int):
    """The states of the best path before and at the end of each block of a series."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        op = np.array(t.column("op").combine_chunks().flatten()).reshape(-1, k, k)
        best, back = np.zeros(k), np.zeros((len(op), k), np.int64)
        for i, o in enumerate(op):
            m = best[:, None] + o
            back[i], best = m.argmax(0), m.max(0)
        end = np.zeros(len(op), np.int64)
        state = int(best.argmax())
        for i in range(len(op) - 1, -1, -1):
            end[i], state = state, back[i, state]
        before = np.append([0], end[:-1])
        return pa.table([t.column("symbol"), t.column("block"), pa.array(before, pa.int32()), pa.array(end, pa.int32())], names=["symbol", "block", "entry", "exit"])
    return run


def _inner_paths(k: int):
    """The best path inside each block from the state before it to its last state."""
    def make(batch):
        b = _Blocks(batch, k)
        start, trans = (np.log(np.maximum(x, 1e-300)) for x in (b.start, b.trans))
        every = np.arange(b.n)
        best = np.full((b.n, k), -np.inf)
        best[every, batch.column("entry").to_numpy()] = 0.0
        back = np.zeros((b.n, b.length, k), np.int64)
        for t in range(b.length):
            into = np.where((b.head & (t == 0))[:, None, None], start[:, None, :], trans)
            m = best[:, :, None] + into
            back[:, t] = m.argmax(1)
            best = np.where(b.inside[:, t, None], m.max(1) + b.density[:, t], best)
        path = np.zeros((b.n, b.length), np.int32)
        state = batch.column("exit").to_numpy().astype(np.int64)
        for t in range(b.length - 1, -1, -1):
            path[:, t] = state
            state = np.where(b.inside[:, t], back[every, t, state], state)
        states = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b.size)]).astype(np.int32)), pa.array(path[b.inside]))
        dates, ret = (batch.column(c) for c in ("date", "ret"))
        return [batch.column("symbol"), dates, ret, states], ["symbol", "date", "ret", "state"]
    return lambda batches: _rows(batches, make)


def best_paths(bars: DataFrame, models: DataFrame, k: int = 3) -> DataFrame:
    """(symbol, date, ret, state): the most likely path of states under the models."""
    own = bars.join(models.select(*[f.split()[0] for f in MODEL.split(", ")]), "symbol")
    ops = own.mapInArrow(_best_products(k), "symbol string, block bigint, op array<double>")
    ends = ops.groupBy("symbol").applyInArrow(_ends(k), "symbol string, block bigint, entry int, exit int")
    paths = own.join(ends, ["symbol", "block"]).mapInArrow(_inner_paths(k), "symbol string, date array<date>, ret array<double>, state array<int>")
    return paths.select("symbol", F.inline(F.arrays_zip("date", "ret", "state")))


def state_rows(bars: DataFrame, models: DataFrame, k: int = 3) -> DataFrame:
    """The paths in the columns of ``patterns.fit_states``, for fitted models."""
    row = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice("trans", i * k + 1, k))
    about = models.select("symbol", F.lit(k).alias("n_states"), "score", row.alias("transition_matrix"))
    return best_paths(bars, models, k).join(about, "symbol")
