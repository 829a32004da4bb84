"""Language model scores by deleted interpolation.

A word is predicted by mixing maximum-likelihood estimates of trigram, bigram and unigram order, over all words, with a class model:
    P(w | u, v) = l3 c(u, v, w) / c(u, v) + l2 c(v, w) / c(v) + l1 c(w) / N + l0 Q(w | u, v)
An order whose context was never seen takes the estimate of the next lower one. The weights l depend on the bucket (powers of two) of
how often the context u, v was seen; expectation-maximisation learns them on a deleted part of the training texts with the counts of
the rest, after which the estimates use all of it.

Q gives words and contexts that were never seen their share. It maps words to symbols: the `TOP` most frequent training words have a
symbol each, every other word one of `CLASSES` drawn from its last bytes, and the end of a text one more. It mixes trigram, bigram,
unigram and uniform estimates of symbols in the same way, then takes the word inside its symbol by its training count plus one:
    Q(w | u, v) = (q3 P(s | u, v) + q2 P(s | v) + q1 P(s) + q0 / S) * (c(w) + 1) / (c(s) + V(s) + 1)
c(s), V(s) are the count and number of distinct words of the class; a symbol with one word has factor 1.

What goes to every task is bounded: `TOP` words, and tables of S**2 and S**3 symbol counts (S = TOP + CLASSES + 2). Counts of words,
bigrams and trigrams grow with the corpus and stay distributed. Documents are cut into blocks, hash groups of about `BLOCK_TOKENS`
tokens; a block cuts the sorted fingerprints of its distinct n-grams at ranges of fingerprints, whose number grows with the corpus.
It first sends outlines, the leading bits of the fingerprints, and learns which n-grams no other block can have: those keep the
counts they have there. Of the others it sends fingerprints and counts; each range sums them over the blocks and returns the
sums in the order in which they were sent. The statistics of expectation-maximisation are sums for each bucket.

Defined results: NULL text is empty and has only the end token; each input row gives one output row; documents with a NULL id
never train; with nothing to learn from the estimates are uniform. Words and n-grams are compared by 64-bit fingerprints.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import fold, mix, signed, stored, text_slices, tokens

FOLDS, HELD_OUT = 7, 2
DELETED = 3  #: the training fold on which the weights are learned
TOP = 95
CLASSES = 31
SYMBOLS = TOP + CLASSES + 2  # and the end of a text, and the start
END, START = TOP + CLASSES, TOP + CLASSES + 1
END_HASH = np.uint64(0xE0D)  #: stands for the end token among the fingerprints of words
START_HASH = np.uint64(0x57A)
BUCKETS = 24
BLOCK_TOKENS = 1 << 20
ROUNDS, SETTLED = 30, 1e-4  #: of expectation-maximisation: at most, and the change of a weight at which it ends
TRAIN, HELD, REST = range(3)  #: what a block holds: texts that train, deleted ones, others


def _text_tokens(batch: pa.RecordBatch):
    """(first row, rows, fingerprints with the end token after each text, class, row of each token)."""
    for at, n, data, off in text_slices(batch, "text"):
        h, row, _, end = tokens(data, off)
        low = data | np.uint8(0x20)
        tail = low[end - 1].astype(np.uint64) << np.uint64(8) | low[np.maximum(end - 2, 0)] if len(end) else np.zeros(0, np.uint64)
        kind = TOP + (mix(tail + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)
        stop = np.searchsorted(row, np.arange(n), side="right")
        yield at, n, np.insert(h, stop, END_HASH), np.insert(kind, stop, END), np.insert(row, stop, np.arange(n))


def _count_words(batches):
    """Counts of the words of a task; what exceeds half a million distinct words is sent on, so memory is bounded."""
    held, size = [], 0

    def squeezed():
        w, k, c, d = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(w, kind="stable")
        w, k, c, d = w[order], k[order], c[order], d[order]
        cut = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        return w[cut], k[cut], np.add.reduceat(c, cut), np.add.reduceat(d, cut)

    def batch_of(x):
        return pa.RecordBatch.from_arrays([pa.array(signed(x[0])), *[pa.array(y) for y in x[1:]]], names=["word", "kind", "n", "d"])

    for batch in batches:
        part = batch.column("deleted").to_numpy(zero_copy_only=False)
        for at, _, h, kind, row in _text_tokens(batch):
            w, first, at_w, c = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            held.append((w, kind[first].astype(np.int32), c.astype(np.int64), np.bincount(at_w[part[at + row]], minlength=len(w))))
            size += len(w)
            if size > 1 << 20:
                held = [squeezed()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield batch_of(held[0])
                    held, size = [], 0
    if held:
        yield batch_of(squeezed())


class _Symbols:
    def __init__(self, top: np.ndarray):
        self.order = np.argsort(top)
        self.words = top[self.order]

    def __call__(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return kind
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where((self.words[at] == h) & (kind != END), self.order[at], kind)


def _contexts(s: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols one and two places before, START before a text."""
    v = np.concatenate([[START], s[:-1]])
    v[np.concatenate([[True], row[1:] != row[:-1]])] = START
    u = np.concatenate([[START], v[:-1]])
    u[v == START] = START
    return u, v


def _count_grams(top):
    def run(batches):
        symbols, total = _Symbols(top), {}
        for batch in batches:
            part = batch.column("deleted").to_numpy(zero_copy_only=False).astype(np.int64)
            for at, _, h, kind, row in _text_tokens(batch):
                s = symbols(h, kind)
                u, v = _contexts(s, row)
                code = ((part[at + row] * SYMBOLS + u) * SYMBOLS + v) * SYMBOLS + s
                total.setdefault(0, np.zeros(2 * SYMBOLS ** 3, np.int64))
                total[0] += np.bincount(code, minlength=2 * SYMBOLS ** 3)
        if total:
            code = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[0][code])], names=["code", "n"])
    return run


class Model:
    """Symbol estimates of all orders and their mixture weights."""

    def __init__(self, train: np.ndarray, deleted: np.ndarray, top: np.ndarray, class_count: np.ndarray, class_words: np.ndarray, rounds: int = 30):
        self.top = top
        self.class_count, self.class_words = class_count, class_words
        self._set(train)
        code = np.flatnonzero(deleted)
        n = deleted.reshape(-1)[code].astype(np.float64)
        s, v, u = code % SYMBOLS, code // SYMBOLS % SYMBOLS, code // SYMBOLS ** 2
        self.weights = np.full((BUCKETS, 4), 0.25)
        p, b = self._parts(u, v, s)
        for _ in range(rounds if len(n) else 0):
            mass = self.weights[b] * p
            mass *= (n / mass.sum(1))[:, None]
            new = np.stack([np.bincount(b, mass[:, k], BUCKETS) for k in range(4)], 1) + 1e-3
            self.weights = new / new.sum(1, keepdims=True)
        self._set(train + deleted)

    def _set(self, count: np.ndarray) -> None:
        self.c3 = count.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        self.c2 = self.c3.sum(0)
        self.c1 = self.c2.sum(0)
        self.n3, self.n2 = self.c3.sum(2), self.c2.sum(1)

    def _parts(self, u, v, s) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the orders 3, 2, 1, 0 and the context bucket. An order whose context was never seen is uniform."""
        flat = 1.0 / (SYMBOLS - 1)

        def ratio(c, n):
            return np.where(n > 0, c / np.maximum(n, 1), flat)

        n3 = self.n3[u, v]
        p = np.stack([ratio(self.c3[u, v, s], n3), ratio(self.c2[v, s], self.n2[v]), ratio(self.c1[s], np.full(len(s), self.c1.sum())), np.full(len(s), flat)], 1)
        return p, np.minimum(np.ceil(np.log2(n3 + 1)).astype(np.int64), BUCKETS - 1)

    def prob(self, u, v, s, c) -> np.ndarray:
        """Q of words with the symbols `s` and the counts `c`."""
        p, b = self._parts(u, v, s)
        inside = np.where((s >= TOP) & (s < END), (c + 1) / (self.class_count[s] + self.class_words[s] + 1.0), 1.0)
        return (self.weights[b] * p).sum(1) * inside

    def without(self, train: np.ndarray, class_count: np.ndarray, class_words: np.ndarray) -> Model:
        """The same weights with the counts of a part."""
        out = copy.copy(self)
        out.class_count, out.class_words = class_count, class_words
        out._set(train)
        return out


def _packed(n: np.ndarray) -> bytes:
    """Counts, one byte each up to 254."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int64).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(data, np.int64, offset=size)
    return n


class _Block:
    """The tokens of a block of documents and its distinct n-grams in order of their fingerprints."""

    def __init__(self, texts: pa.Table):
        h, kind, row, self.slices, rows = [], [], [], [], 0
        for batch in texts.combine_chunks().to_batches():
            for at, n, words, k, r in _text_tokens(batch):
                h.append(words)
                kind.append(k)
                row.append(r + rows)
                self.slices.append(batch.slice(at, n))
                rows += n
        self.rows = rows
        self.h, self.kind, self.row = (np.concatenate(x) for x in (h, kind, row))
        self.first = np.concatenate([[True], self.row[1:] != self.row[:-1]])
        v = np.concatenate([[START_HASH], self.h[:-1]])
        v[self.first] = START_HASH
        u = np.concatenate([[START_HASH], v[:-1]])
        u[self.first] = START_HASH
        start = mix(np.array([START_HASH]) + np.uint64(1 << 41))
        one = mix(self.h + np.uint64(1 << 41))
        two = mix(mix(v + np.uint64(1 << 42)) + self.h)
        twice = mix(mix(np.array([START_HASH]) + np.uint64(1 << 42)) + START_HASH)
        three = mix(mix(mix(u + np.uint64(1 << 43)) + v) + self.h)
        self.grams, at = np.unique(np.concatenate([one, two, three, start, twice]), return_inverse=True)
        self.count = np.bincount(at)
        self.count[at[-2:]] += rows - 1  # each text begins with START, START
        n = len(self.h)
        self.one, self.two, self.three = at[:n], at[n:2 * n], at[2 * n:3 * n]
        # A context is the word or bigram that ends one token earlier.
        self.v, self.uv = np.concatenate([at[-2:-1], self.one[:-1]]), np.concatenate([at[-1:], self.two[:-1]])
        self.v[self.first], self.uv[self.first] = at[-2], at[-1]

    def estimates(self, count: np.ndarray, total: int, model: Model, tokens: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the orders 3, 2, 1 and Q, and the context bucket, by the counts of the n-grams."""
        s = _Symbols(model.top)(self.h, self.kind)
        u, v = _contexts(s, self.row)
        c1, n2, n3 = count[self.one[tokens]], count[self.v[tokens]], count[self.uv[tokens]]
        q = model.prob(u[tokens], v[tokens], s[tokens], c1)
        p1 = c1 / total if total else q
        p2 = np.where(n2 > 0, count[self.two[tokens]] / np.maximum(n2, 1), p1)
        p3 = np.where(n3 > 0, count[self.three[tokens]] / np.maximum(n3, 1), p2)
        return np.stack([p3, p2, p1, q], 1), np.minimum(np.ceil(np.log2(n3 + 1)).astype(np.int64), BUCKETS - 1)


def _gaps(x: np.ndarray) -> tuple[int, bytes]:
    """Sorted numbers as their differences, each in the few bytes (first result) that almost all of them need."""
    gap = np.diff(x, prepend=np.uint64(0))
    mean = int(x[-1] - x[0]) // len(x) if len(x) else 0
    width = min(8, (mean.bit_length() + 9) // 8)
    top = np.uint64((1 << 8 * width) - 1)
    return width, np.minimum(gap, top).view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + gap[gap >= top].tobytes()


def _ungapped(data: bytes, size: int, width: int) -> np.ndarray:
    raw = np.zeros((size, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, size * width).reshape(size, width)
    gap, top = raw.reshape(-1).view(np.uint64), np.uint64((1 << 8 * width) - 1)
    gap[gap == top] = np.frombuffer(data, np.uint64, offset=size * width)
    return np.cumsum(gap, dtype=np.uint64)


def _cells(own: _Block, ranges: int) -> np.ndarray:
    """Where the n-grams of a block are cut, at equal ranges of fingerprints."""
    return np.searchsorted((own.grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))


def _outlined(ranges: int, bits: int):
    """The first `bits` bits of the fingerprints of a block's n-grams."""
    def run(texts: pa.Table) -> pa.Table:
        own = _Block(texts)
        cut, short = _cells(own, ranges), own.grams >> np.uint64(64 - bits)
        live = np.flatnonzero(np.diff(cut))
        width, data = zip(*[_gaps(short[cut[i]:cut[i + 1]]) for i in live], strict=True)
        return pa.table({"range": live, "block": np.full(len(live), texts.column("block")[0].as_py()), "size": np.diff(cut)[live], "width": pa.array(width, pa.int64()), "grams": pa.array(data, pa.binary())})
    return run


def _parts(cells: pa.Table) -> list[np.ndarray]:
    return [_ungapped(*x) for x in zip(*[cells.column(c).to_pylist() for c in ("grams", "size", "width")], strict=True)]


def _met(cells: pa.Table) -> pa.Table:
    """For each part of a block in a range of fingerprints: which n-grams may be in another block too, a bit each."""
    parts = _parts(cells)
    _, at = np.unique(np.concatenate(parts), return_inverse=True)
    once = np.concatenate([np.diff(x, prepend=~x[:1]) != 0 for x in parts])  # of one block
    both = np.bincount(at[once])[at] > 1
    cut = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return pa.table({"block": cells.column("block"), "range": cells.column("range"), "whole": cells.column("size"),
                     "met": pa.array([np.packbits(both[i:j]).tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary())})


def _flags(met: pa.Table) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(x, np.uint8), count=k).astype(bool) for x, k in zip(met.column("met").to_pylist(), met.column("whole").to_pylist(), strict=True)]


def _sent(ranges: int):
    """The n-grams of a block that others may have (all, without `met`), and their counts."""
    def run(texts: pa.Table, met: pa.Table | None = None) -> pa.Table:
        own = _Block(texts)
        cut = _cells(own, ranges)
        live = np.flatnonzero(np.diff(cut))
        if met is None:
            met = pa.table({"block": np.full(len(live), texts.column("block")[0].as_py()), "range": live, "whole": np.diff(cut)[live],
                            "met": pa.array([np.packbits(np.ones(k, bool)).tobytes() for k in np.diff(cut)[live]], pa.binary())})
        met = met.sort_by("range")
        flags = _flags(met)
        if not np.array_equal(live, met.column("range").to_numpy()) or not np.array_equal(np.diff(cut)[live], met.column("whole").to_numpy()):
            raise ValueError("a block changed between two passes")
        picks = [np.flatnonzero(f) + cut[i] for i, f in zip(live, flags, strict=True)]
        width, data = zip(*[_gaps(own.grams[i]) for i in picks], strict=True)
        return pa.table({"range": live, "block": met.column("block"), "whole": met.column("whole"), "met": met.column("met"), "size": pa.array([len(i) for i in picks], pa.int64()),
                         "width": pa.array(width, pa.int64()), "grams": pa.array(data, pa.binary()), "n": pa.array([_packed(own.count[i]) for i in picks], pa.binary())})
    return run


def _summed(cells: pa.Table) -> pa.Table:
    """For each part of a block in a range of fingerprints: the counts of the n-grams sent in all texts that train, and in the deleted ones."""
    block, size = cells.column("block").to_numpy(), cells.column("size").to_numpy()
    grams, at = np.unique(np.concatenate(_parts(cells)), return_inverse=True)
    n = np.concatenate([_unpacked(x, k) for x, k in zip(cells.column("n").to_pylist(), size, strict=True)])
    cut, out = np.concatenate([[0], np.cumsum(size)]), []
    for kind in (TRAIN, HELD):
        use = np.repeat(block % 3 == kind, size)
        total = np.bincount(at[use], n[use], len(grams)).astype(np.int64)
        out.append(pa.array([_packed(total[at[i:j]]) for i, j in zip(cut, cut[1:], strict=False)], pa.binary()))
    return pa.table({"block": block, "range": cells.column("range"), "whole": cells.column("whole"), "met": cells.column("met"), "size": size, "n": out[0], "d": out[1]})


def _counts(own: _Block, totals: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams of a block: what `_summed` returned, and its own counts where no other block has the n-gram."""
    totals = totals.sort_by("range")
    met, size, kind = np.concatenate(_flags(totals)), totals.column("size").to_pylist(), totals.column("block")[0].as_py() % 3
    if len(met) != len(own.grams):
        raise ValueError("a block changed between two passes")
    out = []
    for c, of in (("n", TRAIN), ("d", HELD)):
        count = own.count.copy() if kind == of else np.zeros(len(met), np.int64)
        count[met] = np.concatenate([_unpacked(x, k) for x, k in zip(totals.column(c).to_pylist(), size, strict=True)])
        out.append(count)
    return out[0], out[1]


def _deleted_estimates(shared, total):
    """Estimates for each distinct trigram of a deleted block, by the counts of the other texts that train."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Block(left)
        _, first, n = np.unique(own.three, return_index=True, return_counts=True)
        p, b = own.estimates(_counts(own, right)[0], total, shared.value, first)
        return pa.table({"b": b, "n": n, **{f"p{k}": p[:, k] for k in range(4)}})
    return run


def _weights(estimates: DataFrame) -> np.ndarray:
    """Mixture weights for each context bucket by expectation-maximisation; a round is one sum over the stored estimates."""
    weights = np.full((BUCKETS, 4), 0.25)
    for _ in range(ROUNDS):
        mass = [F.array(*map(F.lit, weights[:, k].tolist()))[F.col("b")] * F.col(f"p{k}") for k in range(4)]
        new = np.full((BUCKETS, 4), 1e-3)
        parts = estimates.select("b", *[m.alias(f"m{k}") for k, m in enumerate(mass)], (F.col("n") / sum(mass[1:], mass[0])).alias("share"))
        for r in parts.groupBy("b").agg(*[F.sum(F.col(f"m{k}") * F.col("share")) for k in range(4)]).collect():
            new[r[0]] += r[1:]
        new /= new.sum(1, keepdims=True)
        old, weights = weights, new
        if np.abs(new - old).max() < SETTLED:
            break
    return weights


def _score(shared, weights, total, distinct):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Block(left)
        n, d = _counts(own, right)
        count = n + d
        p, b = own.estimates(count, total, shared.value)
        c, texts = count[own.one], pa.Table.from_batches(own.slices)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": np.bincount(own.row, minlength=own.rows),
            "n_known": np.bincount(own.row, c > 0, own.rows).astype(np.int64), "train_tokens": np.full(own.rows, total),
            "base_score": np.bincount(own.row, np.log10((c + 1) / (total + distinct + 1)), own.rows),
            "score": np.bincount(own.row, np.log10((weights[b] * p).sum(1)), own.rows)})
    return run


def scored(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), fold("doc_id", FOLDS).alias("fold"))
    train = own.where(F.col("fold") != HELD_OUT).select("text", (F.col("fold") == DELETED).alias("deleted"))
    counts = stored(train.mapInArrow(_count_words, "word bigint, kind int, n bigint, d bigint")
                    .groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"), F.sum("d").alias("d")), "words", release=True)
    ranked = counts.where(F.col("kind") != END).orderBy(F.col("n").desc(), "word").limit(TOP).toPandas()
    top = ranked.word.to_numpy(np.int64).view(np.uint64)
    classes = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.col("n") - F.col("d")).alias("fit_n"), F.count_if(F.col("n") > F.col("d")).alias("fit_v")).toPandas()
    by_class = {k: np.zeros(SYMBOLS, np.int64) for k in ("n", "v", "fit_n", "fit_v")}
    for k, x in by_class.items():
        x[classes.kind] = classes[k]
    total, distinct, fit_total = int(by_class["n"].sum()), int(by_class["v"].sum()), int(by_class["fit_n"].sum())
    for k, x in (("n", ranked.n), ("v", ranked.n > 0), ("fit_n", ranked.n - ranked.d), ("fit_v", ranked.n > ranked.d)):
        np.subtract.at(by_class[k], ranked.kind.to_numpy(np.int64), x.to_numpy(np.int64))
    grams = train.mapInArrow(_count_grams(top), "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # 2 * SYMBOLS**3 rows at most
    both = np.zeros(2 * SYMBOLS ** 3, np.int64)
    both[grams.column("code").to_numpy()] = grams.column("n").to_numpy()
    model = Model(*both.reshape(2, -1), top, by_class["n"], by_class["v"])
    fit = model.without(both[:SYMBOLS ** 3], by_class["fit_n"], by_class["fit_v"])

    blocks = [max(1, round(total * k / (FOLDS - 1) / block_tokens)) for k in (FOLDS - 2, 1, 1)]
    kind = F.when(F.col("fold") == DELETED, HELD).when(F.col("fold") != HELD_OUT, TRAIN).otherwise(REST)
    of_kind = F.when(kind == TRAIN, blocks[TRAIN]).when(kind == HELD, blocks[HELD]).otherwise(blocks[REST])
    placed = own.select("doc_id", F.coalesce(F.col("fold") == HELD_OUT, F.lit(True)).alias("held_out"), "text",
                        (F.pmod(F.xxhash64("doc_id", F.octet_length("text")), of_kind) * 3 + kind).cast("bigint").alias("block"))
    # Outlines of 1/16 false hits at most, had all texts no two n-grams alike.
    bits = min(64, max(32, (16 * 3 * max(total, 1) * FOLDS // (FOLDS - 1)).bit_length()))
    outlines = placed.groupBy("block").applyInArrow(_outlined(sum(blocks), bits), "range bigint, block bigint, size bigint, width bigint, grams binary")
    met = stored(outlines.groupBy("range").applyInArrow(_met, "block bigint, range bigint, whole bigint, met binary"), "met", release=True)
    sent = placed.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(
        _sent(sum(blocks)), "range bigint, block bigint, whole bigint, met binary, size bigint, width bigint, grams binary, n binary")
    totals = stored(sent.groupBy("range").applyInArrow(_summed, "block bigint, range bigint, whole bigint, met binary, size bigint, n binary, d binary"), "grams", release=True)
    deleted = F.col("block") % 3 == HELD
    estimates = stored(placed.where(deleted).groupBy("block").cogroup(totals.where(deleted).groupBy("block")).applyInArrow(
        _deleted_estimates(spark.sparkContext.broadcast(fit), fit_total), "b bigint, n bigint, p0 double, p1 double, p2 double, p3 double"), "estimates", release=True)
    return placed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _score(spark.sparkContext.broadcast(model), _weights(estimates), total, distinct),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
