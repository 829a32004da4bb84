"""Periodic runs of words, found by convolution of blocks at dyadic scales.

A run is a maximal stretch of words with smallest period q and a length of at least max(6, 4 q). For the periods q in [B, 2 B), B a power
of two, the words are cut into blocks of B. A run of such a period holds at least two neighbouring blocks that occur again q words
later. The sums of squared differences between a block and each place in the window that follows it are an exact integer convolution,
taken by a number-theoretic transform: words are mapped to numbers so small that no sum reaches the modulus, so a sum is zero if and only
if all mapped words agree. Distances of zero that neighbouring blocks share are seeds; a seed is extended to both sides on the words'
64-bit fingerprints, which also rejects what only the mapping made equal, and dropped if a divisor of its distance is a period too.

Two tests that no run can fail keep the convolutions few: each word of a block must occur again less than 2 B words later, and blocks whose window
lies inside a run of a smaller scale are left out (a longer primitive period cannot overlap a shorter one so far). Work for n words is therefore
about n log n for prose and at most n (log n)**2.

Everything is one scan without a shuffle: texts are read in slices of about a megabyte (a longer text is a slice of its own, its working memory
grows with it), and all texts of a slice are handled as one sequence with a separator after each.

Defined results: words are strings between blanks; NULL texts have no words; a text without runs has an empty list and its words joined by one space;
each row is handled by itself, so repeated rows, ids and NULL ids give a row each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import mix, plain_tokens, spaced, text_slices

LEAST, TIMES = 6, 4  #: a run has at least LEAST words and TIMES periods
PRIME = 2013265921  #: 15 * 2**27 + 1, so that transforms of up to 2**27 numbers exist
ROOT = 31  #: a primitive root of it
BATCH = 1 << 18  #: numbers that are transformed at once

_P = np.uint64(PRIME)
RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k:2 * k] = out[:k] * np.uint64(pow(base, k, PRIME)) % _P
        k *= 2
    return out


@lru_cache(maxsize=36)
def _kept_roots(half: int, inverse: bool) -> np.ndarray:
    r = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    return _powers(pow(r, -1, PRIME) if inverse else r, half)


def _roots(half: int, inverse: bool) -> np.ndarray:
    return _kept_roots(half, inverse) if half <= 1 << 16 else _kept_roots.__wrapped__(half, inverse)


def transformed(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), in place and in bit-reversed order."""
    half = x.shape[1] // 2
    while half:
        v = x.reshape(len(x), -1, 2, half)
        total, gap = v[:, :, 0] + v[:, :, 1], v[:, :, 0] + (_P - v[:, :, 1])
        v[:, :, 0] = np.minimum(total, total - _P)  # unsigned, so a negative difference is large
        v[:, :, 1] = gap * _roots(half, False) % _P
        half //= 2
    return x


def restored(x: np.ndarray) -> np.ndarray:
    """The inverse of `transformed`, in place."""
    size, half = x.shape[1], 1
    while half < size:
        v = x.reshape(len(x), -1, 2, half)
        turned = v[:, :, 1] * _roots(half, True) % _P
        total, gap = v[:, :, 0] + turned, v[:, :, 0] + (_P - turned)
        v[:, :, 0], v[:, :, 1] = np.minimum(total, total - _P), np.minimum(gap, gap - _P)
        half *= 2
    x *= np.uint64(pow(size, -1, PRIME))
    x %= _P
    return x


def occurrences(ids: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance): the `size` words from start[block] occur again `distance` words later, size <= distance < 2 * size.

    All such pairs, and rarely one whose words only agree as mapped."""
    limit = int(((PRIME - 1) / size) ** 0.5)  # size * (limit - 1)**2 < PRIME: sums are exact
    x = ids.astype(np.uint64)
    if len(x) and int(x.max()) >= limit:
        x = mix(x + np.uint64(size)) % np.uint64(limit)
    x = np.concatenate([x, np.zeros(3 * size, np.uint64)])
    squares = np.concatenate([[np.uint64(0)], np.cumsum(x * x)]).astype(np.int64)
    blocks, windows = (np.lib.stride_tricks.sliding_window_view(x, n) for n in (size, 2 * size))
    found, step = [], max(1, BATCH // (2 * size))
    for k in range(0, len(start), step):
        s = start[k:k + step]
        u = np.zeros((len(s), 2 * size), np.uint64)
        u[:, :size] = blocks[s][:, ::-1]
        w = transformed(windows[s + size].copy())
        product = restored(transformed(u) * w % _P)[:, size - 1:2 * size - 1].astype(np.int64)
        at = s[:, None] + size + np.arange(size)
        rest = (squares[s + size] - squares[s])[:, None] + squares[at + size] - squares[at] - 2 * product
        block, gap = np.nonzero(rest == 0)
        found.append((block + k, gap + size))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


@lru_cache(maxsize=4096)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return (*out, n) if n > 1 else tuple(out)


class _Known:
    """Runs found so far, asked for the one that covers an interval much longer than its period: there is at most one."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.n = len(runs)
        if self.n:
            start, self.period, length = np.array(sorted(runs), np.int64).T
            self.start, end = start, start + length
            best = np.maximum.accumulate(end)
            self.best, self.of = best, np.maximum.accumulate(np.where(end == best, np.arange(self.n), 0))

    def period_over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Period of the run over each [start, end), 0 if there is none."""
        out = np.zeros(len(start), np.int64)
        if self.n:
            k = np.searchsorted(self.start, start, side="right") - 1
            ok = (k >= 0) & (self.best[k] >= end)
            out[ok] = self.period[self.of[k[ok]]]
        return out


def _extended(ids: np.ndarray, lo: int, hi: int, d: int) -> list[tuple[int, int, int]]:
    """Runs of period d among the stretches of words in [lo, hi) that equal the word d later."""
    hi = min(hi, len(ids) - d)
    equal = np.zeros(hi - lo + 2, np.int8)
    equal[1:-1] = ids[lo:hi] == ids[lo + d:hi + d]
    edge = np.diff(equal)
    out = []
    for a, b in zip((np.flatnonzero(edge == 1) + lo).tolist(), (np.flatnonzero(edge == -1) + lo).tolist(), strict=True):
        if b - a + d >= max(LEAST, TIMES * d) and not any(np.array_equal(ids[a:a + d], ids[a + d // f:a + d // f + d]) for f in _prime_factors(d)):
            out.append((a, d, b - a + d))
    return out


def runs_of(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs in a sequence of small numbers of which no run has more than `longest`."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n, np.int64)  # distance to the next equal word
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found: list[tuple[int, int, int]] = []
    worst, size = again, 1
    while size * TIMES <= longest:
        near = worst < 2 * size  # per block
        beside = np.concatenate([[False], near, [False]])
        block = np.flatnonzero(near & (beside[:-2] | beside[2:]))
        known = _Known(found)
        block = block[known.period_over(block * size, block * size + 3 * size) == 0]
        k, d = occurrences(ids, block * size, size) if len(block) else (block, block)
        j = block[k]
        p = known.period_over(j * size, (j + 1) * size + d)
        use = (p == 0) | (d % np.maximum(p, 1) != 0)
        j, d = j[use], d[use]
        by = np.lexsort((j, d))
        j, d = j[by], d[by]
        head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (j[1:] != j[:-1] + 1)])) if len(j) else j
        count = np.diff(np.append(head, len(j)))
        stretch = np.maximum(LEAST, TIMES * d[head]) - d[head]
        enough = count >= (stretch - size + 1) // size
        for a, c, q in zip(j[head][enough].tolist(), count[enough].tolist(), d[head][enough].tolist(), strict=True):
            found.extend(_extended(ids, max(0, (a - 1) * size), (a + c + 1) * size, q))
        found = sorted(set(found))
        if len(worst) % 2:
            worst = np.append(worst, n)
        worst, size = np.maximum(worst[::2], worst[1::2]), 2 * size
    return found


def _echo(cut: np.ndarray, seeds: list) -> np.ndarray:
    """Word numbers after the tails that the seeds ask for were made periodic."""
    at = np.arange(cut[-1])
    for row, h in enumerate(seeds):
        n = int(cut[row + 1] - cut[row])
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[cut[row] + a:cut[row + 1]] = cut[row] + a + np.arange(n - a) % p
    return at


def _strings(data: np.ndarray, to: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    offsets = to[np.searchsorted(row, np.arange(rows + 1))]
    if offsets[-1] < 1 << 31:
        return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(data))


def _found(batches):
    for batch in batches:
        for at, rows, data, off in text_slices(batch, "text"):
            h, row, start, end = plain_tokens(data, off)
            cut = np.searchsorted(row, np.arange(rows + 1))
            word = _echo(cut, batch.column("seed").slice(at, rows).to_pylist())
            distinct, ids = np.unique(h[word], return_inverse=True)
            place = np.arange(len(word)) + row  # one separator after each text
            line = np.empty(len(word) + rows, np.int64)
            line[cut[1:] + np.arange(rows)] = len(distinct) + np.arange(rows)
            line[place] = ids
            first = cut[:-1] + np.arange(rows)
            runs = np.array(sorted(runs_of(line, int(np.diff(cut).max(initial=0)))), np.int64).reshape(-1, 3)
            owner = np.searchsorted(first, runs[:, 0], side="right") - 1
            gone = np.zeros(len(line) + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 1], 1)
            np.add.at(gone, runs[:, 0] + runs[:, 2], -1)
            keep = np.cumsum(gone)[place] == 0
            kept = word[keep]
            fields = [pa.array(c) for c in (runs[:, 0] - first[owner], runs[:, 1], runs[:, 2])]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "period", "length"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, rows), pa.array(np.diff(cut)), lists, _strings(*spaced(data, start[kept], end[kept], row[keep]), row[keep], rows)],
                                             names=["doc_id", "n_words", "runs", "collapsed"])


def detected(docs: DataFrame, seed: Column | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text `collapsed`: words without those that a run repeats after its first period.

    With a `seed`, an unsigned number per row, the tail of each text whose seed is divisible by ten is first made periodic, which plants
    runs at known places: with n words, g = seed / 10 and a = g % n, word i >= a becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8)."""
    rows = docs.select("doc_id", "text", (F.lit(None) if seed is None else seed).cast("bigint").alias("seed"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_found, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
