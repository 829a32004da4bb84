"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is encoded (shares of character classes, repetition
of words, means of hashed word bits), embedded by a dense layer, weighed by a gated attention (tanh branch times
sigmoid branch) and the weighted sum of the embeddings is scored by a logistic output. Only document labels teach it.

Encoding and scoring run in the scan, one task for each piece of the table, with the parameters (about 10 kB) in the
closure; nothing is shuffled. The fit takes a documented, bounded sample of labelled rows: `SAMPLE` ids, those with
the smallest hash, with texts of at most `SAMPLE_BYTES` bytes. Scoring covers every whole text.

Defined results: NULL and empty texts are a bag of one empty passage and get a score too; each input row gives one
output row; a NULL doc_id is held out. Labels with NULL id or quality teach nothing; of contradicting labels of an id the smallest
counts. Without labels of both kinds every score is 0.5. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import fold, lean, text_slices, tokens

PASSAGE = 48
SAMPLE = 6000
SAMPLE_BYTES = 1 << 16
HIDDEN = 24
FOLDS = 5
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASSES[_i] = (1 if 65 <= _i <= 90 else 2 if 97 <= _i <= 122 else 3 if 48 <= _i <= 57 else 4 if _c in " \t" else 5 if _c in "\r\n" else 6 if _c in ".,;:"
                    else 7 if _c in "!?" else 8 if _c in "|/\\<>[]{}_=" else 9 if 33 <= _i <= 126 else 10 if _i in (0xC3,) else 11 if _i >= 128 else 0)
N_CLASSES = 12
N_BITS = 24
N_FEATURES = N_CLASSES + 8 + N_BITS


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (n, N_FEATURES) and the row of each passage; every row has a passage."""
    n_rows = len(off) - 1
    h, row, start, end = tokens(data, off)
    cut = np.searchsorted(row, np.arange(n_rows + 1))
    count = np.maximum(1, -(-np.diff(cut) // PASSAGE))
    bag = np.repeat(np.arange(n_rows), count)
    first = np.repeat(cut[:-1], count) + PASSAGE * (np.arange(len(bag)) - np.repeat(np.cumsum(count) - count, count))
    last = np.minimum(first + PASSAGE, np.repeat(cut[1:], count))
    x = np.zeros((len(bag), N_FEATURES), np.float32)
    full = np.flatnonzero(last > first)
    if not len(full):
        return x, bag
    a, b = first[full], last[full]
    lo, hi = start[a], end[b - 1]
    kind = _CLASSES[data]
    size = (hi - lo).astype(np.float64)
    for k in range(N_CLASSES):
        s = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        x[full, k] = (s[hi] - s[lo]) / size
    n = (b - a).astype(np.float64)

    def mean(v):
        s = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
        return (s[b] - s[a]) / n

    long = (end - start).astype(np.float64)
    upper = np.concatenate([[0], np.cumsum((kind == 1), dtype=np.int32)])
    caps = (upper[end] - upper[start]) * 2 > long
    tail = kind[end - 1]
    same = [np.concatenate([np.zeros(min(d, len(h)), bool), (h[d:] == h[:-d]) & (row[d:] == row[:-d])]) for d in (1, 2, 3)]
    odd = np.isin(tail, (7, 8, 9))
    for j, v in enumerate((long / 16, caps & (long > 2), odd, same[0], same[1], same[2], long == 1)):
        x[full, N_CLASSES + j] = mean(v)
    x[full, N_CLASSES + 7] = np.minimum(n / PASSAGE, 1)
    for k in range(N_BITS):
        x[full, N_CLASSES + 8 + k] = mean(((h >> np.uint64(k)) & np.uint64(1)).astype(np.float64)) - 0.5
    return x, bag


def _forward(p: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray):
    z = np.tanh(((x - p["mean"]) / p["std"]) @ p["E"] + p["e"])
    t, g = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-(z @ p["U"])))
    s = (t * g) @ p["w"]
    cut = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
    width = np.diff(np.concatenate([cut, [len(bag)]]))
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, cut), width))
    a = s / np.repeat(np.add.reduceat(s, cut), width)
    m = np.add.reduceat(a[:, None] * z, cut)
    y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["b"], -30, 30)))
    return y, (z, t, g, a, m, cut, width)


def fit(x: np.ndarray, bag: np.ndarray, label: np.ndarray, epochs: int = 150, rate: float = 0.04, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the mean logistic loss; x, bag: all passages, bag non-decreasing; label: one for each bag."""
    r = np.random.default_rng(seed)
    f = x.shape[1]
    p = {"mean": x.mean(0), "std": x.std(0) + 0.02, "E": r.normal(0, f ** -0.5, (f, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, HIDDEN)),
         "U": r.normal(0, 0.3, (HIDDEN, HIDDEN)), "w": r.normal(0, 0.3, HIDDEN), "c": r.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    p = {k: v.astype(x.dtype) for k, v in p.items()}
    learn = [k for k in p if k not in ("mean", "std")]
    m1, m2 = ({k: np.zeros_like(p[k]) for k in learn} for _ in range(2))
    xs = (x - p["mean"]) / p["std"]
    n = len(label)
    for step in range(1, epochs + 1):
        y, (z, t, g, a, m, _, width) = _forward(p, x, bag)
        d = ((y - label) / n).astype(x.dtype)
        dm = np.repeat(d[:, None] * p["c"], width, 0)
        da = (dm * z).sum(1)
        cut = np.concatenate([[0], np.cumsum(width)[:-1]])
        ds = a * (da - np.repeat(np.add.reduceat(a * da, cut), width))
        dt, dg = ds[:, None] * p["w"] * g, ds[:, None] * p["w"] * t
        dt, dg = dt * (1 - t * t), dg * g * (1 - g)
        dz = (a[:, None] * dm + dt @ p["V"].T + dg @ p["U"].T) * (1 - z * z)
        grad = {"E": xs.T @ dz + 1e-4 * p["E"], "e": dz.sum(0), "V": z.T @ dt, "U": z.T @ dg, "w": (t * g).T @ ds, "c": m.T @ d + 1e-4 * p["c"], "b": d.sum(keepdims=True)}
        for k in learn:
            m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
            m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return p


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = batch.select(["doc_id", "quality"])
        for at, n, data, off in text_slices(batch, "text"):
            x, bag = encode(data, off)
            cut = np.searchsorted(bag, np.arange(n))
            bags = [b.tobytes() for b in np.split(x, cut[1:])]
            own = keep.slice(at, n)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray] | None:
    """Parameters learned from at most `sample` labelled documents outside the held-out fold; None without both kinds."""
    known = labels.where("doc_id is not null and quality is not null").where(fold("doc_id", FOLDS) != 0) \
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    # A row for each sampled id at most: bounded by `sample`, so it may go to every task.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.octet_length("text") <= sample_bytes)
    got = texts.join(F.broadcast(known), "doc_id").mapInArrow(lean(_encoded), "doc_id bigint, quality int, bag binary")
    # One row for each id, combined before the shuffle, so repeats of an id never reach the driver.
    got = got.groupBy("doc_id").agg(F.min(F.struct("bag", "quality")).alias("first")).select("doc_id", "first.*").toPandas().sort_values("doc_id")
    if got.quality.nunique() < 2:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got.bag]
    return fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), (got.quality.to_numpy() > 0).astype(np.float32))


def scored(docs: DataFrame, model: dict[str, np.ndarray] | None, name: str = "score") -> DataFrame:
    """`docs` with a column `name`: the probability of label 1."""
    def run(batches):
        for batch in batches:
            for at, n, data, off in text_slices(batch, "text"):
                y = np.full(n, 0.5) if model is None else _forward(model, *encode(data, off))[0]
                own = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(y, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(lean(run), ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{name}` double")
