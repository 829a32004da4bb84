"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram binds its letters: the vector of the j-th letter is rotated
by j places and the rotated vectors are multiplied component by component. A text bundles (adds) its n-gram vectors; a
language prototype bundles the texts of that language, each scaled to a common length and rounded to whole numbers, so sums do
not depend on their order. A text gets the language of the prototype with the largest cosine.

Training sums stay in the tasks: each sends one vector of `DIM` numbers for each language it saw. Prediction is one
scan with the prototypes in the closure. The prototypes number as many as there are languages; more than `MAX_LANGS` is an error.

Defined results: `und` with score 0 for NULL texts and texts without letters, and when nothing was learned; ties go to the
smallest language name; score is the cosine moved to 0..1; a NULL doc_id is held out; each input row gives one output row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import fold, mix

DIM = 1024
NGRAM = 3
FOLDS = 5
MAX_LANGS = 4096
GROUP = 32  #: texts bundled by one matrix product
SCALE = 1 << 12

_letters: dict[int, np.ndarray] = {}
_table: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _table:
        t = np.zeros(0x110000, bool)
        t[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _table.append(t)
    return _table[0]


def letter(code: int) -> np.ndarray:
    """The vector of a character: seeded by its code point, the same in every task."""
    if code not in _letters:
        bits = mix(np.uint64(code) * np.uint64(DIM) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(0x5EED))
        _letters[code] = np.unpackbits(bits.view(np.uint8)).astype(np.float32) * 2 - 1
    return _letters[code]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the letter n-grams; other characters become one blank at each word border."""
    code = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    is_letter = _is_letter()[code]
    if not is_letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.where(is_letter, code, np.uint64(32))
    code = code[is_letter | np.concatenate([[True], is_letter[:-1]])]
    n = len(code) - NGRAM + 1
    gram = np.zeros(max(n, 0), np.uint64)
    for j in range(NGRAM):
        gram = gram << np.uint64(21) | code[j:j + n]
    return np.unique(gram, return_counts=True)


def _vectors(grams: np.ndarray) -> np.ndarray:
    out = np.ones((len(grams), DIM), np.float32)
    for j in range(NGRAM):
        code = (grams >> np.uint64(21 * (NGRAM - 1 - j))) & np.uint64(0x1FFFFF)
        own, inv = np.unique(code, return_inverse=True)
        out *= np.stack([np.roll(letter(int(c)), j) for c in own])[inv]
    return out


class _Bundler:
    """n-gram vectors are kept for the next texts, up to a fixed number."""

    def __init__(self, keep: int = 1 << 15):
        self.keep = keep
        self.grams, self.vec = np.zeros(0, np.uint64), np.zeros((0, DIM), np.float32)

    def _lookup(self, need: np.ndarray) -> np.ndarray:
        new = np.setdiff1d(need, self.grams, assume_unique=True)
        if len(new):
            if len(self.grams) + len(new) > self.keep:
                self.grams, self.vec, new = np.zeros(0, np.uint64), np.zeros((0, DIM), np.float32), need
            grams = np.concatenate([self.grams, new])
            order = np.argsort(grams)
            self.grams, self.vec = grams[order], np.concatenate([self.vec, _vectors(new)])[order]
        return self.vec[np.searchsorted(self.grams, need)]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of the texts; zero for those without letters."""
        parts = [ngrams(t) for t in texts]
        all_ = np.unique(np.concatenate([g for g, _ in parts])) if parts else np.zeros(0, np.uint64)
        out = np.zeros((len(texts), DIM), np.float32)
        for lo in range(0, len(all_), 4096):
            some = all_[lo:lo + 4096]
            count = np.zeros((len(texts), len(some)), np.float32)
            for i, (g, c) in enumerate(parts):
                a, b = np.searchsorted(g, [some[0], some[-1]], side="left")
                b = min(b + 1, len(g))
                at = np.searchsorted(some, g[a:b])
                ok = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == g[a:b])
                count[i, at[ok]] = c[a:b][ok]
            out += count @ self._lookup(some)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _sums(batches):
    bundle, total = _Bundler(), {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text")
        for at in range(0, len(langs), GROUP):
            unit = bundle([t or "" for t in texts.slice(at, GROUP).to_pylist()])
            whole = np.rint(unit * SCALE).astype(np.int64)
            for i, name in enumerate(langs[at:at + GROUP]):
                total[name] = total.get(name, 0) + whole[i]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names in order and their unit vectors, from documents outside the held-out fold."""
    known = docs.where("lang is not null and text is not null").where(fold("doc_id", FOLDS) != 0).select(F.col("lang").cast("string").alias("lang"), "text")
    parts = known.mapInArrow(_sums, "lang string, v array<bigint>")
    got = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")) \
        .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("v"))
    rows = got.orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    names = [r.lang for r in rows]
    vec = np.array([r.v for r in rows], np.float64).reshape(len(rows), DIM)
    norm = np.linalg.norm(vec, axis=1, keepdims=True)
    ok = norm[:, 0] > 0
    return [n for n, k in zip(names, ok, strict=True) if k], (vec[ok] / norm[ok]).astype(np.float32)


def predicted(docs: DataFrame, names: list[str], proto: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs`."""
    def run(batches):
        bundle = _Bundler()
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, GROUP):
                some = texts.slice(at, GROUP).to_pylist()
                unit = bundle([t or "" for t in some])
                lang, score = ["und"] * len(some), np.zeros(len(some))
                if names:
                    cos = unit.astype(np.float64) @ proto.T
                    best, has = cos.argmax(1), unit.any(1)
                    lang = [names[b] if k else "und" for b, k in zip(best, has, strict=True)]
                    score = np.where(has, np.clip((1 + cos.max(1)) / 2, 0, 1), 0)
                own = batch.slice(at, GROUP)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(True)).alias("held_out"), "text") \
        .mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
