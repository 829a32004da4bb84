"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is a set of windows of `size` consecutive words (a shorter item is one window). Inside a window all
shingles are necessary, so one of them is a complete prefix: the rarest in the corpus. Documents are joined on that
shingle only; length and position bounds discard windows that would stick out of the document, and the words of the
remaining candidates are compared one by one (as 64-bit fingerprints).

Passes over the documents: one counts how often each benchmark shingle occurs (counts are combined per task), one
emits the positions of prefix shingles. Both skip other shingles by a bitmap of fixed size; a full bitmap only passes
more rows to the join, which decides.

Defined results: a NULL or empty text has no words; every input row gives one output row, repeated rows and NULL ids
included; benchmark rows with NULL id, NULL text or no words are no items; with no items nothing is contaminated.
Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import lean, runs, signed, stored, text_slices, words

SIZE = 10  #: words of a window
SHINGLE = 3  #: words of a shingle
FILTER_BITS = 1 << 22  #: size of the bitmap that goes to all tasks


def _windows(size: int, shingle: int):
    """Rows (item_id, words, shingles) of every window; shingles in order of position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("item_id"))
            for at, n, data, off in text_slices(batch, "text"):
                h, row, _, _ = words(data, off)
                cut = np.searchsorted(row, np.arange(n + 1))
                item, ws, ss = [], [], []
                for r in range(n):
                    own = h[cut[r]:cut[r + 1]]
                    m = min(size, len(own))
                    for s in range(len(own) - m + 1) if m else ():
                        w = own[s:s + m]
                        item.append(ids[at + r].as_py())
                        ws.append(signed(w))
                        ss.append(signed(runs(w, min(shingle, m))))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(ws, pa.list_(pa.int64())), pa.array(ss, pa.list_(pa.int64()))],
                                                 names=["item_id", "words", "shingles"])
    return run


def windows(items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInArrow(_windows(size, shingle), "item_id string, words array<bigint>, shingles array<bigint>")


def _bitmap(shingles: DataFrame, bits: int) -> bytes:
    """At most `bits` slots come to the driver, whatever the number of shingles."""
    slots = shingles.select(F.pmod("shingle", F.lit(bits)).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()
    marks = np.zeros(bits, bool)
    marks[slots] = True
    return np.packbits(marks).tobytes()


class _Finder:
    """Positions of words at which a marked shingle of one of the lengths begins."""

    def __init__(self, packed: bytes, lengths: list[int]):
        self.marks = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        self.lengths = lengths

    def __call__(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in self.lengths:
            s = runs(h, k)
            if len(s):
                at = np.flatnonzero(self.marks[(signed(s) % np.int64(len(self.marks)))] & (row[:len(s)] == row[k - 1:]))
                yield at, s[at]


def _count(shared, lengths):
    def run(batches):
        find, seen, total = _Finder(shared.value, lengths), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, off in text_slices(batch, "text"):
                h, row, _, _ = words(data, off)
                got = [s for _, s in find(h, row)]
                key, c = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
                seen, inv = np.unique(np.concatenate([seen, key]), return_inverse=True)
                total = np.bincount(inv, np.concatenate([total, c]), len(seen)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(seen)), pa.array(total)], names=["shingle", "n"])
    return run


def _candidates(shared, lengths, reach):
    """One row for each document: its number of words and the marked positions with the words around them."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("shingle", pa.int64()), ("lead", pa.int32()), ("near", pa.list_(pa.int64()))]))

    def run(batches):
        find, row_no = _Finder(shared.value, lengths), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, n, data, off in text_slices(batch, "text"):
                h, row, _, _ = words(data, off)
                cut = np.searchsorted(row, np.arange(n + 1))
                found = [[] for _ in range(n)]
                for pos, s in find(h, row):
                    for p, key in zip(pos.tolist(), signed(s).tolist(), strict=True):
                        r = int(row[p])
                        lo, hi = max(int(cut[r]), p - reach + 1), min(int(cut[r + 1]), p + reach)
                        found[r].append({"pos": p - int(cut[r]), "shingle": key, "lead": p - lo, "near": signed(h[lo:hi])})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.array(np.arange(row_no, row_no + n)), pa.array(np.diff(cut).astype(np.int64)), pa.array(found, kind)],
                    names=["doc_id", "row_no", "n_words", "found"])
                row_no += n
    return run


def contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item ids), contaminated: one row for each row of `docs`."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    win = stored(windows(items, size, shingle).select("*", F.xxhash64("words").alias("win")), "windows")
    part = win.select("win", "words", F.explode(F.arrays_zip("shingles", F.sequence(F.lit(0), F.size("shingles") - 1).alias("off"))).alias("s")) \
        .select("win", "words", F.col("s.shingles").alias("shingle"), F.col("s.off").alias("off")).distinct()
    lengths = sorted({min(shingle, r[0]) for r in win.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect()})
    counted = spark.sparkContext.broadcast(_bitmap(part, filter_bits))
    rarity = texts.mapInArrow(lean(_count(counted, lengths)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    first = stored(part.join(rarity, "shingle", "left").groupBy("win", "words")
                   .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "off")).alias("p"))
                   .select("win", "words", "p.shingle", "p.off"), "prefixes")
    marked = spark.sparkContext.broadcast(_bitmap(first, filter_bits))
    rows = stored(texts.mapInArrow(lean(_candidates(marked, lengths, size)), "doc_id bigint, row_no bigint, n_words bigint, "
                                   "found array<struct<pos:int,shingle:bigint,lead:int,near:array<bigint>>>"), "candidates")
    found = rows.where(F.size("found") > 0).select("row_no", "n_words", F.explode("found").alias("f")).select("row_no", "n_words", "f.*")
    length = F.size("words")
    hits = found.join(first, "shingle").where((F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + length <= F.col("n_words"))) \
        .where((F.col("lead") >= F.col("off")) & (F.slice("near", F.col("lead") - F.col("off") + 1, length) == F.col("words"))) \
        .select("row_no", "win", (F.col("pos") - F.col("off")).alias("at"), length.alias("len"))
    reach = F.aggregate(F.array_sort(F.collect_set(F.struct("at", "len"))), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.at + x["len"] - F.greatest(a.to, x.at))).alias("n"),
                                              F.greatest(a.to, x.at + x["len"]).alias("to")), lambda a: a.n)
    covered = hits.groupBy("row_no").agg(reach.cast("bigint").alias("n_hit"))
    named = hits.select("row_no", "win").distinct().join(win.select("win", "item_id").distinct(), "win") \
        .groupBy("row_no").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return rows.select("row_no", "doc_id", "n_words").join(covered, "row_no", "left").join(named, "row_no", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
