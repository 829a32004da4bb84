"""Removal of repeated substrings by prefix-free parsing.

Rolling-hash triggers cut the texts into phrases: the trigger of a string of `length` bytes is the place with the smallest hash of
`WINDOW` bytes among its first `REACH` places (the leftmost of equals), and a phrase is a maximal run of starts with the same
trigger. As the trigger depends on the string alone, equal strings lie at the same distance from equal triggers, wherever
they occur: the parse is prefix-free and phrases of repeated text are equal.

Equal strings are neighbours in suffix order. That order is built from the dictionary of phrases and the parse, coarse to fine,
and only for what is not settled yet; entries of the order are fingerprints (equality up to `length` bytes is all that is
asked), so it is spread evenly over tasks however repetitive the text is:
  1. Text after a trigger that all strings of a phrase share (its core) must occur twice, else no string of the phrase does.
  2. A phrase with its right context in the parse (its span) that occurs twice makes all its strings repeated: one dictionary entry
     stands for any number of copies. Spans whose core also has other right or left contexts are passed on, one for each
     distinct span.
  3. The suffixes of those dictionary spans are ordered in cells of `CELL` places, by the same two tests, and
  4. those of the cells left over one by one.
Cores are 64-bit fingerprints and only filter. Spans and single strings are compared by 128-bit fingerprints.

The texts are dealt out once, to a table bucketed by row; each later pass joins its short list of places to that table.

Defined results: NULL text is empty; texts shorter than `length` keep everything; each input row gives one output row, repeated rows
included (they are copies of each other); ids are not used but returned.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import Fingerprints, shared_dir, signed, stored, text_slices

LENGTH = 400
WINDOW = 24
REACH = 320
CELL = 16
_PLACE = np.uint64((1 << 28) - 1)
PIECE = 1 << 19


def triggers(data: np.ndarray, reach: int, window: int) -> np.ndarray:
    """For each place s: the trigger of the string that starts there. Places near the end of the array have no meaning."""
    n = len(data)
    t = np.arange(max(n - window + 1, 0))
    key = np.full(-(-(n + reach) // reach) * reach, np.iinfo(np.uint64).max)
    key[:len(t)] = (Fingerprints(data, 3).of(t, t + window) & ~_PLACE) | t.astype(np.uint64)
    grid = key.reshape(-1, reach)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    return (np.minimum(ahead[:n], behind[reach - 1:n + reach - 1]) & _PLACE).astype(np.int64)


def _phrases(length: int, reach: int, window: int):
    """Rows (core, row_no, a, lo, hi): trigger a of the strings that start at lo..hi."""
    def run(batches):
        for batch in batches:
            row_no = batch.column("row_no").to_numpy()
            for at, _, data, off in text_slices(batch, "text", PIECE):
                if off[-1] < length:
                    continue
                a = triggers(data, reach, window)
                size = np.diff(off)
                row = np.repeat(np.arange(len(size)), size)
                s = np.flatnonzero(np.arange(off[-1]) + length <= off[1:][row])
                if not len(s):
                    continue
                a = a[s]
                head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
                last = np.concatenate([head[1:], [len(s)]]) - 1
                lo, hi, a = s[head], s[last], a[head]
                r = row[lo]
                core = Fingerprints(data, 1).of(a, a + length - reach + 1)
                yield pa.RecordBatch.from_arrays([pa.array(signed(core)), pa.array(row_no[at + r]), *[pa.array((x - off[r]).astype(np.int32)) for x in (a, lo, hi)]],
                                                 names=["core", "row_no", "a", "lo", "hi"])
    return run


def _spans(length: int, cell: int):
    """Rows (core, u1, u2, row_no, a, lo, hi) of the places of each row, cut into cells of the distance from their trigger."""
    def run(batches):
        for batch in batches:
            row_no = batch.column("row_no").to_numpy()
            lists = batch.column("places")
            for at, n, data, off in text_slices(batch, "text", PIECE):
                own = lists.slice(at, n)
                count = np.diff(own.offsets.to_numpy())
                flat = own.flatten()
                r = np.repeat(np.arange(n), count)
                a, lo, hi = (flat.field(k).to_numpy().astype(np.int64) + off[r] for k in range(3))
                first, last = (a - hi) // cell, (a - lo) // cell
                many = last - first + 1
                pick = np.repeat(np.arange(len(a)), many)
                k = np.repeat(last, many) - (np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many))
                r, a = r[pick], a[pick]
                near, far = a - k * cell, a - k * cell - cell + 1  # the last and the first place of the cell
                lo, hi = np.maximum(lo[pick], far), np.minimum(hi[pick], near)
                one, two = Fingerprints(data, 1), Fingerprints(data, 2)
                # The core is common to all strings of the cell; a one-place cell is its own core.
                core = one.of(near, np.maximum(far + length, near + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(core)), pa.array(signed(one.of(lo, hi + length))), pa.array(signed(two.of(lo, hi + length))), pa.array(row_no[at + r]),
                     *[pa.array((x - off[r]).astype(np.int32)) for x in (a, lo, hi)]], names=["core", "u1", "u2", "row_no", "a", "lo", "hi"])
    return run


def _bucketed(docs: DataFrame) -> DataFrame:
    """(row_no, doc_id, text) in a table bucketed by row_no: joins by it do not move the texts again."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .repartition(n, "row_no").write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark, "texts")).bucketBy(n, "row_no").saveAsTable(name)
    return spark.table(name)


def repeated(texts: DataFrame, length: int = LENGTH, reach: int = REACH, window: int = WINDOW, cell: int = CELL) -> list[DataFrame]:
    """Tables (row_no, lo, hi): the strings of `length` bytes that start at lo..hi occur elsewhere too. `texts`: row_no, text."""
    rows = stored(texts.select("row_no", "text").mapInArrow(_phrases(length, reach, window), "core bigint, row_no bigint, a int, lo int, hi int"), "phrases")
    twice = stored(rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")  # stored, so that the join can split a hot core
    todo = rows.join(twice, "core", "left_semi")
    found = []
    for width in (reach, cell, 1):
        places = todo.groupBy("row_no").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("places"))  # bounded by the text of the row
        spans = texts.join(places.hint("shuffle_hash"), "row_no").select("row_no", "text", "places") \
            .mapInArrow(_spans(length, width), "core bigint, u1 bigint, u2 bigint, row_no bigint, a int, lo int, hi int")
        spans = stored(spans, "spans")
        if width > 1:
            twice = stored(spans.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
            spans = spans.join(twice, "core", "left_semi")
        entries = stored(spans.groupBy("u1", "u2").agg(F.count("*").alias("n"), F.min(F.struct("core", "row_no", "a", "lo", "hi")).alias("e")), "entries")
        found.append(spans.join(entries.where("n > 1").select("u1", "u2"), ["u1", "u2"], "left_semi").select("row_no", "lo", "hi"))
        kept = entries.select("e.*")
        todo = kept.join(stored(kept.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores"), "core", "left_semi")
    return found


def _cut(length: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            lists = batch.column("places")
            for at, n, data, off in text_slices(batch, "text", PIECE):
                own = lists.slice(at, n)
                if own.null_count:
                    own = own.fill_null([])
                count = np.diff(own.offsets.to_numpy())
                flat = own.flatten()
                r = np.repeat(np.arange(n), count)
                lo, hi = (flat.field(k).to_numpy().astype(np.int64) + off[r] for k in range(2))
                step = np.bincount(lo, minlength=len(data) + 1) - np.bincount(hi + length, minlength=len(data) + 1)
                gone = np.cumsum(step)[:len(data)] > 0
                before = np.concatenate([[0], np.cumsum(gone)])
                rise = gone.copy()
                rise[1:] &= ~gone[:-1]
                inside = off[:-1][np.diff(off) > 0]
                rise[inside] = gone[inside]  # a run ends with its text
                spans = np.concatenate([[0], np.cumsum(rise)])
                raw, kept = data.tobytes(), []
                for i in range(n):
                    a, b = int(off[i]), int(off[i + 1])
                    kept.append(raw[a:b] if before[a] == before[b] else data[a:b][~gone[a:b]].tobytes())
                cols = [batch.column("doc_id").slice(at, n), pa.array(np.diff(off)), pa.array(np.diff(before[off])), pa.array(np.diff(spans[off])),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept if keep_text else [None] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left over; NULL without `keep_text`) for each row of `docs`."""
    texts = _bucketed(docs)
    first, *more = repeated(texts, length, **options)
    for df in more:
        first = first.unionByName(df)
    places = first.groupBy("row_no").agg(F.collect_list(F.struct("lo", "hi")).alias("places"))
    return texts.join(places.hint("shuffle_hash"), "row_no", "left").select("doc_id", "text", "places") \
        .mapInArrow(_cut(length, keep_text), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
