"""Helpers shared by the text operators: shared folders, Arrow slices, word and string fingerprints."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


BATCH_ROWS = 1000  #: of long texts, that go to Python at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Sees to it that texts go to Python in small batches, unless the session asks for even smaller ones."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder path below spark.checkpoint.dir; only a local master may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"tapeflow-{os.getpid()}")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str, release: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors. With `release`, Spark removes the
    files of the write's shuffles when it ends, not at some later collection of garbage."""
    conf, path = df.sparkSession.conf, shared_dir(df.sparkSession, purpose)
    before = conf.get(RELEASE)
    conf.set(RELEASE, str(release or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        conf.set(RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text modulo `modulus`; NULL ids give NULL."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def lean(run: Callable) -> Callable:
    """The function of a mapInArrow stage that gives freed memory back to the system when its task ends: workers live on, and their
    share of an executor's memory is wanted by the next stages."""
    def trimmed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)
    return trimmed


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, bytes, offsets) pieces of a string column of about `limit` bytes; NULL counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to - at, data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return p


class Fingerprints:
    """Hashes of any substring of a byte array in constant time per substring (polynomial prefix sums modulo 2**64)."""

    _cache: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        base = (_BASE * (2 * seed + 1) | 1) & _MASK
        n = len(data) + 1
        got = self._cache.get(seed)
        if got is None or len(got[0]) < n:
            size = max(n, (1 << 20) + 64)
            got = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE_INV) + np.uint64(seed)))
            if size <= 1 << 22:
                self._cache[seed] = got
        power, self._back, table_ = got
        self._sum = np.zeros(n, np.uint64)
        np.cumsum(table_[data] * power[:n - 1], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._back[start] + (end - start).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words of digits, letters and non-ASCII characters: (fingerprint, row, start byte, end byte) in order."""
    low = _LOWER[data]
    return _spans(low, offsets, _WORD[low])


_BLANK = np.ones(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words between blanks, as `words` returns them."""
    low = _LOWER[data]
    return _spans(low, offsets, _BLANK[low])


def plain_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between blanks as they are, as `words` returns them."""
    return _spans(data, offsets, _BLANK[data])


_SPACE = np.ones(256, bool)
_SPACE[[32, 10]] = False


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings between spaces and line ends, as they are."""
    return _spans(data, offsets, _SPACE[data])


def _spans(low: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(low)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    fence = np.zeros(n + 1, bool)
    fence[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | fence[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | fence[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Fingerprints(low).of(start, end), row, start, end


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place of each word and the end) of the words [start, end) with one space between words of a row."""
    blank = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
    size = end - start + blank
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(to[-1], np.uint8)
    for k in range(0, len(row), 1 << 16):
        m = min(k + (1 << 16), len(row))
        source = np.arange(to[k], to[m]) + np.repeat(start[k:m] - to[k:m], size[k:m])
        out[to[k]:to[m]] = data[np.minimum(source, len(data) - 1)]
    out[to[1:][blank] - 1] = 32
    return out, to


def runs(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Fingerprints of k consecutive entries at each of the len(h) - k + 1 positions (ignoring row borders)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        out += h[j:j + n] * np.uint64(factor)
        factor = factor * (_BASE ^ (seed << 1)) & _MASK
    return mix(out + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def flagged(df: DataFrame, keys: DataFrame, key: str, name: str = "maybe__", bits: int = 1 << 24) -> DataFrame:
    """`df` with a boolean column: false only where the key is not among `keys` (which has the same column).

    The bitmap behind it is built by a distributed aggregate and has `bits` bits whatever the number of keys, so it may go to all
    tasks; where it fills up it only sends more rows to the join that decides."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    marks = keys.select(F.bitmap_bucket_number(slot).alias("part__"), F.bitmap_bit_position(slot).alias("bit__")) \
        .groupBy("part__").agg(F.bitmap_construct_agg("bit__").alias("marks__"))
    at = F.bitmap_bit_position("slot__")
    byte = F.conv(F.hex(F.substring("marks__", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    own = df.withColumn("slot__", slot).join(F.broadcast(marks), F.bitmap_bucket_number("slot__") == F.col("part__"), "left")
    return own.select(*df.columns, F.coalesce(bit, F.lit(False)).alias(name))


def maybe_in(df: DataFrame, keys: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """Rows of `df` whose key may be among `keys`: all that are and few others."""
    return flagged(df, keys, key, bits=bits).where("maybe__").drop("maybe__")


def connected(edges: DataFrame, purpose: str) -> DataFrame:
    """(v, root) for the undirected edges (a, b): root is the smallest id of the component.

    Smallest labels spread along the edges and then along labels (pointer jumping), one stored table a round. A hub
    only meets its edges in joins that adaptive execution splits and in minima that are combined before the shuffle."""
    e = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct(), purpose)
    labels = stored(e.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root")), purpose)
    while True:
        near = e.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("m"))
        low = labels.join(near, "v").select("v", "root", F.least("root", "m").alias("m"))
        up = labels.select(F.col("v").alias("m"), F.col("root").alias("up"))
        new = stored(low.join(up, "m", "left").select("v", F.least("m", F.coalesce("up", "m")).alias("new"), "root"), purpose)
        if new.where("new <> root").isEmpty():
            return labels
        labels = new.select("v", F.col("new").alias("root"))
