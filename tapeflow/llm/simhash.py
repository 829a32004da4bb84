"""Near duplicates by SimHash, found in a byte-position inverted index with count filtering.

Each text gets a fingerprint of 64 bits: a bit is set if more than half of its shingles' XXH64 values have it. Two fingerprints that differ in at
most two bits agree in at least six of their eight positional bytes, so pairs that share fewer need not be looked at. Postings of single bytes
would hold n / 256 fingerprints each and tally most pairs of the table. The index therefore keeps a posting for each set of six positions and
the six bytes there: two fingerprints meet in a posting if and only if their tally of shared bytes reaches six. A posting holds distinct fingerprints that differ
in two bytes only, so at most 65,536 of them whatever the input, and 28 rows a distinct fingerprint are shuffled.

Inside a posting the links are verified on all bits: neighbours in short postings, in long ones by looking up each fingerprint with one or two of
its 16 free bits turned, so no posting is compared pair by pair. A task sends on a spanning set of links only; components are those of all links.

Equal fingerprints are one entry with its smallest id, counted with partial sums, so a group of copies of any size is one row.

Defined results: words are strings between blanks, A-Z lower-cased; a text of one or two words has one shingle; NULL texts and texts without words have fingerprint zero
and link like any other; each row is judged by its own text, so rows that repeat an id may differ in their components; a component without any id is
named NULL; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import connected, signed, spaced, stored, text_slices, tokens
from tapeflow.llm.near_duplicates import _spanning

WORDS = 3
SEED = 42
BITS = 2  #: differing bits of a link
PLACES = list(combinations(range(8), 8 - BITS))  #: positions of a posting
SHORT = 64  #: postings of fewer entries are compared by neighbours
CHUNK = 1 << 16  #: shingles that are counted at once
EDGES = 1 << 20


def _shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of the shingles of all rows in order, first shingle of each row and the end)."""
    rows = len(off) - 1
    _, row, start, end = tokens(data, off)
    cut = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(cut)
    many = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    first = np.arange(at[-1]) + np.repeat(cut[:-1] - at[:-1], many)
    last = first + np.repeat(np.minimum(n, WORDS) - 1, many)
    low, to = spaced(data, start, end, row)
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    text, digest = low.tobytes(), xxhash.xxh64_intdigest
    stop = to[last] + (end - start)[last]
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(to[first].tolist(), stop.tolist(), strict=True)), np.uint64, len(first)), at


def fingerprints(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The fingerprint of each row from the hashes of its shingles, h[cut[row]:cut[row + 1]]."""
    rows = len(cut) - 1
    ones = np.zeros((rows, 64), np.int64)
    row = np.repeat(np.arange(rows), np.diff(cut))
    for k in range(0, len(h), CHUNK):
        part = np.unpackbits(h[k:k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[k:k + CHUNK]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[head]] += np.add.reduceat(part, head, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(cut)[:, None], axis=1, bitorder="little").view("<u8").reshape(rows)


def _signed_rows(batches):
    for batch in batches:
        for at, rows, data, off in text_slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, rows), pa.array(signed(fingerprints(*_shingles(data, off))))], names=["doc_id", "fp"])


def _mask(places: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in places)
    return m - (1 << 64) if m >> 63 else m


#: Every pattern of one or two turned bits among 16.
_TURNS = [sum(1 << b for b in some) for n in range(1, BITS + 1) for some in combinations(range(16), n)]


def links(fp: np.ndarray, cut: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries that differ in one or two bits within the lists fp[cut[k]:cut[k + 1]], whose entries share the bytes of PLACES[places[k]]."""
    size = np.diff(cut)
    owner = np.repeat(np.arange(len(size)), size)
    a, b = [], []
    short = np.where(size < SHORT, size, 0)
    for k in range(1, int(short.max(initial=0))):
        i = np.flatnonzero((short[owner[:-k]] > k) & (owner[:-k] == owner[k:]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= BITS]
        a.append(fp[i])
        b.append(fp[i + k])
    for k in np.flatnonzero(size >= SHORT):
        own = fp[cut[k]:cut[k + 1]]
        x, y = (np.uint64(8 * p) for p in range(8) if p not in PLACES[places[k]])
        free = ((own >> x & np.uint64(255)) | (own >> y & np.uint64(255)) << np.uint64(8)).astype(np.int64)
        at = np.full(1 << 16, -1)
        at[free] = np.arange(len(own))
        for turn in _TURNS:
            to = at[free ^ turn]
            use = to > np.arange(len(own))
            a.append(own[use])
            b.append(own[to[use]])
    return tuple(np.concatenate([np.zeros(0, np.uint64), *x]) for x in (a, b))


def _linked(batches):
    """A spanning set of the links in all postings of a task."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        lists = batch.column("fps")
        cut = lists.offsets.to_numpy().astype(np.int64)
        fp = lists.values.to_numpy()[cut[0]:cut[-1]].view(np.uint64)
        x, y = links(fp, cut - cut[0], batch.column("places").to_numpy())
        a, b = np.concatenate([a, signed(x)]), np.concatenate([b, signed(y)])
        if len(a) > EDGES:
            a, b = _spanning(a, b)
            if len(a) > EDGES // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a = b = a[:0]
    a, b = _spanning(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number) and component_id, the smallest doc_id that links reach."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(docs.select("doc_id", "text").mapInArrow(_signed_rows, f"doc_id {kind}, fp bigint"), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    posting = F.explode(F.array(*[F.struct(F.lit(k).alias("places"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("shared")) for k, p in enumerate(PLACES)]))
    lists = distinct.select("fp", posting.alias("p")).groupBy("p.places", "p.shared").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    label = connected(lists.select("places", "fps").mapInArrow(_linked, "a bigint, b bigint"), "components")
    named = distinct.join(label.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "named")
    alone = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(alone, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
