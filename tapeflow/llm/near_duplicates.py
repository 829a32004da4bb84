"""N-gram Jaccard join with a MinHash LSH forest.

Texts become sets of shingles of five words. Each of `TREES` trees orders texts by a signature of `DEPTH` MinHash values, a path
in a prefix trie. Buckets are prefixes of one depth, fixed in advance by the parameters and not by matches found: the longest at which pairs at the
threshold share a prefix in some tree with probability `RECALL`: 1 - (1 - t**depth)**trees. In each bucket, texts sorted by
their paths are linked with the first text and the few before them whenever their signatures agree well enough
that a similarity of t is possible. Connected texts form families. In buckets where that leaves several families, all pairs of texts of
different families are then tested, in blocks of `BLOCK` texts whose pairs are groups, so every pair that shares a bucket is either
tested or in one family already.

Inside a family all pairs are verified on the shingle sets. Families are cut into blocks of `BLOCK` texts; each pair of blocks is one
group, so a family that holds a third of the table is spread over many tasks, and a group sends on only counts and a spanning set of
links, never its pairs. Classes are the connected components of the verified links.

Equal word sequences are one text with a number of copies, found by a 128-bit fingerprint with counts combined per task.

Defined results: words are runs of digits, letters and non-ASCII characters, A-Z lower-cased; a text of one to four words is a set of one
shingle; NULL texts and texts without words are linked to nothing and are their own class; rows with a NULL id are left out;
rows that repeat an id count as one document, which keeps its smallest fingerprint. Classes are named by their smallest id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import connected, lean, maybe_in, mix, runs, signed, stored, text_slices, words

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.9995
NEAR = 3  #: texts before it, in trie order, that a text is compared with besides the first of its bucket
DOUBT = 5.0  #: standard deviations of the signature's estimate below the threshold that still count as possible
BLOCK = 256

_r = np.random.default_rng(20240607)
_MUL = _r.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_ADD = _r.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def last_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that reaches the recall."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def _shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all rows in order, first shingle of each row and the end)."""
    n = len(off) - 1
    h, row, _, _ = words(data, off)
    cut = np.searchsorted(row, np.arange(n + 1))
    s = runs(h, WORDS)
    inside = row[:len(s)] == row[WORDS - 1:] if len(s) else np.zeros(0, bool)
    s, at = s[inside], row[:len(s)][inside]
    short = np.flatnonzero((np.diff(cut) > 0) & (np.diff(cut) < WORDS))
    if len(short):
        extra = np.array([runs(h[cut[i]:cut[i + 1]], int(cut[i + 1] - cut[i]))[0] for i in short], np.uint64)
        s, at = np.concatenate([s, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        s, at = s[order], at[order]
    return s, np.searchsorted(at, np.arange(n + 1))


def _fingerprints(s: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sequences of shingles apart, in two halves; the rows all have shingles."""
    place = (np.arange(len(s)) - np.repeat(cut[:-1], np.diff(cut))).astype(np.uint64)
    return tuple(signed(np.add.reduceat(mix(s + mix(place + np.uint64(salt))), cut[:-1])) if len(s) else np.zeros(0, np.int64) for salt in (1, 1 << 40))


def signatures(s: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(rows, TREES * DEPTH) MinHash values of rows that have shingles."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(cut) - 1, len(_MUL)), np.uint32)
    for k, (m, a) in enumerate(zip(_MUL, _ADD, strict=True)):
        v = low * m + a
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(v, cut[:-1])
    return out


def _signed_rows(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for at, n, data, off in text_slices(batch, "text"):
            s, cut = _shingles(data, off)
            full = np.flatnonzero(np.diff(cut))
            cut = np.append(cut[:-1][full], len(s))
            sig = signatures(s, cut) if len(full) else np.zeros((0, len(_MUL)), np.uint32)
            yield pa.RecordBatch.from_arrays([ids.slice(at, n).take(pa.array(full)), *[pa.array(k) for k in _fingerprints(s, cut)], pa.array([r.tobytes() for r in sig], pa.binary())],
                                             names=["doc_id", "k1", "k2", "sig"])


def _paths(depth: int):
    """For each tree: the bucket (tree and prefix) of each text."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
            bucket = np.zeros((n, TREES), np.uint64)
            for d in range(depth):
                bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d] + np.arange(TREES, dtype=np.uint64) * np.uint64(1 << 40))
            tail = sig[:, :, depth:].astype(">u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("doc_id").to_numpy(), TREES)), pa.array(signed(bucket.reshape(-1))), pa.array([t.tobytes() for t in tail.reshape(n * TREES, -1)], pa.binary())],
                names=["doc_id", "bucket", "tail"])
    return run


def _low_bytes(batches):
    for batch in batches:
        low = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8)[::4].reshape(batch.num_rows, TREES * DEPTH)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in low], pa.binary())], names=["doc_id", "low"])


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every id to the smallest one it is connected with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label[a], new[a])  # a whole tree moves with its members
        np.minimum.at(new, label[b], new[b])
        new = new[new]
        if (new == label).all():
            own = label != np.arange(len(ids))
            return ids[label[own]], ids[own]
        label = new


def _fewer(batches):
    """A spanning set of the links of a task."""
    found, size = [], 0
    for batch in batches:
        found.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
        size += batch.num_rows
        if size > 1 << 20:
            found = [_spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))]
            size = len(found[0][0])
            if size > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=["a", "b"])
                found, size = [], 0
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))], names=["a", "b"])


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same texts: a text that many buckets or blocks link keeps about one.

    Links meet at their larger end, of which a spanning set has few: those names came from are the smallest ids."""
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.repartition("b").mapInArrow(lean(_fewer), "a bigint, b bigint")


def _linked(least: float):
    """Links between rows in trie order: with the `NEAR` rows before and the first row of the bucket, where at least `least` of the
    signatures agree (one byte of each value is compared, which only lets more pass). A bucket that a border of ranges cuts is
    held together by a link to its first row, from all its rows if `_across` leaves it out. Only a spanning set of links leaves a task."""
    def run(batches):
        bucket, doc, head, many, low = *(np.zeros(0, np.int64) for _ in range(4)), np.zeros((0, TREES * DEPTH), np.uint8)
        found, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(bucket)
            b, d, h, m = (batch.column(c).to_numpy() for c in ("bucket", "doc_id", "head", "n"))
            new = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(len(b), -1)
            bucket, doc, head, many, low = (np.concatenate(x) for x in ((bucket, b), (doc, d), (head, h), (many, m), (low, new)))
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            first = np.repeat(start, np.diff(np.append(start, len(bucket))))
            at = np.arange(old, len(bucket))
            for to, of in [(at, first[at]), *((at[at >= k], at[at >= k] - k) for k in range(1, NEAR + 1))]:
                ok = (bucket[to] == bucket[of]) & (doc[to] != doc[of])
                to, of = to[ok], of[ok]
                ok = (low[to] == low[of]).mean(1) >= least
                found.append((doc[to[ok]], doc[of[ok]]))
            cut = at[(head[at] != doc[first[at]]) & ((first[at] == at) | (many[at] <= NEAR + 2))]
            found.append((doc[cut], head[cut]))
            size += sum(len(x) for x, _ in found[-NEAR - 2:])
            if size > 1 << 20:
                found = [_spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                size = len(found[0][0])
                if size > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=["a", "b"])
                    found, size = [], 0
            # The first row of an open bucket and the last few rows are still needed.
            keep = np.unique(np.append(np.arange(max(0, len(bucket) - NEAR), len(bucket)), first[-1]))
            bucket, doc, head, many, low = bucket[keep], doc[keep], head[keep], many[keep], low[keep]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))], names=["a", "b"])
    return run


def _tested(least: float):
    """Links between texts of different families in a pair of blocks of a bucket, where at least `least` of the signatures agree."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        doc, root, block = (t.column(c).to_numpy() for c in ("doc_id", "root", "block"))
        low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(len(doc), -1)
        to, of = (np.flatnonzero(block == k.as_py()) for k in key[1:])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(to), 64):
            some = to[k:k + 64]
            x, y = np.nonzero(((low[some][:, None] == low[of]).mean(2) >= least) & (root[some][:, None] != root[of]))
            found.append((doc[some[x]], doc[of[y]]))
        return pa.table(dict(zip("ab", _spanning(*(np.concatenate(x) for x in zip(*found, strict=True))), strict=True)))
    return run


def _families(reps: DataFrame, threshold: float, block: int) -> DataFrame:
    """(v, root): texts that are connected by possible links, named by their smallest id."""
    least = threshold - DOUBT * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    paths = reps.select("doc_id", "sig").mapInArrow(lean(_paths(last_depth(threshold))), "doc_id bigint, bucket bigint, tail binary")
    shared = stored(paths, "paths")
    many = shared.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("tail", "doc_id")).alias("head")).where("n > 1").select("bucket", "n", F.col("head.doc_id").alias("head"))
    low = reps.select("doc_id", "sig").mapInArrow(lean(_low_bytes), "doc_id bigint, low binary")
    own = shared.join(many, "bucket").join(low, "doc_id")
    # Trie order inside a bucket comes from ranges of a sorted table, so a bucket of any size is spread over tasks.
    ordered = own.repartitionByRange("bucket", "tail", "doc_id").sortWithinPartitions("bucket", "tail", "doc_id").select("bucket", "doc_id", "head", "n", "low")
    family = connected(thinned(ordered.mapInArrow(lean(_linked(least)), "a bigint, b bigint")), "families")
    across = stored(_across(shared, low, family, least, block), "across")
    if across.isEmpty():
        return family
    return connected(across.union(family.select("v", "root")), "families")


def _across(shared: DataFrame, low: DataFrame, family: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b): links between families whose texts share a bucket that `_linked` does not test completely."""
    named = shared.join(shared.groupBy("bucket").count().where(F.col("count") > NEAR + 2).select("bucket"), "bucket") \
        .join(family.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi") \
        .select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = named.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).join(low, "doc_id")
    tiles = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "root", "block", "low")
    return tiles.groupBy("bucket", "i", "j").applyInArrow(_tested(least), "a bigint, b bigint")


def _sets(batches):
    """The shingle set of each row whose fingerprint is the one its id counts with."""
    for batch in batches:
        k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
        rest = batch.select(["doc_id", "family", "copies", "blocks", "block"])
        for at, n, data, off in text_slices(batch, "text"):
            s, cut = _shingles(data, off)
            full = np.flatnonzero(np.diff(cut))
            cut = np.append(cut[:-1][full], len(s))
            f1, f2 = _fingerprints(s, cut)
            use = np.flatnonzero((f1 == k1[at + full]) & (f2 == k2[at + full]))
            own = rest.slice(at, n).take(pa.array(full[use]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([np.unique(s[cut[i]:cut[i + 1]]).tobytes() for i in use], pa.binary())], names=[*own.schema.names, "shingles"])


def _shared(parts: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; shingles that only one text has are left out beforehand."""
    n = len(parts)
    owner = np.repeat(np.arange(n), [len(p) for p in parts])
    code = np.concatenate(parts)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    head = np.concatenate([[True], code[1:] != code[:-1]])
    number = np.cumsum(head) - 1
    often = np.bincount(number)[number] > 1
    code, owner = (np.cumsum(head & often) - 1)[often], owner[often]
    both, step = np.zeros((n, n), np.float32), 1 << 13
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [lo, lo + step])
        m = np.zeros((n, step), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        both += m @ m.T
    return both


def _verify(threshold: float):
    """For each text of a group: its verified links, and the smallest id of the group it is connected with."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, first = np.unique(t.column("doc_id").to_numpy(), return_index=True)
        block, copies = (t.column(c).to_numpy()[first] for c in ("block", "copies"))
        parts = [np.frombuffer(x, np.uint64) for x in t.column("shingles").take(pa.array(first)).to_pylist()]
        size = np.array([len(p) for p in parts])
        both = _shared(parts)
        link = both >= threshold * (size[:, None] + size - both) - 1e-3
        np.fill_diagonal(link, False)
        if key[1].as_py() != key[2].as_py():
            link &= block[:, None] != block
        head = np.arange(len(ids))
        while True:
            new = np.minimum(head, np.where(link, head, len(ids)).min(1))
            new = new[new]
            if (new == head).all():
                break
            head = new
        return pa.table({"doc_id": ids, "n": link @ copies.astype(np.int64), "head": ids[head], "similar": link.sum(1).astype(np.int64)})
    return run


def joined(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, n_similar, n_copies, n_rows: one row for each id.

    n_links counts the other documents with a similarity of at least `threshold`, copies included, n_similar the other texts among
    them n_copies the documents with the same words and n_rows the rows of the id."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    rows = stored(texts.mapInArrow(lean(_signed_rows), "doc_id bigint, k1 bigint, k2 bigint, sig binary"), "signatures")
    keys = rows.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.k1", "k.k2")
    groups = stored(keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    reps = stored(rows.join(groups.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"]).select("doc_id", "sig"), "texts")
    family = _families(reps, threshold, block)
    of_size = family.groupBy("root").agg(F.count("*").alias("n"))
    members = stored(family.join(of_size, "root").join(groups.withColumnRenamed("rep", "v"), "v")
                     .select(F.col("v").alias("doc_id"), F.col("root").alias("family"), "copies", F.ceil(F.col("n") / block).cast("int").alias("blocks"), "k1", "k2")
                     .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "members")
    likely = maybe_in(texts, members, "doc_id")  # so that few texts are moved
    named = likely.join(members.hint("merge"), "doc_id").mapInArrow(lean(_sets), "doc_id bigint, family bigint, copies bigint, blocks int, block int, shingles binary")
    tiles = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "block", "copies", "shingles")
    verified = stored(tiles.groupBy("family", "i", "j").applyInArrow(_verify(threshold), "doc_id bigint, n bigint, head bigint, similar bigint"), "links")
    classes = connected(thinned(verified.select(F.col("doc_id").alias("a"), F.col("head").alias("b"))), "classes")
    links = verified.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("similar").alias("similar"))
    by_text = groups.join(classes.select(F.col("v").alias("rep"), "root"), "rep", "left").join(links.select(F.col("doc_id").alias("rep"), "n", "similar"), "rep", "left") \
        .select("k1", "k2", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("similar", F.lit(0)).alias("n_similar"), "copies")
    known = keys.join(by_text, ["k1", "k2"]).select("doc_id", "class_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "n_similar", F.col("copies").alias("n_copies"))
    every = texts.groupBy("doc_id").agg(F.count("*").alias("n_rows")).join(known, "doc_id", "left")
    return every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                        F.coalesce("n_similar", F.lit(0)).cast("bigint").alias("n_similar"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"), "n_rows")
