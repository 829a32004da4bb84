"""Token ids of documents in grammar-compressed shards (Re-Pair).

Documents are put in the order of their ids by range partitions and sorted inside each. A task encodes its documents,
appends the end id to each and cuts the ids into shards of about `SHARD_TOKENS` at document borders. In each shard
frequent pairs of ids are repeatedly replaced by nonterminals: a round counts all pairs, replaces the most frequent
ones from left to right, until no pair occurs `MIN_COUNT` times or the shard has `MAX_RULES` rules (so that its symbols mostly fit 16 bits). A nonterminal may
stand for any number of ids.

A shard is one row (part, shard, n_docs, n_tokens, body) of the output files, which Spark's own writer commits, so lost executors
leave no half-written shards and any file system serves. The body holds, little-endian:
    4 bytes `RPS1`; 4 uint32: documents D, rules R, symbols S, first nonterminal N
    D uint64 document ids with a marker bit row for NULL ids (D bytes), D uint32 token counts
    R pairs of uint32 (the rule of nonterminal N + r), R uint32 expansion lengths
    1 byte width w (2 or 4); S symbols of w bytes
Expansion lengths give the symbol in which any token position falls, so a document is decoded without the rest.

Defined results: NULL text is empty and has only the end id; NULL ids come first; rows that share an id stand in the order of
their texts; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeflow.llm.common import lean, pieces, shared_dir, text_slices

END_ID = 2
SHARD_TOKENS = 1 << 20
MAX_RULES = 1 << 14
MIN_COUNT = 8
SLOT_BITS = 18  #: of the table of hashed pair counts, small enough for the processor's cache
_MAGIC = b"RPS1"
MARKS = ".,;:!?%$*&|#@)"  #: punctuation that is cut off a word before it is looked up


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _ByteLetters(dict):
    """The characters that stand for the UTF-8 bytes of a character in a byte-level vocabulary, asked of the library once each."""

    def __missing__(self, code: int) -> str:
        from tokenizers import pre_tokenizers

        self[code] = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
        return self[code]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges start..start + size, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Memory:
    """Ids by fingerprint in sorted arrays, about 25 bytes an entry; the newest entries wait in a small dict."""

    def __init__(self, keep: int, recent: int = 1 << 16):
        self.keep, self.most = keep, recent
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.recent: dict[int, bytes] = {}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are in the arrays, and where)"""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def add(self, keys: list[int], ids: list[bytes]) -> None:
        self.recent.update(zip(keys, ids, strict=True))
        if len(self.recent) < self.most:
            return
        if len(self.keys) > self.keep:
            self.clear()
            return
        size = np.fromiter(map(len, self.recent.values()), np.int64, len(self.recent)) // 4
        new = np.fromiter(self.recent, np.uint64, len(self.recent))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(self.recent.values()), np.uint32)])
        keys_ = np.concatenate([self.keys, new])
        order = np.argsort(keys_, kind="stable")
        self.keys, self.at, self.size = keys_[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.recent = {}


class Encoder:
    """Ids of texts. Pieces between spaces are encoded once and remembered: the vocabulary never joins across white space.

    A piece that is one word of Latin-1 letters, with or without punctuation behind it, goes straight to the library's
    model: lower-casing is all its normaliser does to it and its pattern cuts it where the letters end. Other pieces take the full way.
    The memory, by 64-bit fingerprints of pieces, is emptied when it holds `keep` of them, so it is bounded whatever the texts."""

    def __init__(self, path: str, keep: int = 1 << 21):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.letters = _ByteLetters()
        self.known, self.words, self.tails = _Memory(keep), {}, {}

    def _full(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        if len(self.words) > 1 << 17:
            self.words.clear()
        words, tails, tokenize, out, rest = self.words, self.tails, self.model.tokenize, [], []
        for i, p in enumerate(pieces):
            body = p.rstrip(MARKS)
            if body.isalpha() and (body.isascii() or max(body) <= "ÿ"):
                word, tail = body.lower(), p[len(body):]
                ids = words.get(word)
                if ids is None:
                    shown = word if word.isascii() else word.translate(self.letters)
                    ids = words[word] = array("I", [t.id for t in tokenize(shown)]).tobytes()
                if tail:
                    if tail not in tails:
                        tails[tail] = self._full([tail])[0]
                    ids = ids + tails[tail]
                out.append(ids)
            else:
                out.append(b"")
                rest.append(i)
        if len(tails) > 1 << 14:
            tails.clear()
        for i, ids in zip(rest, self._full([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of UTF-8 texts that lie behind one another."""
        key, row, start, end = pieces(data, off)
        own, first, inv = np.unique(key, return_index=True, return_inverse=True)
        hit, at = self.known.find(own)
        rest = np.flatnonzero(~hit)
        keys = own[rest].tolist()
        got = list(map(self.known.recent.get, keys))
        new = [i for i, g in enumerate(got) if g is None]
        if new:
            raw, of = data.tobytes(), first[rest[new]]
            for i, ids in zip(new, self._learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[of].tolist(), end[of].tolist(), strict=True)]), strict=True):
                got[i] = ids
        size = np.empty(len(own), np.int64)
        size[hit] = self.known.size[at[hit]] if hit.any() else 0
        size[rest] = np.fromiter(map(len, got), np.int64, len(got)) // 4
        place = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        if hit.any():
            flat[_ranges(place[hit], size[hit])] = self.known.flat[_ranges(self.known.at[at[hit]], size[hit])]
        flat[_ranges(place[rest], size[rest])] = np.frombuffer(b"".join(got), np.uint32)
        if new:
            self.known.add([keys[i] for i in new], [got[i] for i in new])
        count = size[inv]
        return flat[_ranges(place[inv], count)], np.bincount(row, count, len(off) - 1).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def compress(ids: np.ndarray, first: int, min_count: int = MIN_COUNT, max_rules: int = MAX_RULES) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule r is the pair that nonterminal first + r stands for."""
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    for round_ in count(0):
        room = max_rules - len(rules)
        if len(seq) < 2 or room <= 0:
            break
        # Counts of hashed pairs are upper bounds; only places whose pair may be frequent enough are counted exactly.
        slot = (seq[:-1] * np.uint32(0x9E3779B1) ^ seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS)
        seen = np.bincount(slot, minlength=1 << SLOT_BITS)
        most = max(1, min(room, MAX_RULES // 4 * (round_ + 1)))
        tall = np.bincount(np.minimum(seen, 1 << 16))[::-1].cumsum()[::-1]  # slots with at least that count
        floor = max(min_count, int(np.searchsorted(-tall, -2 * most, side="left")))
        at = np.flatnonzero((seen >= floor)[slot])
        code = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        order = np.argsort(code)
        code = code[order]
        head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        pair, n = code[head], np.diff(np.append(head, len(code)))
        good = np.flatnonzero(n >= min_count)
        good = good[np.argsort(-n[good], kind="stable")][:most]
        if not len(good):
            break
        rank = np.full(len(pair), -1)
        rank[good] = np.arange(len(good))
        chosen = np.empty(len(code), np.int64)
        chosen[order] = np.repeat(rank, n)
        at, chosen = at[chosen >= 0], chosen[chosen >= 0]
        # Neighbouring places overlap: of each run of them every second one is replaced.
        head = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
        nth = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        at, chosen = at[nth % 2 == 0], chosen[nth % 2 == 0]
        keep = np.bincount(chosen, minlength=len(good)) >= 3
        if not keep.any():
            break
        at, chosen = at[keep[chosen]], chosen[keep[chosen]]
        new = pair[good[keep]]
        seq[at] = first + len(rules) + (np.cumsum(keep) - 1)[chosen]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        rules = np.concatenate([rules, np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)])
    return seq, rules


def _unrolled(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """One level of rules after the other."""
    while True:
        big = seq >= first
        if not big.any():
            return seq
        width = big.astype(np.int64) + 1
        to = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        out[to] = np.where(big, rules[np.where(big, seq - first, 0), 0] if len(rules) else seq, seq)
        out[to[big] + 1] = rules[seq[big] - first, 1]
        seq = out


def expand(seq: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that the symbols stand for. The rules are unrolled once; the symbols are then copied from that table."""
    lengths = _lengths(rules, first) if lengths is None else lengths
    table = np.concatenate([np.arange(first, dtype=np.uint32), _unrolled(np.arange(first, first + len(rules), dtype=np.uint32), rules, first)])
    size = np.concatenate([np.ones(first, np.int32), lengths.astype(np.int32)])
    width = size[seq]
    shift = (np.cumsum(size) - size)[seq] - (np.cumsum(width) - width)
    return table[np.repeat(shift, width) + np.arange(int(width.sum()))]


def _lengths(rules: np.ndarray, first: int) -> np.ndarray:
    n = np.ones(len(rules), np.int64)
    todo = np.arange(len(rules))
    done = np.zeros(len(rules), bool)
    while len(todo):  # a rule only names terminals and earlier rules: a round of compression is settled at a time
        a, b = rules[todo, 0].astype(np.int64) - first, rules[todo, 1].astype(np.int64) - first
        ready = ((a < 0) | done[np.maximum(a, 0)]) & ((b < 0) | done[np.maximum(b, 0)])
        r = todo[ready]
        n[r] = np.where(a[ready] < 0, 1, n[np.maximum(a[ready], 0)]) + np.where(b[ready] < 0, 1, n[np.maximum(b[ready], 0)])
        done[r] = True
        todo = todo[~ready]
    return n


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray, first: int) -> bytes:
    seq, rules = compress(ids, first)
    top = first + len(rules)
    width = 2 if top <= 1 << 16 else 4
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([_MAGIC, struct.pack("<4I", len(doc_ids), len(rules), len(seq), first), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(),
                     counts.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), _lengths(rules, first).astype("<u4").tobytes(), bytes([width]), seq.astype(f"<u{width}").tobytes()])


class Shard:
    def __init__(self, body: bytes):
        if body[:4] != _MAGIC:
            raise ValueError("not a shard")
        d, r, s, self.first = struct.unpack_from("<4I", body, 4)
        at = 20

        def take(kind, n):
            nonlocal at
            x = np.frombuffer(body, kind, n, at)
            at += x.nbytes
            return x

        ids, known = take("<i8", d), take(np.uint8, d)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.counts = take("<u4", d).astype(np.int64)
        self.rules = take("<u4", 2 * r).reshape(-1, 2)
        self.lengths = take("<u4", r).astype(np.int64)
        width = int(take(np.uint8, 1)[0])
        self.seq = take(f"<u{width}", s).astype(np.uint32)

    def tokens(self) -> np.ndarray:
        return expand(self.seq, self.rules, self.first, self.lengths)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document; only the symbols that cover it are expanded."""
        width = np.ones(len(self.seq), np.int64)
        big = self.seq >= self.first
        width[big] = self.lengths[self.seq[big] - self.first]
        end = np.cumsum(width)
        lo = int(self.counts[:i].sum())
        hi = lo + int(self.counts[i])
        a, b = int(np.searchsorted(end, lo, side="right")), int(np.searchsorted(end, hi, side="left")) + 1
        skip = lo - (int(end[a - 1]) if a else 0)
        return expand(self.seq[a:b], self.rules, self.first, self.lengths)[skip:skip + hi - lo]


def _write(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        first = max(encode.tok.get_vocab_size(with_added_tokens=True), end_id + 1)
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def shard(doc_ids, counts, ids):
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number - 1], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()),
                                               pa.array([pack(doc_ids, counts, ids, first)], pa.binary())], names=["part", "shard", "n_docs", "n_tokens", "body"])

        def flushed(all_: bool):
            """Full shards of what is held; the rest stays, or goes too with `all_`."""
            nonlocal held
            doc_ids, counts, ids = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            end = np.cumsum(counts)
            a = 0
            while a < len(doc_ids):
                base = int(end[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(end, base + shard_tokens, side="right")))
                if b >= len(doc_ids) and not all_:
                    break
                yield shard(doc_ids[a:b], counts[a:b], ids[base:int(end[b - 1])])
                a = b
            held = [(doc_ids[a:], counts[a:], ids[int(end[a - 1]) if a else 0:])] if a < len(doc_ids) else []

        for batch in batches:
            for at, n, data, off in text_slices(batch, "text"):
                ids, counts = encode(data, off)
                held.append((batch.column("doc_id").slice(at, n).to_pylist(), counts + 1, np.insert(ids, np.cumsum(counts), np.uint32(end_id))))
                if sum(len(h[2]) for h in held) > shard_tokens:
                    yield from flushed(False)
        if held:
            yield from flushed(True)
    return run


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, parts: int | None = None) -> None:
    """Encode `docs` and write the shards below `folder`."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text") \
        .mapInArrow(lean(_write(path or tokenizer_path(), end_id, shard_tokens)), "part int, shard int, n_docs bigint, n_tokens bigint, body binary").write.parquet(folder)


def _read(batches):
    for batch in batches:
        for base, body in zip(batch.column("base").to_pylist(), batch.column("body"), strict=True):
            s = Shard(body.as_py())
            flat = s.tokens()
            cut = np.concatenate([[0], np.cumsum(s.counts)])
            data = flat.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.doc_ids, pa.int64()), pa.array(base + cut[:-1]), pa.array(s.counts), pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    shards = spark.read.schema("part int, shard int, n_docs bigint, n_tokens bigint, body binary").parquet(folder)
    head = shards.select("part", "shard", "n_tokens")
    parts = head.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))  # a row for each partition written
    starts = head.withColumn("base", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).join(parts, "part") \
        .select("part", "shard", (F.col("base") + F.col("part_base")).alias("base"))
    return shards.join(starts, ["part", "shard"]).select("base", "body").mapInArrow(lean(_read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encoded(docs: DataFrame, **options) -> DataFrame:
    """Write the shards to a new shared folder and read the index of documents back from them."""
    folder = shared_dir(docs.sparkSession, "tokens")
    write(docs, folder, **options)
    return index(docs.sparkSession, folder)
