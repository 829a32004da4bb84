"""Periodic runs, SimHash components and the audit of sources against brute force."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from test_llm_operators import SCHEMA, edge_rows, prose, rows, same  # noqa: E402

from tapeflow.llm import divergence, periodic, simhash  # noqa: E402
from tapeflow.llm.common import table  # noqa: E402
from tapeflow.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Periodic runs

def repeating(r, n, kinds):
    x = []
    while len(x) < n:
        u = [r.randrange(kinds) for _ in range(r.randint(1, 12))]
        x += u * r.choice([1, 1, 2, 4, 5, 9])
    return x[:n]


def test_transform_is_exact():
    r = np.random.default_rng(3)
    for size in (1, 2, 8, 64):
        a, b = r.integers(0, periodic.PRIME, (2, 3, size)).astype(np.uint64)
        assert (periodic.restored(periodic.transformed(a.copy())) == a).all()
        got = periodic.restored(periodic.transformed(a.copy()) * periodic.transformed(b.copy()) % np.uint64(periodic.PRIME))
        want = [[sum(int(x[i]) * int(y[(k - i) % size]) for i in range(size)) % periodic.PRIME for k in range(size)] for x, y in zip(a, b, strict=True)]
        assert got.tolist() == want


@pytest.mark.parametrize("kinds", [1, 2, 3, 50])
def test_runs_of_random_words(kinds):
    r = random.Random(kinds)
    for _ in range(150):
        x = repeating(r, r.randint(0, 220), kinds)
        if r.random() < 0.3:
            x = x[:30] * 7
        assert sorted(periodic.runs_of(np.array(x, np.int64), len(x))) == brute.periodic_runs(x)


def test_runs_when_the_mapping_collides(monkeypatch):
    """Distances that only the mapped words allow are rejected; no run is lost."""
    monkeypatch.setattr(periodic, "mix", lambda x: x % np.uint64(2))
    r = random.Random(9)
    for _ in range(30):
        x = [v + 100_000 * (v % 3) for v in repeating(r, 200, 9)]
        assert sorted(periodic.runs_of(np.array(x, np.int64), len(x))) == brute.periodic_runs(x)


def digests(doc_id, text):
    w = brute.echoed(doc_id, text)
    found = brute.periodic_runs(w)
    best = min(found, key=lambda f: (-f[2], f[0], f[1]), default=None)
    lines = "".join(f"{a},{n},{q}\n" for a, q, n in found)
    return (doc_id, len(found), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute.collapsed(w, found).encode()).hexdigest())


def test_runs_of_texts(spark, edge):
    texts = [(t if t is None or len(t) < 9000 else t[:9000]) for _, t, *_ in edge_rows()]
    more = ["a b c " * 5 + "a b", "é é é é é é é x", "x" * 5000 + " " + "y z " * 6, "tail " * 6, " w w w w w", "\n\n a\tb a\tb a\tb a\tb \v"]
    pairs = [(i, t) for i, t in enumerate(texts + more)]
    df = spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(2)
    got = rows(periodic.detected(df).select("doc_id", "n_words", F.transform("runs", lambda x: F.array(x.start, x.period, x.length)).alias("runs"), "collapsed"), "doc_id", "n_words", "runs", "collapsed")
    want = []
    for i, t in pairs:
        w = brute.TOKEN.findall(t or "")
        found = brute.periodic_runs(w)
        want.append((i, len(w), [list(f) for f in found], brute.collapsed(w, found)))
    same(got, want)
    assert sum(bool(x[2]) for x in want) >= 6


def test_runs_ignore_other_columns_and_keep_rows(edge, empty):
    assert periodic.detected(edge).count() == len(edge_rows())
    assert periodic.detected(empty).count() == 0
    assert periodic.detected(edge).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_runs_query(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, small).collect())
    assert got == sorted(digests(d, t) for d, t in docs)
    assert any(g[1] and zlib.crc32(str(g[0]).encode()) % 10 == 0 for g in got)


# SimHash

def test_simhash_edge(edge):
    got = rows(simhash.components(edge).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id"), "doc_id", "f", "component_id")
    same(got, brute.simhash_components([r[:2] for r in edge_rows()]))


def test_simhash_empty(empty):
    assert simhash.components(empty).count() == 0


def test_simhash_query(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    got = rows(QUERIES["op12_simhash"](spark, small), "doc_id", "fingerprint", "component_id")
    same(got, brute.simhash_components(docs))
    assert any(g[0] != g[2] for g in got)


def test_long_text_is_counted_in_pieces(monkeypatch):
    text = prose(5, 700)
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprints(*simhash._shingles(data, np.array([0, len(data)])))[0] == brute.simhash(text)


@pytest.mark.parametrize("short", [2, 64])
def test_posting_links(short, monkeypatch):
    """Short and long postings give the links that comparing all pairs gives, and each is bounded by its free bits."""
    monkeypatch.setattr(simhash, "SHORT", short)
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 3).astype(np.uint64)
    fp = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) for b in base]]))
    want = {(a, b) for i, a in enumerate(fp.tolist()) for b in fp[:i].tolist() if (a ^ b).bit_count() <= 2}
    got = set()
    for k, p in enumerate(simhash.PLACES):
        lists = {}
        for x in fp.tolist():
            lists.setdefault(x & simhash._mask(p) & (1 << 64) - 1, []).append(x)
        cut = np.concatenate([[0], np.cumsum([len(x) for x in lists.values()])])
        a, b = simhash.links(np.array([x for v in lists.values() for x in v], np.uint64), cut, np.full(len(lists), k))
        got |= {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == want


# Audit of sources

def test_divergence_edge(edge):
    docs = [(r[1], r[2], r[3]) for r in edge_rows()]
    for least in (1, 2, 30):
        got = rows(divergence.audited(edge, top=5, least_docs=least, shard=16), "lang", "source", "part", "item", "value", "rank")
        same(got, brute.divergence(docs, least, 5))


def test_divergence_documents(spark, small):
    docs = table(spark, small, "documents")
    got = rows(QUERIES["op13_source_divergence"](spark, small), "lang", "source", "part", "item", "value", "rank")
    same(got, brute.divergence([(r.text, r.lang, r.source) for r in docs.collect()]))


def test_divergence_empty(empty):
    assert divergence.audited(empty).count() == 0


def test_partial_counts_are_bounded(edge, monkeypatch):
    """Sending partial counts early, in small slices, changes nothing."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_pandas(edge.select("text", "lang", "source").toPandas())
    want = divergence._merged([pa.Table.from_batches(divergence._partial([batch]))]).sort_by([(k, "ascending") for k in divergence.KEYS])
    monkeypatch.setattr(divergence, "PARTIAL", 50)
    monkeypatch.setattr(divergence, "SLICE", 200)
    sent = list(divergence._partial([batch, batch.slice(0, 0)]))
    assert len(sent) > 3
    got = divergence._merged([pa.Table.from_batches(sent)]).sort_by([(k, "ascending") for k in divergence.KEYS])
    assert got.equals(want)


def test_share_is_exact_for_large_counts(spark):
    n = [0, 7, 10**10, 9 * 10**15]
    df = spark.createDataFrame([(x, 10**16, 12345) for x in n], "n bigint, total bigint, terms bigint")
    got = [r[0] for r in df.orderBy("n").select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 1_000_000_000 * (x + 5) // (10**16 + 5 * 12345) for x in n]


# Classifiers by plain loops

def test_quality_scores_equal_plain_loops(spark, small, edge):
    from tapeflow.llm import quality
    docs = table(spark, small, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, small, "labels"))
    some = edge.select("doc_id", F.substring("text", 1, 4000).alias("text")).unionByName(docs.orderBy("doc_id").limit(40))
    for r in quality.scored(some, model).collect():
        assert r.score == pytest.approx(brute.quality_score(model, r.text), abs=2e-4)


def test_languages_equal_plain_loops(spark, small, edge):
    from tapeflow.llm import language
    docs = table(spark, small, "documents").select("doc_id", F.substring("text", 1, 600).alias("text"), "lang").orderBy("doc_id").limit(80)
    df = docs.unionByName(edge.select("doc_id", F.substring("text", 1, 300).alias("text"), "lang"))
    rows_ = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language.predicted(df, *language.prototypes(df)).collect()), key=repr)
    for (a, p, s), (b, q, t) in zip(got, sorted(brute.languages(rows_), key=repr), strict=True):
        assert (a, p) == (b, q) and s == pytest.approx(t, abs=1e-5)
