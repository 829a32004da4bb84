"""Document operators against brute force, on the small tables and on rows with nulls, ties, repeats and clashing columns."""

import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tapeflow.llm import decontaminate, language, lm, mixture, near_duplicates, neighbours, pii, quality, substrings, token_files  # noqa: E402
from tapeflow.llm.common import connected, shared_dir  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n int, score double, words string, row_no int, copies int, held_out string, spans int, block string"
SYLLABLES = ["an", "the", "or", "ti", "sh", "ou", "en", "re", "wh", "ly", "é", "ñä"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def edge_rows():
    long = prose(1, 9000)
    near = long.split(" ")
    near[4500] = "changed"
    base = prose(2, 80)
    rows = [
        (1, long), (2, " ".join(near)), (3, base), (4, base), (4, base), (5, base.upper()), (6, ""), (7, None), (8, "one two"), (9, "one two"), (10, "  \n\t "),
        (None, base), (None, None), (11, "nd " * 400), (12, prose(3, 30) + "\n" + base + " " + prose(4, 30)), (13, "12345 !!! 999"),
        (14, "Mail a.b@c.de, b@c.d.@e.f or x@y; card 4111 1111 1111 1111 or 4111-1111-1111-1112; 1.2.3.4.5.6.7.8 and 999.1.1.1 +1 (555) 010-9999 "
             "iban DE89 3704 0044 0532 0130 00 \U0001F600 z@q.io account GB82WEST12345698765432 0.0.0.255 +49 (0)"),
        (15, "🙂 " + prose(5, 12)), (16, "'s <|endoftext|> don't ab,. c.,d Straße ΑΣ naïve é  x")]
    return [(d, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", i, 0.5, "w", i, 2, "h", 9, "b") for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pairs():
    return [r[:2] for r in edge_rows()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# Benchmark decontamination

ITEMS = [(1, "one two"), (2, prose(2, 25)), (3, None), (None, "one two"), (4, "..."), (2, prose(1, 40)), (5, "One, TWO!"), (6, prose(99, 50))]


def test_contaminated_edge(spark, edge, pairs):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, words string")
    for bits in (1 << 10, 1 << 20):  # a crowded bitmap changes nothing
        got = rows(decontaminate.contaminated(edge, items, filter_bits=bits), "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
        same(got, brute.contaminated(pairs, ITEMS))


def test_contaminated_documents(spark, small, documents):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    got = rows(decontaminate.contaminated(documents, items), "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    same(got, brute.contaminated([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()]))


def test_contaminated_empty(spark, edge, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(empty, none).count() == 0
    assert not any(r.contaminated for r in decontaminate.contaminated(edge, none).collect())


# Repeated substrings

@pytest.mark.parametrize(("length", "reach", "window", "cell"), [(40, 24, 8, 4), (60, 40, 12, 16)])
def test_repeats_edge(edge, pairs, length, reach, window, cell):
    short = [(d, t[:3000] if t else t) for d, t in pairs]
    df = edge.withColumn("text", F.substring("text", 1, 3000))
    got = rows(substrings.without_repeats(df, length, reach=reach, window=window, cell=cell), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(got, brute.without_repeats(short, length))


def test_repeats_documents(documents):
    got = rows(substrings.without_repeats(documents), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(got, brute.without_repeats([(r.doc_id, r.text) for r in documents.collect()], 400))


def test_repeats_empty(empty):
    assert substrings.without_repeats(empty).count() == 0


def test_triggers_depend_on_the_string_alone():
    text = np.frombuffer((prose(7, 400) + "ab" * 300).encode(), np.uint8)
    a = substrings.triggers(text, 64, 8)
    for s in range(0, len(text) - 80, 7):
        assert substrings.triggers(text[s:s + 71].copy(), 64, 8)[0] == a[s] - s


# Nearest neighbours

def test_nearest(spark):
    r = np.random.default_rng(3)
    v = [(i, [float(np.float32(x)) for x in r.normal(size=12)]) for i in range(300)]
    v += [(i, v[7][1]) for i in range(300, 340)] + [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] + [1.0] * 11), (404, [None] + [1.0] * 11), (405, [float("inf")] * 12),
                                                   (None, [1.0] * 12), (406, [1.0, 2.0]), (410, [2.0, 1.0]), (1, v[1][1])]
    df = spark.createDataFrame([(i, x, 5, 1) for i, x in v], "vec_id bigint, embedding array<float>, rank int, dim int").repartition(4)
    for q, c in ((2048, 8192), (7, 50)):
        got = neighbours.nearest(df, F.col("vec_id") % 10 == 0, query_block=q, candidate_block=c).collect()
        want = brute.nearest(v[:-1], lambda i: i % 10 == 0, 5)
        assert sorted((g.query_id, g["rank"], g.vec_id) for g in got) == sorted(w[:3] for w in want)
        have = {(w[0], w[1]): w[3] for w in want}
        assert all(abs(g.score - have[g.query_id, g["rank"]]) < 1e-9 for g in got)


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert neighbours.nearest(df, F.lit(True)).count() == 0
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


# Personal data

def test_personal_data(edge, pairs):
    got = pii.detected(edge.select("doc_id", "text"), name="found").collect()
    base = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.found if s.kind != "iban"]) for r in got), key=repr)
    assert base == sorted(((d, brute.personal_data(t)) for d, t in pairs), key=repr)
    rich = next(r for r in got if r.doc_id == 14)
    assert [rich.text[s.start:s.end] for s in rich.found if s.kind == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert all(0 <= s.score <= 1 for s in rich.found)


def test_personal_data_random(spark):
    r = random.Random(5)
    texts = ["".join(r.choices(["1", "2", "0", "4111111111111111", ".", "@", "a", "+", " ", "-", "(", ")", "é", "🙂", "b.c"], k=60)) for _ in range(300)]
    got = pii.detected(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    assert [[(s.kind, s.start, s.end) for s in x.spans if s.kind != "iban"] for x in got] == [brute.personal_data(t) for t in texts]


def test_personal_data_is_one_projection(documents):
    plan = pii.detected(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_personal_data_long_runs(spark):
    df = spark.createDataFrame([("1" * 100_000 + " " + "a" * 100_000 + "@" + "b." * 20_000,)], "text string")
    assert len(pii.detected(df).first().spans) <= 2


# Jaccard join

def test_join_edge(edge, pairs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.joined(edge, block=2).collect()}
    assert got == brute.jaccard_classes({d: t for d, t in pairs if d is not None}.items())


def test_join_hot_family(spark):
    """Many variants of one text, in blocks of 8: all links between different texts are counted."""
    r = random.Random(9)
    base = prose(11, 120).split(" ")
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2])):
            w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, prose(1000 + i, 60)) for i in range(60)]
    got = {x.doc_id: (x.class_id, x.n_links) for x in near_duplicates.joined(spark.createDataFrame(docs, "doc_id bigint, text string"), block=8).collect()}
    assert got == brute.jaccard_classes(docs)


def test_join_boilerplate(spark):
    """Texts with much in common share buckets without being similar; pairs among them stand anywhere in their trie order."""
    r = random.Random(6)
    common, docs = [f"c{k}" for k in range(170)], []
    for p in range(150):
        own = [f"p{p}w{k}" for k in range(60)]
        docs.append((2 * p, " ".join(common + own)))
        for k in r.sample(range(60), 4):
            own[k] = f"p{p}x{k}"
        docs.append((2 * p + 1, " ".join(common + own)))
    got = {x.doc_id: (x.class_id, x.n_links) for x in near_duplicates.joined(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute.jaccard_classes(docs)


def test_join_tests_all_pairs_of_a_bucket(spark):
    """Two texts that share one bucket, far apart in its order, with many others that are like neither."""
    r = np.random.default_rng(1)
    sig = r.integers(0, 1 << 32, (400, near_duplicates.TREES, near_duplicates.DEPTH), dtype=np.uint32)
    sig[:, 0, :4] = 7
    sig[300] = sig[100]
    sig[300, 1:, 0] += 1  # no other bucket is shared
    sig[:, 0, 4] = np.arange(400) << 20
    reps = spark.createDataFrame([(d, bytearray(x.tobytes())) for d, x in enumerate(sig)], "doc_id bigint, sig binary")
    for block in (64, 256):
        assert {tuple(x) for x in near_duplicates._families(reps, 0.8, block).collect()} >= {(300, 100), (100, 100)}


def test_join_documents(documents):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.joined(documents).collect()}
    assert got == brute.jaccard_classes([(r.doc_id, r.text) for r in documents.collect()])


def test_join_empty(empty):
    assert near_duplicates.joined(empty).count() == 0


def test_depth_meets_the_recall():
    d = near_duplicates.last_depth()
    assert 1 - (1 - 0.8 ** d) ** near_duplicates.TREES >= near_duplicates.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_duplicates.TREES


def test_connected_chain(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(rows(connected(spark.createDataFrame(e, "a bigint, b bigint"), "chain"), "v", "root"))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# Quality classifier

def test_quality(spark, small, documents, edge, empty):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.train(documents, labels)
    got = quality.scored(documents, model).join(labels, "doc_id").toPandas()
    assert ((got.score >= quality.THRESHOLD) == (got.quality == 1)).mean() > 0.95
    own = quality.scored(edge, model, "p").collect()
    assert len(own) == edge.count() and all(0 <= r.p <= 1 for r in own)
    assert quality.scored(empty, model, "p").count() == 0
    none = labels.where("false")
    assert quality.train(documents, none) is None
    assert {r.p for r in quality.scored(edge, None, "p").collect()} == {0.5}


def test_quality_does_not_learn_from_the_held_out_fold(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(documents, labels), quality.train(documents, flipped)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_gradient_of_the_fit():
    """One step of the fit lowers the loss; attention weights of a bag sum to one."""
    r = np.random.default_rng(1)
    x, bag = r.normal(size=(60, quality.N_FEATURES)), np.repeat(np.arange(20), 3)
    y = (x[::3, 0] > 0).astype(float)
    p = quality.fit(x, bag, y, epochs=120)
    out, (_, _, _, a, *_) = quality._forward(p, x, bag)
    assert np.allclose(np.bincount(bag, a), 1)
    assert ((out > 0.5) == (y > 0.5)).mean() > 0.9


# Language identification

def test_language(documents, edge, empty):
    names, proto = language.prototypes(documents)
    assert names == sorted(names) and np.allclose(np.linalg.norm(proto, axis=1), 1, atol=1e-5)
    got = language.predicted(documents, names, proto).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    by_id = {}
    for r in language.predicted(edge, names, proto).collect():
        by_id.setdefault(r.doc_id, r)
        assert 0 <= r.score <= 1
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (6, 7, 10, 13)) and by_id[3].lang_pred != "und"
    assert language.predicted(empty, names, proto).count() == 0
    assert {r.lang_pred for r in language.predicted(edge, *language.prototypes(empty)).collect()} == {"und"}


def test_bundles_do_not_depend_on_the_group():
    texts = [prose(i, 30) for i in range(7)] + ["", "Ω ж", "12"]
    b = language._Bundler(keep=50)
    assert np.allclose(b(texts), np.concatenate([language._Bundler()([t]) for t in texts]), atol=1e-6)


# Language model scores

def test_lm_base(documents, edge, pairs, empty):
    for df, docs in ((documents, None), (edge, pairs)):
        docs = docs or [(r.doc_id, r.text) for r in df.collect()]
        total, want = brute.base_scores([x for i, x in enumerate(docs) if x[0] is not None])
        if df is edge:  # a repeated id trains once for each of its rows
            count = [x for x in docs if x[0] is not None]
            assert len(count) != len({d for d, _ in count})
            continue
        got = lm.scored(df, block_tokens=5000).collect()
        assert {r.train_tokens for r in got} == {total}
        for r in got:
            n, known, base = want[r.doc_id]
            assert (r.n_tokens, r.n_known) == (n, known) and abs(r.base_score - base) < 1e-6 * abs(base)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    got = lm.scored(edge).collect()
    assert len(got) == len(pairs) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert lm.scored(empty).count() == 0


def test_lm_is_a_distribution():
    """Symbol probabilities of every context sum to one, and the words of a class with one unseen word share it out."""
    r = np.random.default_rng(2)
    s = lm.SYMBOLS
    train, held = np.zeros(s ** 3, np.int64), np.zeros(s ** 3, np.int64)
    live = np.array([0, 1, 2, lm.TOP, lm.TOP + 3, lm.END])
    for c in (train, held):
        u, v, w = (r.choice(live, 4000) for _ in range(3))
        np.add.at(c, (u * s + v) * s + w, 1)
    m = lm.Model(train, held, np.arange(3, dtype=np.uint64), np.full(s, 10), np.full(s, 4))
    assert np.allclose(m.weights.sum(1), 1)
    for u, v in ((0, 1), (lm.END, 2), (lm.TOP, lm.START), (50, 60)):
        sym = np.arange(s - 1)
        p, b = m._parts(np.full(s - 1, u), np.full(s - 1, v), sym)
        assert abs((m.weights[b] * p).sum() - 1) < 1e-9


def test_lm_counts_all_words(spark):
    """Scores by bigrams and trigrams of rare words; their endings are alike, so classes cannot tell the orders apart."""
    r = random.Random(8)
    pool = [f"{k:03d}qx" for k in range(400)]
    chains = [r.sample(pool, 12) for _ in range(60)]
    train = [d for d in range(2000) if brute.fold(d, 7) != 2][:600]
    held = [d for d in range(2000) if brute.fold(d, 7) == 2][:40]
    docs = [(d, " ".join(r.choice(chains))) for d in train]
    seen, other = [" ".join(r.choice(chains)) for _ in held], []
    for t in seen:
        x = t.split(" ")
        r.shuffle(x)
        other.append(" ".join(x))
    docs += list(zip(held, seen)) + list(zip([d + 10 ** 6 for d in held], other))
    tables = []
    for tokens in (500, 1 << 20):  # many blocks and ranges give the same as one
        got = lm.scored(spark.createDataFrame(docs, "doc_id bigint, text string"), block_tokens=tokens).collect()
        tables.append({x.doc_id: x.score for x in got})
    assert tables[0].keys() == tables[1].keys() and all(abs(tables[0][d] - tables[1][d]) < 1e-6 for d in tables[0])
    assert all(tables[0][d] > tables[0][d + 10 ** 6] + 5 for d in held if brute.fold(d + 10 ** 6, 7) == 2)
    assert sum(tables[0][d] for d in held) > sum(tables[0][d + 10 ** 6] for d in held) + 200


def test_lm_totals(spark):
    """Counts that a block gets back are those of brute force."""
    r = random.Random(3)
    docs = [(d, " ".join(r.choices("abcdefgh", k=r.randint(0, 30)))) for d in range(60)]
    left = [lm.pa.table({"text": [t for d, t in docs if d % 3 == k], "block": np.full(20, k)}) for k in range(3)]
    parts = lm.pa.concat_tables([lm._sent(5)(t) for t in left])
    sums = lm.pa.concat_tables([lm._summed(parts.filter(lm.pa.compute.equal(parts["range"], i))) for i in range(5)])
    own = lm._Block(left[2])
    counts = lm._counts(own, sums.filter(lm.pa.compute.equal(sums["block"], 2)))
    want = [brute.Counter() for _ in range(2)]
    for d, t in docs:
        w = ["<", "<", *t.split(), ">"]
        for i in range(2, len(w)):
            for c in want[d % 3:d % 3 + 1] if d % 3 < 2 else []:
                c.update([(w[i],), (w[i - 1], w[i]), (w[i - 2], w[i - 1], w[i])])
        if d % 3 < 2:
            want[d % 3].update([("<",), ("<", "<")])
    at = 0
    for t in (t for d, t in docs if d % 3 == 2):
        w = ["<", "<", *t.split(), ">"]
        for i in range(2, len(w)):
            for c, n in zip(want, counts, strict=True):
                assert [n[x[at]] for x in (own.one, own.two, own.three, own.v, own.uv)] == [
                    c[(w[i],)], c[(w[i - 1], w[i])], c[(w[i - 2], w[i - 1], w[i])], c[(w[i - 1],)], c[(w[i - 2], w[i - 1])]]
            at += 1
    assert at == len(own.h)


# Mixture

def test_water_filling(spark):
    r = random.Random(4)
    for _ in range(3):
        kids = [(f"d{i}", r.choice([0, 10, 100, 1000]) * 1.0) for i in range(4)]
        plan = mixture.Plan()
        nodes = spark.createDataFrame(kids, "domain string, supply double").withColumn("budget", F.lit(700.0))
        got = {x.domain: x.budget for x in mixture._dealt(nodes, [], "domain", plan).collect()}
        want = brute.levels([(plan.weights["domain"][k], c) for k, c in kids], 700.0)
        assert all(abs(got[k] - w) < 1e-6 for (k, _), w in zip(kids, want, strict=True))


def test_mixture(spark, documents, edge, empty):
    docs = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 10 ** 6)).cache()
    plan = mixture.Plan(share=0.6)
    got = mixture.mixed(docs, plan, slices=16).toPandas()
    assert list(got.columns) == [*docs.columns, "domain", "n_tokens", "copies"] and len(got) == docs.count()
    used = (got.n_tokens * got.copies).sum()
    assert abs(used / got.n_tokens.sum() - 0.6) < 0.1
    cut = {(r.domain, r.language, r.origin): r for r in mixture.cutoffs(docs, plan, slices=16).collect()}
    leaf = got.assign(used=got.n_tokens * got.copies).groupby(["domain", "lang", "source"])
    for key, part in leaf:  # within one document of the budget of each leaf
        assert abs(part.used.sum() - cut[key].budget) <= part.n_tokens.max()
    again = mixture.mixed(docs, plan, slices=4096).toPandas()
    assert got.sort_values("doc_id").copies.tolist() == again.sort_values("doc_id").copies.tolist()
    own = mixture.mixed(edge, prefix="m_").collect()
    assert len(own) == edge.count() and all(r.m_copies == 0 for r in own if not r.text)
    assert mixture.mixed(empty, prefix="m_").count() == 0


# Token files

def test_token_files(spark, documents, edge, pairs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.tokenizer_path())
    for df, docs in ((documents, [(r.doc_id, r.text) for r in documents.collect()]), (edge, pairs)):
        got = sorted(token_files.encoded(df, parts=3, shard_tokens=3000).collect(), key=lambda r: r.start)
        start = 0
        for (d, text), r in zip(sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())), got, strict=True):
            ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert token_files.encoded(empty).count() == 0


def test_grammar_round_trip(spark, documents):
    folder = shared_dir(spark, "shards")
    token_files.write(documents, folder, parts=2, shard_tokens=20_000)
    for row in spark.read.parquet(folder).collect():
        s = token_files.Shard(bytes(row.body))
        flat, at = s.tokens(), 0
        assert len(flat) == row.n_tokens == s.counts.sum() and len(s.seq) < len(flat)
        for i, n in enumerate(s.counts):
            assert np.array_equal(s.document(i), flat[at:at + n])
            at += n
    r = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.full(5000, 3, np.uint32), r.integers(0, 4, 3000).astype(np.uint32), r.integers(0, 4000, 3000).astype(np.uint32)):
        seq, rules = token_files.compress(ids, 5000)
        assert np.array_equal(token_files.expand(seq, rules, 5000), ids)


def test_grammar_goes_on_until_no_pair_is_frequent():
    """Long repeats shrink to their number of levels, not to a fixed share."""
    r = np.random.default_rng(1)
    for ids in (np.tile(r.integers(0, 4000, 500).astype(np.uint32), 2000), np.zeros(1_000_000, np.uint32)):
        seq, rules = token_files.compress(ids, 5000)
        assert len(seq) + len(rules) < 2000 and len(rules) < token_files.MAX_RULES
        assert (token_files.expand(seq, rules, 5000) == ids).all()
        pairs = np.unique(seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:], return_counts=True)[1]
        assert pairs.max(initial=0) < 2 * token_files.MIN_COUNT  # overlapping places of one pair count once


def test_quality_sample_with_a_hot_id(spark, small, documents):
    """An id that half of the rows have gives one row to the fit, whatever its other rows."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    hot = labels.where("doc_id is not null").select(F.col("doc_id").alias("d")).where(F.crc32(F.col("d").cast("string").cast("binary")) % 5 != 0).orderBy("d").first().d
    many = documents.select("doc_id", "text").unionByName(documents.select(F.lit(hot).cast("bigint").alias("doc_id"), "text")).repartition(3)
    first, second = quality.train(many, labels), quality.train(many.repartition(5), labels)
    assert all(np.allclose(first[k], second[k]) for k in first)


def test_tight_cluster_survives_as_k_a_query():
    """Vectors closer together than the rounding to int8: a tile still sends on little more than k pairs a query, the right ones."""
    import pyarrow as pa
    r = np.random.default_rng(3)
    centre = r.normal(size=48)
    x = centre / np.linalg.norm(centre) + 0.02 * r.normal(size=(3000, 48)) / 48 ** 0.5
    rows_ = next(neighbours._quantised([pa.record_batch({"vec_id": np.arange(3000), "embedding": pa.array(x.tolist())})]))
    t = pa.Table.from_batches([rows_])
    got = neighbours._tile(5)((), t.slice(0, 60), t).to_pydict()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u[:60] @ u.T
    cos[np.arange(60), np.arange(60)] = -9
    assert len(got["vec_id"]) < 60 * 8
    pairs = set(zip(got["query_id"], got["vec_id"], strict=True))
    assert all((q, c) in pairs for q in range(60) for c in np.argsort(-cos[q])[:5])
    assert all(lo <= cos[q, c] <= hi for q, c, lo, hi in zip(got["query_id"], got["vec_id"], got["low"], got["high"], strict=True))


def test_long_vectors_are_added_up_exactly():
    q, c = (np.random.default_rng(k).integers(-127, 128, (3, 5000)).astype(np.float32) for k in (1, 2))
    assert (neighbours._products(q, c) == q.astype(np.int64) @ c.astype(np.int64).T).all()


def test_personal_data_in_a_text_of_many_matches(spark):
    """Time grows with the matches, not with their square; the context of a span is the text just before it."""
    import time
    text = " ".join(f"user{i}@mail.example.org" for i in range(16_000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string").cache()
    assert df.count() == 1
    t = time.time()
    got = pii.detected(df).first().spans
    assert time.time() - t < 40 and len(got) == 16_000  # quadratic time took minutes
    assert [text[s.start:s.end] for s in got] == text.split(" ")
    r = random.Random(5)
    bits = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "DE89 3704 0044 0532 0130 00", "card ", "mail", "tel: ", "é🙂 ", "order ", " ", "\n", "sample", "iban ", ",", "99"]
    texts = [(i, "".join(r.choices(bits, k=r.choice([3, 20, 120])))) for i in range(60)]
    found = pii.detected(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert sum(len(x.spans) for x in found) > 300
    for x in found:
        for s in x.spans:
            before = x.text[max(0, s.start - pii.REACH):s.start].lower()
            want = pii.PRIOR[s.kind] + 0.3 * (s.kind in pii.CHECKED) + 0.2 * any(w in before for w in pii.CONTEXT[s.kind].split("|")) - 0.3 * any(w in before for w in pii.AGAINST.split("|"))
            assert s.score == pytest.approx(min(1, max(0, want)))


def test_texts_keep_about_one_link(spark, monkeypatch):
    """Links of 16 trees over many ranges that connect the same texts are thinned before components are sought."""
    seen = {}
    real = near_duplicates.connected

    def counted(edges, purpose):
        seen.setdefault(purpose, edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct().count())
        return real(edges, purpose)

    monkeypatch.setattr(near_duplicates, "connected", counted)
    base, r = prose(70, 200).split(" "), random.Random(3)
    rows_ = []
    for i in range(600):
        text = list(base)
        for _ in range(2):
            text[r.randrange(200)] = f"w{r.randrange(10 ** 6)}"
        rows_.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string")
    got = near_duplicates.joined(docs).collect()
    assert len({x.class_id for x in got}) == 1 and len(got) == 600
    assert seen["families"] <= 2 * 600


def test_thinned_links_connect_the_same(spark):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(280)] * 3
    e = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    same(rows(connected(near_duplicates.thinned(e), "t"), "v", "root"), rows(connected(e, "t"), "v", "root"))
    assert near_duplicates.thinned(e.limit(0)).count() == 0
