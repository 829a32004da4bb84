"""The corpus pipeline, stage by stage, against brute force."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tapeflow.llm import quality  # noqa: E402
from tapeflow.llm.common import stored, table  # noqa: E402


@pytest.fixture(scope="module")
def outputs(spark, small):
    docs = table(spark, small, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], small), "stage"))
    return [{"rows": d.collect(), "columns": d.columns} for d in out]


def pairs(x):
    return [(r.doc_id, r.text) for r in x["rows"]]


def test_columns(outputs):
    assert all(x["columns"] == outputs[0]["columns"] for x in outputs[:-1])


def test_quality_stage(spark, small, outputs):
    docs = table(spark, small, "documents")
    model = quality.train(docs, table(spark, small, "labels"))
    good = {r.doc_id for r in quality.scored(docs, model).collect() if r.score >= quality.THRESHOLD}
    assert {d for d, _ in pairs(outputs[1])} == good


def test_duplicate_stage(outputs):
    classes = brute.jaccard_classes(pairs(outputs[1]))
    assert sorted(d for d, _ in pairs(outputs[2])) == sorted(d for d, (c, _) in classes.items() if d == c)


def test_decontamination_stage(spark, small, outputs):
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    clean = [r[0] for r in brute.contaminated(pairs(outputs[2]), items) if not r[5]]
    assert sorted(d for d, _ in pairs(outputs[3])) == sorted(clean)


def test_mixture_stage(outputs):
    before, after = {d for d, _ in pairs(outputs[3])}, [d for d, _ in pairs(outputs[4])]
    assert len(after) == len(set(after)) and set(after) <= before
    size = sum(-(-len((t or "").encode()) // 4) for _, t in pairs(outputs[3]))
    assert 0.3 < sum(-(-len((t or "").encode()) // 4) for _, t in pairs(outputs[4])) / size < 0.7


def test_token_stage(outputs):
    assert sorted(r.doc_id for r in outputs[5]["rows"]) == sorted(d for d, _ in pairs(outputs[4]))


def test_edge_rows(spark, small):
    """Rows with NULL ids and texts, repeated rows and odd columns pass all stages."""
    d = table(spark, small, "documents").limit(40)
    odd = spark.createDataFrame([(None, "a b c d e f g", None, None, None), (None, None, None, None, None), (1, None, "en", None, 0), (1, None, "en", None, 0)], d.schema)
    docs = stored(d.unionByName(odd), "odd")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), "stage")
    assert docs.count() > 0


def test_duplicates_are_rows(spark, small):
    """Rows that share an id, or have none, are judged by their own texts; one row of each class stays."""
    words = [[f"{a}{k}" for k in range(60)] for a in "abcd"]
    a, b, c, d = (" ".join(w) for w in words)
    near = " ".join([*words[0][:-1], "other"])
    rows = [(3, a), (5, near), (5, b), (5, c), (None, c), (None, d), (None, d), (None, None), (6, ""), (7, "...")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = pairs({"rows": corpus_pipeline.one_of_each_group(spark, docs, small).collect()})
    assert sorted(got, key=repr) == sorted([(3, a), (5, b), (5, c), (None, d), (None, None), (6, ""), (7, "...")], key=repr)


def test_empty_table(spark, small):
    docs = stored(table(spark, small, "documents").where("false"), "none")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), "stage")
    assert docs.count() == 0
