"""Candidates as data: the replay of a table of candidates equals the replay of their rule documents."""

import pytest
from pyspark.sql import functions as F

from tapeflow.operators import replay as P
from tapeflow.operators import sweep as SW
from tapeflow.plans.q_strategies import _drawn, panel


@pytest.fixture(scope="module")
def rows(spark, small):
    return panel(spark, small).cache()


@pytest.mark.parametrize("chunk", [7, 64])
def test_fitness_equals_the_documents(spark, rows, chunk):
    cand = SW.candidates(spark, per_template=4)
    docs = SW.candidate_documents(cand)
    m = P.trade_metrics(P.backtest(rows, docs), min_trades=1).groupBy("strategy_id").agg(
        F.avg("sharpe_ratio").alias("sharpe"), F.avg("win_rate").alias("win_rate"), F.sum("total_trades").alias("n_trades"))
    want = {r.strategy_id: (round(r.sharpe, 9), round(r.win_rate, 9), r.n_trades) for r in m.collect()}
    got = {r.candidate_id: (round(r.sharpe, 9), round(r.win_rate, 9), r.n_trades) for r in SW.fitness(rows, cand, 1, chunk=chunk).collect()}
    assert got == want and len(got) >= 4


def test_candidates_of_equal_effect_are_replayed_once(spark):
    e = SW.effects(SW.candidates(spark, per_template=30))
    n = e.agg(F.sum(F.size("candidate_ids")).alias("all"), F.count("*").alias("distinct"), F.count_distinct("strategy_id").alias("ids")).first()
    assert n["all"] == SW.candidates(spark, per_template=30).count() and n["distinct"] == n["ids"] < n["all"]


def test_sql_documents_are_those_that_are_drawn(spark):
    assert sorted(d["strategy_id"] for d in _drawn(5)) == sorted(r.candidate_id for r in SW.candidates(spark, 5).collect())
    by_id = {d["strategy_id"]: d for d in SW.candidate_documents(SW.candidates(spark, 5))}
    assert all(by_id[d["strategy_id"]] == d for d in _drawn(5))


def test_no_candidates(spark, rows):
    assert SW.fitness(rows, SW.candidates(spark, 1).limit(0), 1).count() == 0


def test_copies_of_a_point_meet_others_once(spark):
    """30,000 rows of a few points: each row met all rows of the points near it before, 900 million pairs."""
    k = F.col("id")
    ranked = spark.range(30000).select(F.lit("T").alias("template"), F.array((k % 3).cast("double"), (k % 2) * F.lit(0.1)).alias("point"), (k + 1).cast("int").alias("rank"))
    assert sorted(r["rank"] for r in SW.without_near_duplicates(ranked).collect()) == [1, 2, 3]
