import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.operators import context as X
from evispark.operators import evaluation as E
from evispark.operators import rules
from evispark.operators import selection as S

SETTINGS = "rerank_min_topk int, rerank_max_topk int, rerank_gap_ratio double, rerank_gap_abs double, rerank_max_per_document int"


def ranked(spark, scores, docs, settings):
    rows = [("q", i + 1, float(s), d, f"c{i}", *settings) for i, (s, d) in enumerate(zip(scores, docs))]
    return spark.createDataFrame(rows, "query_id string, rank int, score double, document_id string, candidate_id string, " + SETTINGS)


def chosen(df):
    return [r.candidate_id for r in df.orderBy("final_rank").collect()]


def test_first_cliff_cuts_and_places_are_filled_from_below(spark):
    df = ranked(spark, [0.9, 0.85, 0.84, 0.3, 0.29], ["a", "a", "a", "b", "c"], (2, 6, 0.2, 0.2, 2))
    # Cut after three; the third row of document a gives its place to a row below the cliff.
    assert chosen(S.dynamic_top_k(df)) == ["c0", "c1", "c3"]


def test_relative_gap_is_ignored_for_scores_not_above_zero(spark):
    df = ranked(spark, [0.0, -0.01, -0.02, -0.03], list("abcd"), (1, 4, 0.2, 0.2, 2))
    assert len(chosen(S.dynamic_top_k(df))) == 4


def test_no_cut_at_or_below_the_minimum(spark):
    df = ranked(spark, [0.9, 0.1], ["a", "b"], (2, 6, 0.2, 0.2, 2))
    assert chosen(S.dynamic_top_k(df)) == ["c0", "c1"]


def test_failed_scoring_keeps_upstream_order(spark):
    df = ranked(spark, np.linspace(0, 1, 15), [f"d{i}" for i in range(15)], (6, 12, 0.35, 0.35, 3)).withColumn("upstream_rank", F.col("rank"))
    out = S.rerank(df, F.lit(True))
    assert chosen(out) == [f"c{i}" for i in range(12)]
    assert {r.reranker_status for r in out.collect()} == {"failed"}


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("q", 1, "a" * 3000), ("q", 2, "b" * 3000), ("q", 3, "c")], "query_id string, rank int, section string")
    assert [r.rank for r in X.within_budget(df, F.lit(5000)).collect()] == [1]
    first = X.within_budget(df, F.lit(100)).collect()
    assert [(r.rank, len(r.section)) for r in first] == [(1, 100)]


def test_public_evidence_drops_blank_and_not_a_number(spark):
    rows = [(1, "a", "d", "f", "s", "text", 0.5, None), (2, " ", "d", "f", "s", "text", 0.5, None), (3, "c", "d", "f", "s", "  ", 0.5, None), (4, "e", "d", "f", "s", "text", 0.5, float("nan"))]
    df = spark.createDataFrame(rows, "rank int, chunk_id string, document_id string, file_title string, section_title string, content string, score double, rerank_score double").withColumn("query_id", F.lit("q"))
    assert [r.chunk_id for r in S.public_evidence(df, 6).collect()] == ["a"]
    with pytest.raises(ValueError):
        S.public_evidence(df, 7)


def test_scorer_plug_in(spark):
    df = spark.createDataFrame([("ab", "abc")], "q string, t string")
    scorer = S.pair_scorer(lambda: (lambda qs, ts: [len(q) / len(t) for q, t in zip(qs, ts)]))
    assert abs(df.select(scorer("q", "t").alias("s")).first().s - 2 / 3) < 1e-9


def metrics(spark, retrieved, gold, must, answerable=True):
    case = spark.createDataFrame([("1", answerable)], "case_id string, answerable boolean")
    ids = lambda xs: spark.createDataFrame([("1", x) for x in xs], "case_id string, chunk_id string")
    cands = spark.createDataFrame([("1", "rrf", i, x) for i, x in enumerate(retrieved)], "case_id string, layer string, rank int, chunk_id string")
    r = E.layer_metrics(case, ids(gold), ids(must), cands, layers=("rrf",)).first()
    return r.id_precision, r.id_recall, r.must_hit_rate


def test_metric_rules(spark):
    assert metrics(spark, ["a", "a", "x"], ["a", "b"], ["b"]) == (0.5, 0.5, 0.0)
    assert metrics(spark, [], ["a"], []) == (None, 0.0, None)
    assert metrics(spark, ["a"], ["a"], ["a"], answerable=False) == (None, None, None)
    assert metrics(spark, ["a"], [], []) == (None, None, None)


def test_rules_report_all_or_stop_at_the_first(spark):
    df = spark.createDataFrame([(1, -1, ""), (2, 1, "x")], "k int, n int, t string")
    table = [("negative", F.col("n") < 0), ("blank", F.col("t") == "")]
    assert {(r.k, r.reason) for r in rules.rejects(df, ["k"], table).collect()} == {(1, "negative"), (1, "blank")}
    assert [r.k for r in rules.valid(df, table).collect()] == [2]
    with pytest.raises(rules.RuleViolation):
        rules.fail_fast(df, ["k"], table)
    assert rules.fail_fast(df.where("k = 2"), ["k"], table).count() == 1
