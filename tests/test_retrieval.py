import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.operators import embedding as E
from evispark.operators import fusion
from evispark.operators import retrieval as R


def brute(queries, chunks, k, only=None):
    out = set()
    for q, v in queries.items():
        rows = [(-round(float(np.dot(np.float32(v).astype(float), np.float32(c).astype(float))), 9), i) for i, (c, g) in chunks.items() if only is None or only.get(q) is None or g in only[q]]
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(rows)[:k], start=1)}
    return out


@pytest.mark.parametrize("block", [64 << 20, 700])
def test_dense_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "QUERY_BYTES", block)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8)).round(3)
    # A third of all rows are copies of one vector.
    chunks = {f"c{i:03d}": (base[0] if i % 3 == 0 else base[i % 30], f"g{i % 4}") for i in range(120)}
    queries = {f"q{i}": rng.normal(size=8).round(3) for i in range(10)}
    only = {f"q{i}": ["g1", "g2"] if i % 2 else None for i in range(10)}
    q = spark.createDataFrame([(a, [float(x) for x in v], only[a]) for a, v in queries.items()], "query_id string, vector array<float>, only array<string>")
    c = spark.createDataFrame([(a, [float(x) for x in v], g) for a, (v, g) in chunks.items()], "chunk_id string, vector array<float>, group string")
    got = {(r.query_id, r.chunk_id, r.rank) for r in R.dense_top_k(q, c, 7).collect()}
    assert got == brute(queries, chunks, 7, only)


def test_chunks_are_not_moved_before_the_cut(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    c = spark.range(100).selectExpr("string(id) AS chunk_id", "array(float(id), 1f) AS vector")
    plan = R.dense_top_k(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[plan.index("MapInArrow") :]


def test_search_with_types_and_regions(spark):
    rng = np.random.default_rng(9)
    kinds, places = ["a", "b", None], ["x", "y", "z"]
    chunks = [(f"c{i:02d}", [float(v) for v in rng.normal(size=4).round(2)], kinds[i % 3], list(rng.choice(places, i % 3, replace=False))) for i in range(60)]
    queries = [("q0", ["a"], None), ("q1", None, ["x", "z"]), ("q2", ["a", "b"], ["y"]), ("q3", [], None), ("q4", None, None), ("q5", ["none"], ["x"])]
    rows = [(a, [float(v) for v in rng.normal(size=4).round(2)], t, r) for a, t, r in queries]
    q = spark.createDataFrame(rows, "query_id string, vector array<float>, document_types array<string>, regions array<string>")
    c = spark.createDataFrame(chunks, "chunk_id string, vector array<float>, document_type string, region_names array<string>")
    got = {(r.query_id, r.chunk_id, r.rank) for r in R.dense_top_k(q, c, 5).collect()}
    want = set()
    for a, v, t, r in rows:
        fit = {i: (w, None) for i, w, kind, own in chunks if (t is None or kind in t) and (r is None or set(own) & set(r))}
        want |= brute({a: v}, fit, 5)
    assert got == want


def test_sparse_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "PAIR_SLICE", 17)
    monkeypatch.setattr(R, "CELLS", 50)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(12)]
    make = lambda n: {t: float(w) for t, w in zip(rng.choice(words, n, replace=False), rng.random(n).round(3) + 0.001)}
    queries = {f"q{i}": make(4) for i in range(6)}
    chunks = {f"c{i:02d}": make(int(rng.integers(1, 6))) for i in range(60)}
    rows = lambda d: [(a, t, w) for a, m in d.items() for t, w in m.items()]
    q = spark.createDataFrame(rows(queries), "query_id string, term string, weight double")
    c = spark.createDataFrame(rows(chunks), "chunk_id string, term string, weight double")
    got = {(r.query_id, r.chunk_id, r.rank) for r in R.sparse_top_k(q, c, 5).collect()}
    want = set()
    for a, m in queries.items():
        found = sorted((-round(sum(w * n.get(t, 0.0) for t, w in m.items()), 9), b) for b, n in chunks.items() if set(m) & set(n))
        want |= {(a, b, i) for i, (_, b) in enumerate(found[:5], start=1)}
    assert got == want


def test_worker_encoder_equals_columns(spark):
    texts = [("a", "Zwei zwei Wörter, und noch ein Wort 12"), ("b", "other text text text")]
    df = spark.createDataFrame(texts, "k string, text string")
    by_columns = {r.k: r.vector for r in E.hashed_dense(E.sparse_postings(df, "k", "text"), "k").collect()}
    by_worker = {r.k: (r.dense_vector, r.sparse_vector) for r in E.with_vectors(df, "text").collect()}
    for k in by_columns:
        assert np.allclose(by_columns[k], by_worker[k][0], atol=1e-6)
        assert abs(sum(w * w for w in by_worker[k][1].values()) - 1) < 1e-5


def test_encoder_must_return_one_vector_per_text(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, text string")
    short = E.encoder(lambda: (lambda texts: ([[0.0]], [{}] * len(texts))))
    with pytest.raises(Exception, match="another number"):
        E.with_vectors(df.coalesce(1), "text", short).collect()


def test_fusion_limits_and_scores(spark):
    rows = [("q", 0, i + 1, f"chunk-{i}", "embedding", 0.5, 1.0) for i in range(20)]
    lists = spark.createDataFrame(rows, "query_id string, list_no int, rank int, chunk_id string, source string, score double, weight double")
    out = fusion.reciprocal_rank_fusion(lists, F.lit(40), F.lit(8)).orderBy("rank").collect()
    assert len(out) == 8 and abs(out[0].score - 1 / 41) < 1e-9


def test_fusion_joins_arms_and_keeps_first_payload(spark):
    rows = [("q", 0, 1, "a", "embedding", 0.8, 1.0, "x"), ("q", 1, 1, "a", "hyde", 0.7, 0.8, "y"), ("q", 1, 2, " ", "hyde", 0.6, 0.8, "z"), ("q", 1, 3, "b", "hyde", 0.5, 0.8, "w")]
    lists = spark.createDataFrame(rows, "query_id string, list_no int, rank int, chunk_id string, source string, score double, weight double, text string")
    out = fusion.reciprocal_rank_fusion(lists, F.lit(60), F.lit(12), ["text"]).orderBy("rank").collect()
    assert [(r.chunk_id, r.sources, r.text) for r in out] == [("a", ["embedding", "hyde"], "x"), ("b", ["hyde"], "w")]
    assert out[0].retrieval_scores == {"embedding": 0.8, "hyde": 0.7}
    # The blank id kept its rank.
    assert abs(out[1].score - 0.8 / 63) < 1e-9


def test_plan_has_no_pairs(spark, sf):
    from evispark.catalog import QUERIES

    plan = QUERIES["hybrid_retrieval"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan.replace("lang:string,", "")


def test_a_batch_beyond_one_block_never_reaches_the_driver(spark, monkeypatch):
    """Blocks of queries meet blocks of chunks in the tasks; each query has its own number of hits."""
    monkeypatch.setattr(R, "QUERY_BYTES", 2_000)
    monkeypatch.setattr(R, "CHUNK_ROWS", 70)
    rng = np.random.default_rng(11)
    queries = [(f"q{i:03d}", [float(x) for x in rng.normal(size=8).round(3)], int(rng.integers(1, 9)), ["g1", "g2"] if i % 3 == 0 else None) for i in range(200)]
    chunks = [(f"c{i:03d}", [float(x) for x in rng.normal(size=8).round(3)], f"g{i % 4}") for i in range(300)]
    q = spark.createDataFrame(queries, "query_id string, dense array<float>, k int, only array<string>").repartition(3)
    c = spark.createDataFrame(chunks, "chunk_id string, dense array<float>, group string").repartition(3)
    with monkeypatch.context() as m:
        m.setattr(type(q), "toArrow", lambda self: pytest.fail("the queries were fetched"))
        found = R.search(q, c, 8, ("dense",))
        got = {(r.query_id, r.chunk_id, r.rank) for r in found.collect()}
    want = set()
    for a, v, k, only in queries:
        want |= brute({a: v}, {i: (w, g) for i, w, g in chunks}, k, {a: only})
    assert got == want
    assert R.search(q, c.where("false"), 8, ("dense",)).count() == 0


def test_queries_of_every_mode_in_one_batch(spark):
    from evispark.operators import config as S
    from evispark.plans import hybrid

    texts = [f"alpha beta {w} gamma {w}{i}" for i, w in enumerate(["red", "green", "blue", "white"] * 20)]
    chunks = spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(texts)], "chunk_id string, content string")
    options = "struct<candidate_top_k:int,max_reference_count:int,matching_preference:string,hyde_enabled:boolean,hyde_influence:string,web_enabled:boolean>"
    rows = [("a", "alpha red", "balanced", None), ("b", "alpha red", "precision", None), ("c", "alpha red", "recall", None), ("d", "alpha red", "custom", (25, 12, "keyword", False, "low", None)), ("e", "", "recall", None)]
    asked = spark.createDataFrame(rows, f"query_id string, text string, mode string, options {options}")
    out = hybrid.hybrid_retrieval(asked.withColumn("settings", S.resolve(F.col("mode"), F.col("options"))), chunks)
    by = {}
    for r in out.collect():
        by.setdefault(r.query_id, []).append(r)
    # Two lists of search_top_k hits, fused to at most rrf_top_k; the custom query has one list.
    for q, least, most in (("a", 10, 12), ("b", 6, 8), ("c", 20, 24), ("d", 25, 25)):
        assert least <= len(by[q]) <= most
    assert {tuple(x) for r in by["d"] for x in [r.sources]} == {("embedding",)}
    alone = hybrid.hybrid_retrieval(asked.where("query_id = 'a'").select("query_id", "text"), chunks)
    assert {(r.chunk_id, r.rank, r.score) for r in by["a"]} == {(r.chunk_id, r.rank, r.score) for r in alone.collect()}


def test_term_vectors_equal_postings(spark):
    texts = [("a", "Zwei zwei Wörter, und noch ein Wort 12"), ("b", ""), ("c", None), ("d", "x x x y"), ("e", "...")]
    df = spark.createDataFrame(texts, "k string, text string").coalesce(1)
    want = {(r.k, r.term, round(r.weight, 12)) for r in E.sparse_postings(df, "k", "text").collect()}
    rows = E.term_vectors(df, "k", "text").collect()
    assert {(r.k, t, round(w, 12)) for r in rows for t, w in zip(r.terms, r.weights)} == want
    assert {r.k: len(r.terms) for r in rows if r.k in "bce"} == {"b": 0, "c": 0, "e": 0}


def test_items_of_many_lengths_are_searched_in_one_pass(spark):
    """Eight megabytes, ten lengths: taken apart at every character once for each length, they would take a minute."""
    from evispark.catalog.evaluation import documents_with_items

    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1_000_000)), lambda i: F.lpad(i.cast("string"), 7, "0")), " ")
    docs = spark.range(1).select(F.lit("d").alias("document_id"), F.concat(numbers, F.lit(" Quickstep")).alias("text"))
    items = spark.createDataFrame([(f"{n}", "Quickstepping"[:n]) for n in range(1, 11)], "case_id string, item_text string")
    started = time.monotonic()
    assert sorted(int(r.case_id) for r in documents_with_items(docs, items).collect()) == list(range(1, 10))
    assert time.monotonic() - started < 40


def test_windows_of_a_long_text_take_time_in_proportion(spark):
    """Eight megabytes: neither copied for each window nor walked from its beginning."""
    from evispark.operators.chunks import fixed_windows

    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999_999)), lambda i: F.lpad(i.cast("string"), 7, "0")), "é")
    docs = spark.range(1).select(F.lit("d").alias("document_id"), digits.alias("text"))
    started = time.monotonic()
    rows = fixed_windows(docs).select("chunk_index", "content").collect()
    assert time.monotonic() - started < 20
    text = "é".join(f"{i:07d}" for i in range(1_000_000))
    assert len(rows) == -(-(len(text) - 30) // 570)
    assert all(r.content == text[570 * r.chunk_index :][:600] for r in rows)


@pytest.mark.parametrize("size, overlap", [(600, 30), (5, 4), (5, 0), (3, 1)])
def test_windows_of_short_blank_and_missing_texts(spark, size, overlap):
    from evispark.operators.chunks import fixed_windows

    texts = ["", "a", "ab\ncdefgh\r\nij😀kl", "x" * 30, "y" * 31, "z" * 600, "z" * 601, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    step = size - overlap
    want = {(n, i, None if t is None else t[step * i :][:size]) for n, t in enumerate(texts) for i in range(max(1, -(-(len(t or "") - overlap) // step)))}
    assert {(r.n, r.chunk_index, r.content) for r in fixed_windows(docs, size=size, overlap=overlap).collect()} == want
