"""The answering chain over an imported table."""

from pyspark.sql import functions as F

from evispark.operators import config as S
from evispark.operators import selection
from evispark.plans import answering
from evispark.plans.hybrid import stored_chunks
from evispark.plans.ingest import import_batch


def test_chain_over_a_stored_table(spark, tmp_path):
    words = ["red", "green", "blue", "white", "black"]
    rows = [(f"/in/{w}{i}.md", f"{w}{i}", f"# About {w}\n\nThe {w} house number {i} stands by the sea.") for w in words for i in range(4)]
    target = str(tmp_path / "chunks")
    import_batch(spark, spark.createDataFrame(rows, "path string, file_title string, md_content string"), target, 4)
    chunks = stored_chunks(spark.read.parquet(target)).drop("bucket")
    modes = [("a", "the red house", "precision"), ("b", "the blue house by the sea", "recall"), ("c", "green", "balanced"), ("d", "white house", "balanced")]
    queries = spark.createDataFrame(modes, "query_id string, text string, mode string").withColumn("settings", S.resolve(F.col("mode"))).drop("mode")
    hits = [(q, k, f"https://e.org/{q}{k % 8}", f"page {k}", f"the red house of page {k}") for q in "abz" for k in range(1, 11)]
    web = spark.createDataFrame(hits, "query_id string, rank int, url string, display_title string, content string")
    # The scorer fails for one query, which keeps the order of its candidates.
    score = lambda question, text: F.when(question != "white house", selection.lexical_score(question, text))
    evidence = answering.answer_evidence(queries, chunks, web, score)
    found = {}
    for r in evidence.collect():
        found.setdefault(r.query_id, []).append(r)
    for rows in found.values():
        rows.sort(key=lambda r: r.final_rank)
        assert [r.final_rank for r in rows] == list(range(1, len(rows) + 1))
    # Precision uses no web hits, and at most three pieces of evidence.
    assert 1 <= len(found["a"]) <= 3 and {r.source for r in found["a"]} == {"milvus"} and all("red" in r.content for r in found["a"])
    assert 6 <= len(found["b"]) <= 12 and len({r.candidate_id for r in found["b"]}) == len(found["b"])
    assert {r.reranker_status for r in found["d"]} == {"failed"} and len(found["d"]) == 6
    assert {r.reranker_status for r in found["b"]} == {"success"}
    told = {r.query_id: r for r in answering.answer_contexts(queries, evidence).collect()}
    assert set(told) == set("abcd")
    assert told["a"].labels[0].startswith("[本地知识库/red") and told["a"].n_sections == len(found["a"]) == len(told["a"].candidate_ids)
    assert told["a"].context.count("内容：") == told["a"].n_sections


def test_a_query_without_evidence(spark):
    chunk = "chunk_id string, document_id string, chunk_index int, file_title string, section_title string, content string, context_type string, region_names array<string>, document_type string, topics array<string>, keywords array<string>, token_count int"
    chunks = spark.createDataFrame([("c", "d", 0, "f", "s", "some words", "text", [], "其他", [], [], 2)], chunk)
    queries = spark.createDataFrame([("q", "other things")], "query_id string, text string").withColumn("settings", S.resolve(F.lit("balanced")))
    web = spark.createDataFrame([], "query_id string, rank int, url string, display_title string, content string")
    none = answering.answer_evidence(queries, chunks.where("false"), web)
    (row,) = answering.answer_contexts(queries, none).collect()
    assert (row.context, row.n_sections, row.labels, row.candidate_ids) == ("", 0, [], [])
