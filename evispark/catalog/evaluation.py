"""Retrieval evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.catalog import views as V
from evispark.catalog.registry import query
from evispark.catalog.retrieval import FULL_SQL, RRF_LISTS_SQL, benchmark_queries, rrf_of_lists
from evispark.functions import arrays as A
from evispark.functions import text as T
from evispark.operators import evaluation as E
from evispark.plans.hybrid import hybrid_retrieval
from evispark.session import cut_lineage, table

# Cases: one per supplier; gold ids come from its returned lines.
CASES_SQL = """cases AS (SELECT s_suppkey AS case_id, s_suppkey % 5 <> 0 AS answerable, CASE s_nationkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'other' END AS split,
    CASE WHEN s_nationkey % 4 = 0 THEN '多文档题' ELSE '' END AS notes FROM supplier),
  gold AS (SELECT DISTINCT l_suppkey AS case_id, 'p' || (l_partkey % 97) AS chunk_id FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.085),
  must AS (SELECT DISTINCT l_suppkey AS case_id, 'p' || (l_partkey % 97) AS chunk_id FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.085 AND l_tax > 0.05)"""

METRICS_SQL = (
    RRF_LISTS_SQL
    + ", "
    + CASES_SQL
    + """, cands AS (
  SELECT DISTINCT query_id AS case_id, layer, chunk_id FROM arm_lists
  UNION ALL SELECT query_id, 'rrf', chunk_id FROM rrf UNION ALL SELECT query_id, 'rerank', chunk_id FROM rrf WHERE rank <= 6),
hits AS (SELECT c.case_id, c.layer, count(*) AS n, count(g.chunk_id) AS h, count(m.chunk_id) AS mh FROM cands c
  LEFT JOIN gold g ON g.case_id = c.case_id AND g.chunk_id = c.chunk_id LEFT JOIN must m ON m.case_id = c.case_id AND m.chunk_id = c.chunk_id GROUP BY ALL),
sizes AS (SELECT case_id, count(*) AS gold_count, (SELECT count(*) FROM must m WHERE m.case_id = g.case_id) AS must_hit_count FROM gold g GROUP BY case_id),
metrics AS (SELECT c.case_id, l.layer, coalesce(n, 0) AS retrieved_count, coalesce(gold_count, 0) AS gold_count, coalesce(must_hit_count, 0) AS must_hit_count, coalesce(h, 0) AS hit_count,
   CASE WHEN answerable AND gold_count > 0 AND n > 0 THEN h::DOUBLE / n END AS id_precision,
   CASE WHEN answerable AND gold_count > 0 THEN coalesce(h, 0)::DOUBLE / gold_count END AS id_recall,
   CASE WHEN answerable AND gold_count > 0 AND must_hit_count > 0 THEN coalesce(mh, 0)::DOUBLE / must_hit_count END AS must_hit_rate
  FROM cases c CROSS JOIN (SELECT unnest(['embedding', 'hyde', 'rrf', 'rerank']) AS layer) l
  LEFT JOIN sizes s USING (case_id) LEFT JOIN hits h ON h.case_id = c.case_id AND h.layer = l.layer)"""
)


def eval_cases(spark, sf):
    n = F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("case_id"),
        (F.col("s_suppkey") % 5 != 0).alias("answerable"),
        F.when(n % 3 == 0, F.lit("dev")).when(n % 3 == 1, F.lit("test")).otherwise(F.lit("other")).alias("split"),
        F.when(n % 4 == 0, F.lit(E.MULTI_DOCUMENT_NOTE)).otherwise(F.lit("")).alias("notes"),
    )


def gold_ids(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.085")
    gold = lines.select(
        F.col("l_suppkey").alias("case_id"), F.concat(F.lit("p"), F.col("l_partkey") % 97).alias("chunk_id"), "l_tax"
    )
    return gold.drop("l_tax"), gold.where("l_tax > 0.05").drop("l_tax")


def layer_candidates(spark, sf):
    arms = V.arm_lists(spark, sf).select(
        F.col("query_id").alias("case_id"), "layer", "rank", "chunk_id", F.lit("milvus").alias("source")
    )
    fused = rrf_of_lists(spark, sf).select(
        F.col("query_id").alias("case_id"),
        F.explode(F.when(F.col("rank") <= 6, F.array(F.lit("rrf"), F.lit("rerank"))).otherwise(F.array(F.lit("rrf")))).alias("layer"),
        "rank",
        "chunk_id",
        F.lit("milvus").alias("source"),
    )
    return arms.unionByName(fused)


def metrics_per_layer(spark, sf):
    gold, must = gold_ids(spark, sf)
    return E.layer_metrics(eval_cases(spark, sf), gold, must, layer_candidates(spark, sf))


@query(
    "layer_id_metrics",
    "A1,A2,J2",
    f"""WITH {METRICS_SQL} SELECT case_id, layer, retrieved_count, gold_count, must_hit_count, hit_count,
        round(id_precision, 9) AS id_precision, round(id_recall, 9) AS id_recall, round(must_hit_rate, 9) AS must_hit_rate FROM metrics""",
)
def layer_id_metrics(spark, sf):
    rounded = {m: F.round(m, 9) for m in E.ID_METRICS}
    return metrics_per_layer(spark, sf).withColumns(rounded)


@query(
    "evaluation_summary",
    "A3,A4,J3",
    f"""WITH {METRICS_SQL}, long AS (
          SELECT case_id, layer, 'id_precision' AS metric, id_precision AS value FROM metrics UNION ALL
          SELECT case_id, layer, 'id_recall', id_recall FROM metrics UNION ALL SELECT case_id, layer, 'must_hit_rate', must_hit_rate FROM metrics),
        g AS (SELECT case_id, 'overall' AS summary_group FROM cases UNION ALL SELECT case_id, 'split:' || split FROM cases WHERE split IN ('dev', 'test')
          UNION ALL SELECT case_id, 'answerable:' || answerable::VARCHAR FROM cases UNION ALL SELECT case_id, 'multi_document' FROM cases WHERE notes = '多文档题')
        SELECT summary_group, layer, metric, count(value) AS valid_count, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS median,
               round(quantile_cont(value, 0.1), 9) AS p10 FROM long JOIN g USING (case_id) GROUP BY ALL""",
)
def evaluation_summary(spark, sf):
    long = E.long_metrics(metrics_per_layer(spark, sf), ["case_id", "layer"], E.ID_METRICS)
    return E.grouped_summary(long, eval_cases(spark, sf))


@query(
    "retrieved_gold_semi_join",
    "J2",
    f"""WITH {V.LISTS_SQL}, {CASES_SQL}, f AS (SELECT query_id AS case_id, layer, chunk_id, min(rank) AS rank FROM arm_lists GROUP BY ALL)
        SELECT case_id, layer, chunk_id, rank FROM f SEMI JOIN gold USING (case_id, chunk_id)""",
)
def retrieved_gold_semi_join(spark, sf):
    gold, _ = gold_ids(spark, sf)
    ids = E.ordered_ids(V.arm_lists(spark, sf).withColumnRenamed("query_id", "case_id"))
    return ids.join(gold, ["case_id", "chunk_id"], "left_semi").select("case_id", "layer", "chunk_id", "rank")


# Result rows of a run: one per event, failures and responses read off its type and value.
RESULTS_SQL = """results AS (SELECT event_id AS case_id, user_id % 3 = 0 AS answerable,
   CASE event_type WHEN 'error' THEN 'boom' ELSE '' END AS error_message, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'TimeoutError' ELSE '' END AS error_type,
   CASE event_type WHEN 'view' THEN '资料不足，需要补充' WHEN 'click' THEN '答案是 42' ELSE ' 无法回答 ' END AS response FROM events)"""


def run_results(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("case_id"),
        (F.col("user_id") % 3 == 0).alias("answerable"),
        F.when(kind == "error", F.lit("boom")).otherwise(F.lit("")).alias("error_message"),
        F.when((kind == "error") & (F.col("user_id") % 2 == 0), F.lit("TimeoutError")).otherwise(F.lit("")).alias("error_type"),
        F.when(kind == "view", F.lit("资料不足，需要补充"))
        .when(kind == "click", F.lit("答案是 42"))
        .otherwise(F.lit(" 无法回答 "))
        .alias("response"),
    )


@query(
    "error_counts",
    "A5",
    f"""WITH {RESULTS_SQL} SELECT CASE WHEN error_message = '' THEN 'success' WHEN error_type = '' THEN 'unknown' ELSE error_type END AS outcome,
        count(*) AS n FROM results GROUP BY 1""",
)
def error_counts(spark, sf):
    return E.run_counts(run_results(spark, sf))


@query(
    "abstention_accuracy",
    "A6",
    f"""WITH {RESULTS_SQL} SELECT count(*) AS valid_count,
          round(avg(CASE WHEN error_message = '' AND regexp_matches(response, '无法确定|资料不足|未检索到|无法回答|需要补充') THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS value
        FROM results WHERE NOT answerable""",
)
def abstention_accuracy(spark, sf):
    flag = F.when(F.col("error_message") == "", E.abstained(F.col("response")))
    return E.abstention_accuracy(run_results(spark, sf).withColumn("abstention_correct", flag))


@query(
    "judge_score_summary",
    "A8,A3",
    """WITH s AS (SELECT l_returnflag AS grp, CASE WHEN l_linestatus = 'F' THEN l_discount END AS faithfulness, l_tax AS answer_relevancy,
                 CASE WHEN l_quantity > 25 THEN l_quantity / 50 END AS context_precision, l_discount + l_tax AS context_recall,
                 CASE WHEN l_quantity < 0 THEN 1.0 END::DOUBLE AS answer_correctness FROM lineitem),
       u AS (SELECT grp, 'faithfulness' AS metric, faithfulness AS value FROM s UNION ALL SELECT grp, 'answer_relevancy' AS metric, answer_relevancy AS value FROM s UNION ALL SELECT grp, 'context_precision' AS metric, context_precision AS value FROM s UNION ALL SELECT grp, 'context_recall' AS metric, context_recall AS value FROM s UNION ALL SELECT grp, 'answer_correctness' AS metric, answer_correctness AS value FROM s)
       SELECT grp, metric, count(value) AS valid_count, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS median,
              round(quantile_cont(value, 0.1), 9) AS p10 FROM u GROUP BY ALL""",
)
def judge_score_summary(spark, sf):
    q = F.col("l_quantity")
    scores = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"),
        F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("faithfulness"),
        F.col("l_tax").alias("answer_relevancy"),
        F.when(q > 25, q / 50).alias("context_precision"),
        (F.col("l_discount") + F.col("l_tax")).alias("context_recall"),
        F.when(q < 0, F.lit(1.0)).alias("answer_correctness"),
    )
    return E.statistics(E.long_metrics(scores, ["grp"], E.JUDGE_SCORES), ["grp", "metric"])


TRACE_SQL = (
    V.LISTS_SQL
    + """, c AS (SELECT query_id AS case_id, rank, CASE WHEN query_id % 11 = 3 AND rank = 2 THEN '  ' ELSE 'text ' || chunk_id END AS content FROM arm_lists WHERE list_no = 0),
   i AS (SELECT query_id AS case_id, layer, chunk_id, min(rank) AS rank FROM arm_lists WHERE NOT (query_id % 13 = 5 AND rank = 4) GROUP BY ALL),
   l AS (SELECT case_id, string_agg(chunk_id, ',' ORDER BY rank) FILTER (WHERE layer = 'embedding') AS embedding_ids,
          string_agg(chunk_id, ',' ORDER BY rank) FILTER (WHERE layer = 'hyde') AS hyde_ids FROM i GROUP BY case_id),
   x AS (SELECT case_id, string_agg(trim(content), '|' ORDER BY rank) AS contexts, count(*)::INT AS final_context_count, bool_or(trim(content) = '') AS blank FROM c GROUP BY case_id)"""
)


@query(
    "evaluation_trace",
    "A10,A9",
    f"""WITH {TRACE_SQL} SELECT s_suppkey AS case_id, coalesce(embedding_ids, '') AS embedding_ids, coalesce(hyde_ids, '') AS hyde_ids, coalesce(contexts, '') AS contexts,
          coalesce(final_context_count, 0) AS final_context_count, CASE WHEN s_nationkey = 3 THEN 'missing_answer' WHEN coalesce(blank, false) THEN 'missing_content'
          WHEN s_suppkey % 13 = 5 AND EXISTS (SELECT 1 FROM arm_lists a WHERE a.query_id = s_suppkey AND a.rank = 4) THEN 'missing_chunk_id' ELSE '' END AS error_message
        FROM supplier LEFT JOIN l ON l.case_id = s_suppkey LEFT JOIN x ON x.case_id = s_suppkey""",
)
def evaluation_trace(spark, sf):
    q = F.col("query_id")
    lists = V.arm_lists(spark, sf)
    candidates = lists.select(
        q.alias("case_id"),
        "layer",
        "rank",
        F.when((q % 13 == 5) & (F.col("rank") == 4), F.lit(None)).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.lit("milvus").alias("source"),
    )
    contexts = lists.where("list_no = 0").select(
        q.alias("case_id"),
        "rank",
        F.when((q % 11 == 3) & (F.col("rank") == 2), F.lit("  "))
        .otherwise(F.concat(F.lit("text "), "chunk_id"))
        .alias("content"),
    )
    cases = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("case_id"),
        F.when(F.col("s_nationkey") == 3, F.lit(" ")).otherwise(F.lit("answer")).alias("response"),
    )
    ids = lambda layer: F.coalesce(F.array_join(F.element_at("layer_ids", F.lit(layer)), ","), F.lit(""))
    return E.traces(cases, candidates, contexts).select(
        "case_id",
        ids("embedding").alias("embedding_ids"),
        ids("hyde").alias("hyde_ids"),
        F.coalesce(F.array_join("retrieved_contexts", "|"), F.lit("")).alias("contexts"),
        "final_context_count",
        "error_message",
    )


@query(
    "evaluation_case_filter",
    "P20",
    """SELECT o_orderkey, split, review_status FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'dev' ELSE 'test' END AS split,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'draft' WHEN '2' THEN 'reviewed' ELSE 'rejected' END AS review_status FROM orders)
       WHERE split = 'dev' AND review_status IN ('draft', 'reviewed')""",
)
def evaluation_case_filter(spark, sf):
    digit = F.substring("o_orderpriority", 1, 1)
    cases = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", F.lit("dev")).otherwise(F.lit("test")).alias("split"),
        F.when(digit == "1", F.lit("draft")).when(digit == "2", F.lit("reviewed")).otherwise(F.lit("rejected")).alias("review_status"),
    )
    return E.select_cases(cases)


GRAM = 10
MAX_BROADCAST_ITEMS = 200_000  # of a few hundred bytes; more items are joined by a shuffle
MAX_FIRST = 256  # first characters of items that a pattern names


def documents_with_items(docs, items):
    """(case_id, document_id) where a document's text contains an item's text (of one character or more).

    An item is looked up by its first ``GRAM`` characters among the runs of that length that the document has; a shorter one,
    as a whole, among the beginnings of these runs. Only the hits of longer items meet the texts again, to be tested in full.
    """
    anchored = items.where("length(item_text) > 0").select(
        "case_id", "item_text", F.left("item_text", F.lit(GRAM)).alias("anchor"), (F.length("item_text") > GRAM).alias("long")
    )
    stats = anchored.agg(F.count("*").alias("n"), F.collect_set(F.length("anchor")).alias("sizes"), F.collect_set(F.left("anchor", F.lit(1))).alias("first")).first()
    table = F.broadcast(anchored) if stats["n"] <= MAX_BROADCAST_ITEMS else anchored
    sizes = sorted(stats["sizes"])  # no more than GRAM
    # A run begins as some item does.
    first = "".join(rf"\x{{{ord(c):x}}}" for c in sorted(stats["first"])) if 0 < stats["n"] and len(stats["first"]) <= MAX_FIRST else ""
    begin = f"(?=[{first}])" if first else ""
    runs = F.regexp_extract_all("text", F.lit(rf"(?s){begin}(?=(.{{1,{GRAM}}}))"), F.lit(1))
    beginnings = lambda found: F.array_distinct(F.flatten(F.array(*(F.transform(found, lambda run: F.left(run, F.lit(k))) for k in sizes))))  # noqa: B023, E731
    grams = A.let(F.array_distinct(runs), beginnings) if sizes else F.array().cast("array<string>")
    # Outer, as the inner form adds a size test that would search every text twice.
    hits = docs.select("document_id", F.explode_outer(grams).alias("gram")).join(table, F.col("gram") == F.col("anchor"))
    # Not worked out again for each length.
    hits = cut_lineage(hits.select("document_id", "case_id", F.when(F.col("long"), F.col("item_text")).alias("item_text")))
    told = hits.where("item_text IS NOT NULL").distinct().withColumnRenamed("document_id", "_id")
    tested = docs.join(told, F.col("document_id").eqNullSafe(F.col("_id")) & F.contains("text", F.col("item_text")))
    return hits.where("item_text IS NULL").select("case_id", "document_id").unionByName(tested.select("case_id", "document_id"))


def gold_documents(spark, sf):
    """Documents that contain a benchmark item."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.col("text").alias("item_text"))
    docs = V.documents_with_metadata(spark, sf).select("document_id", "text")
    return documents_with_items(docs, items).select("case_id", F.col("document_id").alias("chunk_id"))


@query(
    "gold_item_documents",
    "A1,J2",
    """WITH items AS (
         SELECT item_id || '-' || k AS case_id, CASE k WHEN 0 THEN text WHEN 1 THEN split_part(text, ' ', 1) ELSE split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) END AS item
         FROM benchmark, range(3) t(k))
       SELECT case_id, count(d.doc_id) AS n_documents FROM items LEFT JOIN documents d ON contains(d.text, item) GROUP BY case_id""",
)
def gold_item_documents(spark, sf):
    """How many documents contain each benchmark item, its first word and its first two words."""
    word = F.split_part("text", F.lit(" "), F.lit(1))
    texts = F.array("text", word, F.concat_ws(" ", word, F.split_part("text", F.lit(" "), F.lit(2))))
    items = table(spark, sf, "benchmark").select("item_id", F.posexplode(texts).alias("k", "item_text")).select(
        F.concat_ws("-", F.col("item_id").cast("string"), F.col("k").cast("string")).alias("case_id"), "item_text"
    )
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text").repartition("document_id")
    # Items that share a text are looked up once.
    texts = items.select(F.col("item_text").alias("case_id"), "item_text").distinct()
    found = documents_with_items(docs, texts).groupBy(F.col("case_id").alias("item_text")).agg(F.count("*").alias("n"))
    return items.join(found, "item_text", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n_documents"))


@query(
    "retrieval_evaluation",
    "A1,A2,J2,F1",
    FULL_SQL
    + """, gold AS (SELECT item_id::VARCHAR AS case_id, document_id FROM benchmark b JOIN doc_meta d ON contains(d.text, b.text)),
       got AS (SELECT DISTINCT query_id AS case_id, document_id FROM rrf JOIN chunks USING (chunk_id)),
       hit AS (SELECT case_id, count(*) AS n, count(g.document_id) AS h FROM got LEFT JOIN gold g USING (case_id, document_id) GROUP BY case_id),
       size AS (SELECT case_id, count(*) AS gold_count FROM gold GROUP BY case_id)
       SELECT item_id::VARCHAR AS case_id, coalesce(n, 0) AS retrieved_count, coalesce(gold_count, 0) AS gold_count, coalesce(h, 0) AS hit_count,
         CASE WHEN gold_count > 0 THEN round(h::DOUBLE / n, 9) END AS id_precision, CASE WHEN gold_count > 0 THEN round(coalesce(h, 0)::DOUBLE / gold_count, 9) END AS id_recall
       FROM benchmark LEFT JOIN hit ON hit.case_id = item_id::VARCHAR LEFT JOIN size ON size.case_id = item_id::VARCHAR""",
)
def retrieval_evaluation(spark, sf):
    """Document-level recall of the fused ranking for items that occur in some document."""
    chunks = V.document_chunks(spark, sf)
    queries = benchmark_queries(spark, sf)
    fused = hybrid_retrieval(queries, chunks.repartition("chunk_id"))
    got = fused.join(chunks.select("chunk_id", "document_id"), "chunk_id").select(
        F.col("query_id").alias("case_id"), F.lit("rrf").alias("layer"), "rank", F.col("document_id").alias("chunk_id")
    )
    gold = gold_documents(spark, sf)
    cases = queries.select(F.col("query_id").alias("case_id"), F.lit(True).alias("answerable"))
    out = E.layer_metrics(cases, gold, gold.limit(0), got, layers=("rrf",))
    return out.select(
        "case_id",
        "retrieved_count",
        "gold_count",
        "hit_count",
        F.round("id_precision", 9).alias("id_precision"),
        F.round("id_recall", 9).alias("id_recall"),
    )
