"""The registered queries of the training-data operators, over whole tables, and their checking SQL where SQL can say it."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm.decontamination import contamination
from evispark.llm.embedding_join import near_duplicates
from evispark.llm.line_dedup import dedup_lines
from evispark.llm.merkle import digest, field, fold, merkle_manifest
from evispark.llm.ngram_join import ngram_jaccard_join
from evispark.llm.packing import pack_documents
from evispark.llm.secrets import KINDS, scan_secrets
from evispark.llm.sharding import assign_shards
from evispark.llm.substring_dedup import drop_repeated_passages
from evispark.llm.toxicity import score_documents, train
from evispark.llm.url_filter import judge_urls
from evispark.llm.vector_codes import compressed
from evispark.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * 40)


def op7_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


# The rules of the contract.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository, its source the owner."""
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    place = F.array(*(F.lit(k) for k in KINDS))
    # By start, then by kind as listed.
    both = F.concat("base_spans", "live_spans")
    ranked = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode(listed(F.col("base_spans")), "utf-8"), 256).alias("base_sha256"), listed(ranked).alias("spans")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256, the digest of the text that is left."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(F.coalesce("kept", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf with its proof; rows whose id's checksum 7 divides are verified after a change of n_chars."""

    def leaf(n_chars: Column) -> Column:
        return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars), field(F.col("text")))

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.col("n_chars") + 1)).alias("found")
    )
    manifest = merkle_manifest(rows, leaf_col="leaf", group_col="lang", order_cols=["doc_id"])
    siblings = F.transform("proof", lambda step: F.concat(step["left"], step["right"]))
    folded = manifest.select(
        "row.doc_id", "row.leaf", "subroot", "root", digest(siblings).alias("proof_sha256"),
        fold(F.coalesce("row.found", "row.leaf"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are summed by label with the labels of many vectors salted on both sides."""
    codes, books = compressed(table(spark, sf_dir, "embeddings"), keep=["label"])
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    salts = 32
    salt = F.pmod(F.xxhash64("row.vec_id"), F.lit(salts))
    by_label = codes.groupBy("row.label").agg(F.sum("error").alias("label_error"))
    totals = by_label.select(F.col("label").alias("total_of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("share"))
    same = F.col("row.label").eqNullSafe(F.col("total_of")) & (salt == F.col("share"))
    code = F.lower(F.array_join(F.transform("code", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return codes.join(totals, same).select(
        "row.vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256")
    )


_ALL = (
    op1_toxicity,
    op2_decontamination,
    op3_ngram_jaccard_join,
    op4_warc,
    op5_packing,
    op6_sharding,
    op7_embedding_join,
    op8_url_filter,
    op9_secrets,
    op10_line_dedup,
    op11_substring_dedup,
    op12_merkle_manifest,
    op13_vector_codes,
)
QUERIES = {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, item_id, i, runs.k FROM runs JOIN win ON runs.g = win.g AND runs.k = win.k),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(doc.w) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP3_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(s.s) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id
"""

OP4_SQL = """
WITH page AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
hashed AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM page),
coded AS (
  SELECT page_id, n, array_to_string(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS d
  FROM hashed)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY d) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER (PARTITION BY d) THEN min(page_id) OVER (PARTITION BY d) END AS refers_to
FROM coded
"""

OP6_SQL = """
WITH cost AS (
  SELECT doc_id, s, -ln((('0x' || substr(md5(doc_id || ':' || s), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) AS c
  FROM documents, range(41) t(s)),
pick AS (
  SELECT doc_id, (arg_min(s, c) FILTER (s < 40))::INTEGER AS shard, arg_min(s, c)::INTEGER AS grown_shard FROM cost GROUP BY doc_id),
steps AS (SELECT list(v ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(n))),
body AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, len(h) // 2 + 16 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM body, steps)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM sums JOIN pick USING (doc_id)
"""

OP7_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

OP8_SQL = r"""
WITH rules(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule,
  coalesce(arg_max(verdict, length(h || p)), 'allow') AS verdict
FROM part LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id
"""

OP11_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (g) WHERE win.doc_id > m)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

_CRC_STEPS = """SELECT list(v ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(n))"""


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({f})::VARCHAR)) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


OP12_SQL = f"""
WITH RECURSIVE steps AS ({_CRC_STEPS}),
doc AS (
  SELECT doc_id, coalesce('.' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS other,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(doc_id::VARCHAR)),
      lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0 AS tampered
  FROM documents, steps),
seat AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM doc),
tree AS (
  SELECT g, 0 AS level, place, leaf AS h, n FROM seat
  UNION ALL
  SELECT g, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, level, place // 2),
subroot AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, place, h, n FROM subroot
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, place // 2),
root AS (SELECT h FROM upper WHERE n = 1),
step AS (
  SELECT s.g, s.place, t.level, (s.place >> t.level) % 2 AS own, b.h
  FROM seat s JOIN tree t ON t.g = s.g AND t.n > 1 AND t.place = s.place >> t.level
  LEFT JOIN tree b ON b.g = s.g AND b.level = t.level AND b.place = xor(t.place, 1)
  UNION ALL
  SELECT s.g, s.place, 1000 + t.level, (r.place >> t.level) % 2, b.h
  FROM seat s JOIN subroot r ON r.g = s.g JOIN upper t ON t.n > 1 AND t.place = r.place >> t.level
  LEFT JOIN upper b ON b.level = t.level AND b.place = xor(t.place, 1)),
proof AS (
  SELECT g, place, list({{'own': own, 'h': coalesce(h, '')}} ORDER BY level) AS p, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256
  FROM step GROUP BY g, place),
folded AS (
  SELECT s.g, s.place, 0 AS k, CASE WHEN tampered AND other IS NOT NULL THEN other ELSE leaf END AS h FROM seat s
  UNION ALL
  SELECT f.g, f.place, k + 1, sha256(CASE WHEN p[k + 1].own = 1 THEN p[k + 1].h || f.h ELSE f.h || p[k + 1].h END)
  FROM folded f JOIN proof USING (g, place) WHERE k < len(p))
SELECT s.doc_id, s.leaf, r.h AS subroot, root.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM seat s JOIN subroot r ON r.g = s.g CROSS JOIN root LEFT JOIN proof p ON p.g = s.g AND p.place = s.place
JOIN folded f ON f.g = s.g AND f.place = s.place AND f.k = coalesce(len(p.p), 0)
"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One assignment and one set of means after another."""
    text = f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
piece AS (
  SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM whole, range({parts}) r(p)),
book0 AS (
  SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id)) - 1 AS e, v FROM piece QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})"""
    near = """
near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT vec_id, label, a.p, e, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM piece a JOIN book{r} b ON a.p = b.p)
  GROUP BY vec_id, label, p)"""
    book = """
mean{r} AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT n.p, n.e, unnest(a.v) AS x, unnest(range(len(a.v))) AS i FROM near{r} n JOIN piece a ON a.vec_id = n.vec_id AND a.p = n.p)
    GROUP BY p, e, i) GROUP BY p, e),
book{s} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)"""
    for r in range(rounds):
        text += "," + near.format(r=r) + "," + book.format(r=r, s=r + 1)
    return (
        text + "," + near.format(r=rounds) + f""",
code AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM code, books
"""
    )


OP13_SQL = _op13_sql()

ORACLES = {
    "op2_decontamination": OP2_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_sharding": OP6_SQL,
    "op7_embedding_join": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op11_substring_dedup": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
