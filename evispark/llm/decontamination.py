"""Benchmark decontamination with DataFrame operations only.

Each item of the benchmark becomes windows of consecutive words; their hashes are a broadcast hash set behind a check of
its size. All windows of all documents are looked up in it by hash while the words are scanned, and a hit only counts
once its words have been compared. Window hashes are built by doubling (1, 2, 4, 8 words), so a window of ten words costs
four steps, not ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a word is, after A-Z have become a-z; and what stands between words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PIECE = r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST_WINDOWS = 2_000_000  # of about 200 bytes; more windows are joined by a shuffle


def words(text: str) -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _with_hashes(df: DataFrame, widths: list[int]) -> DataFrame:
    """Adds ``_w<k>`` for each k of ``widths``: the hashes of all windows of k words of the column ``_words``."""
    powers = [1 << b for b in range(max(widths, default=0).bit_length())]
    df = df.withColumn("_p1", F.transform("_words", lambda w: F.xxhash64(w)))
    for p in powers[1:]:
        half = f"_p{p // 2}"
        df = df.withColumn(f"_p{p}", F.zip_with(half, _from(half, p // 2), lambda a, b: F.xxhash64(a, b)))
    for k in widths:
        parts = [p for p in reversed(powers) if p & k]
        name, done = f"_p{parts[0]}", parts[0]
        for p in parts[1:]:
            df = df.withColumn("_acc", F.zip_with(name, _from(f"_p{p}", done), lambda a, b: F.xxhash64(a, b)))
            name, done = "_acc", done + p
        df = df.withColumn(f"_w{k}", F.slice(name, F.lit(1), F.greatest(F.size("_words") - (k - 1), F.lit(0))))
    return df.drop("_acc", *(f"_p{p}" for p in powers))


def _from(column: str, skipped: int) -> Column:
    return F.slice(column, F.lit(skipped + 1), F.greatest(F.size(column) - skipped, F.lit(0)))


def benchmark_windows(benchmark: DataFrame, *, id_col: str, text_col: str, width: int) -> tuple[DataFrame, list[int]]:
    """(_hash, _width, _window, _items): each distinct window with its words and the ids of its items; and the widths."""
    items = benchmark.select(F.col(id_col).cast("string").alias("_item"), words(text_col).alias("_words")).filter("size(_words) > 0")
    items = items.withColumn("_width", F.least(F.size("_words"), F.lit(width)))
    widths = sorted(r[0] for r in items.select("_width").distinct().collect())  # at most ``width`` numbers
    hashed = _with_hashes(items, widths)
    pick = F.coalesce(*(F.when(F.col("_width") == k, F.col(f"_w{k}")) for k in widths)) if widths else F.array().cast("array<bigint>")
    each = hashed.select("_item", "_words", "_width", F.posexplode(pick).alias("_at", "_hash"))
    windows = each.select("_item", "_width", "_hash", F.slice("_words", F.col("_at") + 1, F.col("_width")).alias("_window"))
    return windows.groupBy("_hash", "_width", "_window").agg(F.collect_set("_item").alias("_items")), widths


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """One row per document: id_col, digest (MD5 of the text), n_words, n_hit, n_items (long), items (sorted ids as
    strings), hits (array of start and end word numbers of the parts to remove) and contaminated (boolean).

    Words are ``WORD`` runs after A-Z are lower-cased. A window is ``width`` consecutive words of an item; an item of
    fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

    Null and empty texts have no words and no hits; items without words or with null text give no windows; an item with a
    null id is not listed, though its words count as hit. Repeated rows give repeated results, and repeated items count
    once per id. Empty tables give empty or all-clean results. Other columns are not looked at.
    """
    windows, widths = benchmark_windows(benchmark, id_col=item_id_col, text_col=item_text_col, width=width)
    digest = F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8"))
    base = docs.select(F.col(id_col).alias("_id"), digest.alias("_digest"), F.col(text_col).alias("_text"))
    n_words = F.regexp_count(F.coalesce(F.col("_text"), F.lit("")), F.lit(ANY_CASE)).cast("long")
    out = base.select("_id", "_digest", n_words.alias("n_words"))
    few = windows.count() <= MAX_BROADCAST_WINDOWS
    table = F.broadcast(windows) if few else windows
    scanned = _with_hashes(base.select("_id", "_digest", words("_text").alias("_words")), widths)
    runs = [F.struct(F.lit(k).alias("width"), F.col(f"_w{k}").alias("hashes")) for k in widths]
    runs = F.array(*runs) if runs else F.array().cast("array<struct<width:int,hashes:array<bigint>>>")
    each = scanned.select("_id", "_digest", "_words", F.explode(runs).alias("_run")).select(
        "_id", "_digest", "_words", F.col("_run.width").alias("_k"), F.posexplode("_run.hashes").alias("_start", "_found")
    )
    # Only rows whose hash is found are compared word by word; the words are not copied for the others.
    same = (F.col("_found") == F.col("_hash")) & (F.col("_k") == F.col("_width")) & (F.slice("_words", F.col("_start") + 1, F.col("_k")) == F.col("_window"))
    hits = each.join(table, same).select("_id", "_digest", "_start", (F.col("_start") + F.col("_k")).alias("_end"), "_items")
    # A document's hits are no more than its words times the widths, its items no more than the benchmark's.
    hits = hits.groupBy("_id", "_digest").agg(
        F.array_sort(F.collect_set(F.struct("_start", "_end"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(
        "_spans",
        F.struct(empty.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
        lambda acc, s: F.when(
            s["_start"] <= acc["end"],
            F.struct(acc["done"].alias("done"), acc["start"].alias("start"), F.greatest(acc["end"], s["_end"]).alias("end")),
        ).otherwise(
            F.struct(
                F.when(acc["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).alias("done"),
                s["_start"].alias("start"), s["_end"].alias("end"),
            )
        ),
        lambda acc: F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))),
    )
    hits = hits.select(F.col("_id").alias("_hit_id"), F.col("_digest").alias("_hit_digest"), "items", merged.alias("hits"))
    joined = out.join(hits, (F.col("_digest") == F.col("_hit_digest")) & F.col("_id").eqNullSafe(F.col("_hit_id")), "left")
    spans = F.coalesce("hits", empty)
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_digest").alias("digest"), "n_words", n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), listed.alias("items"), spans.alias("hits"), (F.size(spans) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents", **options) -> DataFrame:
    """The documents, all columns kept, without those that hold a window (``remove='documents'``), or without the hit
    words and what stands before each of them (``remove='spans'``). Clean documents, null and empty texts stay as they are;
    repeated rows fare alike, and columns may have any names.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).filter("contaminated")
    found = found.select(F.col(id_col).alias("hit_id"), F.col("digest").alias("hit_digest"), "hits").dropDuplicates(["hit_id", "hit_digest"])
    digest = F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8"))
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"), digest.alias("own_digest"))
    same = (F.col("own_digest") == F.col("hit_digest")) & F.col("own_id").eqNullSafe(F.col("hit_id"))
    if remove == "documents":
        return marked.join(found, same, "left_anti").select("row.*")
    text = F.col("row").getField(text_col)
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    kept = F.filter(pieces, lambda piece, i: ~F.exists("hits", lambda h: (h["start"] <= i) & (i < h["end"])))
    cleaned = F.when(F.col("hits").isNotNull(), F.concat(F.array_join(kept, ""), F.regexp_extract(text, TAIL, 0))).otherwise(text)
    columns = (cleaned.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns)
    return marked.join(found, same, "left").select(*columns)
