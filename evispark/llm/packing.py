"""Best-fit packing of documents into sequences of a fixed number of words, under conflicts.

A text longer than a sequence is cut into full pieces and a rest. Pieces are dealt out by hash and packed in windows of
bounded size, longest first: each goes into the open bin with the least room that suffices and that holds neither its
source nor its duplicate cluster; the search goes on to the next larger room until one is compatible.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096  # pieces packed together
WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def bitmaps(values: Sequence[object]) -> list[int]:
    """A bit for each value that occurs more than once; other values and null conflict with nothing."""
    bits = {v: 1 << i for i, v in enumerate(v for v, n in Counter(values).items() if n > 1 and v is not None)}
    return [bits.get(v, 0) for v in values]


def best_fit(sizes: Sequence[int], sources: Sequence[object], clusters: Sequence[object], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, bins numbered from 0. No bin holds a source or a cluster twice."""
    source, cluster = bitmaps(sources), bitmaps(clusters)
    room: list[tuple[int, int]] = []  # (room left, bin) of the open bins, in order
    in_source: list[int] = []
    in_cluster: list[int] = []
    out = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        while at < len(room) and (in_source[room[at][1]] & source[i] or in_cluster[room[at][1]] & cluster[i]):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(in_source)
            in_source.append(0)
            in_cluster.append(0)
        out[i] = (b, capacity - left)
        in_source[b] |= source[i]
        in_cluster[b] |= cluster[i]
        if left > sizes[i]:
            insort(room, (left - sizes[i], b))
    return out


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = 2048, texts: bool = False) -> DataFrame:
    """One row per piece: id_col, piece (int, from 0), start_word, n_words (long), bin_id and bin_offset (long), and with
    ``texts`` the piece's text with the blanks after its words.

    Words are runs without ASCII blanks; a bin holds ``capacity`` words at most. Duplicate clusters are equal texts. Two
    pieces of one source, of equal texts or of one document never share a bin.

    Texts without words (null, empty, blank) are one piece of no words, whose bin_id and bin_offset are null. A null source
    conflicts with nothing; a null id is packed like any other. Rows that repeat are packed as often as they occur. An
    empty table gives an empty result; other columns are not looked at.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.md5(F.encode(body, "utf-8")).alias("_digest"), F.col(source_col).cast("string").alias("_source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("_n"),
    )
    last = F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int")
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("_id", "_digest", "_source", "piece", start.alias("start_word"), F.least(F.col("_n") - start, F.lit(capacity)).alias("n_words"))
    kind = docs.schema[id_col].dataType.simpleString()
    deal = F.xxhash64("_digest", "_id", "piece")
    order = ("_deal", "_digest", "_id", "piece", "_source")
    some = pieces.filter("n_words > 0").withColumn("_deal", deal)
    # A row count decides how many tasks; a task that gets many rows packs window after window.
    parts = max(1, math.ceil(docs.count() / (8 * WINDOW)))
    dealt = some.repartition(parts, "_deal").sortWithinPartitions(*order).drop("_deal")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def packed(table: pa.Table, base: int) -> pa.RecordBatch:
            columns = table.to_pydict()
            placed = best_fit(columns["n_words"], columns["_source"], columns["_digest"], capacity)
            bins, offsets = (pa.array([p[k] + (base if k == 0 else 0) for p in placed], pa.int64()) for k in (0, 1))
            out = table.drop_columns(["_source"]).append_column("bin_id", bins).append_column("bin_offset", offsets)
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= WINDOW:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, WINDOW), base)
                base += 1 << 20
                held = table.slice(WINDOW).to_batches()
        if held and sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held), base)

    fields = f"_id {kind}, _digest string, piece int, start_word long, n_words long, bin_id long, bin_offset long"
    none = F.lit(None).cast("long")
    placed = dealt.mapInArrow(pack, fields).unionByName(
        pieces.filter("n_words = 0").drop("_source").withColumns({"bin_id": none, "bin_offset": none})
    )
    columns = [F.col("p._id").alias(id_col), "piece", "start_word", "n_words", "bin_id", "bin_offset"]
    if not texts:
        return placed.alias("p").select(*columns)
    source = docs.select(F.col(id_col).alias("_id"), F.md5(F.encode(body, "utf-8")).alias("_digest"), body.alias("_text")).dropDuplicates(["_id", "_digest"])
    same = (F.col("p._digest") == F.col("t._digest")) & F.col("p._id").eqNullSafe(F.col("t._id"))
    cut = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(WORD_AND_GAP), F.lit(0)), F.col("start_word").cast("int") + 1, F.col("n_words").cast("int")), "")
    whole = (F.col("piece") == 0) & (F.col("n_words") < capacity)
    return placed.alias("p").join(source.alias("t"), same).select(*columns, F.when(whole, F.col("_text")).otherwise(cut).alias("text"))
