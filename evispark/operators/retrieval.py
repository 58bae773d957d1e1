"""Top-k search over chunk vectors for a whole batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.operators.ranking import ranked, top_k
from evispark.session import cut_lineage

SCORE_DIGITS = 9
QUERY_BYTES = 64 << 20  # of queries that a task gets at once
CHUNK_ROWS = 50_000  # chunks of one block where many queries meet them
CELLS = 2_000_000
# Filters of a search: by name, the query's column, the chunk's column and the chunk column's type.
FILTERS = {
    "only": ("only", "group", "string"),
    "document_type": ("document_types", "document_type", "string"),
    "region": ("regions", "region_names", "array<string>"),
}
PAIR_SLICE = 2_000_000
NATIONWIDE = "全国"


def allowed(filters: Column, document_type: Column, region_names: Column) -> Column:
    """Hard predicate of a query over a chunk; fields that are not hard do not restrict."""
    hard = filters["hard_fields"]
    regions = F.when(filters["strict"], filters["region_names"]).otherwise(
        F.array_union(filters["region_names"], F.array(F.lit(NATIONWIDE)))
    )
    type_ok = ~F.array_contains(hard, "document_types") | F.array_contains(filters["document_types"], document_type)
    region_ok = ~F.array_contains(hard, "region_names") | F.arrays_overlap(region_names, regions)
    return type_ok & region_ok


def hard_filters(filters: Column) -> tuple[Column, Column]:
    """(document types, regions) that a query's hard fields allow; null where they do not restrict."""
    hard = filters["hard_fields"]
    regions = F.when(filters["strict"], filters["region_names"]).otherwise(
        F.array_union(filters["region_names"], F.array(F.lit(NATIONWIDE)))
    )
    types = F.when(F.array_contains(hard, "document_types"), filters["document_types"])
    return types, F.when(F.array_contains(hard, "region_names"), regions)


def _best(query: np.ndarray, chunk: np.ndarray, score: np.ndarray, k: np.ndarray):
    """Keep the k best rows of every query, each with its own k: score first, then the smaller id."""
    order = np.lexsort((chunk, -score, query))
    query, chunk, score = query[order], chunk[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = place < k[query]
    return query[keep], chunk[keep], score[keep]


def _dense_scores(part: pa.RecordBatch, q_dense: np.ndarray) -> np.ndarray:
    values = part.column("dense").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return q_dense @ values.reshape(part.num_rows, -1).T


def _sparse_scores(part: pa.RecordBatch, q_terms: pa.Array, q_bounds, q_at, q_weights, n_queries: int) -> np.ndarray:
    """Sum of weight products over shared terms; -inf where a pair shares none."""
    n = part.num_rows
    out = np.zeros(n_queries * n)
    lengths = part.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    term = pc.index_in(part.column("terms").flatten(), value_set=q_terms).fill_null(-1).to_numpy(zero_copy_only=False)
    weight = part.column("weights").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(n), lengths)
    known = term >= 0
    term, weight, row = term[known], weight[known], row[known]
    fan = q_bounds[term + 1] - q_bounds[term]
    # Each shared term meets all queries that hold it; done in slices of bounded size.
    ends = np.cumsum(fan)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PAIR_SLICE, ends[-1], PAIR_SLICE)) if len(ends) else [], len(term)])
    for lo, hi in zip(cuts[:-1].astype(int), cuts[1:].astype(int)):
        f = fan[lo:hi]
        spot = np.arange(f.sum()) - np.repeat(np.cumsum(f) - f, f) + np.repeat(q_bounds[term[lo:hi]], f)
        cell = q_at[spot] * n + np.repeat(row[lo:hi], f)
        out += np.bincount(cell, weights=q_weights[spot] * np.repeat(weight[lo:hi], f), minlength=len(out))
    scores = out.reshape(n_queries, n)
    scores[scores <= 0] = -np.inf
    return scores


class _QueryBlock:
    """The queries a partition searches for, in matrix form."""

    def __init__(self, rows: pa.Table, arms: tuple[str, ...]):
        self.ids = np.asarray(rows.column("id").to_pylist(), dtype=object)
        self.k = rows.column("k").to_numpy()
        # Of each filter that some query has: the values that occur, and which query allows which (null: all).
        self.filters = {}
        for name in FILTERS:
            lists = rows.column(name).to_pylist()
            if any(values is not None for values in lists):
                known = sorted({v for values in lists for v in values or () if v is not None})
                wanted = np.array([[values is None or v in values for v in known] for values in lists], bool).reshape(len(lists), len(known))
                self.filters[name] = (pa.array(known, pa.string()), wanted, np.array([values is None for values in lists]))
        if "dense" in arms:
            flat = rows.column("dense").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            self.dense = flat.astype(np.float64).reshape(len(self.ids), -1)
        if "sparse" in arms:
            lists, weights = (rows.column(c).combine_chunks() for c in ("terms", "weights"))
            flat = lists.flatten()
            self.terms = pc.unique(flat)
            term = pc.index_in(flat, value_set=self.terms).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(self.ids)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            order = np.argsort(term, kind="stable")
            self.bounds = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
            self.at = at[order]
            self.weights = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)[order]

    def scores(self, part: pa.RecordBatch, arm: str) -> np.ndarray:
        if arm == "dense":
            found = _dense_scores(part, self.dense)
        else:
            found = _sparse_scores(part, self.terms, self.bounds, self.at, self.weights, len(self.ids))
        for name, (known, wanted, free) in self.filters.items():
            found[~(_members(part.column(name), known) @ wanted.T.astype(np.int32) > 0).T & ~free[:, None]] = -np.inf
        return np.round(found, SCORE_DIGITS)


def _members(column: pa.Array, known: pa.Array) -> np.ndarray:
    """Chunks by known filter values: does the chunk have the value? A column of text or of lists of text."""
    out = np.zeros((len(column), len(known)), np.int32)
    rows = np.arange(len(column))
    if pa.types.is_list(column.type):
        rows, column = np.asarray(pc.list_parent_indices(column)), column.flatten()
    at = pc.index_in(column, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    out[rows[at >= 0], at[at >= 0]] = 1
    return out


FOUND = "arm string, query_id string, chunk_id string, score double, k int"


def _found(block: _QueryBlock, batches: Iterator[pa.RecordBatch], arms: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Chunks in, no more than its k rows for each query and arm out."""
    most = int(block.k.max())
    held: dict[str, tuple] = {}
    floors = {arm: np.full(len(block.ids), -np.inf) for arm in arms}
    step = max(1, CELLS // len(block.ids))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            piece = batch.slice(start, step)
            for arm in arms:
                scores = block.scores(piece, arm)
                bar = floors[arm][:, None]
                if scores.shape[1] > most:
                    bar = np.maximum(bar, np.partition(scores, -most, axis=1)[:, -most][:, None])
                query, at = np.nonzero((scores >= bar) & (scores > -np.inf))
                if not len(query):
                    continue
                ids = np.asarray(piece.column("id").take(pa.array(at)).to_pylist(), dtype=object)
                found = (query, ids, scores[query, at])
                if arm in held:
                    found = tuple(np.concatenate(pair) for pair in zip(held[arm], found))
                held[arm] = _best(*found, block.k)
                query, _, score = held[arm]
                full = np.bincount(query, minlength=len(block.ids)) >= block.k
                lowest = np.full(len(block.ids), np.inf)
                np.minimum.at(lowest, query, score)
                floors[arm] = np.where(full, lowest, -np.inf)
    for arm, (query, chunk, score) in held.items():
        ids = block.ids[query]
        columns = [pa.array([arm] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(chunk, pa.string()), pa.array(score, pa.float64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(block.k[query], pa.int32())], names=["arm", "query_id", "chunk_id", "score", "k"])


def _in_place(asked: DataFrame, looked: DataFrame, arms: tuple[str, ...]) -> DataFrame:
    """A batch of bounded size goes to all tasks; chunks stay where the scan puts them."""
    queries = asked.toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if queries.num_rows:
            yield from _found(_QueryBlock(queries, arms), batches, arms)

    return looked.mapInArrow(run, FOUND)


def _on_a_grid(asked: DataFrame, looked: DataFrame, arms: tuple[str, ...], size: int) -> DataFrame:
    """A batch of any size: blocks of queries and blocks of chunks, each pair of which meets in a task of its own."""
    n_queries = -(-size // QUERY_BYTES)
    n_chunks = max(1, -(-looked.count() // CHUNK_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = asked.withColumn("_q", dealt(n_queries)).withColumn("_c", every(n_chunks)).groupBy("_q", "_c")
    cells = looked.withColumn("_c", dealt(n_chunks)).withColumn("_q", every(n_queries)).groupBy("_q", "_c")

    def meet(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        found = _found(_QueryBlock(queries, arms), chunks.to_batches(), arms) if len(queries) and len(chunks) else ()
        schema = pa.schema([("arm", pa.string()), ("query_id", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64()), ("k", pa.int32())])
        return pa.Table.from_batches(found, schema)

    return rows.cogroup(cells).applyInArrow(meet, FOUND)


def search(queries: DataFrame, chunks: DataFrame, k: int, arms: tuple[str, ...] = ("dense", "sparse")) -> DataFrame:
    """Exact inner-product top-k per arm for a batch of queries: arm, query_id, chunk_id, score, rank.

    ``queries``: query_id, and per arm ``dense`` or ``terms`` and ``weights``; optional ``k``, the query's own number of hits
    (at most ``k``), and the filters ``only``, ``document_types`` and ``regions``, each the values allowed before the cut
    (null: all). ``chunks``: chunk_id, the same vectors, and what the filters look at: ``group`` and ``document_type`` (text),
    ``region_names`` (list of text).

    The query batch is worked out once and measured. Up to ``QUERY_BYTES`` it goes to all tasks, and chunks stay where the
    scan puts them. A larger one never leaves the executors: it is cut into blocks, as the chunks are, and a pair of
    blocks is a group. Either way a task scores chunks in pieces and hands on k rows per query and arm.
    """
    none = lambda kind: F.lit(None).cast(kind)
    term_kind, weight_kind = (
        chunks.schema[c].dataType.simpleString() if "sparse" in arms else "array<int>" for c in ("terms", "weights")
    )

    def shaped(df: DataFrame, key: str, filters: dict[str, tuple[str, str]], *more: Column) -> DataFrame:
        has = lambda name, kind, to: (F.col(name).cast(kind) if name in df.columns else none(kind)).alias(to)
        return df.select(
            F.col(key).cast("string").alias("id"),
            *(has(name, kind, to) for to, (name, kind) in filters.items()),
            (has("dense", "array<float>", "dense") if "dense" in arms else none("array<float>").alias("dense")),
            (has("terms", term_kind, "terms") if "sparse" in arms else none(term_kind).alias("terms")),
            (has("weights", weight_kind, "weights") if "sparse" in arms else none(weight_kind).alias("weights")),
            *more,
        )

    own_k = F.least(F.lit(k), F.greatest(F.coalesce("k", F.lit(k)), F.lit(1))) if "k" in queries.columns else F.lit(k)
    asked = cut_lineage(
        shaped(queries, "query_id", {to: (own, "array<string>") for to, (own, _, _) in FILTERS.items()}, own_k.cast("int").alias("k"))
    )
    length = lambda c: F.coalesce(F.size(c), F.lit(0))
    letters = lambda c: F.coalesce(F.length(F.array_join(c, "")), F.lit(0)) + 8 * length(c)
    cost = 200 + 4 * length("dense") + 16 * length("terms") + sum((letters(c) for c in FILTERS), F.lit(0))
    size = asked.agg(F.sum(cost)).first()[0] or 0
    looked = shaped(chunks, "chunk_id", {to: (name, kind) for to, (_, name, kind) in FILTERS.items()})
    partial = _in_place(asked, looked, arms) if size <= QUERY_BYTES else _on_a_grid(asked, looked, arms, size)
    cut = top_k(partial, ["arm", "query_id"], [F.desc("score"), F.asc("chunk_id")], k)
    return cut.where(F.col("rank") <= F.col("k")).drop("k")


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``queries``: query_id, vector; ``chunks``: chunk_id, vector."""
    found = search(
        queries.withColumnRenamed("vector", "dense"), chunks.withColumnRenamed("vector", "dense"), k, ("dense",)
    )
    return found.drop("arm")


def gathered(postings: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) rows as one row per key. The partitioning by key is kept."""
    cells = F.collect_list(F.struct("term", "weight"))
    return postings.groupBy(key).agg(cells.alias("_c")).select(
        key, F.col("_c.term").alias("terms"), F.col("_c.weight").alias("weights")
    )


def sparse_top_k(query_postings: DataFrame, chunk_postings: DataFrame, k: int) -> DataFrame:
    """Inner product over shared terms, both sides as (id, term, weight) rows."""
    found = search(gathered(query_postings, "query_id"), gathered(chunk_postings, "chunk_id"), k, ("sparse",))
    return found.drop("arm")


def unit_score(score: Column) -> Column:
    """Inner product squeezed into 0..1."""
    return 0.5 + F.atan(score) / F.lit(float(np.pi))


def weighted_hybrid(found: DataFrame, w_dense: float | Column, w_sparse: float | Column, k: int | Column) -> DataFrame:
    """Weighted sum of both arms (arm, query_id, chunk_id, score); a chunk missing from an arm gets nothing from it.

    Weights and ``k`` are the same for all queries, or columns of ``found``.
    """
    weight = F.when(F.col("arm") == "dense", w_dense).otherwise(w_sparse)
    score = F.round(F.sum(weight * unit_score(F.col("score"))), SCORE_DIGITS).alias("score")
    order = [F.desc("score"), F.asc("chunk_id")]
    if isinstance(k, int):
        return top_k(found.groupBy("query_id", "chunk_id").agg(score), ["query_id"], order, k)
    fused = found.groupBy("query_id", "chunk_id").agg(score, F.max(k).alias("_k"))
    return ranked(fused, ["query_id"], order).where(F.col("rank") <= F.col("_k")).drop("_k")
