"""Text to sparse and dense vectors.

The default encoder needs no model: term weights for the sparse side, signed feature hashing for the
dense side, either as columns or as a batch encoder. A real model plugs in as another batch encoder.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from evispark.functions import text as T

HASH_DIM = 64
MIN_NORM = 1e-9
MAX_KNOWN = 200_000  # terms that an encoder remembers
WORD_PATTERN = T.WORD_PATTERN


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf). The texts are shuffled by ``key`` before they are taken apart, which moves less
    than the terms would; later steps per key reuse the partitioning."""
    return (
        df.select(key, text)
        .repartition(key)
        # Outer, as the inner form adds a size test that would split every text twice.
        .select(key, F.explode_outer(T.words(F.col(text))).alias("term"))
        .where("term IS NOT NULL")
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"))
    )


def log_weights(counts: DataFrame) -> DataFrame:
    return counts.withColumn("weight", 1 + F.log(F.col("tf").cast("double")))


def l2_normalised(postings: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(key)))
    return postings.withColumn(
        weight, F.when(norm < MIN_NORM, F.col(weight)).otherwise(F.col(weight) / norm)
    )


def sparse_postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Logarithmic term frequency, unit length per text: needs no statistics of the corpus."""
    return l2_normalised(log_weights(term_counts(df, key, text)), key).select(key, "term", "weight")


def _numbers() -> defaultdict:
    """Terms to numbers, each new one getting the next."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    return known


@F.arrow_udf(t.StructType([t.StructField("terms", t.ArrayType(t.StringType())), t.StructField("weights", t.ArrayType(t.DoubleType()))]))
def _term_weights(texts: pa.Array) -> pa.Array:
    word = regex.compile(WORD_PATTERN)
    found = [word.findall((text or "").lower()) for text in texts.to_pylist()]
    sizes = [len(terms) for terms in found]
    known = _numbers()
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))
    n_terms = max(1, len(known))
    cell, count = np.unique(np.repeat(np.arange(len(found)) * n_terms, sizes) + flat, return_counts=True)
    row, term = cell // n_terms, cell % n_terms
    weight = 1.0 + np.log(count)
    weight /= np.sqrt(np.bincount(row, weight * weight, len(found)))[row]
    bounds = pa.array(np.searchsorted(row, np.arange(len(found) + 1)).astype(np.int32))
    terms = pa.ListArray.from_arrays(bounds, pa.array(list(known), pa.string()).take(pa.array(term)))
    return pa.StructArray.from_arrays([terms, pa.ListArray.from_arrays(bounds, pa.array(weight))], names=["terms", "weights"])


def term_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms, weights): the postings of each text as one row, in one narrow step."""
    return df.select(key, _term_weights(F.col(text)).alias("_v")).select(key, "_v.terms", "_v.weights")


def query_postings(queries: DataFrame, key: str, text: str, corpus_postings: DataFrame, n_docs: Column) -> DataFrame:
    """Query weights carry the inverse document frequency; only terms that occur in a query are counted.

    ``corpus_postings`` needs a row per text and term.
    """
    counts = log_weights(term_counts(queries, key, text))
    terms = counts.select("term").distinct()
    df_counts = corpus_postings.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighted = counts.join(df_counts, "term").withColumn(
        "weight", F.col("weight") * F.log(1 + n_docs / F.col("df"))
    )
    return l2_normalised(weighted, key).select(key, "term", "weight")


def hash_bucket(term: Column, dim: int = HASH_DIM) -> Column:
    return F.conv(F.substring(T.sha256_hex(term), 1, 8), 16, 10).cast("long") % dim


def hash_sign(term: Column) -> Column:
    odd = F.conv(F.substring(T.sha256_hex(term), 9, 1), 16, 10).cast("int") % 2
    return F.when(odd == 1, F.lit(-1.0)).otherwise(F.lit(1.0))


def hashed_dense(postings: DataFrame, key: str, dim: int = HASH_DIM) -> DataFrame:
    """(key, vector): signed sums per bucket, unit length. Stays within the partitioning of ``postings``."""
    cells = (
        postings.withColumn("bucket", hash_bucket(F.col("term"), dim))
        .groupBy(key, "bucket")
        .agg(F.sum(F.col("weight") * hash_sign(F.col("term"))).alias("weight"))
    )
    entries = l2_normalised(cells, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("cells"))
    filled = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")),
        lambda b: F.coalesce(F.element_at("cells", b), F.lit(0.0)).cast("float"),
    )
    return entries.select(key, filled.alias("vector"))


def normalise_sparse_map(m: Column) -> Column:
    """Unit length; an empty or vanishing map stays as it is."""
    norm = F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return F.when(norm < MIN_NORM, m).otherwise(F.transform_values(m, lambda k, v: v / norm))


def csr_row(indices: Column, data: Column, start: Column, end: Column) -> Column:
    """Row slice of a compressed matrix as ``{index: weight}``."""
    size = end - start
    return F.map_from_arrays(F.slice(indices, start + 1, size), F.slice(data, start + 1, size))


def hashing_encoder(dim: int = HASH_DIM) -> Callable[[list[str]], tuple[list, list]]:
    """The offline encoder for one worker: same vectors as ``sparse_postings`` and ``hashed_dense``."""
    word = regex.compile(WORD_PATTERN)
    known = _numbers()
    heads = np.zeros(0, np.int64)  # of known terms: the first nine hex digits of the digest

    def encode(texts: list[str]) -> tuple[list, list]:
        nonlocal heads
        if len(known) > MAX_KNOWN:
            known.clear()
            heads = heads[:0]
        found = [word.findall((text or "").lower()) for text in texts]
        sizes = [len(terms) for terms in found]
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))
        fresh = [int.from_bytes(hashlib.sha256(term.encode()).digest()[:5]) >> 4 for term in islice(known, len(heads), None)]
        heads = np.concatenate([heads, np.array(fresh, np.int64)])
        # A cell is a term of a text.
        n_terms = max(1, len(known))
        cell, count = np.unique(np.repeat(np.arange(len(texts)) * n_terms, sizes) + flat, return_counts=True)
        row = cell // n_terms
        head = heads[cell - row * n_terms]
        weight = 1.0 + np.log(count)
        length = np.sqrt(np.bincount(row, weight * weight, len(texts)))
        dense = np.bincount(row * dim + (head >> 4) % dim, (1.0 - 2.0 * (head & 1)) * weight, len(texts) * dim).reshape(len(texts), dim)
        size = np.linalg.norm(dense, axis=1, keepdims=True)
        dense = np.where(size >= MIN_NORM, dense / np.maximum(size, MIN_NORM), dense)
        spot, at = np.unique(row << 28 | head >> 8, return_inverse=True)
        sums = np.bincount(at, weight / length[row], len(spot))
        cuts = np.searchsorted(spot, np.arange(len(texts) + 1) << 28).tolist()
        slots = spot & ((1 << 28) - 1)
        return list(dense), [(slots[lo:hi], sums[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    return encode


def encoder(load: Callable[[], Callable[[list[str]], tuple[list, list]]] = hashing_encoder, batch: int = 256):
    """A text encoder as a column function giving struct<dense, slots, weights>.

    ``load`` runs once per Python worker and returns a function from texts to (dense vectors, sparse
    dicts, or pairs of slot and weight arrays); it sees ``batch`` texts at a time. Another number of vectors than texts fails the task.
    """

    @F.pandas_udf("dense array<float>, slots array<int>, weights array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            dense: list = []
            sparse: list = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].tolist()
                more_dense, more_sparse = model(part)
                if len(more_dense) != len(part) or len(more_sparse) != len(part):
                    raise ValueError("encoder returned another number of vectors than texts")
                dense.extend(more_dense)
                sparse.extend((list(v), list(v.values())) if isinstance(v, dict) else v for v in more_sparse)
            yield pd.DataFrame(
                {
                    "dense": [np.asarray(v, dtype=np.float32) for v in dense],
                    "slots": [np.asarray(slots, dtype=np.int32) for slots, _ in sparse],
                    "weights": [np.asarray(weights, dtype=np.float32) for _, weights in sparse],
                }
            )

    # Marked so that no filter above it is pushed down with a second run of the model.
    return encode.asNondeterministic()


def search_vectors(df: DataFrame, key: str, text: str, encode=None, carried: list[str] = ()) -> DataFrame:
    """(key, carried columns, dense, terms, weights): what a search needs, in one narrow step."""
    encode = encode or encoder()
    return df.select(key, *carried, encode(F.col(text)).alias("_v")).select(
        key, *carried, F.col("_v.dense").alias("dense"), F.col("_v.slots").alias("terms"), F.col("_v.weights").alias("weights")
    )


def with_vectors(df: DataFrame, text: str, encode=None) -> DataFrame:
    """Add dense_vector and sparse_vector; a narrow step, so texts never leave their partition."""
    encode = encode or encoder()
    rows = df.withColumn("_v", encode(F.col(text)))
    return (
        rows.withColumn("dense_vector", F.col("_v.dense"))
        .withColumn("sparse_vector", F.map_from_arrays("_v.slots", "_v.weights"))
        .drop("_v")
    )
