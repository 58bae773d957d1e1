"""Shingle sets of whole texts in order of rarity.

Texts with equal sets are one node. Shingles that only one node has cannot be shared, so
they only count; of the others, each node gets its own in order of (nodes that have it, hash), a total order that is the
same for all nodes. A node whose prefix holds no shared shingle can have no partner and drops out here.

The shingles cross the shuffle as packed arrays dealt out by hash, not as rows: seven bytes for each, and some for its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import durable
from evispark.llm.hashing import blocks, mixed, shingle_sets

BLOCK_BYTES = 1 << 20  # of text, hashed at once
_FIELDS = "bin int, block long, tokens binary, nodes binary, sizes binary, runs binary, key binary, item_nodes array<long>, item_sizes array<int>"
_REPLY = "block long, tokens binary, nodes binary, sizes binary, runs binary, counts binary, key binary, item_nodes array<long>, item_sizes array<int>"
_NODE = "node long, n int, unique int, prefix int, tokens array<long>, second array<int>, third array<int>"
_SECOND, _THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Of sets that share ``percent`` of the larger one at least, so many first elements must have one in common."""
    return n - -(-n * percent // 100) + 1


def _sets(batches: Iterator[pa.RecordBatch], *, shingle: int, bins: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema(
        [("bin", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("tokens", "nodes", "sizes", "runs", "key"))]
        + [("item_nodes", pa.list_(pa.int64())), ("item_sizes", pa.list_(pa.int32()))]
    )
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        for start, stop in blocks(texts, BLOCK_BYTES):
            block += 1
            part = texts.slice(start, stop - start)
            rows = np.arange(stop - start + 1)
            tokens, bounds = shingle_sets(part, shingle)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            nodes = np.zeros(len(sizes), np.int64)
            if len(full):
                sums = np.add.reduceat(mixed(tokens + _SECOND), bounds[full])
                nodes[full] = mixed(sums + sizes[full].astype(np.uint64) * _THIRD).view(np.int64)
            n = stop - start
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, ((block >> 32) + block) % bins), pa.int32()), pa.array(np.full(n, block)), none, none, none, none, keys.slice(start, n),
                    pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(nodes)),
                    pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(sizes.astype(np.int32))),
                ], schema=schema,
            )
            # Of equal sets in the block, the first speaks for all.
            first = np.zeros(len(sizes), bool)
            first[full[np.unique(nodes[full], return_index=True)[1]]] = True
            item = np.repeat(np.arange(len(sizes)), sizes)
            keep = first[item]
            tokens, item = tokens[keep], item[keep]
            home = (tokens % np.uint64(bins)).astype(np.int64)
            order = np.argsort(home.astype(np.uint16) if bins <= 1 << 16 else home, kind="stable")
            tokens, item, home = tokens[order], item[order], home[order]
            cuts = np.searchsorted(home, np.arange(bins + 1))
            out: list[list] = [[], [], [], [], []]
            for b in range(bins):
                lo, hi = cuts[b], cuts[b + 1]
                if lo < hi:
                    there, runs = np.unique(item[lo:hi], return_counts=True)
                    for column, value in zip(out, (b, _packed7(tokens[lo:hi] // np.uint64(bins)), nodes[there].tobytes(), sizes[there].astype(np.int32).tobytes(), runs.astype(np.int32).tobytes()), strict=True):
                        column.append(value)
            n = len(out[0])
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array(np.full(n, block)), *(pa.array(c, pa.binary()) for c in out[1:]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))],
                    schema=schema,
                )


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _packed7(numbers: np.ndarray) -> bytes:
    """The lower seven bytes of each number."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpacked7(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with packed sets: the node of each shingle and the size of the node's set."""
    runs = _joined(table["runs"], np.int32)
    return (
        np.repeat(_joined(table["nodes"], np.int64), runs),
        np.repeat(_joined(table["sizes"], np.int32), runs),
    )


def _shared(table: pa.Table, *, bins: int) -> pa.Table:
    """Of a bin: the shingles that more than one node has, handed back to the first block of each node."""
    schema = pa.schema(
        [("block", pa.int64()), *((c, pa.binary()) for c in ("tokens", "nodes", "sizes", "runs", "counts", "key"))]
        + [("item_nodes", pa.list_(pa.int64())), ("item_sizes", pa.list_(pa.int32()))]
    )
    heads = table.filter(pc.is_null(table["tokens"]))
    heads = heads.append_column("counts", pa.nulls(heads.num_rows, pa.binary())).select(schema.names).cast(schema)
    packed = table.filter(pc.is_valid(table["tokens"])).sort_by("block")
    if not packed.num_rows:
        return heads
    node, size = _unpacked(packed)
    parts = packed["tokens"].to_pylist()
    # What a bin holds has the same remainder; the rest loses the bits above its 56th, of 64 in all.
    tokens = _unpacked7(b"".join(parts)) * np.uint64(bins) + np.uint64(packed["bin"][0].as_py())
    block = np.repeat(packed["block"].to_numpy(), [len(t) // 7 for t in parts])
    order = np.lexsort((node, tokens))  # stable: the first block of equal ones comes first
    tokens, node = tokens[order], node[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    first = new.copy()
    first[1:] |= node[1:] != node[:-1]
    order, tokens, node, new = order[first], tokens[first], node[first], new[first]
    starts = np.flatnonzero(new)
    many = np.diff(np.r_[starts, len(tokens)])
    counts = np.repeat(many, many).astype(np.uint32)
    more = counts > 1
    order, tokens, node, counts = order[more], tokens[more], node[more], counts[more]
    if not len(tokens):
        return heads
    size, block = size[order], block[order]
    by = np.lexsort((node, block))
    tokens, node, counts, size, block = tokens[by], node[by], counts[by], size[by], block[by]
    rows = []
    ids, cuts = np.unique(block, return_index=True)
    for b, lo, hi in zip(ids.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(block)], strict=True):
        begin = np.flatnonzero(np.r_[True, node[lo + 1 : hi] != node[lo : hi - 1]])
        runs = np.diff(np.r_[begin, hi - lo]).astype(np.int32)
        parts = (tokens[lo:hi], node[lo:hi][begin], size[lo:hi][begin], runs, counts[lo:hi])
        rows.append({"block": b, **{c: a.tobytes() for c, a in zip(("tokens", "nodes", "sizes", "runs", "counts"), parts, strict=True)}})
    return pa.concat_tables([heads, pa.Table.from_pylist(rows, schema=schema)])


def _nodes(table: pa.Table, *, percent: int) -> pa.Table:
    """Of a block: its nodes with their shared shingles in order of rarity, and the prefixes under two more orders."""
    tokens = _joined(table["tokens"], np.uint64)
    node, size = _unpacked(table)
    count = _joined(table["counts"], np.uint32)
    order = np.lexsort((tokens, count, node))
    tokens, node, size, count = tokens[order], node[order], size[order], count[order]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(node)] if len(node) else starts
    n = size[starts].astype(np.int64)
    unique = n - (ends - starts)
    prefix = prefix_length(n, percent) - unique
    at = np.flatnonzero(prefix > 0)
    lists: list[list] = [[], [], []]
    second, third = mixed(tokens ^ _SECOND), mixed(tokens ^ _THIRD)
    grade = np.log2(np.maximum(count, 1)).astype(np.int64)
    for i in at.tolist():
        lo, hi, k = starts[i], ends[i], prefix[i]
        own = tokens[lo:hi].view(np.int64)
        lists[0].append(own)
        brief = own.astype(np.int32)
        lists[1].append(brief[np.lexsort((second[lo:hi], count[lo:hi]))[:k]])
        lists[2].append(brief[np.lexsort((third[lo:hi], grade[lo:hi]))[:k]])
    return pa.table(
        [pa.array(node[starts[at]]), pa.array(n[at], pa.int32()), pa.array(unique[at], pa.int32()), pa.array(prefix[at], pa.int32())]
        + [pa.array(c, pa.list_(kind)) for c, kind in zip(lists, (pa.int64(), pa.int32(), pa.int32()), strict=True)],
        names=["node", "n", "unique", "prefix", "tokens", "second", "third"],
    )


def rarity_index(texts: DataFrame, key: str, text: str, *, shingle: int, percent: int, bins: int = 0) -> tuple[DataFrame, DataFrame]:
    """(items, nodes) of a text column.

    ``items``: ``key`` (binary) of each row with the arrays ``item_nodes`` and ``item_sizes`` of one element; a text of
    size 0 has no words and node 0. ``nodes``: those that may have a partner, with the
    size n of the set, how many shingles only they have, the length of the rest of the prefix (unique shingles come first),
    all shared shingles by rarity, and the prefix under two more orders, as 32 bits of each hash: equal counts dealt by
    another hash, and counts graded by powers of two, dealt by a third.

    ``bins`` of the shuffle: the session's shuffle partitions, 64 at least, when 0. A text is hashed whole, in one task.
    """
    bins = bins or max(64, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(partial(_sets, shingle=shingle, bins=bins), _FIELDS)

    def shared(table: pa.Table) -> pa.Table:
        return _shared(table, bins=bins)

    reduced = durable(packed.groupBy("bin").applyInArrow(shared, _REPLY), release=True)
    items = reduced.filter(F.col("tokens").isNull()).select("key", "item_nodes", "item_sizes")
    replies = reduced.filter(F.col("tokens").isNotNull()).select("block", "tokens", "nodes", "sizes", "runs", "counts")

    def ordered(table: pa.Table) -> pa.Table:
        return _nodes(table, percent=percent)

    nodes = durable(replies.groupBy("block").applyInArrow(ordered, _NODE), release=True)
    return items, nodes
