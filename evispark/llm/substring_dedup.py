"""Exact removal of repeated passages, behind a count-min prefilter.

Documents are packed into blocks of bounded size. A block hashes its windows of consecutive words and writes its share of a
count-min sketch: of each sketch row the counters that it raises, as gaps, by slices of the counters. One task per slice
merges the shares of all blocks and answers each of them which of its counters stand at two or more. A counter never reads
less than the number of documents that hold a window, so the windows left out are certain not to repeat. Only those
estimated repeated are grouped exactly, by a 96-bit hash, for the smallest document that holds them. Blocks lie in a bucketed
table, so that the answers go to the texts and the texts stay where they are.

The sketch's width follows the number of windows, while slices and blocks keep their size; a window of any number of documents
goes into the exact pass at most once for each block. The driver sees two numbers, the bytes of text and the count of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import bucketed, durable
from evispark.llm.hashing import blocks, mixed, string_buffers

WINDOW = 50
SLICE_BITS = 22  # counters of one slice, as a power of two
COUNTERS_PER_WINDOW = 8
BLOCK_BYTES = 4 << 20
BUCKET_BLOCKS = 4

_RANDOM = np.random.default_rng(20240711)
_PERIOD = 1 << 12
_PLACE = _RANDOM.integers(1, 2**63, _PERIOD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIR = _RANDOM.integers(1, 2**63, (2, 64, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0xA0761D6478BD642F)
# Blanks (space, tab to carriage return) end words and count nothing.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[_BLANK] = 0


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first byte of each word; texts do not share words."""
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = bounds[:-1][bounds[:-1] < len(data)]
    first[begin] = word[begin]
    return np.flatnonzero(first)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, unchanged, and where each text's words begin in that list (one more than texts)."""
    data, bounds = string_buffers(texts)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    starts = word_starts(data, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    terms = _BYTE[data[starts[0] :]] * _PLACE[place % _PERIOD]
    if place.max() >= _PERIOD:
        terms *= mixed((place // _PERIOD).astype(np.uint64)) | np.uint64(1)
    return mixed(np.add.reduceat(terms, starts - starts[0])), np.searchsorted(starts, bounds)


def run_hashes(words: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """Hash of each run of ``size`` words, put together from runs of 1, 2, 4, ... words."""
    n = max(0, len(words) - size + 1)
    out, run, covered, span = None, words, 0, 1
    for step in range(size.bit_length()):
        a, b = factors[step]
        if size >> step & 1:
            part = run[covered : covered + n]
            out = part if out is None else mixed(out * a + part * b)
            covered += span
        run = mixed(run[:-span] * a + run[span:] * b) if len(run) > span else run[:0]
        span *= 2
    return out


@dataclass
class Windows:
    """Windows of a block: those with equal words are one group, groups ascend by their first hash."""

    ids: np.ndarray  # id of each document; the block holds those with an id first
    bounds: np.ndarray  # first word of each document
    start: np.ndarray  # first word of each window
    doc: np.ndarray  # document of each window
    group: np.ndarray  # group of each window
    first: np.ndarray  # of each group: two hashes, the smallest and the largest document id
    second: np.ndarray
    lowest: np.ndarray
    highest: np.ndarray

    def keys(self, bits: int) -> Iterator[np.ndarray]:
        """The counter of each group, for each row of the sketch."""
        shift = np.uint64(64 - bits)
        yield (self.first >> shift).astype(np.int64)
        yield (self.second >> shift).astype(np.int64)


def windows_of(docs: pa.RecordBatch, size: int) -> Windows:
    """Documents without an id have no windows."""
    words, bounds = words_of(docs.column("text"))
    known = len(docs) - docs.column("id").null_count
    ids = docs.column("id").slice(0, known).to_numpy(zero_copy_only=False).astype(np.int64)
    many = np.maximum(np.diff(bounds)[:known] - size + 1, 0)
    doc = np.repeat(np.arange(known), many)
    start = bounds[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = run_hashes(words, size, _PAIR[0])[start]
    second = run_hashes(mixed(words ^ _SECOND), size, _PAIR[1])[start]
    order = np.argsort(first)
    one, two = first[order], second[order]
    same = one[1:] == one[:-1]
    if (same & (two[1:] != two[:-1])).any():
        order = np.lexsort((second, first))
        one, two = first[order], second[order]
    begin = np.ones(len(order), bool)
    begin[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begin) - 1
    begin = np.flatnonzero(begin)
    held = ids[doc[order]]
    least = np.minimum.reduceat(held, begin) if len(begin) else held
    most = np.maximum.reduceat(held, begin) if len(begin) else held
    return Windows(ids, bounds, start, doc, group, one[begin], two[begin], least, most)


def binaries(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Binary values that start at the given items of one array."""
    offsets = np.append(begin, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def joined(values: pa.ChunkedArray | pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column, and how many each row has."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    data, bounds = string_buffers(values)
    return data[bounds[0] : bounds[-1]].view(dtype), np.diff(bounds) // np.dtype(dtype).itemsize


def bits_of(marks: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Marks that start at the given items of one array, as bits, each row filled up to a whole byte."""
    many = np.diff(np.append(begin, len(marks)))
    filled = -(-many // 8)
    ends = np.cumsum(filled)
    out = np.zeros(8 * int(filled.sum()), bool)
    out[np.arange(len(marks)) + np.repeat(8 * (ends - filled) - begin, many)] = marks
    return binaries(np.packbits(out), ends - filled)


def packed_blocks(docs: DataFrame, size: int) -> DataFrame:
    """(docs: binary, windows: long): documents of about BLOCK_BYTES as a compressed Arrow batch, and their number of windows."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        order = pc.sort_indices(table["id"], null_placement="at_end")
        whole = table.take(order).combine_chunks().to_batches()[0]
        data, bounds = string_buffers(whole.column("text"))
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        words = np.diff(np.searchsorted(word_starts(data, bounds), bounds))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(whole)
        count = int(np.maximum(words - size + 1, 0).sum())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([count], pa.int64())], names=["docs", "windows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled = [], 0
        for batch in batches:
            for start, stop in blocks(batch.column("text"), BLOCK_BYTES):
                part = batch.slice(start, stop - start)
                _, bounds = string_buffers(part.column("text"))
                if held and filled + bounds[-1] - bounds[0] > BLOCK_BYTES:
                    yield block(held)
                    held, filled = [], 0
                held.append(part)
                filled += int(bounds[-1] - bounds[0])
        if held:
            yield block(held)

    return docs.mapInArrow(pack, "docs binary, windows long")


def unpacked(docs: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(docs.as_buffer()).read_next_batch()


def shares(packed: DataFrame, size: int, bits: int) -> DataFrame:
    """(slice, block, low, high): the counters of a slice that a block raises, ascending, as gaps in two halves. A counter
    that it raises by two or more stands there twice. Slices of the second row follow those of the first."""
    slices = 1 << (bits - SLICE_BITS)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs in zip(batch.column("block"), batch.column("docs"), strict=True):
                found = windows_of(unpacked(docs), size)
                several = found.highest > found.lowest
                for row, keys in enumerate(found.keys(bits)):
                    keys = np.sort(np.concatenate([keys, keys[several]]))
                    if not len(keys):
                        continue
                    third = np.zeros(len(keys), bool)
                    third[2:] = keys[2:] == keys[:-2]
                    keys = keys[~third]
                    part = keys >> SLICE_BITS
                    begin = np.flatnonzero(np.diff(part, prepend=-1))
                    gaps = np.diff(keys, prepend=0)
                    gaps[begin] = keys[begin] & ((1 << SLICE_BITS) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part[begin] + row * slices), pa.array(np.full(len(begin), block.as_py())),
                            binaries((gaps & 0xFFFF).astype("<u2"), begin), binaries((gaps >> 16).astype("<u2"), begin),
                        ],
                        names=["slice", "block", "low", "high"],
                    )

    return packed.select("block", "docs").mapInArrow(share, "slice long, block long, low binary, high binary")


def merge_slice(rows: pa.Table) -> pa.Table:
    """Of one slice, the counters that stand at two or more: a bit for each counter of a share, in its order."""
    low, many = joined(rows["low"], "<u2")
    high, _ = joined(rows["high"], "<u2")
    gaps = low.astype(np.int64) + (high.astype(np.int64) << 16)
    begin = np.cumsum(many) - many
    total = np.cumsum(gaps)
    at = total - np.repeat(total[begin] - gaps[begin], many)
    counts = np.bincount(at, minlength=1 << SLICE_BITS)
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    fresh[begin] = True
    marks = bits_of(counts[at[fresh]] >= 2, (np.cumsum(fresh) - fresh)[begin])
    return pa.table({"slice": rows["slice"], "block": rows["block"], "marks": marks})


def merge_exact(rows: pa.Table) -> pa.Table:
    """Of one slice of windows, whether another block has a smaller document with it: a bit for each window, in its order."""
    one, many = joined(rows["first"], "<u8")
    two, _ = joined(rows["second"], "<u4")
    lowest, _ = joined(rows["lowest"], "<i8")
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(fresh)
    least = np.minimum.reduceat(lowest[order], begin)
    marks = np.zeros(len(a), bool)
    marks[order] = lowest[order] > least[np.cumsum(fresh) - 1]
    return pa.table({"slice": rows["slice"], "block": rows["block"], "marks": bits_of(marks, np.cumsum(many) - many)})


def marks_from(answers: pa.Table, low: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """The answers to a block's ascending counters, those of its first slice under the number ``low``."""
    part = answers.filter((pc.field("slice") >= low) & (pc.field("slice") < low + (1 << (bits - SLICE_BITS)))).sort_by("slice")
    data, filled = joined(part["marks"], "u1")
    slices = keys >> SLICE_BITS
    begin = np.flatnonzero(np.diff(slices, prepend=-1))
    if not np.array_equal(slices[begin] + low, part["slice"].to_numpy()):
        raise ValueError("answers do not fit the block")
    shift = 8 * (np.cumsum(filled) - filled) - begin
    return np.unpackbits(data)[np.arange(len(keys)) + np.repeat(shift, np.diff(np.append(begin, len(keys))))].astype(bool)


def estimated_repeated(found: Windows, answers: pa.Table, bits: int) -> np.ndarray:
    """Groups whose counters stand at two or more in every row of the sketch."""
    kept = np.ones(len(found.first), bool)
    for row, keys in enumerate(found.keys(bits)):
        distinct, place = np.unique(keys, return_inverse=True)
        kept &= marks_from(answers, row << (bits - SLICE_BITS), distinct, bits)[place]
    return np.flatnonzero(kept)


def drop_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id_col (long), n_words, n_removed (long) and kept (string).

    Words are runs of characters other than space and tab to carriage return. Each word goes that a window of ``window``
    consecutive words of its document covers whose words also start, in that order, in a document with a smaller id; windows
    are judged on the input. ``kept`` has the words that stay, joined by one space; it is null for a null text.

    A null id is neither smaller nor larger than any: such a document keeps all words and takes none from others. Rows
    that share an id never take words from each other, so repeated rows all stay alike. Texts of fewer words than a
    window, empty and null ones stay whole. A text larger than a block is a block of its own. An empty table gives an
    empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), held // (BUCKET_BLOCKS * BLOCK_BYTES))
    packed = bucketed(packed_blocks(rows, window).withColumn("block", F.monotonically_increasing_id()), "block", buckets)
    total = packed.agg(F.sum("windows")).first()[0] or 0
    bits = max(SLICE_BITS, (COUNTERS_PER_WINDOW * total).bit_length())
    slices = 1 << (bits - SLICE_BITS)

    def candidates(own: pa.Table, answers: pa.Table) -> pa.Table:
        found = windows_of(unpacked(own["docs"][0]), window)
        kept = estimated_repeated(found, answers, bits)
        first = found.first[kept]
        part = (first >> np.uint64(64 - bits)).astype(np.int64) >> SLICE_BITS
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        second = (found.second[kept] >> np.uint64(32)).astype("<u4")
        return pa.table(
            {
                "slice": part[begin] + 2 * slices, "block": np.full(len(begin), own["block"][0].as_py()), "first": binaries(first, begin),
                "second": binaries(second, begin), "lowest": binaries(found.lowest[kept], begin),
            }
        )

    def removal(own: pa.Table, answers: pa.Table) -> pa.Table:
        docs = unpacked(own["docs"][0])
        found = windows_of(docs, window)
        elsewhere = np.zeros(len(found.first), bool)
        kept = estimated_repeated(found, answers, bits)
        elsewhere[kept] = marks_from(answers, 2 * slices, (found.first[kept] >> np.uint64(64 - bits)).astype(np.int64), bits)
        gone = found.start[elsewhere[found.group] | (found.ids[found.doc] > found.lowest[found.group])]
        steps = np.zeros(found.bounds[-1] + 1, np.int64)
        steps[gone] += 1
        steps[gone + window] -= 1
        stays = np.cumsum(steps[:-1]) <= 0
        texts = []
        for text, begin, end in zip(docs.column("text").cast(pa.binary()), found.bounds[:-1], found.bounds[1:], strict=True):
            texts.append(b" ".join(compress(text.as_py().split(), stays[begin:end])) if text.is_valid else None)
        lost = np.concatenate([[0], np.cumsum(~stays)])
        return pa.table(
            {
                "id": docs.column("id"), "n_words": np.diff(found.bounds).astype(np.int64), "n_removed": np.diff(lost[found.bounds]).astype(np.int64),
                "kept": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    marks = "slice long, block long, marks binary"
    sketch = durable(shares(packed, window, bits).groupBy("slice").applyInArrow(merge_slice, marks))
    own = packed.select("block", "docs").groupBy("block")
    repeated = own.cogroup(sketch.groupBy("block")).applyInArrow(candidates, "slice long, block long, first binary, second binary, lowest binary")
    exact = durable(repeated.groupBy("slice").applyInArrow(merge_exact, marks))
    left = own.cogroup(sketch.union(exact).groupBy("block")).applyInArrow(removal, "id long, n_words long, n_removed long, kept string")
    return left.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")
