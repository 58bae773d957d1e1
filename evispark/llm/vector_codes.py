"""Product quantisation of vectors in whole numbers, with memoised grid cells.

Every part of a vector falls into a coarse cell of a grid. For a cell, the entries of the codebook that can be nearest to
anything in its box are worked out once and remembered: those whose least distance to the box does not exceed the smallest
of the greatest distances. Only these are evaluated exactly. The codebooks are a bounded model (parts x entries numbers of a part's
width); the table itself is read once for each round and never leaves its tasks, which return sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import durable
from evispark.llm.hashing import mixed

SCALE = 4096
LIMIT = 1 << 26  # components beyond are held to it, so that squared distances stay exact in 64 bits
REMEMBERED = 1 << 16  # cells of a part that a task keeps
CHUNK = 4096  # vectors worked on at once
_FACTOR = np.random.default_rng(20240815).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Codebook:
    """The entries of one part with the memo of its cells; cells are 2**bits wide."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries, self.bits = entries, bits
        self.forget()

    def forget(self) -> None:
        """The memo: hashes of cells, ascending, the cells, and their candidates."""
        self.hashes = np.zeros(0, np.uint64)
        self.cells = np.zeros((0, self.entries.shape[1]), np.int64)
        self.kept = np.zeros((0, len(self.entries)), bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Of each cell, the entries that may be nearest to something in its box."""
        low = (cells << self.bits)[:, None, :]
        high = low + ((1 << self.bits) - 1)
        near = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
        far = np.maximum(np.abs(self.entries - low), np.abs(high - self.entries))
        return (near**2).sum(2) <= (far**2).sum(2).min(1, keepdims=True)

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """A row of marks for each part: the entries not dominated across its cell."""
        cells = parts >> self.bits
        hashes = mixed((cells.astype(np.uint64) * _FACTOR[np.arange(cells.shape[1]) % len(_FACTOR)]).sum(1, dtype=np.uint64))
        place = np.searchsorted(self.hashes, hashes)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == hashes[known]
        fresh, index = np.unique(hashes[~known], return_index=True)
        if len(fresh):
            if len(self.hashes) + len(fresh) > REMEMBERED:
                self.forget()
                fresh, index, known = *np.unique(hashes, return_index=True), np.zeros(len(hashes), bool)
            new = cells[~known][index]
            order = np.argsort(np.concatenate([self.hashes, fresh]))
            self.hashes = np.concatenate([self.hashes, fresh])[order]
            self.cells = np.concatenate([self.cells, new])[order]
            self.kept = np.concatenate([self.kept, self.undominated(new)])[order]
            place = np.searchsorted(self.hashes, hashes)
        # A cell that only shares its hash with the remembered one keeps all entries.
        return self.kept[place] | (self.cells[place] != cells).any(1)[:, None]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part, the lower of equals, and its squared distance."""
        marks = self.candidates(parts)
        best = np.zeros(len(parts), np.int64)
        least = np.full(len(parts), np.iinfo(np.int64).max)
        for entry in range(len(self.entries)):
            row = np.flatnonzero(marks[:, entry])
            distance = ((parts[row] - self.entries[entry]) ** 2).sum(1)
            closer = distance < least[row]
            row = row[closer]
            best[row], least[row] = entry, distance[closer]
        return best, least


def cell_bits(entries: np.ndarray) -> int:
    """Cells about as long across as half the mean distance between entries."""
    distance = np.sqrt(((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2).astype(float))
    across = distance.sum() / max(1, len(entries) * (len(entries) - 1)) / 2 / max(1, entries.shape[1]) ** 0.5
    return max(0, int(np.log2(max(1.0, across))))


def fixed_point(width: int, scale: int):
    """Column function: vector -> its components as 64-bit whole numbers, ended by zeros up to ``width``."""

    @F.arrow_udf("binary")
    def whole(vectors: pa.Array) -> pa.Array:
        lengths = np.asarray(vectors.value_lengths().fill_null(0))
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        out = np.zeros((len(lengths), width), np.int64)
        out[np.arange(width) < lengths[:, None]] = np.clip(flat, -LIMIT, LIMIT).astype(np.int64)
        offsets = np.arange(len(lengths) + 1, dtype=np.int64) * width * 8
        return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())]).cast(pa.binary())

    return whole


def chunks(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for start in range(0, len(column), CHUNK):
        raw = column.slice(start, CHUNK).to_pylist()
        yield np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), width)


def compressed(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: Sequence[str] = (), parts: int = 8, entries: int = 16,
    rounds: int = 6, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(codes, codebooks). codes has one row per vector: row (a struct of id_col and ``keep``), code (array of ints, one per
    part) and error (long, the sum of squared distances); codebooks has an array (entry, position) of whole numbers per part.

    Rows whose vector is null or holds null, NaN or an infinity are dropped. A component x becomes floor(scale * x), held to 2**26
    on either side. Codebooks start as the vectors of the smallest ids (null ids last, equal ids by components), fewer if there
    are fewer; each round assigns every part to its nearest entry, the lower of equals, and moves each entry to the floor of its
    parts' mean; unused entries stay. Vectors shorter than the longest, or whose length the parts do not divide, count as
    ended by zeros. An empty table gives no codes and no codebooks. Repeated rows each get their code. Column names cannot clash.
    """
    vector = F.col("vector")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.struct(*dict.fromkeys([id_col, *keep])).alias("row"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = kept.filter(vector.isNotNull() & finite)
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    size = max(1, -(-longest // parts))
    width = size * parts
    table = durable(kept.select("row", "id", fixed_point(width, scale)("vector").alias("whole")))
    first = table.orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    start = np.array([np.frombuffer(r["whole"], np.int64) for r in first]).reshape(len(first), parts, size)
    books = [start[:, p, :].copy() for p in range(parts)]

    def memos() -> list[Codebook]:
        return [Codebook(book, cell_bits(book)) for book in books]

    for _ in range(rounds if first else 0):
        found = memos()

        def moved(batches: Iterator[pa.RecordBatch], found: list[Codebook] = found) -> Iterator[pa.RecordBatch]:
            # The last position counts the parts.
            sums = np.zeros((parts, len(found[0].entries), size + 1), np.int64)
            for batch in batches:
                for block in chunks(batch.column(0), width):
                    for p, book in enumerate(found):
                        own = block[:, p * size : (p + 1) * size]
                        best, _ = book.nearest(own)
                        np.add.at(sums[p], best, np.column_stack([own, np.ones(len(own), np.int64)]))
            place = np.nonzero(sums)
            columns = [pa.array(x.astype(np.int32)) for x in place] + [pa.array(sums[place])]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "value"])

        sums = table.select("whole").mapInArrow(moved, "part int, entry int, position int, value long")
        # At most parts * entries * (size + 1) rows.
        total = sums.groupBy("part", "entry", "position").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        means = {(r["part"], r["entry"], r["position"]): int(r["value"]) for r in total}
        books = [
            np.array([
                [means.get((p, e, k), 0) // means[p, e, size] for k in range(size)] if (p, e, size) in means else book[e].tolist() for e in range(len(book))
            ], np.int64).reshape(book.shape)
            for p, book in enumerate(books)
        ]

    last = memos()

    @F.arrow_udf("struct<code: array<int>, error: bigint>")
    def coded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            codes, errors = [np.zeros((0, parts), np.int32)], [np.zeros(0, np.int64)]
            for block in chunks(column, width):
                best, distance = zip(*(book.nearest(block[:, p * size : (p + 1) * size]) for p, book in enumerate(last)), strict=True)
                codes.append(np.column_stack(best).astype(np.int32))
                errors.append(np.sum(distance, axis=0))
            flat = np.concatenate(codes).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, parts, dtype=np.int32)), pa.array(flat))
            yield pa.StructArray.from_arrays([lists, pa.array(np.concatenate(errors))], names=["code", "error"])

    codes = durable(table.select("row", coded("whole").alias("found"))).select("row", "found.code", "found.error")
    return codes, books if first else []
