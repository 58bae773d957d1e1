"""Word and shingle hashes of whole Arrow string columns, without a Python object per word.

A word is read as numbers of eight bytes; its hash is the mixed sum of these, each mixed with its place, and of the
word's length. A shingle's hash is a multilinear sum over its words, mixed. All sums are modulo 2**64. Equal words always
hash alike; two different ones do so with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
_STEP = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _LENGTH = (_RANDOM.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
_LOWER = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the lower k bytes of a number


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the column, and where each text begins and ends in them (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def word_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, where each text's words begin in that list (one more than texts), and each word's first byte,
    counted from the beginning of the column."""
    data, bounds = string_buffers(texts)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), np.zeros(0, np.int64)
    word = ~((data == 0x20) | (data - np.uint8(0x09) <= 0x0D - 0x09))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begin, end = bounds[:-1][bounds[:-1] < len(data)], bounds[1:][bounds[1:] > 0] - 1
    first[begin], last[end] = word[begin], word[end]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), starts
    sizes = np.flatnonzero(last) + 1 - starts
    lowered = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    lowered[: len(data)] = data | ((data - np.uint8(ord("A")) <= ord("Z") - ord("A")).view(np.uint8) << 5)
    eights = lowered.view("<u8")

    def read(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes from ``at``, eight at most, as a number."""
        shift = (at & 7).astype(np.uint64) * np.uint64(8)
        there = at >> 3
        both = (eights[there] >> shift) | (eights[there + 1] << np.uint64(1) << (np.uint64(63) - shift))
        return both & _LOWER[np.minimum(size, 8)]

    sums = mixed(read(starts, sizes))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8  # numbers after the first
        ends = np.cumsum(more)
        place = np.arange(ends[-1]) - np.repeat(ends - more, more) + 1
        rest = read(np.repeat(starts[long], more) + 8 * place, np.repeat(sizes[long], more) - 8 * place)
        sums[long] += np.add.reduceat(mixed(rest + place.astype(np.uint64) * np.uint64(_PLACE)), ends - more)
    return mixed(sums + sizes.astype(np.uint64) * np.uint64(_LENGTH)), np.searchsorted(starts, bounds), starts


def blocks(texts: pa.Array | pa.ChunkedArray, max_bytes: int, max_rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text each; a longer text makes a range of its own."""
    _, bounds = string_buffers(texts)
    start = 0
    while start < len(bounds) - 1:
        stop = int(np.searchsorted(bounds, bounds[start] + max_bytes, "right")) - 1
        stop = min(max(stop, start + 1), start + max_rows, len(bounds) - 1)
        yield start, stop
        start = stop


def shingle_runs(texts: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(runs, item): hashes of all ``size``-word shingles, repeated ones included, and the number of each one's text.

    A text of fewer words makes one shingle of them all, a text without words none.
    """
    words, bounds, _ = word_hashes(texts)
    n = max(0, len(words) - size + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(size):
        runs += words[k : k + n] * _STEP[k]
    runs = mixed(runs)
    counts = np.diff(bounds)
    own = np.maximum(counts - size + 1, 0)
    item = np.repeat(np.arange(len(counts)), own)
    if size > 1:  # those that lie within a text
        runs = runs[np.arange(len(item)) + np.repeat(bounds[:-1] - (np.cumsum(own) - own), own)]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sums = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            sums[has] += words[bounds[short[has]] + k] * _STEP[k]
        item = np.concatenate([item, short])
        runs = np.concatenate([runs, mixed(sums + _STEP[size + counts[short]])])
    return runs, item


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as in ``shingle_runs``: their hashes, sorted within a text, and where each text's
    begin (one more than texts)."""
    runs, item = shingle_runs(texts, size)
    # Sorted by one number, the text's above the upper bits of the hash. Should that leave two hashes of a text tied, by both.
    bits = np.uint64(max(1, len(texts).bit_length()))
    both = (item.astype(np.uint64) << (np.uint64(64) - bits)) | (runs >> bits)
    order = np.argsort(both)
    both, sorted_ = both[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    tied = both[1:] == both[:-1]
    if (tied & new[1:]).any():
        order = np.lexsort((runs, item))
        sorted_ = runs[order]
        new[1:] = sorted_[1:] != sorted_[:-1]
    item = item[order]
    new[1:] |= item[1:] != item[:-1]
    return sorted_[new], np.searchsorted(item[new], np.arange(len(texts) + 1))
