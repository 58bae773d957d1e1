"""Prefix index of all lines, with line tokens in order of rarity.

Rarity comes from a counter table of fixed size: every token of every line is counted, as often as it stands there, in the
counter that its hash picks.
Tokens are ordered by (counter, hash), one order for all lines; sharing a counter only makes a token look less rare, so the
result does not depend on the table's size. Only each line's prefix crosses the shuffle, as packed arrays with a bitmap of the
whole line: 96 bits, each the parity of the tokens that fall on it. Two bitmaps differ in no more bits than the sets differ in
tokens, so where a token's lines meet, length, position and bitmap tell most strangers apart. A prefix token stays only if some
other line may match by it; whole token sets are made again only for lines that keep one, and with them a sketch, which is a
bitmap of 256 bits: it tells apart what 96 bits cannot before pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import durable
from evispark.llm.hashing import blocks, mixed, shingle_runs, shingle_sets
from evispark.llm.rarity import prefix_length

COUNTERS = 1 << 20
PARTS = 16  # pieces of the counter table that are summed apart
BLOCK_BYTES = 1 << 20
_NODE_SEED = np.uint64(0x9E3779B97F4A7C15)
_SIZE_SEED = np.uint64(0xC2B2AE3D27D4EB4F)
_BIT_SEED = np.uint64(0x165667B19E3779F9)
SKETCH = ("s0", "s1", "s2", "s3")
PACKED = ("tokens", "nodes", "low", "high", "sizes", "places")


def line_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, bounds, rows): the token set of each line as in ``shingle_sets``, and where each text's lines begin."""
    lines = pc.split_pattern(texts.fill_null(""), "\n")
    rows = np.asarray(lines.offsets) - lines.offsets[0].as_py()
    tokens, bounds = shingle_sets(lines.flatten(), shingle)
    return tokens, bounds, rows


def node_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, equal for equal sets; 0 for empty ones."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    nodes = np.zeros(len(sizes), np.int64)
    if len(full):
        sums = np.add.reduceat(mixed(tokens + _NODE_SEED), bounds[full])
        nodes[full] = mixed(sums + sizes[full].astype(np.uint64) * _SIZE_SEED).view(np.int64)
    return nodes


def rarity_counters(texts: DataFrame, shingle: int) -> np.ndarray:
    """Occurrences by counter, over all lines of the column ``text``. The driver holds the sums, 8 MB at any size of input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            column = batch.column(0)
            for start, stop in blocks(column, BLOCK_BYTES):
                lines = pc.split_pattern(column.slice(start, stop - start).fill_null(""), "\n").flatten()
                runs, _ = shingle_runs(lines, shingle)
                own += np.bincount((runs % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in own.reshape(PARTS, -1)], pa.binary())], names=["part", "counts"])

    def total(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist())
        return pa.table([table["part"].slice(0, 1).cast(pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "counts"])

    parts = texts.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(total, "part int, counts binary").collect()
    whole = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for row in parts:
        whole[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return whole.ravel()


def by_rarity(item: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The order of (item, rarity, place), for items that ascend and rarities below ``COUNTERS``."""
    if not len(item):
        return np.zeros(0, np.int64)
    bits = len(item).bit_length()
    if (int(item[-1]) + 1) * COUNTERS << bits > 1 << 63:
        return np.argsort(item * COUNTERS + rarity, kind="stable")
    return np.sort((item * COUNTERS + rarity << bits) + np.arange(len(item))) & ((1 << bits) - 1)


def parities(tokens: np.ndarray, bounds: np.ndarray, bits: int) -> list[np.ndarray]:
    """Each set's bitmap of so many bits, as 64-bit words from the lowest on; 0 for empty sets."""
    full = np.flatnonzero(np.diff(bounds))
    place = ((mixed(tokens ^ _BIT_SEED) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
    bit = np.uint64(1) << (place & np.uint64(63))
    out = []
    for word in range(-(-bits // 64)):
        sums = np.zeros(len(bounds) - 1, np.uint64)
        if len(full):
            sums[full] = np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == word, bit, np.uint64(0)), bounds[full])
        out.append(sums)
    return out


def bitmaps(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower 64 and the upper 32 bits of each set's bitmap; 0 for empty sets."""
    low, high = parities(tokens, bounds, 96)
    return low, high


def may_match(start: np.ndarray, many: np.ndarray, sizes: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Of postings in runs of one token each: whether another one of the run passes the length, position and bitmap filters.

    ``start`` and ``many`` are those of a posting's run. In order of size, length and a posting's own position leave it one
    stretch of the run behind it, mostly a short one. A posting is compared with that until it has passed once, so that a run
    of copies costs little more than its length; those left are then compared with the ones before them that stopped so.
    Nothing of the size of a run's pairs is held.
    """
    found = np.zeros(len(start), bool)
    some = np.flatnonzero(many > 1)
    keys = (start[some] << 32) + sizes[some]
    by = np.argsort(keys, kind="stable")
    some, keys = some[by], keys[by]
    run, n, place, left, right = start[some] << 32, *(c[some] for c in (sizes, places, low, high))
    passed = np.zeros(len(some), bool)

    def compare(own: np.ndarray, first: np.ndarray, end: np.ndarray, others: np.ndarray) -> None:
        """Each of ``own`` with its stretch of ``others``."""
        wide = end - first
        at = np.argsort(-wide, kind="stable")  # longest stretches first, so that those still open begin the list
        step = 0
        while True:
            at = at[: np.searchsorted(-wide[at], -step)]  # stretches that have this step
            at = at[~passed[own[at]]]
            if not len(at):
                return
            begin, reach, size, mine = first[at], wide[at], n[own[at]], left[own[at]]
            for step in range(step, min(step + 16, int(reach[0]))):
                k = int(np.searchsorted(-reach, -step))
                j = others[begin[:k] + step]
                near = np.flatnonzero((100 + percent) * np.bitwise_count(mine[:k] ^ left[j]).astype(np.int64) <= (100 - percent) * (size[:k] + n[j]))
                i, j = own[at[near]], j[near]
                differ = np.bitwise_count(left[i] ^ left[j]).astype(np.int64) + np.bitwise_count(right[i] ^ right[j])
                both, room = n[i] + n[j], np.minimum(n[i] - place[i], n[j] - place[j])
                fits = ((100 + percent) * differ <= (100 - percent) * both) & ((100 + percent) * room >= percent * both)
                passed[i[fits]] = True
                passed[j[fits]] = True
            step += 1

    own = np.arange(len(some))
    most = np.minimum(100 * n // percent, ((100 + percent) * (n - place) - percent * n) // percent)
    compare(own, own + 1, np.searchsorted(keys, run + np.maximum(most, 0), side="right"), own)
    rest, stopped = np.flatnonzero(~passed), np.flatnonzero(passed)
    least = np.searchsorted(keys, (run - (-percent * n // 100))[rest])
    compare(rest, np.searchsorted(stopped, least), np.searchsorted(stopped, rest), stopped)
    found[some] = passed
    return found


def _packed5(numbers: np.ndarray) -> np.ndarray:
    """The lower five bytes of each number, as an array whose rows are the numbers."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _unpacked5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """As two bytes each where they fit, else four."""
    return numbers.astype(np.uint16 if not len(numbers) or numbers.max() < 1 << 16 else np.int32)


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    out = [_unpacked5(b"".join(table["tokens"].to_pylist()))]
    out += [np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in zip(PACKED[1:4], (np.int64, np.uint64, np.uint32), strict=True)]
    out[3] = out[3].astype(np.uint64)
    rows = [len(t) // 5 for t in table["tokens"].to_pylist()]
    for c in PACKED[4:]:
        parts = [np.frombuffer(v, np.uint16 if len(v) == 2 * k else np.int32) for v, k in zip(table[c].to_pylist(), rows, strict=True)]
        out.append(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
    return out


def _shared(table: pa.Table, *, percent: int, bins: int) -> pa.Table:
    """Of a bin: the rows of documents as they are, and the postings by which their lines may match another.

    Tokens come without their last bits; two that then look equal only let more lines meet. A line that has both keeps one.
    """
    schema = pa.schema(
        [("key", pa.binary()), ("item_nodes", pa.list_(pa.int64())), ("item_sizes", pa.list_(pa.int32())), ("token", pa.int64()), ("node", pa.int64())]
        + [("low", pa.int64()), ("high", pa.int64()), ("n", pa.int32()), ("place", pa.int32())]
    )
    heads = table.filter(pc.is_null(table["tokens"])).select(schema.names[:3])
    for field in list(schema)[3:]:
        heads = heads.append_column(field, pa.nulls(heads.num_rows, field.type))
    packed = table.filter(pc.is_valid(table["tokens"]))
    columns = _unpacked(packed)
    if packed.num_rows:
        columns[0] = columns[0] * np.uint64(bins) + np.uint64(packed["bin"][0].as_py())
    order = np.argsort(columns[0])
    same = columns[0][order][1:] == columns[0][order][:-1]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order  # tokens of one posting end here
    order = order[np.lexsort((columns[5][order], columns[1][order], columns[0][order]))]
    tokens, nodes = columns[0][order], columns[1][order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    keep = new.copy()
    keep[1:] |= nodes[1:] != nodes[:-1]
    order, starts = order[keep], np.flatnonzero(new[keep])
    tokens, nodes, low, high, sizes, places = (c[order] for c in columns)
    many = np.diff(np.r_[starts, len(tokens)])
    some = may_match(np.repeat(starts, many), np.repeat(many, many), sizes, places, low, high, percent)
    n = int(some.sum())
    found = [pa.array(c[some].view(np.int64)) for c in (tokens, nodes, low, high)] + [pa.array(c[some].astype(np.int32)) for c in (sizes, places)]
    postings = pa.Table.from_arrays([pa.nulls(n, f.type) for f in list(schema)[:3]] + found, schema=schema)
    return pa.concat_tables([heads.cast(schema), postings])


def line_index(texts: DataFrame, *, shingle: int, percent: int, bins: int = 0) -> tuple[DataFrame, DataFrame]:
    """(items, postings) of ``texts``, which has key (binary) and text.

    ``items``: each row's key with the arrays item_nodes and item_sizes, one element a line; a line without words has size
    0. ``postings``: (token, node, low, high, n, place) of the prefix tokens by which a node may match another; low and high
    are the halves of its bitmap.
    """
    bins = bins or max(64, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rarity = np.unique(rarity_counters(texts, shingle), return_inverse=True)[1].astype(np.int64)  # below COUNTERS
    names = ["bin", "key", "item_nodes", "item_sizes", *PACKED]
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), *(pa.binary() for _ in PACKED)]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()  # so that the tasks' rows of documents do not meet in one bin
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for start, stop in blocks(column, BLOCK_BYTES):
                turn += 1
                tokens, bounds, rows = line_sets(column.slice(start, stop - start), shingle)
                nodes, sizes = node_ids(tokens, bounds), np.diff(bounds)
                lists = [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(v)) for v in (nodes, sizes.astype(np.int32))]
                none = [pa.nulls(stop - start, pa.binary())] * len(PACKED)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(stop - start, turn % bins), pa.int32()), keys.slice(start, stop - start), *lists, *none], schema=schema)
                # Of equal lines in the block, the first speaks for all.
                full = np.flatnonzero(sizes)
                first = np.zeros(len(sizes), bool)
                first[full[np.unique(nodes[full], return_index=True)[1]]] = True
                item = np.repeat(np.arange(len(sizes)), sizes)
                low, high = bitmaps(tokens, bounds)
                order = by_rarity(item, rarity[(tokens % np.uint64(COUNTERS)).astype(np.int64)])
                place = np.arange(len(item)) - bounds[item]
                kept = first[item] & (place < prefix_length(sizes, percent)[item])
                item, place, tokens = item[kept], place[kept].astype(np.int32), tokens[order][kept]
                home = (tokens // np.uint64(COUNTERS) % np.uint64(bins)).astype(np.int64)
                by = np.argsort(home.astype(np.uint16) if bins <= 1 << 16 else home, kind="stable")  # two bytes sort in linear time
                cuts = np.searchsorted(home[by], np.arange(bins + 1))
                brief = _packed5(tokens // np.uint64(COUNTERS) // np.uint64(bins))
                packed = [v[by] for v in (brief, nodes[item], low[item], high[item].astype(np.uint32), _narrow(sizes[item]), _narrow(place))]
                used = [b for b in range(bins) if cuts[b] < cuts[b + 1]]
                columns = [pa.array([v[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()) for v in packed]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.nulls(len(used), k) for k in kinds[1:4]), *columns], schema=schema)

    arrays = "item_nodes array<long>, item_sizes array<int>"
    packed = texts.select("key", "text").mapInArrow(prefixes, f"bin int, key binary, {arrays}, " + ", ".join(f"{c} binary" for c in PACKED))
    fields = f"key binary, {arrays}, token long, node long, low long, high long, n int, place int"

    def shared(table: pa.Table) -> pa.Table:
        return _shared(table, percent=percent, bins=bins)

    reduced = durable(packed.groupBy("bin").applyInArrow(shared, fields), release=True)
    items = reduced.filter(F.col("token").isNull()).select("key", "item_nodes", "item_sizes")
    return items, reduced.filter(F.col("token").isNotNull()).select("token", "node", "low", "high", "n", "place")


def squeezed(texts: DataFrame) -> DataFrame:
    """``texts``, whose second column is text, with a column packed in its place: compressed for the way through a shuffle."""
    names = ["packed" if c == "text" else c for c in texts.columns]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            column = batch.column(1)
            bodies = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
            packed = [None if b is None else len(b).to_bytes(8, "little") + codec.compress(b, asbytes=True) for b in bodies]
            columns = [pa.array(packed, pa.binary()) if k == 1 else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ["binary" if c == "text" else texts.schema[c].dataType.simpleString() for c in texts.columns]
    return texts.mapInArrow(squeeze, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def unsqueezed(column: pa.Array) -> list[bytes | None]:
    """The texts in UTF-8."""
    codec = pa.Codec("zstd")
    return [None if p is None else codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True) for p in column.to_pylist()]


def token_sets(texts: DataFrame, wanted: DataFrame, *, shingle: int) -> DataFrame:
    """(node, n, tokens, and the words of the sketch) of the lines that ``wanted`` (key, lines: array of struct<_line, node>)
    names in ``texts``; a node twice where a key is."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array(unsqueezed(batch.column(0)), pa.large_string())
            for start, stop in blocks(column, BLOCK_BYTES):
                tokens, bounds, rows = line_sets(column.slice(start, stop - start), shingle)
                asked = batch.column(1).slice(start, stop - start)
                flat = asked.flatten()
                at = rows[:-1][np.asarray(pc.list_parent_indices(asked))] + np.asarray(flat.field("_line"))
                lists = pa.array([tokens[bounds[i] : bounds[i + 1]].view(np.int64) for i in at], pa.list_(pa.int64()))
                sketch = [pa.array(words[at].view(np.int64)) for words in parities(tokens, bounds, 64 * len(SKETCH))]
                yield pa.RecordBatch.from_arrays([flat.field("node"), pa.array(np.diff(bounds)[at], pa.int32()), lists, *sketch], names=["node", "n", "tokens", *SKETCH])

    once = squeezed(texts.select("key", "text")).join(wanted, "key").dropDuplicates(["key"])
    return once.select("packed", "lines").mapInArrow(sets, "node long, n int, tokens array<long>, " + ", ".join(f"{c} long" for c in SKETCH))
