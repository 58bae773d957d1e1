"""Embedding near-dedup: an exact metric range join of unit vectors.

Cosine of at least t is a distance of at most r = sqrt(2 - 2t) between unit vectors. Pivots, taken from a bounded sample,
cut the vectors into cells by nearest pivot. A vector is also sent to each other cell that could hold a partner: by the
triangle inequality its distance to that pivot is at most the cell's radius plus r, and its distance to the border between
the two pivots at most r. Cells, cut into bounded blocks, are joined independently by matrix products in double precision.
Pivots change the cost, never the result: where no pivot separates anything, all vectors meet all others, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import durable
from evispark.llm.graph import components

SAMPLE = 2048  # vectors that pivots are chosen from
MAX_PIVOTS = 256
FEW_PIVOTS = 16  # of tables that one cell could hold, or fewer: the square root of their vectors
CELL_ROWS = 4096  # vectors a cell should hold; also the most rows of a block
BLOCK_COLUMNS = 16384
CHUNK = 512  # rows of a matrix product
SLACK = 1e-9  # of rounding, in the bounds


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest first: each pivot is the sample's vector farthest from those before it."""
    chosen, nearest = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < k and nearest.max() > 1e-6:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _pivots(vectors: DataFrame, n: int, few: int) -> dict[int, np.ndarray]:
    """Of each vector length, the pivots: one for each CELL_ROWS vectors, but at least the square root of ``n`` or ``few``,
    whichever is less. Vectors are sampled by the order of their hash; a length that the sample misses has one cell."""
    k = min(MAX_PIVOTS, max(min(few, math.ceil(math.sqrt(n))), math.ceil(n / CELL_ROWS)))
    sample = vectors.orderBy("node").limit(SAMPLE).select("vec").toArrow()["vec"].to_pylist() if k > 1 else []
    return {
        d: choose_pivots(unit_rows(pa.array([v for v in sample if len(v) == d])), k) for d in {len(v) for v in sample}
    }


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.asarray(batch.column("vec").value_lengths())
    for d in np.unique(sizes):
        yield int(d), batch.filter(pa.array(sizes == d))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def _joined(table: pa.Table, cosine: float) -> pa.Table:
    """Of a block: (a, null, many) the vectors linked with row a, and (a, b, 0) links enough to connect all linked."""
    is_row = table["is_row"].to_numpy()
    rows, cols = table.filter(pa.array(is_row)), table.filter(pa.array(~is_row))
    a, b, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if rows.num_rows and cols.num_rows:
        x, y = unit_rows(rows["vec"]), unit_rows(cols["vec"])
        x_id, y_id, weight = rows["node"].to_numpy(), cols["node"].to_numpy(), cols["many"].to_numpy()
        ids, local = np.unique(np.r_[x_id, y_id], return_inverse=True)
        row_at, col_at = local[: len(x_id)], local[len(x_id) :]
        label = np.arange(len(ids))
        for start in range(0, len(x), CHUNK):
            near = x[start : start + CHUNK] @ y.T >= cosine
            near &= x_id[start : start + CHUNK, None] != y_id[None, :]
            linked = near @ weight
            some = np.flatnonzero(linked)
            a.append(x_id[start + some])
            b.append(np.full(len(some), -1))
            many.append(linked[some])
            for i in some.tolist():
                found = np.unique(np.r_[label[row_at[start + i]], label[col_at[near[i]]]])
                if len(found) > 1:
                    a.append(ids[found[1:]])
                    b.append(np.full(len(found) - 1, ids[found[0]]))
                    many.append(np.zeros(len(found) - 1, np.int64))
                    label[np.isin(label, found[1:])] = found[0]
    a, b, many = np.concatenate(a), np.concatenate(b), np.concatenate(many).astype(np.int64)
    return pa.table([pa.array(a), pa.array(b, mask=many > 0), pa.array(many)], names=["a", "b", "many"])


def range_join(vectors: DataFrame, *, cosine: float, few_pivots: int = FEW_PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Of (node, vec, many): (node, n_links), where a link with a node counts ``many`` times, and (a, b) links that are
    enough to connect whatever is linked."""
    n = vectors.count()
    pivots = _pivots(vectors, n, few_pivots)
    r = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_length(batch):
                near = _distances(unit_rows(part.column("vec")), pivots[d]) if d in pivots else np.zeros((part.num_rows, 1))
                home = near.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(home), d), pa.int32()), pa.array(home, pa.int32()), pa.array(near[np.arange(len(home)), home])], names=["dims", "cell", "away"]
                )

    # At most one row for each cell.
    stats = vectors.mapInArrow(homes, "dims int, cell int, away double").groupBy("dims", "cell").agg(F.max("away").alias("radius")).collect()
    radius = {(s["dims"], s["cell"]): s["radius"] for s in stats}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_length(batch):
                if d in pivots:
                    p = pivots[d]
                    near = _distances(unit_rows(part.column("vec")), p)
                    home = near.argmin(axis=1)
                    apart = np.maximum(_distances(p, p), 1e-12)[home]
                    own = near[np.arange(len(home)), home][:, None]
                    border = (near**2 - own**2) / (2 * apart)
                    reach = np.array([radius.get((d, j), -np.inf) for j in range(len(p))])
                    sent = (border <= r) & (near <= reach[None, :] + r)
                    sent[np.arange(len(home)), home] = True
                else:
                    sent, home = np.ones((part.num_rows, 1), bool), np.zeros(part.num_rows, np.int64)
                which, cell = np.nonzero(sent)
                taken = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(which), d), pa.int32()), pa.array(cell, pa.int32()), pa.array(cell == home[which]), *(taken.column(c) for c in ("node", "vec", "many"))],
                    names=["dims", "cell", "home", "node", "vec", "many"],
                )

    kind = vectors.schema["vec"].dataType.simpleString()
    dealt = durable(vectors.mapInArrow(cells, f"dims int, cell int, home boolean, node long, vec {kind}, many long"))
    sizes = dealt.groupBy("dims", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("members"))
    sizes = sizes.select(
        "dims", "cell", F.ceil(F.col("homes") / CELL_ROWS).alias("cuts"), F.ceil(F.col("members") / BLOCK_COLUMNS).alias("parts")
    )
    cut = dealt.join(F.broadcast(sizes), ["dims", "cell"])  # one row for each cell
    own = cut.filter("home").select(
        "dims", "cell", F.pmod(F.xxhash64("node"), "cuts").alias("cut"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.lit(True).alias("is_row"), "node", "vec", "many",
    )
    other = cut.filter("cuts > 0").select(
        "dims", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), F.pmod(F.xxhash64(F.lit(1), F.col("node")), "parts").alias("part"),
        F.lit(False).alias("is_row"), "node", "vec", "many",
    )

    def joined(table: pa.Table) -> pa.Table:
        return _joined(table, cosine)

    found = durable(own.union(other).groupBy("dims", "cell", "cut", "part").applyInArrow(joined, "a long, b long, many long"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("many").alias("n_links"))
    return counts, found.filter("b IS NOT NULL").select("a", "b")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, few_pivots: int = FEW_PIVOTS) -> DataFrame:
    """One row per vector: id_col, n_links (long: other vectors linked directly), component_id (long: the smallest id that
    links reach, itself included) and kept (id_col = component_id).

    Two vectors link when their cosine in double precision is at least ``cosine``. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, and so do vectors of different lengths with each other. Equal
    vectors are joined once and count as often as they occur. A null id stays null and is never the smallest; repeated rows
    count as so many vectors. An empty table gives an empty result; other columns are not looked at. Equal vectors are
    recognised by a 64-bit hash. ``few_pivots`` is the least number of pivots, where the square root of the distinct vectors
    is not less; it changes the cost only.
    """
    v = F.col(vec_col)
    good = (
        v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    )
    rows = vectors.select(F.col(id_col).alias("_id"), F.when(good, F.xxhash64(v)).alias("node"), F.when(good, v).alias("vec"))
    classes = durable(
        rows.filter("node IS NOT NULL").groupBy("node")
        .agg(F.first("vec").alias("vec"), F.count("*").alias("many"), F.min("_id").alias("least"))
    )
    counts, links = range_join(classes.select("node", "vec", "many"), cosine=cosine, few_pivots=few_pivots)
    labels = components(links)
    known = durable(
        classes.select("node", "many", "least").join(counts, "node", "left").join(labels, "node", "left")
        .select("node", "least", (F.col("many") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    reach = known.groupBy("component").agg(F.min("least").alias("reach"))
    classed = durable(known.join(reach, "component").select("node", "n_links", "reach"))
    out = rows.select("_id", "node").join(classed, "node", "left")
    component = F.coalesce("reach", "_id").cast("long")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("_id") == component).alias("kept")
    )
