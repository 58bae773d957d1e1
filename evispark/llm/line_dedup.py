"""Line dedup: an exact set-similarity join of all lines, after which the later of two alike lines goes.

A line's tokens are its distinct words (or shingles of more words, by parameter). Tokens are ordered by rarity over all
lines; two lines meet by a token that both have in their prefix (the first quarter for 75 percent), and length, position,
bitmap and sketch filters go before the exact comparison. Lines with equal sets are one node with many occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evispark.llm.durable import durable
from evispark.llm.line_index import SKETCH, line_index, squeezed, token_sets, unsqueezed
from evispark.llm.ngram_join import alike
from evispark.llm.pairs import with_sets

_ORDER = ("_doc", "_line")


def _differ(x: str, y: str) -> Column:
    """Of how many bits the sketches differ; the token sets differ in as many tokens at least."""
    return sum(F.bit_count(F.col(f"{x}{word}").bitwiseXOR(F.col(f"{y}{word}"))) for word in SKETCH)


def _compared(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of (later, earlier) node pairs, those alike."""
    both = with_sets(pairs.select(F.col("later").alias("a"), F.col("earlier").alias("b")), nodes.select("node", "n", "tokens"))
    common = F.size(F.array_intersect("x_tokens", "y_tokens"))
    alike_ = both.withColumn("common", common).filter(alike(F.col("common"), F.col("x_n"), F.col("y_n"), percent))
    return alike_.select(F.col("a").alias("later"), F.col("b").alias("earlier"))


def later_matches(index: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(later, earlier): for each node that is alike to a node with an earlier first occurrence, one or more such nodes.

    ``index`` has token, node, n, place, first, many, which is the node's number of rows, and the words of its sketch. Of each
    of its prefix tokens a node is told three earlier nodes: the very first, the one before it, and the one with the fewest
    prefix tokens of its own, which among edited copies is the original or what is closest to it. The node first meets that of
    them whose sketch is nearest to its own; a node without a match there meets all of them, and only one without a match there
    too meets all earlier nodes that pass the filters. So the first two rounds compare no more than three pairs a posting, and
    a group of copies is not compared with itself.
    """
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = index.withColumn("own", prefix - F.col("many"))
    order = W.partitionBy("token").orderBy("first", "node")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    who = F.struct("own", "node", "n", *SKETCH)
    told = ranked.select("node", "n", *SKETCH, F.array(F.min(who).over(before), F.first(who).over(before), F.lag(who).over(order)).alias("told"))
    told = told.select(*(F.col(c).alias(f"x_{c}") for c in ("node", "n", *SKETCH)), F.explode("told").alias("y")).filter("y IS NOT NULL")
    n, m, differ = F.col("x_n"), F.col("y.n"), _differ("x_", "y.")
    near = told.filter((100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * differ <= (100 - percent) * (n + m)))
    near = near.select(F.col("x_node").alias("later"), F.col("y.node").alias("earlier"), (differ / (n + m)).alias("apart"))
    near = durable(near.distinct(), release=True)
    nearest = near.groupBy("later").agg(F.min(F.struct("apart", "earlier"))["earlier"].alias("earlier"))
    first = durable(_compared(nearest, nodes, percent), release=True)
    more = near.join(first.select("later").distinct(), "later", "left_anti").select("later", "earlier")
    found = first.union(durable(_compared(more, nodes, percent), release=True))
    open_ = index.join(found.select(F.col("later").alias("node")).distinct(), "node", "left_anti")
    return found.union(_compared(_meetings(open_, index, percent).distinct(), nodes, percent))


def _meetings(some: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """(later, earlier): nodes of ``some`` with all earlier ones that share a prefix token and pass the filters."""
    n, m, p, q = F.col("x.n"), F.col("y.n"), F.col("x.place"), F.col("y.place")
    differ = _differ("x.", "y.")
    # The position filter leaves no more than the first seventh of the shorter line (for 75 percent).
    fits = (
        (F.col("y.first") < F.col("x.first"))
        & (100 * n >= percent * m) & (100 * m >= percent * n)
        & ((100 + percent) * F.least(n - p, m - q) >= percent * (n + m))
        & ((100 + percent) * differ <= (100 - percent) * (n + m))
    )
    met = some.alias("x").join(index.alias("y"), (F.col("x.token") == F.col("y.token")) & fits)
    return met.select(F.col("x.node").alias("later"), F.col("y.node").alias("earlier"))


def _key(id_col: str, text_col: str) -> Column:
    """MD5 of the text, then "v" and the id; nothing for a null id."""
    name = F.when(F.col(id_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("v"), F.col(id_col).cast("string")))
    return F.encode(F.concat(F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")), name), "utf-8")


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 1, percent: int = 75) -> DataFrame:
    """(_key, n_lines, removed): of each document its key, its number of lines and the numbers (from 0) of those to remove."""
    keyed = docs.select(_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items, postings = line_index(keyed, shingle=shingle, percent=percent)
    key = F.decode("key", "utf-8")
    # Rows that repeat both id and text are one document. Numbered in order, so that lines carry a number, not texts.
    name = F.when(F.length(key) > 32, F.substring(key, 34, 1 << 30)).cast(docs.schema[id_col].dataType)
    lines = durable(
        items.dropDuplicates(["key"]).orderBy(name, F.substring(key, 1, 32)).withColumn("_doc", F.monotonically_increasing_id()),
        release=True,
    )
    each = (
        lines.select("key", "_doc", F.posexplode(F.arrays_zip("item_nodes", "item_sizes")).alias("_line", "item"))
        .filter("item.item_sizes > 0").select("_doc", "_line", F.col("item.item_nodes").alias("node"))
    )
    firsts = durable(each.groupBy("node").agg(F.min(F.struct(*_ORDER)).alias("first"), F.count("*").alias("many")), release=True)
    counted = postings.drop("low", "high").join(firsts.select("node", "first"), "node").withColumn("many", F.count("*").over(W.partitionBy("node")))
    index = durable(counted, release=True)
    # The sets are made of each node's first occurrence; a document names no more lines than it has.
    held = index.select("node", "first").dropDuplicates(["node"])
    asked = held.groupBy(F.col("first._doc").alias("_doc")).agg(F.collect_list(F.struct(F.col("first._line").alias("_line"), "node")).alias("lines"))
    wanted = lines.select("key", "_doc").join(asked, "_doc").select("key", "lines")
    nodes = durable(token_sets(keyed, wanted, shingle=shingle), release=True)
    # The sketch has the place of the bitmap, which cannot tell lines of some hundred words apart.
    index = durable(index.join(nodes.select("node", *SKETCH), "node"), release=True)
    gone = later_matches(index, nodes, percent).select(F.col("later").alias("node")).distinct()
    marked = durable(
        firsts.join(gone.withColumn("gone", F.lit(True)), "node", "left")
        .filter("gone OR many > 1")
        .select("node", F.when(F.col("gone").isNull(), F.col("first")).alias("stays")),
        release=True,
    )
    doomed = each.join(marked, "node").filter(~F.struct(*_ORDER).eqNullSafe(F.col("stays")))
    out = doomed.groupBy("_doc").agg(F.array_sort(F.collect_list("_line")).alias("removed"))
    none = F.array().cast("array<int>")
    return lines.join(out, "_doc", "left").select(
        F.col("key").alias("_key"), F.size("item_nodes").alias("n_lines"), F.coalesce("removed", none).alias("removed")
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 1, percent: int = 75) -> DataFrame:
    """The documents, all columns kept, without their lines that match an earlier one; adds n_lines and n_removed (long).

    Lines end at line feeds; words are runs without ASCII blanks, A-Z lower-cased. Two lines match when the Jaccard
    similarity of their sets of distinct words (runs of ``shingle`` words; a line of fewer is one run) reaches
    ``percent`` / 100. Lines are in order of (id, MD5 of the text, line number), null ids first; a line goes if an earlier line
    matches it, whether or not that one stays itself. Lines without words always stay.

    A null or empty text stays as it is. Rows that repeat id and text are one document and get the same result. A text
    of which all lines go becomes empty. An empty table gives an empty one. Columns of ``docs`` may have any names but
    n_lines and n_removed, which are replaced.
    """
    removed = removed_lines(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rest = F.struct(*(F.col(c) for c in names if c != text_col)).alias("rest")
    packed = squeezed(docs.select(_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"), rest))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unsqueezed(batch.column(1))
            gone = batch.column(3).to_pylist()
            for i, numbers in enumerate(gone):
                if numbers and texts[i] is not None:
                    out = set(numbers)
                    texts[i] = b"\n".join(line for k, line in enumerate(texts[i].split(b"\n")) if k not in out)
            count = [0 if t is None else n for t, n in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array([len(g) for g in gone], pa.int64())], names=["rest", "text", "n_lines", "n_removed"]
            )

    joined = packed.join(removed, F.col("key") == F.col("_key")).select("rest", "packed", "n_lines", "removed")
    kind = packed.schema["rest"].dataType.simpleString()
    left = joined.mapInArrow(cut, f"rest {kind}, text string, n_lines long, n_removed long")
    columns = [F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in names]
    return left.select(*columns, "n_lines", "n_removed")
