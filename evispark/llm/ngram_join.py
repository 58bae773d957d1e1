"""N-gram Jaccard join: documents whose word-shingle sets are alike, found by prefixes under several global orders.

Under any total order of all shingles, two sets with enough in common share a shingle in their prefixes. Candidates come
from the prefixes in order of rarity; before the sets themselves are compared, they must also share a prefix shingle under
two more orders. Three things keep groups of copies from becoming all their pairs: equal sets are one node; each node is
first compared with the most typical node of its most common prefix shingle; after that only pairs of nodes that no chain of
found links joins yet are compared. So the links returned are enough for the components, not all links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import durable
from evispark.llm.graph import components
from evispark.llm.pairs import with_sets
from evispark.llm.rarity import rarity_index


def alike(common: Column, n: Column, m: Column, percent: int) -> Column:
    """Jaccard similarity of at least ``percent`` / 100, in whole numbers."""
    return 100 * common >= percent * (n + m - common)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) node pairs those that pass the second and third order and then the exact comparison."""
    both = with_sets(pairs, nodes.select("node", "n", "tokens", "second", "third"))
    likely = F.arrays_overlap("x_second", "y_second") & F.arrays_overlap("x_third", "y_third")
    common = F.when(likely, F.size(F.array_intersect("x_tokens", "y_tokens"))).otherwise(0)
    return both.withColumn("common", common).filter(alike(F.col("common"), F.col("x_n"), F.col("y_n"), percent)).select("a", "b")


def postings(nodes: DataFrame) -> DataFrame:
    """(token, node, n, unique, place): each shared shingle of a node's prefix, with its place among all the node's."""
    return nodes.select(
        "node", "n", F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("place", "token"), "unique"
    ).select("token", "node", "n", "unique", (F.col("place") + F.col("unique")).alias("place"))


def first_links(index: DataFrame) -> DataFrame:
    """(a, b): each node with the head of the most common shingle in its prefix, the node with the fewest shingles of its
    own: among edited copies that is the original or what is closest to it."""
    heads = durable(
        index.groupBy("token").agg(F.min(F.struct("unique", "node")).alias("head"), F.count("*").alias("many"))
        .filter("many > 1").select("token", "many", F.col("head.node").alias("head"))
    )
    best = index.join(heads, "token").groupBy("node").agg(F.max(F.struct("many", "head")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.head").alias("b")).filter("a <> b")


def fits(percent: int) -> Column:
    """Length and position filters of two postings x and y of the same shingle."""
    n, m = F.col("x.n"), F.col("y.n")
    room = F.least(n - F.col("x.place"), m - F.col("y.place"))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * room >= percent * (n + m))


def unjoined_pairs(index: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b) that share a prefix shingle, pass length and position filters and are in different components so far.

    Of each shingle's postings, those outside its most common component meet all others; those inside do not meet.
    """
    known = durable(
        index.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    most = (
        known.groupBy("token", "component").agg(F.count("*").alias("many"))
        .groupBy("token").agg(F.max(F.struct("many", "component")).alias("most"), F.count("*").alias("parts"))
        .filter("parts > 1").select("token", F.col("most.component").alias("most"))
    )
    mixed = durable(known.join(most, "token"))
    outside = mixed.filter("component <> most")
    pair = (F.col("x.component") != F.col("y.component")) & (
        (F.col("y.component") == F.col("y.most")) | (F.col("x.node") < F.col("y.node"))
    )
    met = outside.alias("x").join(mixed.alias("y"), (F.col("x.token") == F.col("y.token")) & pair & fits(percent))
    return met.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    ).distinct()


def node_components(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) of a rarity index: (a, b) and (node, component)."""
    index = durable(postings(nodes))
    links = durable(verified(first_links(index), nodes, percent))
    labels = components(links)
    rest = durable(verified(unjoined_pairs(index, labels, percent), nodes, percent))
    links = links.union(rest)
    named = rest.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left"
    )
    merged = components(
        named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        .union(labels.select(F.col("node"), F.col("component")))
    )
    return links, merged


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: id_col, n_shingles (long) and component_id (long).

    Words are runs without ASCII blanks, A-Z lower-cased; a document's set is its distinct ``shingle``-word shingles, or
    all its words as one if they are fewer. Two documents link when their sets' Jaccard similarity reaches
    ``percent`` / 100. component_id is the smallest id that links reach, itself included.

    Null, empty and blank texts have no shingles and link with nothing, not even with each other. Repeated rows give
    repeated results. A null id stays null; its row links like any other and has the smallest id among its component's
    known ones. An empty table gives an empty result; other columns are not looked at. Shingles are told apart by 64-bit
    hashes.
    """
    keyed = docs.select(
        F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8").alias("key"), F.col(text_col).alias("text")
    )
    items, nodes = rarity_index(keyed, "key", "text", shingle=shingle, percent=percent)
    kind = docs.schema[id_col].dataType
    rows = items.select(
        F.when(F.length("key") > 0, F.decode("key", "utf-8")).cast(kind).alias("_id"),
        F.col("item_nodes")[0].alias("_node"),
        F.col("item_sizes")[0].cast("long").alias("n_shingles"),
    )
    _, labels = node_components(nodes, percent)
    least = rows.filter("n_shingles > 0").groupBy("_node").agg(F.min("_id").alias("_least"))
    linked = durable(least.join(labels, F.col("_node") == F.col("node")).select("_node", "component", "_least"))
    reach = linked.groupBy("component").agg(F.min("_least").alias("_reach"))
    apart = least.join(linked.select("_node"), "_node", "left_anti").select("_node", F.col("_least").alias("_reach"))
    classes = durable(linked.join(reach, "component").select("_node", "_reach").union(apart))
    return (
        rows.withColumn("_node", F.when(F.col("n_shingles") > 0, F.col("_node")))
        .join(classes, "_node", "left")
        .select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("_reach", "_id").cast("long").alias("component_id"))
    )
