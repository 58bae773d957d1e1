"""Secret scan with corpus-wide ownership frequency.

Patterns find candidates in each text. The value of each candidate is hashed, and the hashes are counted over the whole
corpus by distinct repository and owner, copies of one text once: a value that several owners hold, or too many repositories
of one owner, is a copied example; any other that looks random is reported as a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import durable
from evispark.llm.ngram_join import ngram_jaccard_join

# The base patterns, their shortest matches, and their order. Only the names are free in case, and only in
# ASCII.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_FREE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in _NAMES)
ASSIGN = re.compile(rf"""({_FREE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # as runs are maximal, the same as runs of any length without the short ones
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "live")
_HINTS = ("passw", "secret", "token", "api")


def candidates(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) of all base matches, in code points."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def looks_random(value: str, least_bits: float = 2.75) -> bool:
    """Letters and digits of enough entropy in bits a character; words, repeats and counting up stay below or step too evenly."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    steps = Counter(ord(b) - ord(a) for a, b in zip(value, value[1:], strict=False))
    return bits >= least_bits and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and steps.most_common(1)[0][1] < n / 2


def _copies(rows: DataFrame, held: DataFrame, percent: int) -> DataFrame | None:
    """(_text, copy): of texts that share a value with another text, the group of near copies; None if there are no such."""
    shared = held.groupBy("value").agg(F.min("_text").alias("a"), F.max("_text").alias("b")).filter("a < b")
    asked = durable(held.select("value", "_text").distinct().join(shared, "value", "left_semi").select("_text").distinct())
    if asked.isEmpty():
        return None

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [zlib.decompress(t).decode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_text", "text"])

    texts = rows.filter("_text IS NOT NULL").select("_text", "packed").dropDuplicates(["_text"]).join(asked, "_text", "left_semi")
    alike = ngram_jaccard_join(durable(texts).mapInArrow(unpack, "_text long, text string"), id_col="_text", text_col="text", percent=percent)
    return alike.select("_text", F.col("component_id").alias("copy"))


def _ownership(rows: DataFrame, each: DataFrame, percent: int) -> DataFrame:
    """(value, n_owners, n_repos): how many owners hold a value, and how many repositories of the one with the most.

    A group of copies counts for one owner, of those that have it the one with most of the value's groups, and there for one
    repository, chosen alike; of equal ones for the smallest. So a value has one owner if any owner has all its groups.
    """
    held = durable(each.select("value", "_owner", "_repo", "_text").distinct())
    copies = _copies(rows, held, percent)
    group = F.col("_text")
    if copies is not None:
        held, group = held.join(copies, "_text", "left"), F.coalesce("copy", "_text")
    held = durable(held.select("value", "_owner", "_repo", group.alias("_copy")).distinct())
    owners = held.select("value", "_owner", "_copy").distinct().groupBy("value", "_owner").agg(F.count("*").alias("by_owner"))
    repos = held.groupBy("value", "_owner", "_repo").agg(F.count("*").alias("by_repo"))
    ranked = held.join(owners, ["value", "_owner"]).join(repos, ["value", "_owner", "_repo"])
    place = F.struct(-F.col("by_owner"), "_owner", -F.col("by_repo"), "_repo")
    given = ranked.groupBy("value", "_copy").agg(F.min(place).alias("place")).select("value", "place._owner", "place._repo")
    # Repositories are counted for each owner, then owners: no task sees a value's rows.
    counted = given.distinct().groupBy("value", "_owner").agg(F.count("*").alias("repos"))
    return durable(counted.groupBy("value").agg(F.count("*").alias("n_owners"), F.max("repos").alias("n_repos")))


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_live_owners: int = 1, max_live_repos: int = 3, copy_percent: int = 75
) -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex (long), base_spans, live_spans and examples, each an array
    of struct<kind, start, end>, by start and then kind, in code points with the end exclusive.

    live_spans are the values that look random and that at most ``max_live_owners`` owners hold, each in at most
    ``max_live_repos`` repositories; examples are the spans of values that more owners or repositories hold. A repository
    belongs to its owner: equal names of different owners are different. Equal texts, and texts that ``ngram_jaccard_join``
    links at ``copy_percent``, count once, for one repository of one owner: copying a document makes its key no example.
    Where a value has several matches in a text, its span is given once.

    Null and empty texts have no spans. A null repository or owner counts as one of its own kind. Repeated rows give
    repeated results and count once for ownership. An empty table gives an empty result; other columns are not looked at.
    Whole texts are scanned, each in one task; only texts that share a value with a different text are compared.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("from", pa.int32()), ("to", pa.int32()), ("random", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests, packed = [], [], []
            for text in batch.column(3).to_pylist():
                text = text or ""
                rows.append(
                    [
                        {"kind": k, "start": a, "end": b, "value": hashlib.sha256(text[c:d].encode()).hexdigest(), "from": c, "to": d, "random": looks_random(text[c:d])}
                        for k, a, b, c, d in candidates(text)
                    ]
                )
                body = text.encode() if rows[-1] else None
                digests.append(body and int.from_bytes(hashlib.sha256(body).digest()[:8], "big", signed=True))
                packed.append(body and zlib.compress(body, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.list_(span)), pa.array(digests, pa.int64()), pa.array(packed, pa.binary())], names=["_id", "_repo", "_owner", "spans", "_text", "packed"]
            )

    def name(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit(""))

    texts = docs.select(F.col(id_col).alias("_id"), name(repo_col).alias("_repo"), name(owner_col).alias("_owner"), F.col(text_col).alias("_text"))
    fields = "array<struct<kind:string,start:int,end:int,value:string,`from`:int,`to`:int,random:boolean>>"
    rows = durable(
        texts.mapInArrow(scan, f"_id {kind}, _repo string, _owner string, spans {fields}, _text long, packed binary").withColumn("_row", F.monotonically_increasing_id())
    )
    each = rows.select("_row", "_repo", "_owner", "_text", F.explode("spans").alias("s")).select("_row", "_repo", "_owner", "_text", "s.*")
    judged = each.join(_ownership(rows, each, copy_percent), "value")
    copied = (F.col("n_owners") > max_live_owners) | (F.col("n_repos") > max_live_repos)
    live = F.when(F.col("random") & ~copied, F.struct(F.col("from").alias("start"), F.col("to").alias("end")))
    shown = F.when(copied, F.struct("start", "end", "kind"))
    marks = judged.groupBy("_row").agg(F.array_sort(F.collect_set(live)).alias("live"), F.array_sort(F.collect_set(shown)).alias("shown"))
    out = rows.drop("packed").join(marks, "_row", "left")
    kinds = F.transform("spans", lambda s: s["kind"])

    def count(name: str):
        return F.size(F.filter(kinds, lambda k: k == name)).cast("long").alias(f"n_{name}")

    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return out.select(
        F.col("_id").alias(id_col), count("assign"), count("access"), count("hex"),
        F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base_spans"),
        F.coalesce(F.transform("live", lambda s: F.struct(F.lit("live").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), empty).alias("live_spans"),
        F.coalesce(F.transform("shown", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), empty).alias("examples"),
    )
