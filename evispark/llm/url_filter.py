"""URL filter lists with DataFrame operations only.

Each URL is expanded into expressions, a suffix of its host and a prefix of its path, whose hashes are equi-joined with
the rules' by a short prefix; the full digest confirms a match, and of a URL's rules the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_RULES = 500_000  # of about 200 bytes; a longer list is joined by a shuffle
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEAD = r"(?s)\A.*?://([^/?#]*)"
_PATH = r"(?s)\A.*?://[^/?#]*([^?#]*)"


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HEAD, 1), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _PATH, 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("\x00", host, path), "utf-8"), 256)


def _labels(host: str) -> Column:
    return F.length(F.regexp_replace(host, r"[^.]", "")) + 1


def judge_urls(urls: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """``urls``, all columns kept, with host, path, rule and verdict (columns of these names are replaced).

    ``rules`` has host, path and verdict ('allow' or 'block'). A rule fits its host and all subdomains if the URL's path
    starts with the rule's path. The longest rule wins (host and path together, then the longer host, then 'block');
    without one the verdict is ``default`` and the rule null. The path lengths among the rules (no more numbers than the
    longest path has characters) decide which prefixes a URL is expanded into, the numbers of labels in their hosts likewise
    which suffixes. Other columns may have any names.

    A null URL or one without ``://`` has an empty host and path and no rule; an empty path starts with no rule's path
    but the empty one. Rules with a null in any column are ignored; rules that repeat count once. Repeated URLs give
    repeated results, and each distinct one is judged once. Empty tables give empty or all-default results.
    """
    good = rules.select("host", "path", "verdict").dropna().distinct()
    table = good.select(
        F.col("host").alias("_rule_host"), F.col("path").alias("_rule_path"), F.col("verdict").alias("_rule_verdict"),
        _digest(F.col("host"), F.col("path")).alias("_rule_digest"),
    ).withColumn("_rule_short", F.substring("_rule_digest", 1, prefix_digits))
    size = good.agg(F.count("*"), F.collect_set(F.length("path")), F.collect_set(_labels("host"))).first()
    if size[0] <= MAX_BROADCAST_RULES:
        table = F.broadcast(table)
    lengths, depths = sorted(size[1]), sorted(size[2])
    split = urls.select(F.struct(*urls.columns).alias("row"), host_of(url_col).alias("_host"), path_of(url_col).alias("_path"))
    known = split.select("_host", "_path").filter("_host <> ''").distinct()
    suffixes = F.array(*(F.when(_labels("_host") >= n, F.substring_index("_host", ".", -n)) for n in depths)) if depths else F.array().cast("array<string>")
    suffixed = known.select("_host", "_path", F.explode(F.array_compact(suffixes)).alias("_suffix"))
    prefixes = F.array(*(F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    expanded = suffixed.select("_host", "_path", "_suffix", F.explode(F.array_compact(prefixes)).alias("_prefix"))
    expanded = expanded.withColumn("_full", _digest(F.col("_suffix"), F.col("_prefix")))
    hit = expanded.join(table, (F.substring("_full", 1, prefix_digits) == F.col("_rule_short")) & (F.col("_full") == F.col("_rule_digest")))
    rank = F.struct(
        (F.length("_rule_host") + F.length("_rule_path")).alias("long"),
        F.length("_rule_host").alias("host_long"),
        F.col("_rule_verdict").alias("verdict"),
        F.concat("_rule_host", "_rule_path").alias("rule"),
    )
    best = hit.groupBy("_host", "_path").agg(F.max(rank).alias("_best"))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return split.join(best, ["_host", "_path"], "left").select(
        *(F.col("row").getField(c).alias(c) for c in kept), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
