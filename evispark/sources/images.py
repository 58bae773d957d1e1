"""Image references in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.text import IMAGE_SUFFIXES

REFERENCE = r"!\[[^\n]*?\]\([^\n]*?\)"
CONTEXT_CHARS = 100


def supported_images(files: DataFrame, name: str = "image_name") -> DataFrame:
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return files.where(suffix.isin(*IMAGE_SUFFIXES))


def referenced_images(docs: DataFrame, images: DataFrame, key: str = "document_id", text: str = "md_content") -> DataFrame:
    """Image files a document refers to, with the text around the first reference.

    A reference names a file when the file name occurs in its target; the base name of the target is the
    join key, so files and references meet in an equi-join.
    """
    marks = F.regexp_extract_all(F.col(text), F.lit(rf"({REFERENCE})"), F.lit(1))
    whole, mark = F.col(text), F.col("mark")
    at = F.position(mark, whole)
    # The surroundings are cut before the join, so the whole text is not carried along with every reference.
    refs = (
        docs.select(key, text, F.posexplode_outer(marks).alias("pos", "mark"))
        .where("mark IS NOT NULL")
        .select(
            key,
            "pos",
            base_name(F.regexp_extract("mark", r"\]\(([^\n]*)\)$", 1)).alias("image_name"),
            F.substring(
                whole, F.greatest(at - CONTEXT_CHARS, F.lit(1)), F.least(at - 1, F.lit(CONTEXT_CHARS))
            ).alias("before"),
            F.substring(whole, at + F.length(mark), F.lit(CONTEXT_CHARS)).alias("after"),
        )
    )
    return (
        refs.join(supported_images(images), [key, "image_name"])
        .groupBy(key, "image_name")
        .agg(F.min_by(F.struct("before", "after"), "pos").alias("r"))
        .select(key, "image_name", "r.before", "r.after")
    )


def base_name(target: Column) -> Column:
    """File name of a link target, without directories, query or title text."""
    return F.regexp_extract(F.regexp_replace(target, r"[?#\s].*$", ""), r"([^/\\]+)$", 1)


def rewrite_references(docs: DataFrame, uploads: DataFrame, key: str = "document_id", text: str = "md_content") -> DataFrame:
    """Replace every reference to an uploaded image by its summary and address; others stay.

    ``uploads``: key, image_name, url, summary. The text is taken apart at its references and put
    together again, so a replacement is never read as a reference.
    """
    per_doc = uploads.groupBy(key).agg(
        F.map_from_entries(
            F.collect_list(F.struct("image_name", F.concat(F.lit("!["), "summary", F.lit("]("), "url", F.lit(")"))))
        ).alias("_new")
    )
    joined = docs.join(per_doc, key, "left")
    marks = F.regexp_extract_all(F.col(text), F.lit(rf"({REFERENCE})"), F.lit(1))
    pieces = F.split(F.col(text), REFERENCE, -1)
    shown = F.transform(
        marks,
        lambda m: F.coalesce(
            F.try_element_at(F.col("_new"), base_name(F.regexp_extract(m, r"\]\(([^\n]*)\)$", 1))), m
        ),
    )
    rebuilt = F.array_join(
        F.transform(
            F.arrays_zip(pieces.alias("p"), shown.alias("s")),
            lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.coalesce(x["s"], F.lit(""))),
        ),
        "",
    )
    return joined.withColumn(text, rebuilt).drop("_new")
