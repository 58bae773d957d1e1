"""Fixed-size windows, chunk identity and chunk statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import arrays as A
from evispark.functions import text as T

# Sizes in characters.
CHUNK_MAX_SIZE = 1000
CHUNK_SIZE = 600
CHUNK_OVERLAP = 30
CHUNK_MIN = 300


def document_id_from_name(file_name: Column) -> Column:
    return T.sha256_hex(F.concat(F.lit("filename:"), T.case_folded(file_name)))


def document_id(explicit: Column, path: Column, title: Column) -> Column:
    """Explicit id, else digest of the file name, else digest of the title."""
    given = F.lower(T.first_text(explicit))
    base_name = F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)
    return (
        F.when(given != "", given)
        .when(F.coalesce(path, F.lit("")) != "", document_id_from_name(base_name))
        .otherwise(T.sha256_hex(T.case_folded(T.collapse(title))))
    )


def chunk_id(doc_id: Column, index: Column) -> Column:
    """Depends on document and ordinal only, so an edited text keeps its ids."""
    return T.sha256_hex(F.concat_ws("|", doc_id, index.cast("string")))


def fixed_windows(
    df: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per window of ``size`` characters, consecutive windows sharing ``overlap``; a narrow step."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    # The text is cut once into strides, of which windows are joined; neither is it walked nor copied for each window.
    reach = -(-size // step)
    strides = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    windows = A.let(
        F.struct(strides.alias("strides"), count.alias("n")),
        lambda own: F.transform(
            F.sequence(F.lit(0), own["n"] - 1), lambda i: F.left(F.array_join(F.slice(own["strides"], i + 1, F.lit(reach)), ""), F.lit(size))
        ),
    )
    return df.select(*[c for c in df.columns if c != text], F.posexplode_outer(windows).alias("chunk_index", "content"))


def embedding_text(file_title, section_title, document_type, regions, topics, keywords, content) -> Column:
    """Context lines followed by the content; empty parts leave no line."""
    section = F.when(section_title != file_title, F.nullif(section_title, F.lit("")))
    lists = [F.nullif(F.array_join(x, "、"), F.lit("")) for x in (regions, topics, keywords)]
    return F.concat_ws(
        "\n", F.nullif(file_title, F.lit("")), section, F.nullif(document_type, F.lit("")), *lists, content
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks per document and per content type."""
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("n_chunks"),
        *[F.count_if(F.col("context_type") == kind).alias(f"n_{kind}") for kind in ("text", "table", "code")],
        F.sum("token_count").alias("n_tokens"),
    )
