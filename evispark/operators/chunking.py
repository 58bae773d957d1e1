"""Markdown documents to chunks.

Everything is a column expression on the document row: one regular expression cuts the text into code,
table and text segments, array functions walk the headings, pack long segments and merge short ones.
No shuffle happens; a document becomes chunk rows only at the very end. The explosion is an outer one,
since an inner one makes the optimiser test the array's size first, which works it out a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import arrays as A
from evispark.functions import text as T
from evispark.operators import chunks as C


# How the parts of a Markdown text are recognised, line by line.
H = r"[^\S\n]"
FENCE = rf"{H}*(?:`{{3,}}|~{{3,}})"
HEADING = rf"{H}*#{{1,6}}{H}[^\n]+"
HTML_OPEN = r"[^\n]*(?i:<table)"
SEPARATOR = rf"{H}*\|?{H}*:?-{{3,}}:?{H}*(?:\|{H}*:?-{{3,}}:?{H}*)+\|?{H}*$"
PIPE_TABLE = rf"[^\n]*\|[^\n]*\n{SEPARATOR}"
CAPTION = rf"(?i:{H}*(?:表|Table|Tab\.){H}*[A-Za-z0-9一二三四五六七八九十.-]+[^\n]*)"
SENTENCE_BREAK = r"(?U)(?<=[。！？；.!?;])\s*|\n+"
HTML_ROW = r"(?is)<tr\b[^>]*>.*?</tr\s*>"
MODES = "(?dmU)"
TITLE_JOINER = "；"

_ANY = r"[\s\S]*"
SEGMENT = (
    MODES
    + rf"^(?:{H}*(?:(`{{3,}}+)[^\n]*(?:\n{_ANY}?^{H}*\1`*{H}*$|{_ANY})|(~{{3,}}+)[^\n]*(?:\n{_ANY}?^{H}*\2~*{H}*$|{_ANY}))"
    + rf"|(?={HTML_OPEN}){_ANY}?(?:(?i:</table>)[^\n]*$|\z)"
    + rf"|{PIPE_TABLE}(?:\n[^\n]*\|[^\n]*)*+"
    + rf"|[^\n]*(?:\n(?!{FENCE}|{HTML_OPEN}|{PIPE_TABLE}|{HEADING})[^\n]*)*+)"
)
CAPTION_TAIL = MODES + rf"(?:\A|\n)({CAPTION})\s*\z"

BLOCK_TYPE = "struct<content:string,context_type:string,path:array<string>,title:string>"


def segments(text: Column) -> Column:
    """Ordered segments of a text with their kind; blank ones are gone."""
    one_break = F.regexp_replace(text, "[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    raw = F.filter(F.regexp_extract_all(one_break, F.lit(SEGMENT), F.lit(0)), lambda s: T.strip(s) != "")
    kind = lambda s: (
        F.when(F.rlike(s, F.lit(rf"{MODES}\A{FENCE}")), F.lit("code"))
        .when(F.rlike(s, F.lit(rf"{MODES}\A(?:{HTML_OPEN}|{PIPE_TABLE})")), F.lit("table"))
        .otherwise(F.lit("text"))
    )
    return F.transform(raw, lambda s: F.struct(s.alias("raw"), kind(s).alias("kind")))


def with_captions(parts: Column) -> Column:
    """A caption line right before a table moves into the table; headings give level and title."""

    def one(own: Column, x: Column, i: Column) -> Column:
        before, after = F.get(own, i - 1), F.get(own, i + 1)
        caption = F.when(
            (x["kind"] == "table") & (before["kind"] == "text"),
            F.nullif(T.strip(F.regexp_extract(before["raw"], CAPTION_TAIL, 1)), F.lit("")),
        )
        gives = (x["kind"] == "text") & F.coalesce(after["kind"] == "table", F.lit(False))
        body = F.when(gives, F.regexp_replace(x["raw"], CAPTION_TAIL, "")).otherwise(x["raw"])
        is_heading = (x["kind"] == "text") & F.rlike(x["raw"], F.lit(rf"{MODES}\A{HEADING}"))
        marks = F.regexp_extract(x["raw"], rf"{MODES}\A{H}*(#{{1,6}})", 1)
        title = F.regexp_extract(x["raw"], rf"{MODES}\A{H}*#{{1,6}}{H}([^\n]*)", 1)
        return F.struct(
            T.strip(F.concat_ws("\n", caption, body)).alias("content"),
            x["kind"].alias("kind"),
            caption.alias("caption"),
            F.when(is_heading, F.length(marks)).otherwise(F.lit(0)).alias("level"),
            F.when(is_heading, T.clean_heading(title)).otherwise(F.lit("")).alias("heading"),
        )

    return A.let(parts, lambda own: F.transform(own, lambda x, i: one(own, x, i)))


def with_paths(parts: Column, file_title: Column) -> Column:
    """Blocks with section path and title: a heading replaces its own and all deeper levels."""
    start = F.struct(F.array().cast("array<string>").alias("path"), file_title.alias("title"))

    def step(acc: Column, x: Column) -> Column:
        opens = x["level"] > 0
        parents = F.slice(acc["path"], F.lit(1), F.greatest(x["level"] - 1, F.lit(0)))
        return F.struct(
            F.when(opens, F.array_append(parents, x["heading"])).otherwise(acc["path"]).alias("path"),
            F.when(opens, x["heading"]).otherwise(acc["title"]).alias("title"),
        )

    def block(x: Column, at: Column) -> Column:
        return F.struct(
            x["content"].alias("content"), x["kind"].alias("context_type"), at["path"].alias("path"), F.coalesce(x["caption"], at["title"]).alias("title")
        )

    return F.filter(A.let(parts, lambda own: F.zip_with(own, A.scan(own, start, step), block)), lambda b: b["content"] != "")


def sliced(text: Column, size: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.length(text) - 1, size), lambda at: F.substring(text, at + 1, size)
    )


def small_units(text: Column, size: Column) -> Column:
    """Sentences, cut hard where a sentence alone is too long; a short text stays whole."""
    sentences = F.filter(F.transform(F.split(text, SENTENCE_BREAK, -1), T.strip), lambda s: s != "")
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.flatten(F.transform(sentences, lambda s: sliced(s, size)))
    )


def cut(units: Column, states: Column, piece: Callable[[Column, Column, Column], Column]) -> Column:
    """Pieces of consecutive units, one from each unit whose state ``opens`` up to the next one.

    ``piece`` takes the state at the cut, the number of the piece and its units.
    """

    def marked(x: Column) -> Column:
        places = F.filter(F.transform(x["states"], lambda s, i: F.when(s["opens"], i)), lambda i: i.isNotNull())
        return F.struct(x["units"].alias("units"), x["states"].alias("states"), places.alias("cuts"))

    def pieces(x: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(x["cuts"], k + 1), F.size(x["units"]))
            return piece(F.get(x["states"], at), k, F.slice(x["units"], at + 1, end - at))

        return F.transform(x["cuts"], one)

    return A.let(F.struct(units.alias("units"), states.alias("states")), lambda x: A.let(marked(x), pieces))


def packed_text(units: Column, target: int, overlap: int) -> Column:
    """Fill pieces up to the target; each further piece starts with the tail of the one before.

    Only lengths and the tail of the piece so far are carried along the units; texts are joined once the cuts are known.
    """
    start = F.struct(F.lit(0).alias("size"), F.lit("").alias("tail"), F.lit("").alias("lead"), F.lit(False).alias("opens"))

    def led(lead: Column, unit: Column) -> Column:
        return T.strip(F.concat(lead, F.lit("\n"), unit)) if overlap > 0 else unit

    def step(acc: Column, unit: Column) -> Column:
        n = F.length(unit)
        first = acc["size"] == 0
        flush = ~first & (acc["size"] + 2 + n > target)
        more = F.when(first | (n >= overlap), unit).otherwise(F.concat(acc["tail"], F.lit("\n\n"), unit))
        return F.struct(
            F.when(flush, F.length(led(acc["tail"], unit))).when(first, n).otherwise(acc["size"] + 2 + n).alias("size"),
            F.right(F.when(flush, led(acc["tail"], unit)).otherwise(more), F.lit(overlap)).alias("tail"),
            F.when(flush, acc["tail"]).otherwise(F.lit("")).alias("lead"),
            (first | flush).alias("opens"),
        )

    def piece(state: Column, k: Column, own: Column) -> Column:
        head = F.when(k > 0, led(state["lead"], F.get(own, F.lit(0)))).otherwise(F.get(own, F.lit(0)))
        return F.array_join(F.concat(F.array(head), F.slice(own, F.lit(2), F.size(own))), "\n\n")

    return cut(units, A.scan(units, start, step), piece)


def text_pieces(x: Column, max_size: int, target: int, overlap: int) -> Column:
    """A long text in pieces; pieces after the first repeat the heading line. ``x``: units, prefix."""
    heading = x["prefix"]
    room = F.lit(max_size - 1) - F.length(heading)

    def expand(piece: Column, i: Column) -> Column:
        repeat = (i > 0) & (heading != "") & ~F.startswith(piece, heading) & (room > 0)
        headed = F.transform(small_units(piece, F.greatest(room, F.lit(1))), lambda s: F.concat(heading, F.lit("\n"), s))
        return F.when(repeat, headed).otherwise(small_units(piece, F.lit(max_size)))

    return F.flatten(F.transform(packed_text(x["units"], target, overlap), expand))


def packed_rows(rows: Column, prefix: Column, suffix: Column, sep: str, max_size: int) -> Column:
    """Whole rows per piece, each piece between ``prefix`` and ``suffix``; an over-long row stays whole."""
    start = F.struct(F.lit(None).cast("int").alias("size"), F.lit(False).alias("opens"))

    def step(acc: Column, n: Column) -> Column:
        longer = acc["size"] + len(sep) + n
        opens = F.coalesce(longer > max_size, F.lit(True))
        return F.struct(F.when(opens, n + F.length(prefix) + F.length(suffix)).otherwise(longer).alias("size"), opens.alias("opens"))

    def piece(_: Column, __: Column, own: Column) -> Column:
        return F.concat(prefix, F.array_join(own, sep), suffix)

    return cut(rows, A.scan(F.transform(rows, F.length), start, step), piece)


def _units_of(content: Column, kind: Column, target: int) -> Column:
    """What a long block is packed from: sentences, table rows, or lines."""
    paragraphs = F.filter(F.transform(F.split(content, r"(?U)\n\s*\n", -1), T.strip), lambda p: p != "")
    return (
        F.when(kind == "text", F.flatten(F.transform(paragraphs, lambda p: small_units(p, F.lit(target)))))
        .when(kind == "html", F.regexp_extract_all(content, F.lit(HTML_ROW), F.lit(0)))
        .when(kind == "code", F.split(content, "\n", -1))
        .otherwise(F.array().cast("array<string>"))
    )


def _header_of(content: Column, kind: Column) -> Column:
    """What every piece repeats at its start, before the rows that are repeated too."""
    bare = F.rlike(content, F.lit(rf"{MODES}\A{SEPARATOR}"))
    return (
        F.when(kind == "text", F.regexp_extract(content, rf"{MODES}\A({HEADING})", 1))
        .when(kind == "html", F.regexp_extract(content, r"(?is)\A(.*?)<tr\b[^>]*>.*?</tr\s*>", 1))
        .when(kind == "code", F.regexp_extract(content, r"(?d)\A([^\n]*)", 1))
        .when(bare, F.lit(""))
        .otherwise(F.regexp_extract(content, rf"{MODES}\A((?:[^\n]*\n)+?{SEPARATOR})", 1))
    )


def _tail_of(content: Column, kind: Column) -> Column:
    """What closes every piece."""
    last = F.regexp_extract(content, r"(?d)\n([^\n]*)\z", 1)
    mark = F.regexp_extract(content, r"\A\s*(`{3,}|~{3,})", 1)
    bare = T.strip(last)
    closes = F.rlike(bare, F.lit(r"\A(?:`{3,}|~{3,})\z")) & F.startswith(bare, mark)
    return (
        F.when(kind == "html", F.regexp_extract(content, r"(?is)\A.*<tr\b[^>]*>.*?</tr\s*>(.*)\z", 1))
        .when((kind == "code") & closes, last)
        .when(kind == "code", mark)
        .otherwise(F.lit(""))
    )


def _table_pieces(x: Column, max_size: int) -> Column:
    """By table rows with the header repeated; a table without a header or rows stays whole."""
    return F.when((x["prefix"] == "") | (F.size(x["units"]) == 0), F.array(x["content"])).otherwise(
        packed_rows(x["units"], x["prefix"], x["suffix"], "\n", max_size)
    )


def _html_pieces(x: Column, max_size: int) -> Column:
    """By table rows; header rows are repeated and every piece is closed."""
    return (
        F.when(x["whole"], F.array(x["content"]))
        .when(F.size(x["units"]) == 0, F.array(F.concat(x["prefix"], x["suffix"])))
        .otherwise(packed_rows(x["units"], x["prefix"], x["suffix"], "", max_size))
    )


def _code_pieces(x: Column, max_size: int) -> Column:
    """By lines, every piece fenced."""
    return F.when(F.size(x["units"]) == 0, F.array(x["content"])).otherwise(
        packed_rows(x["units"], x["prefix"], x["suffix"], "\n", max_size)
    )


def refined(blocks: Column, max_size: int, target: int, overlap: int) -> Column:
    """Every block in pieces no longer than allowed, by the way of its kind.

    Header, tail and units of a long block are worked out once per block, in two steps, before the
    packing refers to them for every unit.
    """

    def prepare(b: Column) -> Column:
        content, kind = b["content"], b["context_type"]
        how = (
            F.when(F.length(content) <= max_size, F.lit("short"))
            .when(kind != "table", kind)
            .when(F.contains(F.lower(content), F.lit("<table")), F.lit("html"))
            .otherwise(F.lit("pipe"))
        )
        return F.struct(b.alias("b"), how.alias("how"))

    def take_apart(p: Column) -> Column:
        content, how = p["b"]["content"], p["how"]
        none = F.lit("")
        return F.struct(
            p["b"].alias("b"),
            how.alias("how"),
            F.when(how == "short", none).otherwise(_header_of(content, how)).alias("header"),
            F.when(how == "short", none).otherwise(_tail_of(content, how)).alias("tail"),
            _units_of(content, how, target).alias("units"),
        )

    def complete(x: Column) -> Column:
        content, how, units = x["b"]["content"], x["how"], x["units"]
        is_head = lambda r: F.contains(F.lower(r), F.lit("<th"))
        # Data rows equal to a header row go as well, as they hold the same mark.
        body = F.filter(units, lambda r: ~is_head(r))
        rest = F.substring(content, F.length(x["header"]) + 2, F.length(content))
        closed = F.element_at(units, -1) == x["tail"]
        inner = F.slice(units, F.lit(2), F.greatest(F.size(units) - F.when(closed, 2).otherwise(1), F.lit(0)))
        return F.struct(
            content.alias("content"),
            how.alias("how"),
            x["b"].alias("b"),
            F.when(how == "html", F.concat(x["header"], F.array_join(F.filter(units, is_head), "")))
            .when(how == "code", F.concat(x["header"], F.lit("\n")))
            .when((how == "pipe") & (x["header"] != ""), F.concat(x["header"], F.lit("\n")))
            .otherwise(x["header"])
            .alias("prefix"),
            F.when(how == "code", F.concat(F.lit("\n"), x["tail"])).otherwise(x["tail"]).alias("suffix"),
            F.when(how == "html", body)
            .when(how == "code", inner)
            .when((how == "pipe") & (rest != ""), F.split(rest, "\n", -1))
            .otherwise(units)
            .alias("units"),
            ((how == "html") & (F.size(units) == 0)).alias("whole"),
        )

    def pieces(x: Column) -> Column:
        cut = (
            F.when(x["how"] == "short", F.array(x["content"]))
            .when(x["how"] == "text", text_pieces(x, max_size, target, overlap))
            .when(x["how"] == "code", _code_pieces(x, max_size))
            .when(x["how"] == "html", _html_pieces(x, max_size))
            .otherwise(_table_pieces(x, max_size))
        )
        b = x["b"]
        return F.transform(
            cut,
            lambda p: F.struct(
                p.alias("content"), b["context_type"].alias("context_type"), b["path"].alias("path"), b["title"].alias("title")
            ),
        )

    stages = F.transform(F.transform(F.transform(blocks, prepare), take_apart), complete)
    return F.flatten(F.transform(stages, pieces))


def merged_short(blocks: Column, min_size: int, max_size: int) -> Column:
    """Join neighbouring texts of one section, and short neighbours below one top heading."""
    start = F.lit(None).cast(f"{BLOCK_TYPE[:-1]},opens:boolean>")

    def step(last: Column, x: Column) -> Column:
        short = (F.length(last["content"]) < min_size) & (F.length(x["content"]) < min_size)
        same_top = F.get(last["path"], F.lit(0)).eqNullSafe(F.get(x["path"], F.lit(0)))
        may = (
            last.isNotNull()
            & (last["context_type"] == "text")
            & (x["context_type"] == "text")
            & ((last["path"] == x["path"]) | (short & same_top))
        )
        both = F.when(F.coalesce(may, F.lit(False)), T.strip(F.concat(last["content"], F.lit("\n\n"), x["content"])))

        def joined(text: Column) -> Column:
            joins = F.coalesce(F.length(text) <= max_size, F.lit(False))
            differ = joins & (last["title"] != x["title"])
            titles = F.concat_ws(TITLE_JOINER, F.nullif(last["title"], F.lit("")), F.nullif(x["title"], F.lit("")))
            shorter = F.slice(last["path"], F.lit(1), F.greatest(F.size(last["path"]) - 1, F.lit(0)))
            return F.struct(
                F.when(joins, text).otherwise(x["content"]).alias("content"),
                x["context_type"].alias("context_type"),
                F.when(differ, shorter).when(joins, last["path"]).otherwise(x["path"]).alias("path"),
                F.when(differ, titles).otherwise(x["title"]).alias("title"),
                (~joins).alias("opens"),
            )

        return A.let(both, joined)

    def last_ones(states: Column) -> Column:
        ends = F.filter(states, lambda s, i: F.coalesce(F.get(states, i + 1)["opens"], F.lit(True)))
        return F.transform(ends, lambda s: F.struct(*(s[c].alias(c) for c in ("content", "context_type", "path", "title"))))

    return A.let(A.scan(blocks, start, step), last_ones)


def heading_sections(docs: DataFrame, text: str = "md_content", title: str = "file_title") -> DataFrame:
    """One row per block of a document before any length rule."""
    rows = (
        docs.withColumn("_parts", segments(F.col(text)))
        .withColumn("_parts", with_captions(F.col("_parts")))
        .withColumn("_blocks", with_paths(F.col("_parts"), F.col(title)))
    )
    return rows.select(
        *[c for c in docs.columns if c != text], F.posexplode_outer("_blocks").alias("block_index", "_b")
    ).where("_b IS NOT NULL").select(
        "*",
        F.col("_b.content").alias("content"),
        F.col("_b.context_type").alias("context_type"),
        F.col("_b.path").alias("section_path"),
        F.col("_b.title").alias("section_title"),
    ).drop("_b")


def document_blocks(
    docs: DataFrame,
    text: str = "md_content",
    title: str = "file_title",
    max_size: int = C.CHUNK_MAX_SIZE,
    target: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP,
    min_size: int = C.CHUNK_MIN,
) -> DataFrame:
    """One row per final block, in order, all other columns of the document kept."""
    if not 0 <= overlap < min_size <= target <= max_size:
        raise ValueError("sizes must satisfy 0 <= overlap < min <= target <= max")
    rows = (
        docs.withColumn("_parts", segments(F.col(text)))
        .withColumn("_parts", with_captions(F.col("_parts")))
        .withColumn("_blocks", with_paths(F.col("_parts"), F.col(title)))
        .withColumn("_blocks", refined(F.col("_blocks"), max_size, min(target, max_size), overlap))
        .withColumn("_blocks", merged_short(F.col("_blocks"), min_size, max_size))
        .withColumn("_blocks", F.filter("_blocks", lambda b: T.strip(b["content"]) != ""))
    )
    return rows.select(
        *[c for c in docs.columns if c != text], F.posexplode_outer("_blocks").alias("block_index", "_b")
    ).where("_b IS NOT NULL").select(
        "*",
        T.strip(F.col("_b.content")).alias("content"),
        F.col("_b.context_type").alias("context_type"),
        F.col("_b.path").alias("section_path"),
        F.col("_b.title").alias("section_title"),
    ).drop("_b")


def _chunk_columns(rows: DataFrame) -> DataFrame:
    section = T.first_text(F.col("section_title"), F.col("file_title"))
    named = rows.withColumn("section_title", section)
    return (
        named.withColumn("chunk_id", C.chunk_id(F.col("document_id"), F.col("chunk_index")))
        .withColumn("token_count", T.token_estimate(F.col("content")))
        .withColumn(
            "embedding_text",
            C.embedding_text(
                *[
                    F.col(c)
                    for c in "file_title section_title document_type region_names topics keywords content".split()
                ]
            ),
        )
    )


def finalised(blocks: DataFrame) -> DataFrame:
    """Block rows to chunk rows: blanks dropped, ordinals contiguous per document."""
    kept = blocks.withColumn("content", T.strip(F.col("content"))).where("content <> ''")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("block_index")) - 1
    return _chunk_columns(kept.withColumn("chunk_index", place).drop("block_index"))


def chunk_documents(docs: DataFrame, **sizes: int) -> DataFrame:
    """Documents with metadata to chunk rows, without a shuffle.

    ``docs``: document_id, file_title, md_content, document_type, region_names, topics, keywords.
    """
    blocks = document_blocks(docs, **sizes)
    return _chunk_columns(blocks.withColumnRenamed("block_index", "chunk_index"))
