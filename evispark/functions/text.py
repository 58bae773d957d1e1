"""Text columns. Every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space that Python's str methods recognise, as a regex class body.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
# The same characters one by one.
SPACE_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Patterns of headings, tags and titles.
HEADING_CLOSING = rf"[{SPACE}]+#+[{SPACE}]*$"
INLINE_TAG = "<[^>]+>"
TITLE_ELEMENT = r"(?is)<title[^>]*>(.*?)</title>"
ANCHOR_OTHER = r"[^\p{L}\p{N}_-]"
LEADING_HEADING = r"(?d)^#{1,6}\s+.+?(?:\s+#{1,6})?\s*\n"
SUB_HEADING = r"\n#{2,6}\s"

# Marker texts that betray an unfinished section.
SECTION_PLACEHOLDERS = ("占位", "待生成", "稍后补充", "待补充", "TODO", "真实内容将在", "尚未接入真实")
RENDER_PLACEHOLDERS = ("占位", "待生成", "待补充", "真实内容将在", "尚未接入真实")
REFUSAL_SIGNALS = ("无法确定", "资料不足", "未检索到", "无法回答", "需要补充")

# Supported image suffixes.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")

# One token is a Han character, a run of ASCII letters and digits, or any other visible character.
TOKEN_PATTERN = rf"[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+|[^{SPACE}]"
WORD_PATTERN = r"[\p{L}\p{N}]+"

# Display texts.
UNTITLED_HEADING = "未命名章节"
CONFIDENCE_LABELS = {"high": "高置信度", "medium": "中置信度", "low": "低置信度"}


def strip(c: Column) -> Column:
    """A trim by characters: a pattern for both ends would be tried at every character between them."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    """Every white-space run becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_text(*cols: Column) -> Column:
    """First non-blank text, stripped; empty when there is none."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def token_estimate(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0)))


@cache
def _folds() -> dict[str, str]:
    """Lower-case characters that case folding still changes, by the Unicode data of the interpreter."""
    every = (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    return {c: c.casefold() for c in every if c.casefold() != c and c.lower() == c}


def case_folded(c: Column) -> Column:
    """Full case folding: lower case, then what has no case pair of its own (ß, final sigma, ligatures and the like)."""
    low = F.lower(c)
    one = {a: b for a, b in _folds().items() if len(b) == 1}
    more = {a: b for a, b in _folds().items() if len(b) > 1}
    single = F.translate(low, "".join(one), "".join(one.values()))
    table = F.create_map(*(F.lit(x) for pair in more.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(single, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.when(F.rlike(single, F.lit(f"[{''.join(more)}]")), spelled).otherwise(single)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))


def clean_heading(c: Column) -> Column:
    no_closing = strip(F.regexp_replace(c, HEADING_CLOSING, ""))
    text = collapse(F.regexp_replace(no_closing, INLINE_TAG, ""))
    return F.when(text == "", F.lit(UNTITLED_HEADING)).otherwise(text)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(url, F.lit(""))), r"(?s)#.*$", "")


def is_image_url(url: Column) -> Column:
    path = F.lower(F.regexp_replace(url, r"(?s)[?#].*$", ""))
    found = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        found = found | path.endswith(suffix)
    return found


def is_http_url(url: Column) -> Column:
    text = strip(F.coalesce(url, F.lit("")))
    return text.startswith("http://") | text.startswith("https://")


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def choice(c: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(text.isin(*allowed), text).otherwise(F.lit(fallback))


def ellipsize(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def error_summary(message: Column, error_type: Column, detail: Column, limit: int = 500) -> Column:
    text = strip(F.coalesce(detail, F.lit("")))
    head = F.concat(message, F.lit(": "), error_type)
    return F.when(text == "", head).otherwise(F.concat(head, F.lit(": "), F.substring(text, 1, limit)))


def page_title(html: Column) -> Column:
    raw = F.regexp_extract(html, TITLE_ELEMENT, 1)
    return collapse(F.regexp_replace(raw, INLINE_TAG, " "))


def page_date(html: Column) -> Column:
    """First match of three patterns, most specific first; empty when none matches."""
    # Where a publication date may stand in a page.
    patterns = (
        r'(?i)"datePublished"\s*:\s*"([^"]+)"',
        r'(?i)"dateModified"\s*:\s*"([^"]+)"',
        r"(\d{4}-\d{2}-\d{2}(?:[T ][0-9:]+(?:Z|[+-]\d{2}:?\d{2})?)?)",
    )
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns], F.lit(""))


def section_anchor(section_id: Column, title: Column) -> Column:
    raw = F.coalesce(F.nullif(section_id, F.lit("")), F.nullif(title, F.lit("")), F.lit("section"))
    return F.concat(F.lit("section-"), F.regexp_replace(collapse(raw), ANCHOR_OTHER, "-"))


def strip_leading_heading(body: Column) -> Column:
    text = F.regexp_replace(body, r"^\n+", "")
    rest = F.regexp_replace(text, LEADING_HEADING, "")
    return F.when(rest == text, text).otherwise(F.regexp_replace(rest, r"^\n+", ""))


def before_first_subheading(body: Column) -> Column:
    """The introduction: text before the first heading of level two or deeper, or all of it."""
    intro = strip(F.regexp_extract(body, rf"(?s)^(.*?){SUB_HEADING}", 1))
    return F.when(F.rlike(body, F.lit(SUB_HEADING)), intro).otherwise(body)


def citation_labels(source_ids: Column) -> Column:
    """``[label]`` for every non-blank id, in order, joined without separators."""
    kept = F.filter(F.transform(source_ids, collapse), lambda x: x != "")
    return F.array_join(
        F.transform(kept, lambda x: F.concat(F.lit("["), F.regexp_replace(x, "^source-", ""), F.lit("]"))), ""
    )


def json_object_text(c: Column) -> Column:
    """The JSON object inside model output: fence removed, else first ``{`` to last ``}``; empty when none."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def source_key(url: Column, source_type: Column, title: Column) -> Column:
    kind, name = strip(F.coalesce(source_type, F.lit(""))), strip(F.coalesce(title, F.lit("")))
    return F.coalesce(
        blank_to_null(url),
        F.when(name != "", F.concat(kind, F.lit(":"), name)),
    )


def render(template: str, **values: Column) -> Column:
    """Fill the named ``{places}`` of a template with columns."""
    pieces: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def confidence_label(c: Column) -> Column:
    out = F.lit(CONFIDENCE_LABELS["medium"])
    for key, label in CONFIDENCE_LABELS.items():
        out = F.when(c == key, F.lit(label)).otherwise(out)
    return out


def display_title(file_title: Column, section_title: Column) -> Column:
    file_part, section_part = first_text(file_title), first_text(section_title)
    return F.when(
        (section_part != "") & (section_part != file_part),
        F.concat(file_part, F.lit(" / "), section_part),
    ).otherwise(file_part)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
