"""Fragments shared by the checking SQL (DuckDB dialect)."""

# The same white-space set as the Spark side, spelled for RE2.
SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
