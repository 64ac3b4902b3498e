"""String helpers that follow JavaScript's whitespace rules, which the data contract is written in."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points JavaScript's \s and trim() treat as white space.
WHITE_CODES = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]
WHITE = "[" + "".join(f"\\x{{{code:04X}}}" for code in WHITE_CODES) + "]"
MAX_TEXT = 80
MAX_SAFE_INTEGER = 2**53 - 1


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space, and the ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{WHITE}+", " "))


def clean_text(c: Column, limit: int = MAX_TEXT) -> Column:
    return F.substring(collapse(F.coalesce(c, F.lit(""))), 1, limit)


def readable_count(c: Column) -> Column:
    """How many ASCII letters and digits a string has."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))


def readable(c: Column, min_chars) -> Column:
    return readable_count(c) >= min_chars


def is_digits(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^[0-9]+\z")


def json_quote(c: Column) -> Column:
    """The JSON string literal for a column."""
    quoted = F.to_json(F.array(c))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)
