"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the web platform treats as white space.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def not_blank(text: Column) -> Column:
    return text.rlike(f"[^{SPACES}]")


def words(text: Column) -> Column:
    """Non-empty pieces between runs of white space."""
    # A one-character split needs no regular expression.
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def terms(text: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def query_terms(query: str) -> list[str]:
    """Search terms of a query. The parameter is one short text, so it is cut on the caller's side."""
    kept = "".join(c if c.isalpha() or c.isnumeric() else " " for c in query.lower())
    return kept.split()


def contains_folded(text: Column, query: str) -> Column:
    """Case-insensitive contains; a blank query keeps everything."""
    wanted = query.strip().lower()
    return F.lit(True) if not wanted else F.coalesce(F.lower(text).contains(wanted), F.lit(False))


def or_else(text: Column, other: Column) -> Column:
    """`text` unless it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def pad_number(number: Column, width: int = 5) -> Column:
    """Zero-padded to `width`, longer numbers stay whole."""
    digits = number.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def xml_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def json_string(text: Column) -> Column:
    """A JSON string literal, null for a null text."""
    wrapped = F.to_json(F.struct(text.alias("t")))
    return F.when(text.isNotNull(), wrapped.substr(F.lit(6), F.length(wrapped) - 6))


def json_or_null(text: Column) -> Column:
    return F.coalesce(text, F.lit("null"))
