"""Size of a text in word-and-punctuation tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern `\w+|[^\w\s]+` with Unicode classes, spelled out, since
# Java's own \w also takes marks and its \s is ASCII.
WORD_CHARS = "\\p{L}\\p{N}_"
SPACE_CHARS = "\\t-\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WORD_PUNCT = f"[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE_CHARS}]+"


def token_count(text: Column) -> Column:
    """Number of WordPunct tokens of a text; 0 for an empty text, null for null."""
    return F.regexp_count(text, F.lit(WORD_PUNCT)).cast("bigint")


def token_count_sql(text: str) -> str:
    """The same count in DuckDB SQL."""
    return f"len(regexp_extract_all({text}, '{WORD_PUNCT}'))::BIGINT"
