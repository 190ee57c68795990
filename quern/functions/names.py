"""Keys of names: one spelling for names that differ in form, case or white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode property White_Space, as a class.
WHITE_SPACE = (
    "[\\t-\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
)

#: The same class in DuckDB SQL.
SQL_SPACE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def nfc(name: Column) -> Column:
    """Unicode NFC. Pure ASCII is NFC already and skips the call; the rest goes to
    ICU, which ships with Spark, so the value never leaves the JVM."""
    composed = F.call_function(
        "reflect",
        F.lit("com.ibm.icu.text.Normalizer"),
        F.lit("compose"),
        F.coalesce(name, F.lit("")),
        F.lit(False),
    )
    return F.when(F.octet_length(name) == F.char_length(name), name).otherwise(composed)


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def name_key(name: Column) -> Column:
    """The key of a name: NFC, lower case, trimmed, inner white space as one `-`.

    Null, empty and blank names have no key: the result is null.
    """
    key = F.regexp_replace(trimmed(F.lower(nfc(name))), f"{WHITE_SPACE}+", "-")
    return F.when(F.octet_length(key) > 0, key)


def name_keys(names: Column) -> Column:
    """Keys of an array of names, in order, with repeats and without empty ones.

    A null array counts as empty.
    """
    keys = F.filter(F.transform(names, name_key), lambda k: k.isNotNull())
    return F.coalesce(keys, F.array().cast("array<string>"))


def trimmed_sql(text: str) -> str:
    """The same trimming in DuckDB SQL."""
    return f"regexp_replace({text}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def name_key_sql(name: str) -> str:
    """The same key in DuckDB SQL, for the comparison queries."""
    key = f"regexp_replace({trimmed_sql(f'lower(nfc_normalize({name}))')}, '{SQL_SPACE}+', '-', 'g')"
    return f"nullif({key}, '')"
