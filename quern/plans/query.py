"""The query language: forgiving text to a typed query. No Spark here.

A query is words and `field:value` clauses. Nothing is an error: what isn't a clause
is text. Double quotes keep white space in a token; inside them a backslash takes the
next character as it is. A leading `-` negates a clause.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from quern.functions.names import WHITE_SPACE

I64_MAX = 2**63 - 1

# The spellings of fields, sort keys and states.
FIELDS = {"lang": "language", "language": "language", "tag": "tag", "group": "group", "owner": "owner", "user": "owner", "stars": "stars", "is": "is", "sort": "sort"}
SORT_NAMES = {
    "relevance": "relevance", "best": "relevance",
    "stars": "stars",
    "name": "name", "alpha": "name",
    "recent": "recent", "pushed": "recent", "updated": "recent",
    "starred": "starred", "added": "starred",
}
SUFFIXES = {"k": 1e3, "m": 1e6}
LARGEST_SCALED = 1e12

_SPACE = re.compile(WHITE_SPACE)
_TOKEN = re.compile(rf'(?:"(?:\\.|[^"\\])*(?:"|\\?\Z)|(?!{WHITE_SPACE})[^"])+', re.S)
_ESCAPE = re.compile(r"\\(.)|\\\Z", re.S)
_WHOLE = re.compile(r"[+-]?[0-9]+")
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class SortKey(Enum):
    RELEVANCE = "relevance"
    STARS = "stars"
    NAME = "name"
    RECENT = "recent"
    STARRED = "starred"


@dataclass(frozen=True)
class StarRange:
    """Inclusive bounds; None is open."""

    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Clause:
    """field is language, tag, group, owner, stars, archived or fork."""

    field: str
    value: str | bool | StarRange
    negated: bool = False


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    clauses: list[Clause] = field(default_factory=list)
    sort: SortKey | None = None

    @property
    def text(self) -> str:
        return " ".join(self.terms)

    @property
    def is_empty(self) -> bool:
        return not (self.terms or self.clauses or self.sort)

    @property
    def has_text(self) -> bool:
        return self.text != ""


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def tokens(text: str) -> list[str]:
    """Tokens with their quotes, escapes resolved; an open quote runs to the end."""

    def plain(match: re.Match) -> str:
        parts = re.split(r'("(?:\\.|[^"\\])*(?:"|\\?\Z))', match[0], flags=re.S)
        return "".join(_ESCAPE.sub(lambda m: m[1] or "", p) if p.startswith('"') else p for p in parts)

    return [t for t in map(plain, _TOKEN.finditer(text)) if t not in ("", '"', '""')]


def unquote(text: str) -> str:
    """Without one quote in front and one behind, whichever is there."""
    return text.removeprefix('"').removesuffix('"')


def count(text: str) -> int | None:
    """A whole number, or a decimal with the suffix k or m, cut to a whole one."""
    text = _strip(text)
    scale = SUFFIXES.get(ascii_lower(text[-1:]))
    if scale is None:
        n = int(text) if _WHOLE.fullmatch(text) else -1
        return n if 0 <= n <= I64_MAX else None
    if not _DECIMAL.fullmatch(text[:-1]):
        return None
    n = float(text[:-1])
    return int(n * scale) if 0 <= n <= LARGEST_SCALED else None


def _strip(text: str) -> str:
    return re.sub(rf"\A{WHITE_SPACE}+|{WHITE_SPACE}+\Z", "", text)


def star_range(text: str) -> StarRange | None:
    """`a..b` with either end open, `>=a`, `<=a`, `>a`, `<a` or one number."""
    text = _strip(text)
    low, dots, high = text.partition("..")
    if dots:
        ends = [count(e) if e else None for e in (low, high)]
        bad = any(e and n is None for e, n in zip((low, high), ends)) or ends == [None, None]
        return None if bad else StarRange(*ends)
    sign = re.match(r">=|<=|>|<|", text)[0]
    n = count(text[len(sign) :])
    if n is None:
        return None
    return {
        "": StarRange(n, n), ">=": StarRange(n, None), "<=": StarRange(None, n),
        ">": StarRange(min(n + 1, I64_MAX), None), "<": StarRange(None, n - 1),
    }[sign]


def _clause(name: str, value: str, negated: bool) -> Clause | SortKey | None:
    """What a field with a value means; None if the value is none of the field's."""
    value = unquote(value)
    if name == "sort":
        key = SORT_NAMES.get(ascii_lower(value))
        return SortKey(key) if key else None
    if name == "stars":
        bounds = star_range(value)
        return Clause(name, bounds, negated) if bounds else None
    if name == "is":
        # `active` and `source` ask for the same with and without a dash in front.
        states = {"archived": ("archived", True), "active": ("archived", negated), "fork": ("fork", True), "source": ("fork", negated)}
        state = states.get(ascii_lower(value))
        return Clause(*state, negated) if state else None
    return Clause(name, value, negated)


def parse(text: str) -> Query:
    """Any text to a query. A field without a value says nothing yet; a field with a
    value that is none of its own is text, as typed; the last `sort:` counts."""
    query = Query()
    for token in tokens(text):
        negated = len(token) > 1 and token[0] == "-"
        name, colon, value = token[negated:].partition(":")
        name = FIELDS.get(ascii_lower(name)) if colon else None
        if name is None:
            query.terms.append(unquote(token))
        elif value:
            meaning = _clause(name, value, negated)
            if meaning is None:
                query.terms.append(token)
            elif isinstance(meaning, SortKey):
                query.sort = meaning
            else:
                query.clauses.append(meaning)
    return query


def with_sort(text: str, key: SortKey) -> str:
    """The query text with its `sort:` tokens replaced by one for `key`."""
    kept = [t for t in _SPACE.split(text) if t and not t.lower().startswith("sort:")]
    return " ".join([*kept, f"sort:{key.value}"])


def with_filter(text: str, clause: str) -> str:
    """The query text with a clause appended."""
    return " ".join(filter(None, [_strip(text), clause]))


# Canned filters by label.
CANNED = {"Only archived repositories": "is:archived", "Hide forks": "-is:fork", "More than 1 000 stars": "stars:>1000", "Written in Rust": "lang:rust"}


def commands(search: str = "") -> list[tuple[str, str]]:
    """(group, label) of the commands whose label or group holds the text, in any case."""
    every = [("sort", k.value) for k in SortKey] + [("filter", label) for label in CANNED]
    wanted = search.lower()
    return [c for c in every if wanted in c[0].lower() or wanted in c[1].lower()]
