"""Fuzzy matching of short names: a JVM prefilter and an Arrow-batched scorer.

A pattern is words; each must match and their scores add up. A word matches as a
subsequence, favouring runs, starts of words and early matches; `'word` asks for the
word itself, `^word` at the start, `word$` at the end, `!word` for its absence. A word
with a capital letter heeds case, one with a diacritic heeds diacritics.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.functions.fulltext import fold_text, folded

# The scores of an affine-gap alignment.
MATCH, GAP_START, GAP_MORE = 16, -3, -1
AT_WORD, AT_DELIMITER, AT_SPACE, AT_CAMEL, IN_RUN, FIRST = 8, 9, 10, 5, 4, 2
DELIMITERS = "/,:;|"
#: Stands for no match; gaps and bonuses move it, but never by half of it.
NONE = -(10**8)


@dataclass(frozen=True)
class Word:
    text: str
    kind: str = "fuzzy"  # or substring, prefix, suffix, exact
    inverse: bool = False

    @property
    def heeds_case(self) -> bool:
        return any(c.isupper() for c in self.text)

    @property
    def heeds_marks(self) -> bool:
        return fold_text(self.text) != self.text.lower()


def words(pattern: str) -> list[Word]:
    """The words of a pattern; `\\ ` is a space within a word."""
    out = []
    for raw in re.findall(r"(?:\\\s|\S)+", pattern):
        inverse = raw.startswith("!")
        raw = raw[inverse:]
        start, end, quoted = raw.startswith("^"), raw.endswith("$") and not raw.endswith("\\$"), raw.startswith("'")
        body = raw[start or quoted : len(raw) - end]
        body = re.sub(r"\\(.)", r"\1", body)
        kind = "exact" if start and end else "prefix" if start else "suffix" if end else "substring" if quoted or inverse else "fuzzy"
        if body:
            out.append(Word(body, kind, inverse))
    return out


def _prepared(name: Column, word: Word) -> tuple[Column, str]:
    if word.heeds_marks:
        return (name, word.text) if word.heeds_case else (F.lower(name), word.text.lower())
    if word.heeds_case:
        return name, word.text
    return folded(name), fold_text(word.text)


def matches(name: Column, pattern: str) -> Column:
    """Whether the name matches, without a score: all of it in the JVM."""

    def one(word: Word) -> Column:
        text, wanted = _prepared(name, word)
        test = {
            "fuzzy": lambda: text.rlike("(?s)" + ".*".join(map(re.escape, wanted))),
            "substring": lambda: text.contains(wanted),
            "prefix": lambda: text.startswith(wanted),
            "suffix": lambda: text.endswith(wanted),
            "exact": lambda: text == wanted,
        }[word.kind]()
        test = F.coalesce(test, F.lit(False))
        return ~test if word.inverse else test

    return reduce(lambda a, b: a & b, map(one, words(pattern)), F.lit(True))


def _bonuses(names: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the names as a padded matrix, and what a match at each is worth besides."""
    points = np.zeros((len(names), width), np.uint32)
    bonus = np.zeros((len(names), width), np.int32)
    for r, name in enumerate(names):
        before = " "
        for i, c in enumerate(name):
            points[r, i] = ord(c)
            if c.isalnum():
                if before.isspace():
                    bonus[r, i] = AT_SPACE
                elif before in DELIMITERS:
                    bonus[r, i] = AT_DELIMITER
                elif not before.isalnum():
                    bonus[r, i] = AT_WORD
                elif (c.isupper() and before.islower()) or (c.isdigit() and not before.isdigit()):
                    bonus[r, i] = AT_CAMEL
            before = c
    return points, bonus


def _fold_points(names: list[str], word: Word) -> list[str]:
    """The names as the word sees them, character for character."""
    if not word.heeds_marks:
        names = [n if n.isascii() else "".join(fold_keep(c) for c in n) for n in names]
    return names if word.heeds_case else ["".join(x if len(x := c.lower()) == 1 else c for c in n) for n in names]


def fold_keep(c: str) -> str:
    plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    return plain if len(plain) == 1 else c


def _align(points: np.ndarray, bonus: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The best score of the word as a subsequence of each name; hugely negative if it is none."""
    none = np.int32(NONE)
    here = np.where(points == word[0], MATCH + FIRST * bonus, none)
    for c in word[1:]:
        run = np.full_like(here, none)
        run[:, 1:] = here[:, :-1] + np.maximum(bonus[:, 1:], IN_RUN)
        gap = np.full_like(here, none)
        for i in range(2, here.shape[1]):
            gap[:, i] = np.maximum(here[:, i - 2] + GAP_START, gap[:, i - 1] + GAP_MORE)
        here = np.where(points == c, MATCH + np.maximum(run, gap + bonus), none)
    return here.max(axis=1)


def score_names(names: list[str], pattern: list[Word]) -> np.ndarray:
    """The score of each name, as floats; nan where it doesn't match."""
    total = np.zeros(len(names))
    width = max(map(len, names), default=0) + 1
    _, bonus = _bonuses(names, width)
    for word in pattern:
        text = word.text if word.heeds_case else word.text.lower()
        seen = _fold_points(names, word)
        if word.kind == "fuzzy":
            points, _ = _bonuses(seen, width)
            best = _align(points, bonus, np.array([ord(c) for c in text], np.uint32))
            total += np.where(best > NONE // 2, np.maximum(best, 0), np.nan)  # gaps may cost a match all its score
            continue
        found = {
            "substring": lambda n: n.find(text), "prefix": lambda n: 0 if n.startswith(text) else -1,
            "suffix": lambda n: len(n) - len(text) if n.endswith(text) else -1, "exact": lambda n: 0 if n == text else -1,
        }[word.kind]
        at = np.array([found(n) for n in seen])
        if word.inverse:
            total[at >= 0] = np.nan
        else:
            first = np.where(at >= 0, bonus[np.arange(len(names)), np.maximum(at, 0)], 0)
            total += np.where(at >= 0, MATCH * len(text) + FIRST * first + IN_RUN * (len(text) - 1), np.nan)
    return total


def fuzzy_score(name: Column, pattern: str) -> Column:
    """The score as DOUBLE, null where the name doesn't match. Names that can't match
    are told apart in the JVM and reach the scorer as null."""
    wanted = words(pattern)

    @pandas_udf("double")
    def score(names: pd.Series) -> pd.Series:
        out = np.full(len(names), np.nan)
        there = names.notna().to_numpy()
        if there.any():
            out[there] = score_names(names[there].tolist(), wanted)
        return pd.Series(out, index=names.index, dtype="Float64").where(~np.isnan(out), None)

    return score(F.when(matches(name, pattern), name))
