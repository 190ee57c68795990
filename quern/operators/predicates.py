"""Clauses and facets as DataFrame predicates.

Predicates are two-valued: what is missing is simply not equal, so a negated clause
holds on a null. Comparisons fold the case of ASCII letters alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.query import Clause, Query, StarRange, ascii_lower

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """Lower case for ASCII letters only."""
    return F.translate(text, _UPPER, _LOWER)


def _has(values: Column, wanted: str) -> Column:
    return F.exists(values, lambda v: fold(v) == ascii_lower(wanted))


def _meaning(clause: Clause) -> Column:
    value = clause.value
    if isinstance(value, StarRange):
        stars, tests = F.col("stargazers"), [F.lit(True)]
        if value.low is not None:
            tests.append(stars >= value.low)
        if value.high is not None:
            tests.append(stars <= value.high)
        return reduce(lambda a, b: a & b, tests)
    return {
        "language": lambda: (fold(F.col("primary_language")) == ascii_lower(value)) | _has(F.map_keys("languages"), value),
        "tag": lambda: _has(F.col("tags.name"), value) | _has(F.col("topics"), value),
        "group": lambda: _has(F.col("groups"), value),
        "owner": lambda: fold(F.col("owner")) == ascii_lower(value),
        "archived": lambda: F.col("archived") == value,
        "fork": lambda: F.col("fork") == value,
    }[clause.field]()


def clause_predicate(clause: Clause) -> Column:
    # `or false` on each part keeps null out, as in `null or true`.
    holds = F.coalesce(_meaning(clause), F.lit(False))
    return ~holds if clause.negated else holds


def query_predicate(query: Query) -> Column:
    """All clauses hold. Free text never filters by itself."""
    return reduce(lambda a, b: a & b, map(clause_predicate, query.clauses), F.lit(True))


def facet_predicate(tags: set[str], groups: set[str]) -> Column:
    """One of the tags (of any source, not topics) and one of the groups; an empty set asks nothing."""
    asked = []
    for chosen, held in ((tags, F.col("tags.name")), (groups, F.col("groups"))):
        if chosen:
            wanted = F.array(*[F.lit(ascii_lower(c)) for c in sorted(chosen)])
            asked.append(F.arrays_overlap(F.transform(F.filter(held, lambda x: x.isNotNull()), fold), wanted))
    return reduce(lambda a, b: a & b, asked, F.lit(True))


def known_selection(selected: set[str], facets: DataFrame) -> set[str]:
    """The selected names that still are facets (same case); the selection bounds what is collected."""
    return {r[0] for r in facets.where(F.col("name").isin(sorted(selected))).select("name").distinct().collect()} if selected else set()


def stale_rows(view: DataFrame, cutoff: Column) -> DataFrame:
    """Rows never synced, or last synced before the cut-off, oldest first."""
    return view.where(F.col("synced_at").isNull() | (F.col("synced_at") < cutoff)).orderBy(F.asc_nulls_first("synced_at"), "id")


def without_languages(view: DataFrame, limit: int) -> DataFrame:
    """The `limit` most starred rows that have no languages yet."""
    return view.where(F.size("languages") == 0).orderBy(F.desc("stargazers"), "id").limit(limit)


def fresh(fetched_at: Column, cutoff: Column) -> Column:
    """Whether a cached text is still fresh; an unknown time is not."""
    return F.coalesce(fetched_at >= cutoff, F.lit(False))


def summaries(view: DataFrame) -> DataFrame:
    """What enrichment sees of a repository: absent parts are null and left out of JSON."""
    return view.select(
        "id", "full_name", "description",
        F.when(F.size("topics") > 0, F.col("topics")).alias("topics"), F.col("primary_language").alias("language"),
    )
