"""Search: filter, fuzzy and full-text scores, one blended rank under a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.fulltext import LIMIT, bm25, index_texts, postings_bm25, top
from quern.functions.fuzzy import fuzzy_score
from quern.operators.ordering import effective_sort, order_columns
from quern.operators.predicates import facet_predicate, query_predicate
from quern.plans.query import SortKey, parse
from quern.session import cut_lineage

# The weights of the two signals.
FUZZY_WEIGHT, FTS_WEIGHT = 0.7, 0.3

_KEPT = ["id", "full_name", "stargazers", "last_commit_at", "starred_at"]


def blend(scored: DataFrame) -> DataFrame:
    """fuzzy (null: no match) and fts (null or below 0: none) to score; rows with
    neither signal drop out. Each signal is divided by its maximum over these rows.

    The matching rows, narrow ones, are written once, so that the maxima don't cost
    the scores a second time.
    """
    fts = F.greatest(F.coalesce("fts", F.lit(0.0)), F.lit(0.0))
    kept = cut_lineage(scored.withColumn("fts", fts).where(F.col("fuzzy").isNotNull() | (F.col("fts") > 0)).withColumn("fuzzy", F.coalesce("fuzzy", F.lit(0.0))))
    best = kept.agg(F.max("fuzzy").alias("fuzzy"), F.max("fts").alias("fts")).first()
    share = lambda c: F.col(c) / F.lit(float(best[c])) if best[c] else F.lit(0.0)
    return kept.withColumns({"fuzzy": share("fuzzy"), "fts": share("fts")}).withColumn("score", FUZZY_WEIGHT * F.col("fuzzy") + FTS_WEIGHT * F.col("fts"))


def search(view: DataFrame, text: str, tags: set[str] = frozenset(), groups: set[str] = frozenset(), header: SortKey | None = None, fts: bool = True, index: DataFrame | tuple[DataFrame, DataFrame] | None = None, fts_limit: int = LIMIT, limit: int | None = None) -> DataFrame:
    """id, full_name, stargazers, last_commit_at, starred_at, fuzzy, fts, score, in order.

    view: the catalog. Clauses and facets filter before anything is scored; statistics
    of the full-text index are over the whole view all the same. A query without free
    text keeps all rows that pass, with zeros for scores. fts=False gives what the fuzzy
    signal alone says; index: token lists (index_texts) or postings and lengths written
    before, of which a query reads only its own words. Of the full-text hits the
    fts_limit best ones count. limit: only the first rows, for which no global sort is
    needed; None for all.
    """
    query = parse(text)
    order = order_columns(effective_sort(query, header))
    passing = view.where(query_predicate(query) & facet_predicate(set(tags), set(groups))).select(*_KEPT)
    if not query.has_text:
        zero = {c: F.lit(0.0) for c in ("fuzzy", "fts", "score")}
        return _first(passing.withColumns(zero).orderBy(*order), limit)
    scored = passing.withColumn("fuzzy", fuzzy_score(F.col("full_name"), query.text))
    if fts:
        if isinstance(index, tuple):
            scores = postings_bm25(*index, query.terms)
        else:
            scores = bm25(index if index is not None else index_texts(view), query.terms)
        best = top(scores, fts_limit).withColumnRenamed("rel", "fts")  # fts_limit rows
        scored = scored.join(best, "id", "left")
    else:
        scored = scored.withColumn("fts", F.lit(None).cast("double"))
    return _first(blend(scored).orderBy(*order), limit)


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def retained(results: DataFrame, selected_id: int | None) -> DataFrame:
    """The selected row if it is still among the results, else their first row."""
    if selected_id is not None:
        kept = results.where(F.col("id") == selected_id).limit(1)
        if kept.head(1):
            return kept
    return results.limit(1)
