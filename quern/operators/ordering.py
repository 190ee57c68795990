"""Sort orders, and ranks computed without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.query import Query, SortKey
from quern.session import cut_lineage


def tie_break() -> list[Column]:
    """Ends every order: stars descending, full name ascending, then id."""
    return [F.desc("stargazers"), F.asc("full_name"), F.asc("id")]


def order_columns(key: SortKey) -> list[Column]:
    lead = {
        SortKey.RELEVANCE: [F.desc("score")],
        SortKey.STARS: [],
        SortKey.NAME: [F.asc(F.lower("full_name"))],
        SortKey.RECENT: [F.desc_nulls_last("last_commit_at")],
        SortKey.STARRED: [F.desc_nulls_last("starred_at")],
    }
    return lead[key] + tie_break()


def effective_sort(query: Query, header: SortKey | None = None) -> SortKey:
    """`sort:` before the header's choice before the default."""
    return query.sort or header or (SortKey.RELEVANCE if query.has_text else SortKey.STARRED)


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based place in the order. The order must be total.

    A range-partitioned sort; only the number of rows of each partition (one number
    per partition) comes to the driver, to number the partitions on.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    offset, rows = 0, []
    for p, n in sizes:
        rows.append((p, offset))
        offset += n
    table = df.sparkSession.createDataFrame(rows, "_p bigint, _before bigint")
    within = F.col("_at") - F.shiftleft(part, 33)
    return placed.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_before") + within + 1).drop("_at", "_p", "_before")


def chunked(df: DataFrame, order: list[Column], size: int = 25) -> DataFrame:
    """Adds batch: rows in order, `size` at a time from 0, the last one partial."""
    ranked = with_rank(df, order, "_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / F.lit(size)).cast("bigint")).drop("_rank")
