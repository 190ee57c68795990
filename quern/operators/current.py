"""The current row of every key in a table that holds older and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per `key`: the one greatest by `order` (null is oldest), then by content.

    One aggregation with a map-side combine, over only the named columns, so a key
    that holds a large part of the rows is reduced before the shuffle. Rows whose
    key is null belong to nothing and are left out. Repeated rows collapse. The
    columns must be orderable (no maps): equal `order` values are settled by the
    columns themselves, so the result doesn't depend on the order of the input.
    """
    best = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(best.alias("_best"))
        .select(key, *[F.col(f"_best.c{i}").alias(c) for i, c in enumerate(columns)])
    )


def current_columns(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The same row per `key`, for plans that use few of the columns.

    Each column is an aggregate of its own, so the optimizer drops those that a plan
    doesn't use, from the scan on. Of rows that are equal in all of `order` each column
    has its greatest value.
    """
    at = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    best = [F.max(F.struct(*at, F.col(c).alias("c")))["c"].alias(c) for c in columns]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*best)
