"""The names that the current repositories hold, as arrays of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import name_keys
from quern.operators.current import current_rows
from quern.session import read_table


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "repos")


def current(rows: DataFrame, *columns: str) -> DataFrame:
    """id and the named columns of the current row of each repository."""
    return current_rows(rows, "id", ["synced_at", "seq"], list(columns))


def count_current(rows: DataFrame) -> int:
    """N, the number of distinct repositories."""
    return rows.where(F.col("id").isNotNull()).select("id").distinct().count()


def keys_of(*columns: str):
    """All keys of the named columns in one array, sorted, each once."""
    arrays = [name_keys(F.col(f"{c}.name" if c == "tags" else c)) for c in columns]
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


#: The current rows in DuckDB SQL.
CURRENT_SQL = """current AS (
  SELECT * FROM repos WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY synced_at DESC NULLS LAST, seq DESC NULLS LAST) = 1
)"""
