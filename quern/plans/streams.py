"""Streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ensure_checkpoint_dir
from quern.sources.wire import parse_items
from quern.streaming.sync import Catalog, stream


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after all star items went through the streaming sync, file by file."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/star_items.parquet").schema
    items = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/star_items.parquet*")
    parsed = items.select("snapshot_no", "page", "pos", "received_at", parse_items(F.col("payload")).alias("i")).where(F.col("i.repo").isNotNull())
    rows = parsed.select("i.starred_at", "i.repo", F.struct("snapshot_no", "page", "pos", "received_at").alias("ordinal"))
    catalog = Catalog(spark, f"{base}/tables")
    stream(catalog, rows, f"{base}/checkpoint").awaitTermination()
    return catalog.read("repos").select("id", "full_name", "stargazers")


QUERIES = {"stream_sync": stream_sync}
SQL = {
    "stream_sync": """SELECT TRY_CAST(p->>'$.repo.id' AS BIGINT) AS id, p->>'$.repo.full_name' AS full_name, coalesce(TRY_CAST(p->>'$.repo.stargazers_count' AS BIGINT), 0) AS stargazers
FROM (SELECT *, payload::JSON AS p FROM star_items WHERE json_valid(payload)) WHERE TRY_CAST(p->>'$.repo.id' AS BIGINT) IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY TRY_CAST(p->>'$.repo.id' AS BIGINT) ORDER BY snapshot_no DESC, page DESC, pos DESC, received_at DESC) = 1"""
}
