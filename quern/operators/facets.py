"""Facets: how many repositories hold each tag and each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.catalog import TAG_SOURCES, source_rank
from quern.operators.predicates import fold



def tag_facets(links: DataFrame) -> DataFrame:
    """name, source, count, most used first."""
    return links.groupBy("name", "source").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name", "source")


def group_facets(groups: DataFrame, links: DataFrame) -> DataFrame:
    """name, summary, count, most used first; groups without members are there with 0."""
    counted = links.groupBy("group_name").agg(F.count("*").alias("n"))
    joined = groups.join(counted, groups["name"] == counted["group_name"], "left")
    return joined.select("name", "summary", F.coalesce("n", F.lit(0)).alias("count")).orderBy(F.desc("count"), "name")


def merged_facets(facets: DataFrame) -> DataFrame:
    """name, source, count over all sources: names that differ in ASCII case alone are
    one facet, spelled as its most used form, with the strongest source; facets of a
    single repository are left out."""
    best = F.min(F.struct((-F.col("count")).alias("n"), "name", "source"))
    merged = facets.groupBy(fold(F.col("name")).alias("_key")).agg(best.alias("_b"), F.sum("count").alias("count"), F.max(source_rank(F.col("source"))).alias("_s"))
    strongest = F.element_at(F.array(*map(F.lit, TAG_SOURCES)), F.col("_s") + 1)
    return merged.where(F.col("count") > 1).select(F.col("_b.name").alias("name"), strongest.alias("source"), "count").orderBy(F.desc("count"), "name")


def facet_head(facets: DataFrame, n: int = 40) -> DataFrame:
    """The n first facets."""
    return facets.orderBy(F.desc("count"), "name").limit(n)
