"""The catalog: one denormalised row per repository, and the normal tables behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.current import current_columns

# Tag sources from weakest to strongest.
TAG_SOURCES = ("github", "ai", "user")

COLUMNS = ["node_id", "full_name", "name", "owner", "html_url", "description", "stargazers", "primary_language", "languages_json", "archived", "fork", "topics", "tags", "groups", "last_commit_at", "starred_at", "updated_at", "synced_at", "etag"]


def stored_languages(text: Column) -> Column:
    """The stored form of languages, {name: bytes}, as a map; {} for anything else."""
    parsed = F.from_json(text, "map<string,bigint>", {"mode": "PERMISSIVE"})
    whole = parsed.isNotNull() & ~F.exists(F.map_values(parsed), lambda v: v.isNull())
    return F.when(whole, parsed).otherwise(F.create_map().cast("map<string,bigint>"))


def stored_contributors(text: Column) -> Column:
    """The stored form of contributors, a JSON list of objects; null for anything else.

    The text is parsed inside a list, so that anything after its end shows as broken."""
    one = F.from_json(F.concat(F.lit('[{"r":'), text, F.lit("}]")), "array<struct<r: array<struct<login: string, avatar_url: string, contributions: bigint>>>>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    return F.when(text.rlike("^[ \\t\\r\\n]*\\[") & (F.size(one) == 1), one[0]["r"])


def source_rank(source: Column) -> Column:
    """0, 1, 2 from weakest to strongest; an unknown source counts as the weakest."""
    rank = F.lit(0)
    for i, name in enumerate(TAG_SOURCES):
        rank = F.when(source == name, i).otherwise(rank)
    return rank


def ordered_tags(tags: Column) -> Column:
    """Tags by source (as text, descending), confidence descending, name; nameless ones left out."""
    named = F.filter(F.coalesce(tags, F.array().cast("array<struct<name:string,source:string,confidence:float>>")), lambda t: t.isNotNull() & t["name"].isNotNull())
    compare = lambda a, b: (
        F.when(a["source"] > b["source"], -1).when(a["source"] < b["source"], 1)
        .when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1)
        .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    )
    return F.array_sort(named, compare)


def texts(column: str) -> Column:
    """A list of texts, never null, without null ones."""
    return F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: x.isNotNull())


def catalog(repos: DataFrame) -> DataFrame:
    """The search view: the current row of every id, lists never null, tags and groups in order.

    A plan scans and shuffles id, synced_at, seq and the columns that it asks of the
    view, no others. Rows without an id are left out.
    """
    rows = current_columns(repos, "id", ["synced_at", "seq"], COLUMNS)
    return rows.select(
        "id", *[c for c in COLUMNS if c not in ("languages_json", "topics", "tags", "groups", "stargazers", "archived", "fork")],
        F.coalesce("stargazers", F.lit(0)).alias("stargazers"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        F.coalesce("fork", F.lit(False)).alias("fork"),
        stored_languages(F.col("languages_json")).alias("languages"),
        texts("topics").alias("topics"), ordered_tags(F.col("tags")).alias("tags"), F.array_sort(texts("groups")).alias("groups"),
    )


def tag_links(view: DataFrame) -> DataFrame:
    """repo_id, name, source, confidence: one row per repository, name and source, the
    greatest confidence of repeated ones."""
    each = view.select(F.col("id").alias("repo_id"), F.explode("tags").alias("t"))
    rows = each.select("repo_id", F.col("t.name").alias("name"), F.col("t.source").alias("source"), F.col("t.confidence").cast("double").alias("confidence"))
    return rows.groupBy("repo_id", "name", "source").agg(F.max("confidence").alias("confidence"))


def group_links(view: DataFrame) -> DataFrame:
    """repo_id, group_name: one row per repository and group."""
    return view.select(F.col("id").alias("repo_id"), F.explode(F.array_distinct("groups")).alias("group_name"))


def with_lists(repos: DataFrame, tags: DataFrame, groups: DataFrame) -> DataFrame:
    """The view put together from the normal tables: repositories with the ordered
    lists of their tags and groups, empty where there are none."""
    listed = tags.groupBy("repo_id").agg(ordered_tags(F.collect_list(F.struct("name", "source", F.col("confidence").cast("float").alias("confidence")))).alias("tags"))
    grouped = groups.groupBy("repo_id").agg(F.array_sort(F.collect_list("group_name")).alias("groups"))
    joined = repos.join(listed.withColumnRenamed("repo_id", "id"), "id", "left").join(grouped.withColumnRenamed("repo_id", "id"), "id", "left")
    return joined.withColumns({"tags": ordered_tags(F.col("tags")), "groups": F.coalesce("groups", F.array().cast("array<string>"))})


def record(repos: DataFrame, tags: DataFrame, groups: DataFrame, id: int) -> DataFrame:
    """All columns of one repository with the ordered lists of its tags and groups; no row
    if it isn't there. The id is filtered in each table before anything is joined."""
    mine = lambda links: links.where(F.col("repo_id") == id)
    return with_lists(repos.where(F.col("id") == id), mine(tags), mine(groups))


def records(repos: DataFrame, tags: DataFrame, groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for many repositories (a column id)."""
    ids = wanted.select("id").distinct()
    mine = lambda links: links.join(ids.withColumnRenamed("id", "repo_id"), "repo_id", "left_semi")
    return with_lists(repos.join(ids, "id", "left_semi"), mine(tags), mine(groups))
