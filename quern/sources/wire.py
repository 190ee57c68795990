"""Wire formats: pages of starred items, language batches, envelopes, raw texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.display import parse_time

#: One starred item as it comes; times are text until they prove to be times.
ITEM = (
    "starred_at string, repo struct<id bigint, node_id string, name string, full_name string, owner struct<login string>, "
    "html_url string, description string, fork boolean, archived boolean, updated_at string, pushed_at string, "
    "stargazers_count bigint, language string, topics array<string>>"
)
PAGE_SIZE = 100
#: A batch of languages: repositories under aliases, null where one is gone.
BATCH = "data map<string, struct<databaseId bigint, languages struct<edges array<struct<size bigint, node struct<name string>>>>>>, errors array<struct<message string>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows of page files (each a JSON list of items, newest first): item columns, file (its path), position.

    The schema is given, so nothing is inferred; broken files are empty.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    items = text.select("file", F.posexplode(F.from_json("value", f"array<struct<{ITEM}>>")).alias("position", "item"))
    return items.select("file", "position", "item.*")


def parse_items(payload: Column) -> Column:
    """A payload as an item; null if it is not JSON."""
    return F.from_json(payload, ITEM)


def to_repos(items: DataFrame) -> DataFrame:
    """Items (starred_at, repo) as rows of the catalog: absent counts are 0, flags false,
    topics empty, undecodable times null; what the wire doesn't say is empty. Items
    without an id are left out; other columns of `items` come along."""
    others = [c for c in items.columns if c not in ("starred_at", "repo")]
    r = F.col("repo")
    return items.where(r["id"].isNotNull()).select(
        *others, r["id"].alias("id"), r["node_id"].alias("node_id"), r["full_name"].alias("full_name"), r["name"].alias("name"), r["owner"]["login"].alias("owner"),
        r["html_url"].alias("html_url"), r["description"].alias("description"), F.coalesce(r["stargazers_count"], F.lit(0)).alias("stargazers"),
        parse_time(r["pushed_at"]).alias("last_commit_at"), parse_time(F.col("starred_at")).alias("starred_at"), parse_time(r["updated_at"]).alias("updated_at"),
        r["language"].alias("primary_language"), F.create_map().cast("map<string,bigint>").alias("languages"), F.lit(None).cast("array<struct<login:string,avatar_url:string,contributions:bigint>>").alias("contributors"),
        F.coalesce(r["archived"], F.lit(False)).alias("archived"), F.coalesce(r["fork"], F.lit(False)).alias("fork"),
        F.coalesce(F.filter(r["topics"], lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("topics"),
    )


def unwrap(body: Column, schema: str) -> Column:
    """The `data` of an envelope (a JSON text of `data` and `errors`); if there is none,
    the query fails with the errors' messages joined."""
    told = F.from_json(body, f"data {schema}, errors array<struct<message string>>")
    messages = F.array_join(told["errors"]["message"], "; ")
    return F.coalesce(told["data"], F.raise_error(F.coalesce(F.nullif(messages, F.lit("")), F.lit("no data"))))


def language_batches(batches: DataFrame, body: str) -> DataFrame:
    """id, languages MAP: from JSON texts of language batches. Null nodes are skipped, a
    missing size is 0, of a repeated name the last counts; a batch that has no `data`
    gives nothing."""
    told = batches.select(F.explode(F.from_json(body, BATCH)["data"]).alias("alias", "node")).where(F.col("node.databaseId").isNotNull())
    edges = F.filter(F.coalesce(F.col("node.languages.edges"), F.array().cast("array<struct<size:bigint,node:struct<name:string>>>")), lambda e: e["node"]["name"].isNotNull())
    pairs = F.transform(edges, lambda e: F.struct(e["node"]["name"].alias("name"), F.coalesce(e["size"], F.lit(0)).alias("size")))
    # Later entries replace earlier ones of the same name, whatever the session's map policy is.
    last = F.aggregate(pairs, F.create_map().cast("map<string,bigint>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["name"]), F.create_map(p["name"], p["size"])))
    return told.select(F.col("node.databaseId").alias("id"), last.alias("languages"))


def full_name_aliases(full_names: list[str]) -> dict[str, tuple[str, str]]:
    """Alias to (owner, name) of the repositories a batch asks for; names without a slash are skipped."""
    parts = [n.split("/", 1) for n in full_names if "/" in n]
    return {f"r{i}": (owner, name) for i, (owner, name) in enumerate(parts)}


def conditional(rows: DataFrame, remote: DataFrame) -> DataFrame:
    """What a conditional fetch of `rows` (id, etag) would bring from `remote` (id, etag, ...):
    status 304 where the tags are equal, 200 with the remote columns where not, 404 where it is gone."""
    there = remote.withColumn("_there", F.lit(True)).withColumnRenamed("etag", "new_etag")
    status = F.when(F.col("_there").isNull(), 404).when(F.col("etag") == F.col("new_etag"), 304).otherwise(200)
    return rows.select("id", "etag").join(there, "id", "left").withColumn("status", status).drop("_there")


def first_contributors(contributors: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The first `limit` contributors of each record, in listed order (node)."""
    listed = contributors.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("node", "login", "contributions"))), 1, limit).alias("_c"))
    return listed.select(key, F.explode("_c").alias("c")).select(key, "c.login", "c.contributions")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file and text of raw text files, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
