"""Maintenance of the catalog's tables: upserts, tags, groups, deletes, point updates.

Every operator is a function from the current tables to their next state; the caller
writes the result as a new version (quern.sources.tables). Inputs that may repeat a
key carry an ordinal, and the last one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.names import trimmed

#: Columns of repositories that an upsert never touches.
KEPT = ("etag", "readme_md", "readme_fetched_at")


#: Columns that an upsert fills but never empties, and when a value counts as there.
FILLED = {
    "languages": lambda c: F.size(c) > 0,
    "contributors": lambda c: F.size(c) > 0,
    "starred_at": lambda c: c.isNotNull(),
}


def place(rows: DataFrame, ordinal: str) -> Column:
    """The order of rows: by ordinal (null first); of equal ordinals by a hash of the row,
    so that the last one is the same whatever the order of the input."""
    return F.struct(F.col(ordinal), F.xxhash64(*[F.array_sort(F.map_entries(n)) if t.startswith("map<") else F.col(n) for n, t in rows.dtypes]))


def last_of(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key by ordinal, by one aggregation with a map-side combine."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), place(rows, ordinal)).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def _row_after_row(rows: DataFrame, ordinal: str) -> DataFrame:
    """One row per id, as if the rows had been upserted one after the other: the last row,
    but of FILLED columns the last value that is there (else the last row's)."""
    others = [c for c in rows.columns if c != "id"]
    at = place(rows, ordinal)
    filled = [c for c in FILLED if c in others]
    told = rows.groupBy("id").agg(F.max_by(F.struct(*others), at).alias("_last"), *[F.max_by(c, F.when(FILLED[c](F.col(c)), at)).alias(f"_{c}") for c in filled])
    return told.select("id", *[(F.coalesce(F.col(f"_{c}"), F.col(f"_last.{c}")) if c in filled else F.col(f"_last.{c}")).alias(c) for c in others])


def upsert(existing: DataFrame, incoming: DataFrame, ordinal: str, now: Column) -> DataFrame:
    """The repositories after `incoming` is put in row by row, in the order of its ordinal.

    New values replace old ones, except: empty or null languages and contributors and a
    null starred_at keep the value before, which may be that of an earlier incoming row;
    KEPT columns stay as they are; a null synced_at is `now`. Both tables have the
    columns of `existing` (KEPT ones may be missing from incoming). A new repository
    without contributors has null ones. Of rows with equal id and ordinal one counts as
    the last, always the same. Rows without an id change nothing.
    """
    new = _row_after_row(incoming.where(F.col("id").isNotNull()), ordinal).drop(ordinal)
    joined = existing.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), F.col("o.id") == F.col("n.id"), "full")
    came = F.coalesce(F.col("n._new"), F.lit(False))
    out = [F.coalesce("n.id", "o.id").alias("id")]
    for c in existing.columns:
        if c == "id":
            continue
        if c in KEPT or c not in new.columns:
            value = F.col(f"o.{c}")
        elif c in FILLED:
            fresh = F.when(FILLED[c](F.col(f"n.{c}")), F.col(f"n.{c}"))
            empty = F.when(F.col("o.id").isNull(), F.col(f"n.{c}")) if c == "languages" else F.lit(None)
            value = F.coalesce(fresh, f"o.{c}", empty)
        elif c == "synced_at":
            value = F.when(came, F.coalesce(f"n.{c}", now)).otherwise(F.col(f"o.{c}"))
        else:
            value = F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append(value.alias(c))
    return joined.select(*out)


def mirror_topics(links: DataFrame, upserted: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Tag links after the topics of the upserted repositories became their `github` tags.

    With an ordinal, a repository may be upserted more than once, and the topics of its
    last row count; without, each id stands once."""
    if ordinal is not None:
        upserted = last_of(upserted.select("id", "topics", ordinal), ["id"], ordinal)
    ids = upserted.select(F.col("id").alias("repo_id")).distinct()
    kept = links.join(ids.withColumn("_u", F.lit(True)), "repo_id", "left").where(F.col("_u").isNull() | (F.col("source") != "github")).drop("_u")
    topics = upserted.select(F.col("id").alias("repo_id"), F.explode("topics").alias("name")).where(F.col("name").isNotNull()).distinct()
    return kept.unionByName(topics.select("repo_id", "name", F.lit("github").alias("source"), F.lit(1.0).alias("confidence")))


def replace_ai_tags(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tag links after the `ai` tags of every repository in `incoming` were replaced.

    incoming: repo_id, name, confidence, ordinal; a null name stands for a repository
    whose tags are just dropped. A name that a user tag of the repository has, in any
    case, is left out; of a repeated name the last confidence counts.
    """
    ids = incoming.select("repo_id").distinct().withColumn("_u", F.lit(True))
    kept = links.join(ids, "repo_id", "left").where(F.col("_u").isNull() | (F.col("source") != "ai")).drop("_u")
    by_user = links.where(F.col("source") == "user").select("repo_id", F.lower("name").alias("_low")).distinct()
    new = last_of(incoming.where(F.col("name").isNotNull()), ["repo_id", "name"], "ordinal").drop("ordinal")
    new = new.withColumn("_low", F.lower("name")).join(by_user, ["repo_id", "_low"], "left_anti")
    return kept.unionByName(new.select("repo_id", "name", F.lit("ai").alias("source"), F.col("confidence").cast("double").alias("confidence")))


def add_user_tags(links: DataFrame, added: DataFrame) -> DataFrame:
    """Tag links with user tags (repo_id, name) added; names are trimmed, blank ones skipped."""
    named = added.select("repo_id", trimmed(F.col("name")).alias("name")).where(F.col("name") != "").distinct()
    new = named.join(links.where(F.col("source") == "user").select("repo_id", "name"), ["repo_id", "name"], "left_anti")
    return links.unionByName(new.select("repo_id", "name", F.lit("user").alias("source"), F.lit(1.0).alias("confidence")))


def remove_tags(links: DataFrame, removed: DataFrame) -> DataFrame:
    """Tag links without those named exactly by (repo_id, name, source)."""
    return links.join(removed.select("repo_id", "name", "source"), ["repo_id", "name", "source"], "left_anti")


def promote_tags(links: DataFrame, promoted: DataFrame) -> DataFrame:
    """Tag links after `ai` tags (repo_id, name) became user tags."""
    return add_user_tags(remove_tags(links, promoted.withColumn("source", F.lit("ai"))), promoted)


def prune_tags(tags: DataFrame, links: DataFrame) -> DataFrame:
    """The tags (name, source) that some repository still holds."""
    return tags.join(links.select("name", "source"), ["name", "source"], "left_semi")


def replace_ai_groups(groups: DataFrame, members: DataFrame, incoming: DataFrame, incoming_members: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and their members after the `ai` groups were replaced.

    groups: name, summary, source; members: repo_id, group_name; incoming: name,
    summary, ordinal; incoming_members: name, full_name. A name that a remaining group
    has changes that group's summary alone. Members are found by exact full name;
    unknown ones are ignored. Members stay rows throughout, so a group may be of any size.
    """
    gone = groups.where(F.col("source") == "ai").select(F.col("name").alias("group_name"))
    kept = groups.where((F.col("source") != "ai") | F.col("source").isNull())
    new = last_of(incoming, ["name"], "ordinal").select("name", F.coalesce("summary", F.lit("")).alias("summary"))
    joined = kept.alias("k").join(new.alias("n"), "name", "full")
    next_groups = joined.select("name", F.coalesce("n.summary", "k.summary").alias("summary"), F.coalesce("k.source", F.lit("ai")).alias("source"))
    linked = incoming_members.select(F.col("name").alias("group_name"), "full_name").join(repos.select(F.col("id").alias("repo_id"), "full_name"), "full_name").select("repo_id", "group_name")
    next_members = members.join(gone, "group_name", "left_anti").select("repo_id", "group_name").unionByName(linked).distinct()
    return next_groups, next_members


def delete_repos(ids: DataFrame, repos: DataFrame, tags: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repositories, tag links and group members without the given ids (a column id);
    tags and groups themselves stay."""
    gone = ids.select(F.col("id")).distinct()
    by_repo = gone.withColumnRenamed("id", "repo_id")
    return repos.join(gone, "id", "left_anti"), tags.join(by_repo, "repo_id", "left_anti"), members.join(by_repo, "repo_id", "left_anti")


def set_column(rows: DataFrame, delta: DataFrame, column: str) -> DataFrame:
    """Rows with `column` set from delta (id, value); ids that aren't there change
    nothing, a null value is set like any other."""
    given = delta.select("id", F.struct("value").alias("_set"))
    joined = rows.join(given, "id", "left")
    return joined.withColumn(column, F.when(F.col("_set").isNotNull(), F.col("_set.value")).otherwise(F.col(column))).select(*rows.columns)


def merge_delta(snapshot: DataFrame, delta: DataFrame, removed: DataFrame) -> DataFrame:
    """The snapshot with the delta's rows in place of its own, less the removed ids."""
    stay = snapshot.join(delta.select("id").unionByName(removed.select("id")), "id", "left_anti")
    return stay.unionByName(delta.select(*snapshot.columns).join(removed.select("id"), "id", "left_anti"))


def state_put(state: DataFrame, values: dict[str, str | None]) -> DataFrame:
    """The key-value table with values set, or cleared where None."""
    kept = state.where(~F.col("key").isin(list(values)))
    rows = [(k, v) for k, v in values.items() if v is not None]
    return kept.unionByName(state.sparkSession.createDataFrame(rows, "key string, value string"))


def state_get(state: DataFrame, key: str) -> str | None:
    row = state.where(F.col("key") == key).select("value").first()
    return row[0] if row else None


RUNS = "id bigint, provider string, model string, started_at timestamp, finished_at timestamp, repos_count bigint"


def begin_run(runs: DataFrame, provider: str, model: str, at: Column) -> DataFrame:
    """The run log with a run begun: the next id, no finish."""
    following = (runs.agg(F.max("id")).first()[0] or 0) + 1
    row = runs.sparkSession.range(1).select(F.lit(following).cast("bigint").alias("id"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(0).cast("bigint").alias("repos_count"))
    return runs.unionByName(row)


def finish_run(runs: DataFrame, run_id: int, at: Column, repos_count: int) -> DataFrame:
    mine = F.col("id") == run_id
    return runs.withColumns({"finished_at": F.when(mine, at).otherwise(F.col("finished_at")), "repos_count": F.when(mine, F.lit(repos_count)).otherwise(F.col("repos_count"))})


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def newer_than(pages: DataFrame, watermark: Column, position: list[str], within: list[str] | None = None) -> DataFrame:
    """The leading rows of a listing, newest first, up to the first that is not newer
    than the watermark; an unknown time counts as new.

    The first stale position of each listing is found by one aggregation, so no
    listing has to be ordered in one task.
    """
    place = F.struct(*position)
    stale = pages.where(F.col("starred_at") <= watermark)
    if within is None:  # one listing: its stop is one row
        stop = F.broadcast(stale.agg(F.min(place).alias("_stop")).withColumn("_one", F.lit(1)))
        joined = pages.withColumn("_one", F.lit(1)).join(stop, "_one")
        return joined.where(F.col("_stop").isNull() | (place < F.col("_stop"))).drop("_stop", "_one")
    stops = stale.groupBy(*within).agg(F.min(place).alias("_stop"))
    return pages.join(stops, within, "left").where(F.col("_stop").isNull() | (place < F.col("_stop"))).drop("_stop")


def unseen(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known ids that a full listing no longer shows."""
    return known.select("id").distinct().join(seen.select("id"), "id", "left_anti")


def apply_refresh(view: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """Rows after a conditional refresh.

    fetched: id, status and the columns of a fresh row. 304 and 404 set synced_at
    alone; 200 takes the new values but keeps starred_at; any other status and rows not
    asked for stay as they are.
    """
    other = [c for c in fetched.columns if c not in ("id", "status") and c in view.columns]
    joined = view.alias("o").join(fetched.alias("f"), F.col("o.id") == F.col("f.id"), "left")
    status = F.coalesce(F.col("f.status"), F.lit(0))
    out = []
    for c in view.columns:
        if c == "synced_at":
            out.append(F.when(status.isin(200, 304, 404), now).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in other and c not in ("starred_at", *KEPT):
            out.append(F.when(status == 200, F.col(f"f.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return joined.select(*out)
