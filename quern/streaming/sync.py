"""Synchronisation of the catalog with a listing of stars, in batches and as a stream.

State is a key-value table: the watermark is the newest starring time seen, a cursor,
not an event-time watermark. Rows older than it are skipped for good; only a
difference in counts leads to a full reconciliation. It is moved when a run has taken
all of its input, never between the batches of one run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quern.functions.display import format_time, parse_time
from quern.operators.catalog import record
from quern.operators.predicates import fresh, stale_rows, without_languages
from quern.operators.store import apply_refresh, delete_repos, mirror_topics, newer_than, prune_tags, set_column, state_get, state_put, unseen, upsert
from quern.session import cut_lineage
from quern.sources.tables import TableStore, Transaction
from quern.sources.wire import to_repos

WATERMARK, INITIAL_DONE, LAST_RUN = "sync.watermark", "sync.initial_done", "sync.last_run"
#: The newest starring time in the batches of a stream's run that has not ended yet.
NEWEST = "sync.stream_newest"
#: Budgets of one run.
REFRESHES, BACKFILLS, BATCH = 250, 500, 25
STALE_AFTER = "24 hours"
TEXT_FRESH = "7 days"
INTERVAL = "15 minutes"


class Cancelled(RuntimeError):
    """A run that was asked to stop and did, between two steps."""


@dataclass
class Summary:
    """What one run did: rows seen and put in, repositories removed, filled and refreshed."""

    mode: str
    seen: int = 0
    written: int = 0
    removed: int = 0
    languages_filled: int = 0
    metadata_refreshed: int = 0


class Catalog:
    """The catalog's tables in a TableStore: repos, tag_links, tags, groups, group_members,
    state; after a stream also places, the ordinals of what repos holds."""

    TABLES = {
        "repos": "id bigint, node_id string, full_name string, name string, owner string, html_url string, description string, stargazers bigint, last_commit_at timestamp, starred_at timestamp, updated_at timestamp, primary_language string, languages map<string,bigint>, contributors array<struct<login:string,avatar_url:string,contributions:bigint>>, archived boolean, fork boolean, topics array<string>, synced_at timestamp, etag string, readme_md string, readme_fetched_at timestamp",
        "tag_links": "repo_id bigint, name string, source string, confidence double",
        "tags": "name string, source string",
        "groups": "name string, summary string, source string",
        "group_members": "repo_id bigint, group_name string",
        "state": "key string, value string",
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, TableStore(spark, root)
        with self.tables.transaction() as t:
            for name, schema in self.TABLES.items():
                if not t.exists(name):
                    t.write(name, spark.createDataFrame([], schema))

    def read(self, name: str) -> DataFrame:
        return self.tables.read(name)

    def get(self, key: str) -> str | None:
        return state_get(self.read("state"), key)

    def put(self, t: Transaction | None = None, **values: str | None) -> None:
        """Sets state; `__` in a name stands for a dot, None clears."""
        t = t or self.tables
        named = {k.replace("__", "."): v for k, v in values.items()}
        t.write("state", state_put(t.read("state"), named))

    def record(self, id: int) -> DataFrame:
        """Everything about one repository, in one row (none if it isn't there): its
        columns, contributors among them, with the ordered lists of its tags and groups."""
        return record(self.read("repos"), self.read("tag_links"), self.read("group_members"), id)

    def absorb(self, t: Transaction, rows: DataFrame, ordinal: str, now: Column) -> None:
        """Upserts rows and mirrors their topics as tags."""
        t.write("repos", upsert(t.read("repos"), rows, ordinal, now), ["id"])
        self.link(t, mirror_topics(t.read("tag_links"), rows, ordinal))

    def link(self, t: Transaction, links: DataFrame) -> None:
        """Writes the tag links; tags that they name and that aren't there are added."""
        t.write("tag_links", links, ["repo_id"])
        t.write("tags", t.read("tags").unionByName(t.read("tag_links").select("name", "source")).distinct())

    def absorb_placed(self, rows: DataFrame, now: Column) -> None:
        """Absorbs rows (with a column ordinal) that may be older than what is there: of each
        repository the row with the greatest ordinal so far counts, and of the rows with
        a starring time the last one gives it. So the tables don't depend on how rows
        are cut into batches. Of equal ordinals the one that comes later counts.
        """
        place = F.struct("ordinal")  # compares null as least
        timed = F.when(F.col("starred_at").isNotNull(), place)
        others = [c for c in rows.columns if c not in ("id", "starred_at")]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*others), place).alias("_last"), F.max(place).alias("place"), F.max_by("starred_at", timed).alias("starred_at"), F.max(timed).alias("timed_place"))
        columns = ["id", "place", "timed_place"]
        if self.tables.exists("places"):
            stored = self.read("places").join(self.read("repos").select("id"), "id", "left_semi")
        else:
            stored = self.spark.createDataFrame([], StructType([last.schema[c] for c in columns]))
        held = stored.select("id", F.col("place").alias("_place"), F.col("timed_place").alias("_timed"))
        wins = F.col("_place").isNull() | (F.col("place") >= F.col("_place"))
        times = F.col("timed_place").isNotNull() & (F.col("_timed").isNull() | (F.col("timed_place") >= F.col("_timed")))
        told = last.join(held, "id", "left").withColumns({"_wins": wins, "_times": times}).persist()
        try:
            new = told.where("_wins").select("id", *[f"_last.{c}" for c in others], F.when(F.col("_times"), F.col("starred_at")).alias("starred_at"))
            repos = upsert(self.read("repos"), new, "ordinal", now)
            late = told.where("_times and not _wins").select("id", F.col("starred_at").alias("value"))
            places = stored.unionByName(told.select(*columns)).groupBy("id").agg(F.max("place").alias("place"), F.max("timed_place").alias("timed_place"))
            with self.tables.transaction() as t:
                t.write("repos", set_column(repos, late, "starred_at"), ["id"])
                self.link(t, mirror_topics(t.read("tag_links"), new))
                t.write("places", places, ["id"])
        finally:
            told.unpersist()

    def remove(self, ids: DataFrame, t: Transaction | None = None) -> int:
        """Deletes repositories with their links, and then tags that none holds; how many
        repositories there were."""
        if t is None:
            with self.tables.transaction() as t:
                return self.remove(ids, t)
        gone = ids.join(t.read("repos").select("id"), "id", "left_semi").persist()
        try:
            n = gone.count()
            if n:
                names = ("repos", "tag_links", "group_members")
                # All three are computed from the versions read here, none from another's result.
                for name, part in zip(names, delete_repos(gone, *[t.read(x) for x in names])):
                    t.write(name, part)
                t.write("tags", prune_tags(t.read("tags"), t.read("tag_links")))
            return n
        finally:
            gone.unpersist()


def _go_on(cancelled: Callable[[], bool] | None) -> None:
    if cancelled is not None and cancelled():
        raise Cancelled("stopped between two steps")


def _newest(rows: DataFrame) -> str | None:
    return rows.agg(format_time(F.max("starred_at"))).first()[0]


def full_sync(catalog: Catalog, items: DataFrame, now: Column, languages: DataFrame | None = None, cancelled: Callable[[], bool] | None = None) -> Summary:
    """Takes the whole listing: everything is upserted, what it no longer shows is removed,
    with the tags that nothing holds any more; then languages are filled in.

    items: starred_at, repo (see wire.ITEM) and an ordinal column, later rows last;
    languages: what was fetched (see backfill_languages), None for nothing. The
    watermark becomes the newest starring time of this listing, even where that is older
    than the one before, and stays if the listing has none. All tables change together.
    cancelled is asked between steps; a cancelled run has written nothing, or all but
    the languages.
    """
    rows = to_repos(items).withColumn("synced_at", now).persist()
    try:
        with catalog.tables.transaction() as t:
            count, newest = rows.agg(F.count("*"), format_time(F.max("starred_at"))).first()
            summary = Summary("full", seen=count, written=count)
            gone = unseen(t.read("repos"), rows)
            _go_on(cancelled)
            catalog.absorb(t, rows, "ordinal", now)
            _go_on(cancelled)
            summary.removed = catalog.remove(gone, t)
            _go_on(cancelled)
            catalog.put(t, sync__initial_done="1", **({"sync__watermark": newest} if newest else {}))
    finally:
        rows.unpersist()
    _go_on(cancelled)
    if languages is not None:
        summary.languages_filled = backfill_languages(catalog, languages)
    return summary


def incremental_sync(catalog: Catalog, items: DataFrame, now: Column, remote_count: int | None = None, whole: DataFrame | None = None, fetched: DataFrame | None = None, languages: DataFrame | None = None, cancelled: Callable[[], bool] | None = None) -> Summary:
    """Takes the leading items that are newer than the watermark. Without a watermark, or
    when afterwards the number of repositories differs from remote_count, `whole` (default
    items) is reconciled in full; an unknown count is no difference.

    items are a listing, newest first, in the order of the ordinal column. fetched
    (see refresh) is applied to rows last synced STALE_AFTER before now, then languages
    (see backfill_languages) are filled in; None for nothing. cancelled is asked between
    these steps.
    """
    mark = catalog.get(WATERMARK)
    if mark is None:
        return full_sync(catalog, whole if whole is not None else items, now, languages, cancelled)
    rows = to_repos(items).withColumn("synced_at", now)
    new = newer_than(rows, parse_time(F.lit(mark)), ["ordinal"]).persist()
    try:
        count, newest = new.agg(F.count("*"), format_time(F.max("starred_at"))).first()
        summary = Summary("incremental", seen=count, written=count)
        _go_on(cancelled)
        if count:
            with catalog.tables.transaction() as t:
                catalog.absorb(t, new, "ordinal", now)
                if newest:
                    catalog.put(t, sync__watermark=newest)
    finally:
        new.unpersist()
    _go_on(cancelled)
    if fetched is not None:
        _, summary.metadata_refreshed = _refresh(catalog, fetched, now - F.expr(f"INTERVAL {STALE_AFTER}"), now, REFRESHES)
    _go_on(cancelled)
    if languages is not None:
        summary.languages_filled = backfill_languages(catalog, languages)
    _go_on(cancelled)
    if remote_count is not None and remote_count != catalog.read("repos").count():
        reconciled = full_sync(catalog, whole if whole is not None else items, now, languages, cancelled)
        summary.removed, summary.seen = reconciled.removed, max(summary.seen, reconciled.seen)
        summary.mode = "full"
    return summary


def sync(catalog: Catalog, items: DataFrame, now: Column, **how) -> Summary:
    """Full until a full run has finished once, then incremental; notes when it ended."""
    if catalog.get(INITIAL_DONE) != "1":
        summary = full_sync(catalog, items, now, how.get("languages"), how.get("cancelled"))
    else:
        summary = incremental_sync(catalog, items, now, **how)
    ended = catalog.spark.range(1).select(format_time(now)).first()[0]
    catalog.put(**{LAST_RUN.replace(".", "__"): ended})
    return summary


def refresh(catalog: Catalog, fetched: DataFrame, cutoff: Column, now: Column, budget: int = REFRESHES) -> int:
    """Applies a conditional fetch (id, status and columns) to the stalest rows; how many were touched."""
    return _refresh(catalog, fetched, cutoff, now, budget)[0]


def _refresh(catalog: Catalog, fetched: DataFrame, cutoff: Column, now: Column, budget: int) -> tuple[int, int]:
    """How many rows were touched, and how many of them took new values (status 200)."""
    due = stale_rows(catalog.read("repos"), cutoff).limit(budget).select("id")
    mine = fetched.join(due, "id", "left_semi").persist()
    try:
        touched, renewed = mine.agg(F.count_if(F.col("status").isin(200, 304, 404)), F.count_if(F.col("status") == 200)).first()
        if touched:
            with catalog.tables.transaction() as t:
                t.write("repos", apply_refresh(t.read("repos"), mine, now), ["id"])
                if "topics" in mine.columns:
                    catalog.link(t, mirror_topics(t.read("tag_links"), mine.where("status = 200").join(t.read("repos").select("id"), "id", "left_semi")))
    finally:
        mine.unpersist()
    return touched, renewed


def backfill_languages(catalog: Catalog, fetched: DataFrame, budget: int = BACKFILLS) -> int:
    """Sets languages (id, languages) of the most starred rows that have none; empty
    results are skipped, so they are asked for again."""
    due = without_languages(catalog.read("repos"), budget).select("id")
    delta = fetched.where(F.size("languages") > 0).join(due, "id", "left_semi").select("id", F.col("languages").alias("value")).persist()
    try:
        n = delta.count()
        if n:
            catalog.tables.write("repos", set_column(catalog.read("repos"), delta, "languages"), ["id"])
        return n
    finally:
        delta.unpersist()


def cached_texts(catalog: Catalog, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
    """id, text of the wanted ids (those in the catalog): the stored text where it was
    fetched within TEXT_FRESH, else what `fetch` gives (from id, full_name to id, text),
    which is stored with its time. A null text is an answer but isn't stored."""
    repos = catalog.read("repos").join(wanted.select("id").distinct(), "id", "left_semi")
    good = F.col("readme_md").isNotNull() & fresh(F.col("readme_fetched_at"), now - F.expr(f"INTERVAL {TEXT_FRESH}"))
    told = cut_lineage(fetch(repos.where(~good).select("id", "full_name")).select("id", "text"))
    new = told.where(F.col("text").isNotNull())
    if not new.isEmpty():
        with catalog.tables.transaction() as t:
            texts = set_column(t.read("repos"), new.select("id", F.col("text").alias("value")), "readme_md")
            t.write("repos", set_column(texts, new.select("id", now.alias("value")), "readme_fetched_at"), ["id"])
    return repos.where(good).select("id", F.col("readme_md").alias("text")).unionByName(told)


def fetch_contributors(catalog: Catalog, fetched: DataFrame) -> DataFrame:
    """Stores the contributors fetched for a repository (id, contributors) and gives them
    back; an empty list is stored as such."""
    catalog.tables.write("repos", set_column(catalog.read("repos"), fetched.select("id", F.col("contributors").alias("value")), "contributors"), ["id"])
    return catalog.read("repos").join(fetched.select("id"), "id", "left_semi").select("id", "contributors")


class _Run(StreamingQuery):
    """A stream's run over the input that is available. Awaiting its end moves the
    watermark and ends the initial load, unless it failed or was stopped before."""

    def __init__(self, query: StreamingQuery, catalog: Catalog, begun: list[int]):
        super().__init__(query._jsq)
        self._catalog, self._begun, self._open = catalog, begun, True

    def stop(self) -> None:
        self._open = self._open and not self.isActive
        super().stop()

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        ended = super().awaitTermination(timeout)
        if ended is False or not self._open:
            return ended
        self._open = False
        last = self.lastProgress
        if not self._begun or last is not None and last["batchId"] >= self._begun[-1]:
            newest, mark = self._catalog.get(NEWEST), self._catalog.get(WATERMARK)
            marks = [m for m in (newest, mark) if m is not None]
            self._catalog.put(sync__initial_done="1", sync__stream_newest=None, sync__watermark=max(marks, default=None))
        return ended


def stream(catalog: Catalog, source: DataFrame, checkpoint: str, now=F.current_timestamp, once: bool = True) -> StreamingQuery:
    """Runs a stream of items (starred_at, repo, ordinal) into the catalog.

    The initial load takes every row. Once it is done, rows are skipped that are not
    newer than the watermark the run began with (an unknown time counts as new). Rows are
    put in by their ordinals (see absorb_placed), which must go on from run to run, so
    the result doesn't depend on the batches, and a batch that is replayed writes the
    same rows again.

    The watermark moves, and the initial load is done, when a run over the available
    input (once) has ended and awaitTermination of the query returned here has seen it.
    After a failure or a stop, or in a run without end, they stay, so that more rows are
    taken, never fewer. A stream removes nothing: what a listing no longer shows is found
    by full_sync.
    """
    mark = catalog.get(WATERMARK) if catalog.get(INITIAL_DONE) == "1" else None
    begun: list[int] = []

    def absorb(batch: DataFrame, number: int) -> None:
        begun.append(number)
        rows = to_repos(batch).withColumn("synced_at", now())
        if mark is not None:
            rows = rows.where(F.col("starred_at").isNull() | (F.col("starred_at") > parse_time(F.lit(mark))))
        rows = rows.persist()
        try:
            if not rows.isEmpty():
                catalog.absorb_placed(rows, now())
                newest, mark_ = _newest(rows), catalog.get(NEWEST)
                if newest and (mark_ is None or newest > mark_):
                    catalog.put(**{NEWEST.replace(".", "__"): newest})
        finally:
            rows.unpersist()

    writer = source.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    if once:
        return _Run(writer.trigger(availableNow=True).start(), catalog, begun)
    return writer.trigger(processingTime=INTERVAL).start()
