import json
import os

import pytest
from pyspark.sql import functions as F

from quern.operators import enrich, store
from quern.sources import wire
from quern.sources.tables import TableStore
from quern.streaming import sync

LINKS = "repo_id long, name string, source string, confidence double"
def now():
    return F.lit("2026-03-01 00:00:00").cast("timestamp")




def rows(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def links(spark, *each):
    return spark.createDataFrame([(*e, 1.0) for e in each], LINKS)


def test_upsert_keeps_what_is_not_sent(spark):
    schema = "id long, full_name string, languages map<string,long>, contributors array<string>, starred_at string, synced_at timestamp, etag string"
    old = spark.createDataFrame([(1, "a/a", {"Rust": 1}, ["x"], "s1", None, "e1"), (2, "b/b", {}, None, None, None, None)], schema)
    new = spark.createDataFrame([(1, "a/first", {}, None, None, None, 1), (1, "a/A", {}, None, None, None, 2), (3, "c/c", {"Go": 2}, [], "s3", None, 3), (None, "n/n", {}, None, None, None, 4)], "id long, full_name string, languages map<string,long>, contributors array<string>, starred_at string, synced_at timestamp, ordinal int")
    out = {r.id: r for r in store.upsert(old, new, "ordinal", now()).collect()}
    assert set(out) == {1, 2, 3}
    assert (out[1].full_name, out[1].languages, out[1].contributors, out[1].starred_at, out[1].etag) == ("a/A", {"Rust": 1}, ["x"], "s1", "e1")
    assert out[1].synced_at is not None and out[2].synced_at is None and out[3].contributors is None and out[3].etag is None
    assert store.upsert(old.limit(0), new.limit(0), "ordinal", now()).count() == 0


def test_upsert_goes_row_by_row(spark):
    schema = "id long, full_name string, languages map<string,long>, contributors array<string>, starred_at string, synced_at timestamp, etag string"
    old = spark.createDataFrame([(1, "a/a", {"Rust": 1}, ["x"], "s1", None, "e1")], schema)
    rows_ = [(1, "a/1", {"Go": 1}, ["y"], "s2", None, 1), (1, "a/2", {}, [], None, None, 2), (2, "b/1", {"C": 3}, None, "t1", None, 1), (2, "b/2", None, ["z"], None, None, 2), (2, "b/3", {}, None, "t3", None, 3), (3, "c/1", {}, [], None, None, None)]
    new = spark.createDataFrame(rows_, "id long, full_name string, languages map<string,long>, contributors array<string>, starred_at string, synced_at timestamp, ordinal int")
    out = {r.id: r for r in store.upsert(old, new.repartition(3), "ordinal", now()).collect()}
    told = {i: (r.full_name, r.languages, r.contributors, r.starred_at) for i, r in out.items()}
    assert told == {1: ("a/2", {"Go": 1}, ["y"], "s2"), 2: ("b/3", {"C": 3}, ["z"], "t3"), 3: ("c/1", {}, None, None)}
    empty = spark.createDataFrame([(1, "a/9", {}, [], None, None, 1)], new.schema)
    (kept,) = store.upsert(old, empty, "ordinal", now()).collect()
    assert (kept.full_name, kept.languages, kept.contributors, kept.starred_at) == ("a/9", {"Rust": 1}, ["x"], "s1")
    ties = spark.createDataFrame([(1, c, {}, None, None, None, 1) for c in "pqrst"], new.schema)
    assert len({store.upsert(old, ties.repartition(n), "ordinal", now()).first().full_name for n in (1, 2, 5)}) == 1


def test_topics_of_the_last_row(spark):
    have = links(spark, (1, "older", "github"), (1, "mine", "user"))
    topics = spark.createDataFrame([(1, ["old"], 1), (1, ["new", "new"], 2), (2, None, 1)], "id long, topics array<string>, ordinal int")
    assert rows(store.mirror_topics(have, topics, "ordinal"), "repo_id", "name", "source") == {(1, "new", "github"), (1, "mine", "user")}


def test_tags(spark):
    have = links(spark, (1, "rust", "github"), (1, "Cli", "user"), (1, "old", "ai"), (2, "kept", "ai"))
    new = spark.createDataFrame([(1, "cli", 0.5, 0), (1, "new", 0.1, 1), (1, "new", 0.9, 2), (3, None, None, 0)], "repo_id long, name string, confidence double, ordinal int")
    assert rows(store.replace_ai_tags(have, new)) == {(1, "rust", "github", 1.0), (1, "Cli", "user", 1.0), (2, "kept", "ai", 1.0), (1, "new", "ai", 0.9)}
    added = spark.createDataFrame([(1, " Cli "), (1, "  "), (1, None), (2, "x"), (2, "x")], "repo_id long, name string")
    assert rows(store.add_user_tags(have, added)) - rows(have) == {(2, "x", "user", 1.0)}
    promoted = store.promote_tags(have, spark.createDataFrame([(2, "kept")], "repo_id long, name string"))
    assert (2, "kept", "user", 1.0) in rows(promoted) and (2, "kept", "ai", 1.0) not in rows(promoted)
    topics = spark.createDataFrame([(1, ["a", "a", None, "rust"]), (5, None)], "id long, topics array<string>")
    assert rows(store.mirror_topics(have, topics), "repo_id", "name", "source") == {(1, "a", "github"), (1, "rust", "github"), (1, "Cli", "user"), (1, "old", "ai"), (2, "kept", "ai")}
    tags = spark.createDataFrame([("rust", "github"), ("orphan", "ai")], "name string, source string")
    assert rows(store.prune_tags(tags, have)) == {("rust", "github")}


def test_groups_and_deletes(spark):
    repos = spark.createDataFrame([(1, "a/a"), (2, "b/b"), (3, "c/c")], "id long, full_name string")
    groups = spark.createDataFrame([("Mine", "old", "user"), ("Gone", "", "ai")], "name string, summary string, source string")
    members = spark.createDataFrame([(1, "Mine"), (2, "Gone")], "repo_id long, group_name string")
    new = spark.createDataFrame([("Mine", "new", 0), ("Fresh", None, 1)], "name string, summary string, ordinal int")
    named = spark.createDataFrame([("Mine", "c/c"), ("Fresh", "b/b"), ("Fresh", "nobody/x"), ("Fresh", "b/b")], "name string, full_name string")
    next_groups, next_members = store.replace_ai_groups(groups, members, new, named, repos)
    assert rows(next_groups) == {("Mine", "new", "user"), ("Fresh", "", "ai")} and rows(next_members) == {(1, "Mine"), (3, "Mine"), (2, "Fresh")}
    have = links(spark, (1, "x", "ai"), (2, "y", "ai"))
    left = store.delete_repos(spark.createDataFrame([(1,), (99,)], "id long"), repos, have, members)
    assert rows(left[0], "id") == {(2,), (3,)} and rows(left[1], "repo_id") == {(2,)} and rows(left[2], "repo_id") == {(2,)}
    delta = spark.createDataFrame([(1, None), (9, "z")], "id long, value string")
    assert rows(store.set_column(repos, delta, "full_name")) == {(1, None), (2, "b/b"), (3, "c/c")}
    assert rows(store.merge_delta(repos, spark.createDataFrame([(1, "a/A"), (4, "d/d"), (2, "z")], "id long, full_name string"), spark.createDataFrame([(2,)], "id long"))) == {(1, "a/A"), (3, "c/c"), (4, "d/d")}


def test_state_and_runs(spark):
    state = store.state_put(spark.createDataFrame([("a", "1")], "key string, value string"), {"a": "2", "b": "3"})
    assert store.state_get(state, "a") == "2" and store.state_get(store.state_put(state, {"a": None}), "a") is None
    runs = store.begin_run(store.begin_run(spark.createDataFrame([], store.RUNS), "p", "m", now()), "p", "m", now())
    runs = store.finish_run(runs, 1, now(), 7)
    assert [(r.id, r.finished_at is None, r.repos_count) for r in store.recent_runs(runs, 5).collect()] == [(2, True, 0), (1, False, 7)]


def test_versions(spark, tmp_path):
    tables = TableStore(spark, str(tmp_path))
    assert not tables.exists("t")
    for n in (1, 2, 3):
        df = spark.range(n) if n == 1 else tables.read("t").union(spark.range(1))
        assert tables.write("t", df, ["id"]) == n and tables.read("t").count() == n
    assert tables.read("t", 1).count() == 1
    tables.vacuum("t", 1)
    assert tables.read("t").count() == 3 and not (tmp_path / "t" / "v2").exists()


def test_tables_change_together(spark, tmp_path):
    tables = TableStore(spark, str(tmp_path))
    with tables.transaction() as t:
        t.write("a", spark.range(1))
        assert t.read("a").count() == 1 and not tables.exists("a")
        t.write("b", t.read("a").union(spark.range(1)))
    with pytest.raises(ZeroDivisionError), tables.transaction() as t:
        t.write("a", spark.range(9))
        t.write("a", t.read("a").limit(5))
        1 / 0
    assert tables.read("a").count() == 1 and tables.read("b").count() == 2 and tables.write("a", spark.range(3)) == 2 and tables.read("a").count() == 3


def star(id, day, **more):
    return {"starred_at": day and f"2026-02-{day:02d}T00:00:00Z", "repo": {"id": id, "node_id": f"n{id}", "name": f"r{id}", "full_name": f"o/r{id}", "owner": {"login": "o"}, "html_url": "u", "stargazers_count": id * 100, "topics": ["t"], **more}}


def pages(spark, tmp_path, name, *listed):
    folder = tmp_path / name
    folder.mkdir()
    for i, page in enumerate(listed):
        (folder / f"page{i}.json").write_text(json.dumps(page))
    read = wire.read_pages(spark, str(folder))
    return read.withColumn("ordinal", F.struct("file", "position")).drop("file", "position")


def test_sync_runs(spark, tmp_path):
    catalog = sync.Catalog(spark, str(tmp_path / "c"))
    first = sync.sync(catalog, pages(spark, tmp_path, "a", [star(3, 3), star(2, 2)], [star(1, 1)]), now())
    assert (first.mode, first.seen, first.written, first.removed) == ("full", 3, 3, 0) and catalog.get(sync.WATERMARK) == "2026-02-03T00:00:00Z"
    listing = pages(spark, tmp_path, "b", [star(5, 5), star(6, None), star(4, 4)], [star(3, 3), star(7, 7)])
    second = sync.sync(catalog, listing, now())
    assert (second.mode, second.seen) == ("incremental", 3) and catalog.get(sync.WATERMARK) == "2026-02-05T00:00:00Z"
    assert rows(catalog.read("repos"), "id") == {(i,) for i in (1, 2, 3, 4, 5, 6)}
    catalog.tables.write("group_members", spark.createDataFrame([(1, "g")], "repo_id long, group_name string"))
    third = sync.sync(catalog, pages(spark, tmp_path, "d", [star(5, 5), star(4, 4), star(3, 3), star(2, 2)]), now(), remote_count=4)
    assert third.mode == "full" and third.removed == 2 and rows(catalog.read("group_members")) == set()
    assert rows(catalog.read("tag_links"), "repo_id", "name", "source") == {(i, "t", "github") for i in (2, 3, 4, 5)}
    fetched = spark.createDataFrame([(2, 304, None), (3, 200, 999), (4, 404, None), (5, 500, 1)], "id long, status int, stargazers long")
    later = F.lit("2026-04-01 00:00:00").cast("timestamp")
    assert sync.refresh(catalog, fetched, later, later) == 3
    after = {r.id: r for r in catalog.read("repos").collect()}
    assert after[3].stargazers == 999 and after[3].starred_at is not None and after[5].stargazers == 500 and after[2].stargazers == 200
    assert [after[i].synced_at.month for i in (2, 3, 4, 5)] == [4, 4, 4, 3]
    filled = spark.createDataFrame([(2, {"Rust": 1}), (3, {}), (77, {"Go": 1})], "id long, languages map<string,long>")
    assert sync.backfill_languages(catalog, filled) == 1 and rows(catalog.read("repos").where(F.size("languages") > 0), "id") == {(2,)}


def test_runs_refresh_backfill_and_prune(spark, tmp_path):
    catalog = sync.Catalog(spark, str(tmp_path / "c"))
    at = lambda day: F.lit(f"2026-03-{day:02d} 00:00:00").cast("timestamp")
    languages = spark.createDataFrame([(1, {"Rust": 1}), (2, {}), (3, {"Go": 2}), (4, {"C": 3})], "id long, languages map<string,long>")
    first = sync.sync(catalog, pages(spark, tmp_path, "a", [star(2, 2, topics=["t", "gone"]), star(1, 1)]), at(1), languages=languages.where("id < 3"))
    assert first.mode == "full" and first.languages_filled == 1
    assert rows(catalog.read("tags")) == {("t", "github"), ("gone", "github")}
    fetched = spark.createDataFrame([(1, 200, 999), (2, 304, None), (3, 200, 1)], "id long, status int, stargazers long")
    second = sync.sync(catalog, pages(spark, tmp_path, "b", [star(3, 3), star(2, 2)]), at(5), fetched=fetched, languages=languages)
    assert (second.mode, second.metadata_refreshed, second.languages_filled) == ("incremental", 1, 1)
    assert rows(catalog.read("repos"), "id", "stargazers", F.dayofmonth("synced_at")) == {(1, 999, 5), (2, 200, 5), (3, 300, 5)}
    assert rows(catalog.read("repos").where(F.size("languages") > 0), "id") == {(1,), (3,)}
    third = sync.sync(catalog, pages(spark, tmp_path, "d", [star(4, 4), star(3, 3), star(1, 1)]), at(6), remote_count=3, languages=languages)
    assert (third.mode, third.removed, third.languages_filled) == ("full", 1, 1) and rows(catalog.read("tags")) == {("t", "github")}


def test_a_full_run_counts_rows_and_sets_the_mark_back(spark, tmp_path):
    catalog = sync.Catalog(spark, str(tmp_path / "c"))
    sync.sync(catalog, pages(spark, tmp_path, "a", [star(1, 9), star(2, 8)]), now())
    again = sync.full_sync(catalog, pages(spark, tmp_path, "b", [star(2, 5, topics=["old"]), star(2, 3, topics=["last"]), star(2, None, topics=["last"])]), now())
    assert (again.seen, again.written, again.removed) == (3, 3, 1) and catalog.get(sync.WATERMARK) == "2026-02-05T00:00:00Z" and catalog.get(sync.LAST_RUN) == "2026-03-01T00:00:00Z"
    assert rows(catalog.read("tag_links"), "repo_id", "name") == {(2, "last")} and catalog.read("repos").first().starred_at.day == 3
    sync.full_sync(catalog, pages(spark, tmp_path, "d", [star(2, None)]), now())
    assert catalog.get(sync.WATERMARK) == "2026-02-05T00:00:00Z"


def test_a_cancelled_run_writes_nothing(spark, tmp_path):
    catalog = sync.Catalog(spark, str(tmp_path / "c"))
    listing = pages(spark, tmp_path, "a", [star(1, 1)])
    asked = []
    with pytest.raises(sync.Cancelled):
        sync.full_sync(catalog, listing, now(), cancelled=lambda: asked.append(1) or len(asked) == 3)
    assert catalog.read("repos").count() == 0 and catalog.get(sync.INITIAL_DONE) is None
    sync.full_sync(catalog, listing, now(), cancelled=lambda: False)
    with pytest.raises(sync.Cancelled):
        sync.incremental_sync(catalog, pages(spark, tmp_path, "b", [star(2, 2)]), now(), cancelled=lambda: True)
    assert rows(catalog.read("repos"), "id") == {(1,)}


def test_cached_texts_and_records(spark, tmp_path):
    catalog = sync.Catalog(spark, str(tmp_path / "c"))
    sync.full_sync(catalog, pages(spark, tmp_path, "a", [star(1, 1), star(2, 2), star(3, 3)]), now())
    told = spark.createDataFrame([(1, "one"), (2, None)], "id long, text string")
    fetch = lambda missing: missing.join(told, "id").select("id", "text")
    wanted = spark.createDataFrame([(1,), (2,), (2,), (99,)], "id long")
    assert rows(sync.cached_texts(catalog, wanted, fetch, now())) == {(1, "one"), (2, None)}
    again = lambda missing: missing.select("id", F.lit("again").alias("text"))
    assert rows(sync.cached_texts(catalog, wanted, again, now() + F.expr("INTERVAL 1 DAY"))) == {(1, "one"), (2, "again")}
    assert rows(sync.cached_texts(catalog, wanted.where("id = 1"), again, now() + F.expr("INTERVAL 9 DAYS"))) == {(1, "again")}
    people = spark.createDataFrame([(1, [("a", "u", 2)])], "id long, contributors array<struct<login:string,avatar_url:string,contributions:long>>")
    assert rows(sync.fetch_contributors(catalog, people).select("id", F.col("contributors")[0]["login"])) == {(1, "a")}
    catalog.tables.write("group_members", spark.createDataFrame([(1, "g"), (2, "h")], "repo_id long, group_name string"))
    (one,) = catalog.record(1).collect()
    assert (one.readme_md, one.contributors[0].login, [t.name for t in one.tags], one.groups) == ("again", "a", ["t"], ["g"])
    assert catalog.record(99).count() == 0


def test_stream(spark, tmp_path):
    catalog = sync.Catalog(spark, str(tmp_path / "c"))
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for run, items in enumerate(([star(1, 1), star(2, 2)], [star(3, 3), star(1, 1, stargazers_count=7), star(4, None)])):
        (inbox / f"{run}.json").write_text("\n".join(map(json.dumps, items)))
        source = spark.readStream.schema(wire.ITEM).json(str(inbox)).withColumn("ordinal", F.lit(0))
        sync.stream(catalog, source, str(tmp_path / "checkpoint"), now=now).awaitTermination()
    assert {r.id: r.stargazers for r in catalog.read("repos").collect()} == {1: 100, 2: 200, 3: 300, 4: 400}
    assert catalog.get(sync.WATERMARK) == "2026-02-03T00:00:00Z"


def _streamed(spark, tmp_path, name, files, per_batch, catalog=None):
    inbox = tmp_path / f"{name}-in"
    inbox.mkdir(exist_ok=True)
    for i, items in enumerate(files, len(list(inbox.iterdir()))):
        (inbox / f"{i:03d}.json").write_text("\n".join(map(json.dumps, items)))
        os.utime(inbox / f"{i:03d}.json", (1_700_000_000 + i,) * 2)  # the order in which they are taken
    catalog = catalog or sync.Catalog(spark, str(tmp_path / name))
    source = spark.readStream.schema(f"{wire.ITEM}, ordinal int").option("maxFilesPerTrigger", per_batch).json(str(inbox))
    sync.stream(catalog, source, str(tmp_path / f"{name}-checkpoint"), now=now).awaitTermination()
    return catalog


def _held(catalog):
    columns = ["id", "full_name", "stargazers", "starred_at", "topics"]
    return sorted(map(str, catalog.read("repos").select(*columns).collect())), sorted(map(str, catalog.read("tag_links").collect())), catalog.get(sync.WATERMARK), catalog.get(sync.INITIAL_DONE)


def test_stream_does_not_depend_on_batches(spark, tmp_path):
    at = lambda ordinal, *s, **more: star(*s, **more) | {"ordinal": ordinal}
    # The newest first; of 3 an old snapshot without a time comes last, of 4 an old time.
    items = [at(1, 9, 20), at(2, 8, 9), at(9, 3, None, stargazers_count=33, topics=["new"]), at(8, 4, None), at(3, 7, 5), at(4, 3, 2, stargazers_count=1), at(5, 6, 1), at(2, 4, 1, topics=["old"]), at(None, 3, None, topics=["older"])]
    whole = _streamed(spark, tmp_path, "whole", [items], 64)
    cut = _streamed(spark, tmp_path, "cut", [[i] for i in items], 1)
    assert _held(whole) == _held(cut) and whole.get(sync.WATERMARK) == "2026-02-20T00:00:00Z" and whole.get(sync.INITIAL_DONE) == "1"
    kept = {r.id: (r.stargazers, r.topics, r.starred_at and r.starred_at.day) for r in cut.read("repos").collect()}
    assert set(kept) == {3, 4, 6, 7, 8, 9} and kept[3] == (33, ["new"], 2) and kept[4] == (400, ["t"], 1)
    # Afterwards the watermark is that of the run before, for all batches.
    more = [at(10, 10, 28), at(11, 11, 21), at(12, 12, 19), at(1, 3, None)]
    _streamed(spark, tmp_path, "whole", [more], 64, whole)
    _streamed(spark, tmp_path, "cut", [[i] for i in more], 1, cut)
    assert _held(whole) == _held(cut) and {r.id for r in cut.read("repos").collect()} == {3, 4, 6, 7, 8, 9, 10, 11} and cut.get(sync.WATERMARK) == "2026-02-28T00:00:00Z"


def test_a_stopped_stream_is_not_done(spark, tmp_path):
    catalog = sync.Catalog(spark, str(tmp_path / "c"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps(star(1, 1) | {"ordinal": 1}))
    run = sync.stream(catalog, spark.readStream.schema(f"{wire.ITEM}, ordinal int").json(str(tmp_path / "in")), str(tmp_path / "checkpoint"), now=now)
    run.stop()
    run.awaitTermination()
    assert catalog.get(sync.INITIAL_DONE) is None and catalog.get(sync.WATERMARK) is None


def test_stream_sync_over_one_file_and_many(spark, tmp_path):
    from quern.plans.streams import stream_sync

    payloads = [(1, 1, i, None, json.dumps(star(i, 28 - i // 6))) for i in range(140)] + [(0, 1, i, None, json.dumps(star(i, None, stargazers_count=1))) for i in range(140)]
    df = spark.createDataFrame(payloads, "snapshot_no int, page int, pos int, received_at timestamp, payload string")
    df.coalesce(1).write.parquet(str(tmp_path / "one" / "star_items.parquet"))
    df.repartitionByRange(140, F.desc("snapshot_no"), "pos").write.parquet(str(tmp_path / "many" / "star_items.parquet"))
    one, many = (rows(stream_sync(spark, str(tmp_path / d))) for d in ("one", "many"))
    assert one == many == {(i, f"o/r{i}", i * 100) for i in range(140)}


def test_wire(spark, tmp_path):
    body = json.dumps({"data": {"r0": {"databaseId": 1, "languages": {"edges": [{"size": 5, "node": {"name": "A"}}, {"node": {"name": "B"}}, {"size": 9, "node": {"name": "A"}}]}}, "r1": None}})
    df = spark.createDataFrame([(body,), (json.dumps({"errors": [{"message": "no"}]}),), (None,)], "b string")
    assert [(r.id, r.languages) for r in wire.language_batches(df, "b").collect()] == [(1, {"A": 9, "B": 0})]
    envelopes = spark.createDataFrame([('{"data":{"n":3},"errors":[{"message":"x"}]}',)], "b string")
    assert envelopes.select(wire.unwrap(F.col("b"), "struct<n:bigint>").alias("d")).first().d.n == 3
    with pytest.raises(Exception, match="gone; twice"):
        spark.createDataFrame([('{"errors":[{"message":"gone"},{"message":"twice"}]}',)], "b string").select(wire.unwrap(F.col("b"), "struct<n:bigint>")).collect()
    minimal = spark.createDataFrame([('{"repo":{"id":1,"description":null}}',), ("{",), ('{"repo":{}}',)], "p string").select(wire.parse_items(F.col("p")).alias("i")).select("i.*")
    (only,) = wire.to_repos(minimal).collect()
    assert (only.stargazers, only.archived, only.fork, only.topics, only.starred_at) == (0, False, False, [], None)
    local = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id long, etag string")
    remote = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c")], "id long, etag string")
    assert {r.id: r.status for r in wire.conditional(local, remote).collect()} == {1: 304, 2: 200, 3: 200, 4: 404}
    assert wire.full_name_aliases(["a/b/c", "x"]) == {"r0": ("a", "b/c")}
    (tmp_path / "readme.md").write_text("# Hi\n")
    assert [tuple(r) for r in wire.read_texts(spark, str(tmp_path / "readme.md")).collect()] == [("readme.md", "# Hi\n")]
    people = spark.createDataFrame([(1, i, f"l{i}", 1) for i in range(12)], "seq long, node long, login string, contributions long")
    assert rows(wire.first_contributors(people, "seq", 2), "login") == {("l0",), ("l1",)}


REPLIES = [
    ('{"repos":[{"full_name":"a/b","tags":["X Y",{"name":"z","confidence":2},{"name":"z"},5,{"name":7},""]}]}', [("a/b", [("x-y", 0.5), ("z", 1.0)])]),
    ('Sure!\n```json\n{"repos":[{"full_name":" a ","tags":[{"name":"} {\\" ]","confidence":-1}]}]}\n``` bye }', [("a", [('}-{"-]', 0.0)])]),
    ('{broken {"repos":[{"full_name":"a","tags":["1","2","3","4","5","6","7"]}]}', [("a", [(str(i), 0.5) for i in range(1, 7)])]),
    ('{"repos":[{"full_name":"a","tags":[]},{"full_name":"b","tags":"x"}]}', []),
]


@pytest.mark.parametrize("raw, expected", REPLIES)
def test_replies(raw, expected):
    assert enrich.parse_tags(raw) == expected


@pytest.mark.parametrize("raw", ["", "no json", '{"repos":[{"full_name":"a"', "[1]", '{"x":1}', '{"repos":[{"tags":["x"]}]}', '{"repos":[{"full_name":" "}]}', '{"repos":[NaN]}'])
def test_unusable_replies(raw):
    with pytest.raises(enrich.Malformed):
        enrich.parse_tags(raw)


def test_groups_of_a_reply():
    raw = '{"groups":[{"name":" G ","summary":5,"members":["a"," a ","",1,"b"]},{"name":"H","members":[]}]}'
    assert enrich.parse_groups(raw) == [("G", "", ["a", "b"])]


def test_enrichment(spark):
    asked = spark.createDataFrame([(0, "good"), (1, "bad"), (2, "mended"), (3, "down")], "batch long, prompt string")

    def ask(prompt):
        if prompt == "down":
            raise OSError("no route")
        return '{"repos":[{"full_name":"a/b","tags":["t"]}]}' if prompt == "good" or prompt.startswith("mended\n") else "sorry"

    told = {r.batch: (r.ok, r.name, r.error) for r in enrich.run_tags(asked, ask).collect()}
    assert told[0] == (True, "t", None) and told[2][:2] == (True, "t") and not told[1][0] and told[3] == (False, None, "no route")
    with pytest.raises(enrich.Malformed):
        enrich.run_tags(asked.where("batch = 1"), ask)
    nothing = {r.batch: (r.ok, r.name) for r in enrich.run_tags(asked.where("batch in (0, 1)"), lambda p: '{"repos":[]}' if p == "good" else "sorry").collect()}
    assert nothing == {0: (True, None), 1: (False, None)}
    old = spark.createDataFrame([("a", [" x ", "y", ""]), ("b", None)], "full_name string, tags array<string>")
    new = spark.createDataFrame([("a", ["X", "y", "z"]), ("c", ["q"])], "full_name string, tags array<string>")
    assert {r.full_name: r.tags for r in enrich.union_tags(old, new).collect()} == {"a": ["x", "y", "X", "z"], "b": [], "c": ["q"]}
    body = spark.createDataFrame([('{"choices":[{"message":{"content":"hi"}}]}',)], "b string")
    assert body.select(enrich.pointer(F.col("b"), "/choices/0/message/content")).first()[0] == "hi"


def test_analysis(spark):
    repos = spark.createDataFrame([(i, f"o/r{i}", None, 60 - i, ["t"], "L") for i in range(60)] + [(99, "o/r0", None, -1, None, None)], "id long, full_name string, description string, stargazers long, topics array<string>, primary_language string")
    known = spark.createDataFrame([("o/r1", [" k "])], "full_name string, tags array<string>")
    order = [F.desc("stargazers"), F.asc("id")]
    seen = []

    def tag(prompt):
        names = [r["full_name"] for r in json.loads(prompt)]
        if "o/r30" in names:
            raise OSError("down")
        return json.dumps({"repos": [{"full_name": n, "tags": ["A b", "c"]} for n in names] + [{"full_name": "x/unknown", "tags": ["z"]}]})

    def group(prompt):
        asked = json.loads(prompt)
        assert {r["full_name"]: r["tags"] for r in asked}["o/r1"] == ["k", "a-b", "c"]
        return json.dumps({"groups": [{"name": "all", "summary": "s", "members": [r["full_name"] for r in asked]}]})

    out = enrich.analyse(repos, tag, group, known, order)
    assert (out.batches, out.failed, out.repos, out.group_error) == (3, 1, 38, None)
    assert rows(enrich.resolved(out.tags, repos).where("repo_id = 0")) == {(0, "a-b", 0.5, 0), (0, "c", 0.5, 1)} and enrich.resolved(out.tags, repos).where("repo_id = 99").count() == 0
    assert out.groups.count() == 60
    kept = enrich.analyse(repos, tag, lambda p: "no", known, order)
    assert kept.group_error and kept.groups.count() == 0 and kept.repos == 38
    long = enrich.analyse(repos, tag, group, known, order, most=100)
    assert "more than 100" in long.group_error and long.tags.where("ok").count() > 0
    with pytest.raises(enrich.Malformed, match="every batch"):
        enrich.analyse(repos, lambda p: "no", group, known, order)
    with pytest.raises(enrich.Cancelled):
        enrich.analyse(repos, tag, group, known, order, cancelled=lambda: seen.append(1) or len(seen) == 2)
    empty = enrich.analyse(repos.limit(0), tag, group, known, order)
    assert (empty.batches, empty.repos, empty.groups.count()) == (0, 0, 0)


def test_the_last_entry_of_a_repository_counts(spark):
    told = spark.createDataFrame([(0, True, 0, "a/b", 0, "x", 0.1), (0, True, 1, "a/b", 0, "y", 0.2), (1, False, None, None, None, None, None), (0, True, 1, "a/b", 1, "z", 0.3), (0, True, 2, "no/no", 0, "q", 0.3)], "batch long, ok boolean, entry int, full_name string, place int, name string, confidence double")
    repos = spark.createDataFrame([(7, "a/b"), (8, "A/b"), (None, None)], "id long, full_name string")
    assert rows(enrich.resolved(told, repos)) == {(7, "y", 0.2, 0), (7, "z", 0.3, 1)}


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    from quern.sources.synthetic import synthetic_catalog

    one, two = (synthetic_catalog(spark, 500, partitions=p).drop("languages") for p in (1, 7))
    assert one.exceptAll(two).isEmpty() and one.count() == 500 and one.select("full_name").distinct().count() == 500
    assert 5 <= one.where("archived").count() <= 60 and synthetic_catalog(spark, 0).count() == 0
