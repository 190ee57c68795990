"""Queries of several steps: sync runs, enrichment runs, caches and logs; with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import display
from quern.functions.names import SQL_SPACE, trimmed_sql
from quern.operators import catalog as model
from quern.operators import enrich, facets, ordering, predicates, store
from quern.plans.catalog_queries import _NOW, _TAGS, _VIEW, _WIRE, SQL_BATCHES, view
from quern.plans.query import SortKey, commands, parse, with_filter, with_sort
from quern.session import ensure_checkpoint_dir, read_table
from quern.sources import synthetic, wire
from quern.sources.tables import TableStore
from quern.streaming import sync

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def _now(day: int):
    return F.lit(f"2026-03-{day:02d} 00:00:00").cast("timestamp")


# Synchronisation.

def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listed items, newest page and place first, with the snapshot they are of."""
    items = read_table(spark, sf_dir, "star_items").select("snapshot_no", "slice_no", "page", "pos", "received_at", wire.parse_items(F.col("payload")).alias("i"))
    return items.where(F.col("i.repo").isNotNull()).select("snapshot_no", "i.starred_at", "i.repo", F.struct("page", "pos", "slice_no", "received_at").alias("ordinal"))


def _snapshots(spark: SparkSession, sf_dir: str) -> list[int]:
    return [r[0] for r in read_table(spark, sf_dir, "star_items").where("snapshot_no IS NOT NULL").select("snapshot_no").distinct().orderBy("snapshot_no").collect()]


_ROWS = _VIEW + _WIRE.replace("p->>'$.repo.full_name' AS full_name", "received_at, p->>'$.repo.full_name' AS full_name").replace("SELECT snapshot_no, slice_no, page, pos, payload::JSON", "SELECT snapshot_no, slice_no, page, pos, received_at, payload::JSON") + """,
present AS (SELECT DISTINCT snapshot_no, id FROM seen), sized AS (SELECT snapshot_no, count(*) AS n FROM seen GROUP BY ALL)"""


def _after_all(spark: SparkSession, sf_dir: str) -> tuple[sync.Catalog, list[tuple]]:
    """Every snapshot taken in a full run of its own, one after the other; the first fills
    languages in. Done once in a session for each folder of tables."""
    done = (spark.sparkContext.applicationId, sf_dir)
    if done not in _DONE:
        _DONE[done] = _run_all(spark, sf_dir)
    return _DONE[done]


_DONE: dict[tuple[str, str], tuple[sync.Catalog, list[tuple]]] = {}


def _run_all(spark: SparkSession, sf_dir: str) -> tuple[sync.Catalog, list[tuple]]:
    catalog, items, told = sync.Catalog(spark, _folder(spark)), _listing(spark, sf_dir), []
    for i, k in enumerate(_snapshots(spark, sf_dir)):
        languages = view(spark, sf_dir).select("id", "languages") if not i else None
        s = sync.full_sync(catalog, items.where(F.col("snapshot_no") == k).drop("snapshot_no"), _now(1 + i), languages)
        told.append((k, s.mode, s.seen, s.written, s.removed, s.languages_filled, s.metadata_refreshed, catalog.get(sync.WATERMARK)))
    return catalog, told


@query(_ROWS + """, due AS (SELECT l.id FROM (SELECT * FROM seen WHERE snapshot_no = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY page DESC, pos DESC, slice_no DESC, received_at DESC) = 1) l ORDER BY stargazers DESC, id LIMIT 500)
SELECT s.snapshot_no, 'full' AS mode, n AS seen, n AS written, (SELECT count(*) FROM present p WHERE p.snapshot_no = s.snapshot_no - 1 AND NOT EXISTS (SELECT 1 FROM present q WHERE q.snapshot_no = s.snapshot_no AND q.id = p.id)) AS removed,
  CASE WHEN s.snapshot_no = 1 THEN (SELECT count(*) FROM due JOIN cat USING (id) WHERE cardinality(languages) > 0) ELSE 0 END AS languages_filled, 0::BIGINT AS metadata_refreshed,
  (SELECT strftime(max(starred_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') FROM seen x WHERE x.snapshot_no = s.snapshot_no) AS watermark FROM sized s""")
def sync_full_counters(spark, sf_dir):
    """What each of the full runs says it did."""
    told = _after_all(spark, sf_dir)[1]
    return spark.createDataFrame(told, "snapshot_no int, mode string, seen bigint, written bigint, removed bigint, languages_filled bigint, metadata_refreshed bigint, watermark string")


@query(_ROWS + """, newest_no AS (SELECT max(snapshot_no) AS m FROM present), held AS (SELECT id FROM present, newest_no WHERE snapshot_no = m),
gap AS (SELECT h.id, coalesce(max(k.snapshot_no), 0) AS absent FROM held h LEFT JOIN sized k ON NOT EXISTS (SELECT 1 FROM present p WHERE p.id = h.id AND p.snapshot_no = k.snapshot_no) GROUP BY h.id),
since AS (SELECT s.* FROM seen s JOIN gap g ON g.id = s.id WHERE s.snapshot_no > g.absent),
ended AS (SELECT * FROM since QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_no DESC, page DESC, pos DESC, slice_no DESC, received_at DESC) = 1),
timed AS (SELECT * FROM since WHERE starred_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_no DESC, page DESC, pos DESC, slice_no DESC, received_at DESC) = 1)
SELECT e.id, e.full_name, e.description, e.stargazers, epoch_us(t.starred_at) AS starred, coalesce(g, '') AS tags FROM ended e LEFT JOIN timed t ON t.id = e.id
LEFT JOIN (SELECT id, string_agg(x, '|' ORDER BY x) AS g FROM (SELECT DISTINCT id, unnest(topics) AS x FROM ended) WHERE x IS NOT NULL GROUP BY id) y ON y.id = e.id""")
def sync_full_catalog(spark, sf_dir):
    """The catalog after the full runs: repositories with their tags."""
    catalog, _ = _after_all(spark, sf_dir)
    tags = catalog.read("tag_links").groupBy(F.col("repo_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("tags"))
    return catalog.read("repos").join(tags, "id", "left").select("id", "full_name", "description", "stargazers", F.unix_micros("starred_at").alias("starred"), F.coalesce("tags", F.lit("")).alias("tags"))


@query(_ROWS + """, newest_no AS (SELECT max(snapshot_no) AS m FROM present)
SELECT DISTINCT t AS name, 'github' AS source FROM (SELECT unnest(topics) AS t FROM (SELECT s.* FROM seen s, newest_no WHERE snapshot_no = m QUALIFY row_number() OVER (PARTITION BY id ORDER BY page DESC, pos DESC, slice_no DESC, received_at DESC) = 1)) WHERE t IS NOT NULL
AND EXISTS (SELECT 1 FROM present p, newest_no WHERE p.snapshot_no = m - 1 AND NOT EXISTS (SELECT 1 FROM present q WHERE q.snapshot_no = m AND q.id = p.id))""")
def sync_pruned_tags(spark, sf_dir):
    """The tag table after the full runs, the last of which removed something: no tag without a holder."""
    return _after_all(spark, sf_dir)[0].read("tags")


_FRESH = """(SELECT x.* FROM seen x WHERE x.snapshot_no = {k} AND (x.page, x.pos, x.slice_no, x.received_at) < coalesce((SELECT min((page, pos, slice_no, received_at)) FROM seen WHERE snapshot_no = {k} AND starred_at <= {mark}), (2147483647, 0, 0, TIMESTAMPTZ '2000-01-01 00:00:00+00')))"""
_MARKED = "date_trunc('second', {}::TIMESTAMPTZ)"


@query(_ROWS + f""", w1 AS (SELECT {_MARKED.format('max(starred_at)')} AS m FROM seen WHERE snapshot_no = 1),
fresh2 AS (SELECT * FROM {_FRESH.format(k=2, mark="(SELECT m FROM w1)")}), w2 AS (SELECT coalesce({_MARKED.format('max(starred_at)')}, (SELECT m FROM w1)) AS m FROM fresh2),
held2 AS (SELECT id FROM present WHERE snapshot_no = 1 UNION SELECT id FROM fresh2),
fresh3 AS (SELECT * FROM {_FRESH.format(k=3, mark="(SELECT m FROM w2)")}), held3 AS (SELECT id FROM held2 UNION SELECT id FROM fresh3), remote AS (SELECT id FROM present WHERE snapshot_no = 3),
drift AS (SELECT (SELECT count(*) FROM remote) <> (SELECT count(*) FROM held3) AS d),
w3 AS (SELECT CASE WHEN d THEN (SELECT {_MARKED.format('max(starred_at)')} FROM seen WHERE snapshot_no = 3) ELSE coalesce((SELECT {_MARKED.format('max(starred_at)')} FROM fresh3), (SELECT m FROM w2)) END AS m FROM drift),
told AS (SELECT 1 AS step, 'full' AS mode, n AS seen, n AS written, 0::BIGINT AS removed, (SELECT count(*) FROM present WHERE snapshot_no = 1) AS repos, (SELECT m FROM w1) AS mark FROM sized WHERE snapshot_no = 1
UNION ALL SELECT 2, 'incremental', (SELECT count(*) FROM fresh2), (SELECT count(*) FROM fresh2), 0, (SELECT count(*) FROM held2), (SELECT m FROM w2)
UNION ALL SELECT 3, CASE WHEN d THEN 'full' ELSE 'incremental' END, CASE WHEN d THEN greatest((SELECT count(*) FROM fresh3), (SELECT n FROM sized WHERE snapshot_no = 3)) ELSE (SELECT count(*) FROM fresh3) END, (SELECT count(*) FROM fresh3),
  CASE WHEN d THEN (SELECT count(*) FROM held3 WHERE id NOT IN (SELECT id FROM remote)) ELSE 0 END, CASE WHEN d THEN (SELECT count(*) FROM remote) ELSE (SELECT count(*) FROM held3) END, (SELECT m FROM w3) FROM drift)
SELECT step, mode, seen, written, removed, repos, strftime(mark AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS watermark, '2026-03-0' || step || 'T00:00:00Z' AS last_run FROM told""")
def sync_incremental_counters(spark, sf_dir):
    """A first run, which is full; a second, which takes what is newer; a third, which finds
    the counts apart and reconciles."""
    catalog, items, out = sync.Catalog(spark, _folder(spark)), _listing(spark, sf_dir), []
    for step in (1, 2, 3):
        mine = items.where(F.col("snapshot_no") == step).drop("snapshot_no")
        how = {"remote_count": mine.where(F.col("repo.id").isNotNull()).select("repo.id").distinct().count()} if step == 3 else {}
        s = sync.sync(catalog, mine, _now(step), **how)
        out.append((step, s.mode, s.seen, s.written, s.removed, catalog.read("repos").count(), catalog.get(sync.WATERMARK), catalog.get(sync.LAST_RUN)))
    return spark.createDataFrame(out, "step int, mode string, seen bigint, written bigint, removed bigint, repos bigint, watermark string, last_run string")


@query(_VIEW + """, first_text AS (SELECT repo_id, arg_min(text, doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT c.id, coalesce(f.text, 'asked again') AS text FROM cat c LEFT JOIN first_text f ON f.repo_id = c.id""")
def readme_cache(spark, sf_dir):
    """Texts asked for twice: the second time only those that weren't found are fetched."""
    catalog = _filled(spark, sf_dir)
    texts = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.col("repo_id").alias("id")).agg(F.min_by("text", "doc_id").alias("text"))
    wanted = catalog.read("repos").select("id")
    sync.cached_texts(catalog, wanted, lambda missing: missing.select("id").join(texts, "id", "left"), _now(1))
    return sync.cached_texts(catalog, wanted, lambda missing: missing.select("id", F.lit("asked again").alias("text")), _now(2))


def _filled(spark, sf_dir) -> sync.Catalog:
    """A catalog that holds the repositories of the view."""
    catalog = sync.Catalog(spark, _folder(spark))
    rows = view(spark, sf_dir)
    with catalog.tables.transaction() as t:
        t.write("repos", store.upsert(t.read("repos"), rows.drop("tags", "groups").withColumn("ordinal", F.lit(0)), "ordinal", _now(1)), ["id"])
        catalog.link(t, model.tag_links(rows))
        t.write("group_members", model.group_links(rows))
    return catalog


@query(_VIEW + """ SELECT c.id, full_name, stargazers, epoch_us(coalesce(synced_at, TIMESTAMPTZ '2026-03-01 00:00:00+00')) AS synced, coalesce(cardinality(languages), 0)::INTEGER AS n_languages, true AS plain FROM cat c""")
def store_round_trip(spark, sf_dir):
    """The view put into the store's tables and read again; an upsert sets no etag."""
    return _filled(spark, sf_dir).read("repos").select("id", "full_name", "stargazers", F.unix_micros("synced_at").alias("synced"), F.size("languages").alias("n_languages"), F.col("etag").isNull().alias("plain"))


@query(_VIEW + " SELECT DISTINCT name, source FROM links")
def tag_table(spark, sf_dir):
    """Tags that came to be because a link names them."""
    return _filled(spark, sf_dir).read("tags")


@query("SELECT 'run.' || slice_no AS key, removed::VARCHAR AS value FROM sync_runs QUALIFY row_number() OVER (PARTITION BY slice_no ORDER BY snapshot_no DESC) = 1 AND removed IS NOT NULL")
def state_table(spark, sf_dir):
    """The state after each logged run put in what it removed, later values over earlier ones."""
    state = spark.createDataFrame([], "key string, value string")
    for run in read_table(spark, sf_dir, "sync_runs").orderBy("snapshot_no", "slice_no").groupBy("snapshot_no").agg(F.collect_list(F.struct("slice_no", "removed")).alias("all")).orderBy("snapshot_no").collect():  # one row per snapshot
        state = store.state_put(state, {f"run.{r.slice_no}": None if r.removed is None else str(r.removed) for r in run["all"]})
    return state


@query("SELECT * FROM (VALUES (2::BIGINT, 'p', 'large', NULL::VARCHAR, 0::BIGINT), (1::BIGINT, 'p', 'small', '2026-03-02T00:00:00Z', 7::BIGINT)) t(id, provider, model, finished, repos_count)")
def run_log(spark, sf_dir):
    """Two runs begun, the first of them finished."""
    runs = spark.createDataFrame([], store.RUNS)
    for name in ("small", "large"):
        runs = store.begin_run(runs, "p", name, _now(1))
    told = store.recent_runs(store.finish_run(runs, 1, _now(2), 7), 5)
    return told.select("id", "provider", "model", display.format_time(F.col("finished_at")).alias("finished"), "repos_count")


# Sources.

@query("""WITH page AS (SELECT snapshot_no, slice_no, page, received_at, bool_and(json_valid(payload)) AS whole, list(payload ORDER BY pos, payload) AS l FROM star_items WHERE payload IS NOT NULL GROUP BY ALL)
SELECT snapshot_no, slice_no, page, i::INTEGER AS position, TRY_CAST(l[i + 1]->>'$.repo.id' AS BIGINT) AS id FROM (SELECT *, unnest(range(len(l))) AS i FROM page WHERE whole)""")
def star_pages(spark, sf_dir):
    """Page files written and read again; a page with a broken item is a broken page."""
    root = _folder(spark)
    keys = ["snapshot_no", "slice_no", "page", "received_at"]
    pages = read_table(spark, sf_dir, "star_items").where("payload IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("l"))
    pages = pages.withColumn("_at", F.unix_micros("received_at")).select("snapshot_no", "slice_no", "page", "_at", F.concat(F.lit("["), F.array_join(F.col("l.payload"), ","), F.lit("]")).alias("value"))
    pages.write.partitionBy("snapshot_no", "slice_no", "page", "_at").text(root)
    read = wire.read_pages(spark, root)
    part = lambda name: F.regexp_extract("file", f"{name}=([0-9]+)", 1).cast("int").alias(name)
    return read.select(part("snapshot_no"), part("slice_no"), part("page"), "position", F.col("repo.id").alias("id"))


@query("SELECT seq, len(json_keys(languages_json, '$.data')) AS members FROM repos WHERE json_valid(languages_json) AND json_type(languages_json) = 'OBJECT' AND json_type(languages_json, '$.data') = 'OBJECT'")
def envelopes(spark, sf_dir):
    """Envelopes among the stored languages, without what encloses their data."""
    rows = read_table(spark, sf_dir, "repos").where(F.get_json_object("languages_json", "$.data").startswith("{"))
    return rows.select("seq", F.size(wire.unwrap(F.col("languages_json"), "map<string,string>")).cast("bigint").alias("members"))


@query("SELECT i AS id, i % 7 = 0 AS has_people, true AS consistent FROM range(1, 1 + (SELECT count(*) FROM repos)) t(i)")
def synthetic_rows(spark, sf_dir):
    """As many made-up repositories as the store has rows."""
    made = synthetic.synthetic_catalog(spark, read_table(spark, sf_dir, "repos").count())
    fine = (F.concat_ws("/", "owner", "name") == F.col("full_name")) & F.size("topics").between(1, 3) & (F.element_at("languages", F.col("primary_language")) >= 20_000) & (F.col("stargazers") >= 0) & (F.col("starred_at") <= F.col("synced_at"))
    return made.select("id", F.col("contributors").isNotNull().alias("has_people"), fine.alias("consistent"))


# Query texts, facets and display.

_TEXT = with_filter(with_sort("lang:sable sort:name", SortKey.RECENT), "-is:fork")


@query(_VIEW + " SELECT id, row_number() OVER (ORDER BY last_commit_at DESC NULLS LAST, stargazers DESC, full_name, id) AS rank FROM cat WHERE NOT fork AND (coalesce(lower(primary_language) = 'sable', false) OR list_contains(list_transform(map_keys(languages), lambda k: lower(k)), 'sable'))")
def query_rewritten(spark, sf_dir):
    """A text whose order was changed and to which a clause was added."""
    asked = parse(_TEXT)
    rows = view(spark, sf_dir).where(predicates.query_predicate(asked)).select("id", "full_name", "stargazers", "last_commit_at", "starred_at")
    return ordering.with_rank(rows, ordering.order_columns(ordering.effective_sort(asked))).select("id", "rank")


@query(_VIEW + " SELECT id, row_number() OVER (ORDER BY starred_at DESC NULLS LAST, stargazers DESC, full_name, id) AS rank FROM cat WHERE stargazers > 3")
def sort_by_default(spark, sf_dir):
    """The order of a query that names none and has no free text."""
    asked = parse("stars:>3")
    rows = view(spark, sf_dir).where(predicates.query_predicate(asked)).select("id", "full_name", "stargazers", "starred_at")
    return ordering.with_rank(rows, ordering.order_columns(ordering.effective_sort(asked))).select("id", "rank")


@query("SELECT * FROM (VALUES ('filter', 'Hide forks')) t(kind, label)")
def command_search(spark, sf_dir):
    return spark.createDataFrame(commands("FORK"), "kind string, label string")


@query(_VIEW + " SELECT DISTINCT name FROM links WHERE name IN ('terminal', 'Terminal', 'no such tag', 'database')")
def known_selection(spark, sf_dir):
    """Which of the selected names still are facets, in this very spelling."""
    names = predicates.known_selection({"terminal", "Terminal", "no such tag", "database"}, facets.tag_facets(model.tag_links(view(spark, sf_dir))))
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


@query(_VIEW + """ SELECT c.id, coalesce(t, '') AS cells FROM cat c LEFT JOIN (SELECT id, string_agg(x.name || CASE WHEN x.source = 'ai' THEN ' (muted)' ELSE '' END, '|' ORDER BY x.source DESC, x.confidence DESC, x.name) AS t
FROM (SELECT * FROM (SELECT id, unnest(tags) AS x FROM cat) QUALIFY row_number() OVER (PARTITION BY id ORDER BY x.source DESC, x.confidence DESC, x.name) <= 4) GROUP BY id) g ON g.id = c.id""")
def tag_cells(spark, sf_dir):
    """The first four tags of each row, the model's own marked."""
    shown = F.transform(display.tag_cells(F.col("tags")), lambda t: F.concat(t["name"], F.when(t["muted"], " (muted)").otherwise("")))
    return view(spark, sf_dir).select("id", F.array_join(shown, "|").alias("cells"))


_HUE = "(list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substring(h, (2 * i + 1)::INTEGER, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 360)::INTEGER"
_COLORS = ", ".join(f"('{n}', {h}, {s}::DOUBLE, {l}::DOUBLE)" for n, (h, s, l) in display.LANGUAGE_COLORS.items())


@query(_VIEW + f""", known(name, hue, s, l) AS (VALUES {_COLORS}), named AS (SELECT DISTINCT primary_language AS name FROM cat WHERE primary_language IS NOT NULL UNION SELECT name FROM known)
SELECT n.name, coalesce(k.hue, {_HUE})::INTEGER AS hue, coalesce(s, {display.OTHER_SATURATION}::DOUBLE) AS saturation, coalesce(l, {display.OTHER_LIGHTNESS}::DOUBLE) AS lightness FROM (SELECT name, hex(encode(name)) AS h FROM named) n LEFT JOIN known k ON k.name = n.name""")
def language_colors(spark, sf_dir):
    """The colour of every language of the catalog and of every language with one of its own."""
    names = view(spark, sf_dir).where("primary_language IS NOT NULL").select(F.col("primary_language").alias("name")).distinct()
    names = names.union(spark.createDataFrame([(n,) for n in display.LANGUAGE_COLORS], "name string")).distinct()
    return names.select("name", display.language_color(F.col("name")).alias("c")).select("name", "c.hue", "c.saturation", "c.lightness")


# Enrichment with a stand-in for the model.

def _tags_reply(prompt: str) -> str:
    """Tags by rule: the language and the first topic. Some batches fail, some need to be asked twice."""
    asked = json.loads(prompt.split("\n")[0])
    first = asked[0]["full_name"]
    if first[0] in "rs":
        raise OSError("no route")
    if first[0] in "abcd" and "\n" not in prompt:
        return "Sorry, here is half of it: {"
    told = [{"full_name": r["full_name"], "tags": [r.get("language") or "", {"name": (r.get("topics") or [""])[0], "confidence": 0.25}]} for r in asked]
    return "Sure:\n" + json.dumps({"repos": [*told, {"full_name": "no-such/repository", "tags": ["x"]}]})


def _groups_reply(prompt: str) -> str:
    """Groups by rule: the first letter of the first tag."""
    groups: dict[str, list[str]] = {}
    for r in json.loads(prompt):
        if r["tags"]:
            groups.setdefault(r["tags"][0][0], []).append(r["full_name"])
    return json.dumps({"groups": [{"name": f"Tags in {k}", "summary": " by rule ", "members": m} for k, m in groups.items()]})


_KEYED = lambda x: f"regexp_replace(lower({trimmed_sql(x)}), '{SQL_SPACE}+', '-', 'g')"
_MODEL = _VIEW + ", " + SQL_BATCHES + f""", asked AS (SELECT b.*, min(full_name) OVER (PARTITION BY batch) AS head FROM batched b),
fine AS (SELECT a.batch, a.full_name, c.primary_language, c.topics FROM asked a JOIN cat c ON c.id = a.id WHERE left(head, 1) NOT IN ('r', 's')),
each AS (SELECT batch, full_name, {_KEYED("coalesce(primary_language, '')")} AS name, 0.5::DOUBLE AS confidence, 0 AS place FROM fine UNION ALL SELECT batch, full_name, {_KEYED("coalesce(topics[1], '')")}, 0.25, 1 FROM fine),
said AS (SELECT * FROM each WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY batch, full_name, name ORDER BY place) = 1)"""


def _outcome(spark, sf_dir) -> tuple[DataFrame, enrich.Outcome]:
    v = view(spark, sf_dir)
    known = v.groupBy("full_name").agg(F.flatten(F.array_sort(F.collect_list(F.struct("id", F.col("tags.name").alias("names"))))["names"]).alias("tags"))
    return v, enrich.analyse(v, _tags_reply, _groups_reply, known, ordering.tie_break(), most=1 << 28)


@query(_MODEL + """ SELECT count(DISTINCT batch) AS batches, count(DISTINCT batch) FILTER (left(head, 1) IN ('r', 's')) AS failed, (SELECT count(*) FROM (SELECT DISTINCT batch, full_name FROM said)) + count(DISTINCT batch) FILTER (left(head, 1) NOT IN ('r', 's')) AS repos, NULL::VARCHAR AS group_error FROM asked""")
def enrich_run_counts(spark, sf_dir):
    """What an enrichment run says it did; every good reply tells of one repository that isn't there."""
    out = _outcome(spark, sf_dir)[1]
    return spark.createDataFrame([(out.batches, out.failed, out.repos, out.group_error)], "batches bigint, failed bigint, repos bigint, group_error string")


@query(_MODEL + """, ids AS (SELECT full_name, min(id) AS repo_id FROM cat GROUP BY ALL), told AS (SELECT repo_id, name, confidence FROM said JOIN ids USING (full_name))
SELECT repo_id, name, source, round(confidence, 6) AS confidence FROM links WHERE source <> 'ai' OR repo_id NOT IN (SELECT repo_id FROM told)
UNION ALL SELECT repo_id, name, 'ai', round(confidence, 6) FROM told t WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.repo_id = t.repo_id AND l.source = 'user' AND lower(l.name) = lower(t.name))""")
def enrich_run_tags(spark, sf_dir):
    """The tag links after the replies' names were resolved and the model's tags replaced."""
    v, out = _outcome(spark, sf_dir)
    return store.replace_ai_tags(model.tag_links(v), enrich.resolved(out.tags, v)).withColumn("confidence", F.round("confidence", 6))


@query(_MODEL + f""", have AS (SELECT full_name, {trimmed_sql('x.name')} AS name, 0 AS which, id AS a, row_number() OVER (PARTITION BY id ORDER BY x.source DESC, x.confidence DESC, x.name) AS b FROM (SELECT id, full_name, unnest(tags) AS x FROM cat)),
firsts AS (SELECT full_name, name FROM (SELECT * FROM have UNION ALL SELECT full_name, name, 1, batch, place FROM said) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY which, a, b) = 1),
linked AS (SELECT 'Tags in ' || left(f.name, 1) AS name, c.id FROM firsts f JOIN cat c USING (full_name))
SELECT repo_id, group_name FROM members WHERE group_name NOT IN (SELECT name FROM group_list WHERE source = 'ai') UNION SELECT id, name FROM linked""")
def enrich_run_groups(spark, sf_dir):
    """The members of groups after the grouping pass, which saw known and new tags."""
    v, out = _outcome(spark, sf_dir)
    told = out.groups.select("name", "summary", "ordinal").distinct()
    return store.replace_ai_groups(read_table(spark, sf_dir, "group_list"), model.group_links(v), told, out.groups.select("name", F.col("member").alias("full_name")), v)[1]
