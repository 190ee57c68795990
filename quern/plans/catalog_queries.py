"""Queries of the catalog over the test tables, with the same in DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import display, fulltext, fuzzy
from quern.functions.names import SQL_SPACE, trimmed, trimmed_sql
from quern.operators import catalog as model
from quern.operators import enrich, facets, ordering, predicates, search, store
from quern.operators.current import current_columns, current_rows
from quern.plans.query import SortKey, parse
from quern.session import cut_lineage, ensure_checkpoint_dir, read_table
from quern.sources import wire
from quern.sources.tables import TableStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_VIEW = """WITH newest AS (
  SELECT * FROM repos WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY synced_at DESC NULLS LAST, seq DESC NULLS LAST) = 1
), cat AS (
  SELECT id, node_id, full_name, name, owner, html_url, description, primary_language, last_commit_at, starred_at, updated_at, synced_at, etag,
    coalesce(stargazers, 0) AS stargazers, coalesce(archived, false) AS archived, coalesce(fork, false) AS fork,
    CASE WHEN m IS NULL OR len(list_filter(map_values(m), lambda v: v IS NULL)) > 0 THEN MAP([]::VARCHAR[], []::BIGINT[]) ELSE m END AS languages,
    list_filter(coalesce(topics, []), lambda x: x IS NOT NULL) AS topics,
    list_filter(coalesce(tags, []), lambda t: t.name IS NOT NULL) AS tags,
    list_sort(list_filter(coalesce(groups, []), lambda x: x IS NOT NULL)) AS groups
  FROM (SELECT *, CASE WHEN json_valid(languages_json) AND json_type(languages_json) = 'OBJECT' THEN TRY_CAST(languages_json::JSON AS MAP(VARCHAR, BIGINT)) END AS m FROM newest)
), links AS (
  SELECT id AS repo_id, t.name AS name, t.source AS source, max(t.confidence)::DOUBLE AS confidence FROM (SELECT id, unnest(tags) AS t FROM cat) GROUP BY ALL
), members AS (SELECT DISTINCT id AS repo_id, unnest(groups) AS group_name FROM cat)"""
_NOW = "2026-03-01 00:00:00"


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.catalog(read_table(spark, sf_dir, "repos"))


def query(sql: str | None = None):
    """Registers a query under its function's name; the SQL sees cat, links and members."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _VIEW + " " + sql
        return f

    return add


def on_view(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir))
    SQL[name] = _VIEW + " " + sql


def _links(spark, sf_dir):
    return model.tag_links(view(spark, sf_dir))


# The view, lookups and projections.

@query("""SELECT c.id, full_name, stargazers, archived, fork, array_to_string(topics, '|') AS topics, array_to_string(groups, '|') AS groups, coalesce(t, '') AS tags, cardinality(languages)::BIGINT AS n_languages
FROM cat c LEFT JOIN (SELECT id, string_agg(x.name || '/' || x.source, '|' ORDER BY x.source DESC, x.confidence DESC, x.name) AS t FROM (SELECT id, unnest(tags) AS x FROM cat) GROUP BY id) g ON g.id = c.id""")
def catalog_view(spark, sf_dir):
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["name"], F.lit("/"), t["source"])), "|")
    return view(spark, sf_dir).select("id", "full_name", "stargazers", "archived", "fork", F.array_join("topics", "|").alias("topics"), F.array_join("groups", "|").alias("groups"), tags.alias("tags"), F.size("languages").cast("bigint").alias("n_languages"))


@query("""SELECT c.id, full_name, coalesce(t, '') AS tags, coalesce(g, '') AS groups FROM cat c
LEFT JOIN (SELECT repo_id, string_agg(name || '/' || source, '|' ORDER BY source DESC, confidence DESC, name) AS t FROM links GROUP BY ALL) l ON l.repo_id = c.id
LEFT JOIN (SELECT repo_id, string_agg(group_name, '|' ORDER BY group_name) AS g FROM members GROUP BY ALL) m ON m.repo_id = c.id""")
def view_from_tables(spark, sf_dir):
    v = view(spark, sf_dir)
    joined = model.with_lists(v.select("id", "full_name"), model.tag_links(v), model.group_links(v))
    return joined.select("id", "full_name", F.array_join(F.transform("tags", lambda t: F.concat(t["name"], F.lit("/"), t["source"])), "|").alias("tags"), F.array_join("groups", "|").alias("groups"))


_RECORD = ("id", "node_id", "full_name", "name", "owner", "html_url", "description", "stargazers", "primary_language", "archived", "fork", "etag")
_LISTED = """coalesce(t, '') AS tags, coalesce(g, '') AS groups, CASE WHEN json_valid(k.contributors_json) AND json_type(k.contributors_json) = 'ARRAY' THEN json_array_length(k.contributors_json)::INTEGER END AS n_contributors FROM cat c
JOIN (SELECT id, contributors_json FROM newest) k ON k.id = c.id
LEFT JOIN (SELECT repo_id, string_agg(name || '/' || source, '|' ORDER BY source DESC, confidence DESC, name) AS t FROM links GROUP BY ALL) l ON l.repo_id = c.id
LEFT JOIN (SELECT repo_id, string_agg(group_name, '|' ORDER BY group_name) AS g FROM members GROUP BY ALL) m ON m.repo_id = c.id"""


def _whole(spark, sf_dir):
    """The view with contributors, as the table of repositories is."""
    rows = read_table(spark, sf_dir, "repos")
    people = current_columns(rows, "id", ["synced_at", "seq"], ["contributors_json"])
    return view(spark, sf_dir).join(people.select("id", model.stored_contributors(F.col("contributors_json")).alias("contributors")), "id")


def _told(df):
    return df.select(*_RECORD, F.array_join(F.transform("tags", lambda t: F.concat(t["name"], F.lit("/"), t["source"])), "|").alias("tags"), F.array_join("groups", "|").alias("groups"), F.size("contributors").alias("n_contributors")).withColumn("n_contributors", F.when(F.col("n_contributors") >= 0, F.col("n_contributors")))


@query(f"SELECT {', '.join('c.' + c for c in _RECORD)}, {_LISTED} WHERE c.id IN (SELECT repo_id FROM documents)")
def lookup_by_id(spark, sf_dir):
    """Whole records, with contributors, tags and groups, of the repositories that documents name."""
    v = _whole(spark, sf_dir)
    wanted = read_table(spark, sf_dir, "documents").select(F.col("repo_id").alias("id"))
    return _told(model.records(v.drop("tags", "groups"), model.tag_links(v), model.group_links(v), wanted))


@query(f"SELECT {', '.join('c.' + c for c in _RECORD)}, {_LISTED} WHERE c.id = (SELECT min(id) FROM repos)")
def lookup_one(spark, sf_dir):
    """The whole record of one id; the filter on it stands in front of every aggregation."""
    one = read_table(spark, sf_dir, "repos").agg(F.min("id")).first()[0]
    v = _whole(spark, sf_dir)
    return _told(model.record(v.drop("tags", "groups"), model.tag_links(v), model.group_links(v), one if one is not None else -1))


@query("SELECT DISTINCT c.id, c.full_name FROM cat c JOIN (SELECT json_extract_string(payload, '$.repo.full_name') AS f FROM star_items WHERE json_valid(payload)) s ON s.f = c.full_name")
def lookup_by_full_name(spark, sf_dir):
    items = read_table(spark, sf_dir, "star_items").select(wire.parse_items(F.col("payload"))["repo"]["full_name"].alias("full_name"))
    return view(spark, sf_dir).select("id", "full_name").join(items, "full_name", "left_semi").select("id", "full_name")


on_view("row_count", lambda v: v.agg(F.count("*").alias("repos")), "SELECT count(*) AS repos FROM cat")
on_view("known_ids", lambda v: v.select("id").distinct(), "SELECT DISTINCT id FROM cat")
on_view(
    "summary_json", lambda v: predicates.summaries(v).select("id", F.to_json(F.struct("full_name", "description", "topics", "language"), {"ignoreNullFields": "true"}).alias("summary")).select("id", F.length("summary").cast("bigint").alias("chars"), F.get_json_object("summary", "$.topics").isNotNull().alias("has_topics")),
    """SELECT id, (length('{"full_name":' || to_json(full_name) || coalesce(',"description":' || to_json(description), '') || CASE WHEN len(topics) > 0 THEN ',"topics":' || to_json(topics) ELSE '' END || coalesce(',"language":' || to_json(primary_language), '') || '}'))::BIGINT AS chars, len(topics) > 0 AS has_topics FROM cat""",
)


# Filters.

def _filter(name: str, text: str, sql: str) -> None:
    on_view(name, lambda v: v.where(predicates.query_predicate(parse(text))).select("id"), f"SELECT id FROM cat WHERE {sql}")


_low = _FOLD.format
_LANG = lambda x: f"(coalesce({_low('primary_language')} = '{x}', false) OR list_contains(list_transform(map_keys(languages), lambda k: {_low('k')}), '{x}'))"
_TAG = lambda x: f"(list_contains(list_transform(tags, lambda t: {_low('t.name')}), '{x}') OR list_contains(list_transform(topics, lambda t: {_low('t')}), '{x}'))"
_filter("filter_language", "lang:FERRULE", _LANG("ferrule"))
_filter("filter_tag_or_topic", "tag:Terminal", _TAG("terminal"))
_filter("filter_group", 'group:"data plumbing"', f"list_contains(list_transform(groups, lambda g: {_low('g')}), 'data plumbing')")
_filter("filter_owner", "owner:NimbusForge-Labs", f"coalesce({_low('owner')} = 'nimbusforge-labs', false)")
_filter("filter_stars_range", "stars:10..1k", "stargazers BETWEEN 10 AND 1000")
_filter("filter_stars_open", "stars:>=50", "stargazers >= 50")
_filter("filter_archived", "is:archived", "archived")
_filter("filter_not_fork", "-is:fork", "NOT fork")
_filter("filter_negated_language", "-lang:ferrule", f"NOT {_LANG('ferrule')}")
_filter("query_string", 'lang:sable -tag:terminal stars:>5 -is:fork is:active "free text" sort:name', f"{_LANG('sable')} AND NOT {_TAG('terminal')} AND stargazers > 5 AND NOT fork AND NOT archived")
on_view(
    "facet_predicate", lambda v: v.where(predicates.facet_predicate({"terminal", "Library"}, {"Data plumbing", "Search and ranking"})).select("id"),
    f"SELECT id FROM cat WHERE list_has_any(list_transform(tags, lambda t: {_low('t.name')}), ['terminal', 'library']) AND list_has_any(list_transform(groups, lambda g: {_low('g')}), ['data plumbing', 'search and ranking'])",
)
on_view("stale_rows", lambda v: predicates.stale_rows(v, F.lit("2026-02-12 00:00:00").cast("timestamp")).select("id"), "SELECT id FROM cat WHERE synced_at IS NULL OR synced_at < TIMESTAMPTZ '2026-02-12 00:00:00+00'")
on_view("without_languages_top", lambda v: predicates.without_languages(v, 60).select("id", "stargazers"), "SELECT id, stargazers FROM cat WHERE cardinality(languages) = 0 ORDER BY stargazers DESC, id LIMIT 60")


@query("SELECT doc_id, fetched_at IS NOT NULL AND fetched_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00' AS fresh FROM documents")
def cache_freshness(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", predicates.fresh(F.col("fetched_at"), F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("fresh"))


# Orders.

_TIES = "stargazers DESC, full_name, id"
for _key, _lead in ((SortKey.STARS, ""), (SortKey.NAME, "lower(full_name), "), (SortKey.RECENT, "last_commit_at DESC NULLS LAST, "), (SortKey.STARRED, "starred_at DESC NULLS LAST, ")):
    on_view(
        f"sort_{_key.value}", lambda v, k=_key: ordering.with_rank(v.select("id", "full_name", "stargazers", "last_commit_at", "starred_at"), ordering.order_columns(k)).select("id", "rank"),
        f"SELECT id, row_number() OVER (ORDER BY {_lead}{_TIES}) AS rank FROM cat",
    )
on_view("batches_of_25", lambda v: ordering.chunked(v.select("id", "full_name", "stargazers"), ordering.tie_break()).select("id", "batch"), f"SELECT id, (row_number() OVER (ORDER BY {_TIES}) - 1) // 25 AS batch FROM cat")


# Facets.

_TAGS = "counted AS (SELECT name, source, count(*) AS count FROM links GROUP BY ALL)"
_MERGED = f"""{_TAGS}, merged AS (
  SELECT first(name ORDER BY count DESC, name, source) AS name, ['github', 'ai', 'user'][1 + max(CASE source WHEN 'ai' THEN 1 WHEN 'user' THEN 2 ELSE 0 END)] AS source, sum(count)::BIGINT AS count
  FROM counted GROUP BY {_low('name')} HAVING sum(count) > 1)"""
on_view("tag_facets", lambda v: facets.tag_facets(model.tag_links(v)), f", {_TAGS} SELECT * FROM counted")
on_view("merged_facets", lambda v: facets.merged_facets(facets.tag_facets(model.tag_links(v))), f", {_MERGED} SELECT * FROM merged")
on_view("facet_head_40", lambda v: facets.facet_head(facets.merged_facets(facets.tag_facets(model.tag_links(v)))), f", {_MERGED} SELECT * FROM merged ORDER BY count DESC, name LIMIT 40")


@query("SELECT g.name, g.summary, count(m.repo_id) AS count FROM group_list g LEFT JOIN members m ON m.group_name = g.name GROUP BY ALL")
def group_facets(spark, sf_dir):
    return facets.group_facets(read_table(spark, sf_dir, "group_list"), model.group_links(view(spark, sf_dir)))


on_view("language_totals", lambda v: v.select("id", display.language_total(F.col("languages")).alias("bytes")), "SELECT id, coalesce(list_sum(map_values(languages)), 0)::BIGINT AS bytes FROM cat")
on_view("newest_star", lambda v: v.agg(F.unix_micros(F.max("starred_at")).alias("newest")), "SELECT epoch_us(max(starred_at)) AS newest FROM cat")


# Full text and search.

def _fts(name: str, terms: list[str]) -> None:
    on_view(name, lambda v: fulltext.bm25(fulltext.index_texts(v), terms).select("id", F.round("rel", 6).alias("rel")), f", {fulltext.bm25_sql('cat', terms)} SELECT id, round(rel, 6) AS rel FROM hits")


_fts("fts_prefix", ["comm"])
_fts("fts_all_terms", ["Read", "pre"])
_fts("fts_phrase", ["static-sit"])
_fts("fts_folded", ["CAFE"])
_fts("fts_folded_query", ["Überblick"])
on_view("fts_top", lambda v: fulltext.top(fulltext.bm25(fulltext.index_texts(v), ["in"]), 25).select("id", F.round("rel", 6).alias("rel")), f", {fulltext.bm25_sql('cat', ['in'])} SELECT id, round(rel, 6) AS rel FROM hits ORDER BY hits.rel DESC, id LIMIT 25")
on_view("fts_nothing", lambda v: fulltext.bm25(fulltext.index_texts(v), ["--", " "]), "SELECT id, 0.0::DOUBLE AS rel FROM cat WHERE false")


@query(f", {fulltext.bm25_sql('cat', ['static-sit', 'lib'])} SELECT id, round(rel, 6) AS rel FROM hits")
def fts_from_postings(spark, sf_dir):
    """BM25 over a written index: written once for a folder of tables, then only read."""
    entries, sizes = written_index(spark, sf_dir)
    return fulltext.postings_bm25(entries, sizes, ["static-sit", "lib"]).select("id", F.round("rel", 6).alias("rel"))


def written_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the view, as tables in the session's shared folder; they are
    written by the first query that asks for them, sorted by token."""
    root = f"{ensure_checkpoint_dir(spark)}/index-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    store_ = TableStore(spark, root)
    if not store_.exists("lengths"):
        index = cut_lineage(fulltext.index_texts(view(spark, sf_dir)))
        with store_.transaction() as t:
            t.write("postings", fulltext.postings(index).repartitionByRange("token"), ["token"])
            t.write("lengths", fulltext.lengths(index))
    return store_.read("postings"), store_.read("lengths")


on_view("subsequence_match", lambda v: v.where(fuzzy.matches(F.col("full_name"), "nfl !wq")).select("id"), "SELECT id FROM cat WHERE regexp_matches(lower(full_name), 'n.*f.*l') AND NOT contains(lower(full_name), 'wq')")
on_view("search_browse", lambda v: search.search(v, "lang:ferrule stars:>20").select("id", "score"), f"SELECT id, 0.0::DOUBLE AS score FROM cat WHERE {_LANG('ferrule')} AND stargazers > 20")
QUERIES["search_hybrid"] = lambda spark, sf_dir: search.search(view(spark, sf_dir), "-is:archived reader").select("id", "full_name", "fuzzy", "fts", "score")
QUERIES["search_fuzzy_only"] = lambda spark, sf_dir: search.search(view(spark, sf_dir), "nflb stars:>3", fts=False).select("id", "full_name", "score")
_BEST = f", {fulltext.bm25_sql('cat', ['in'])}, best AS (SELECT * FROM hits ORDER BY rel DESC, id LIMIT 100) SELECT id, round(rel / (SELECT max(rel) FROM best), 6) AS fts, round(0.3 * rel / (SELECT max(rel) FROM best), 6) AS score FROM best JOIN cat USING (id) WHERE NOT regexp_matches(lower(full_name), 'i.*n')"


def _fts_only(found: DataFrame) -> DataFrame:
    return found.where("fuzzy = 0 AND fts > 0").select("id", F.round("fts", 6).alias("fts"), F.round("score", 6).alias("score"))


on_view("hybrid_fts_only_rows", lambda v: _fts_only(search.search(v, "in", fts_limit=100)), _BEST)


@query(_BEST)
def hybrid_from_postings(spark, sf_dir):
    """The same over a written index."""
    return _fts_only(search.search(view(spark, sf_dir), "in", index=written_index(spark, sf_dir), fts_limit=100))


@query("SELECT id, full_name FROM cat WHERE stargazers > 3 ORDER BY starred_at DESC NULLS LAST, stargazers DESC, full_name, id LIMIT 50")
def search_top(spark, sf_dir):
    """The first 50 rows of a browsing search, without a global sort."""
    return search.search(view(spark, sf_dir), "stars:>3", limit=50).select("id", "full_name")


QUERIES["search_hybrid_top"] = lambda spark, sf_dir: search.search(view(spark, sf_dir), "-is:archived reader", index=written_index(spark, sf_dir), limit=50).select("id", "full_name", "score")


# Display values.

on_view("compact_count", lambda v: v.select("id", display.compact_count(F.col("stargazers") * 37 - 40).alias("shown")), """SELECT id, CASE WHEN n < 0 THEN '-' ELSE '' END || replace(replace(CASE WHEN abs(n) < 1000 THEN abs(n)::VARCHAR WHEN abs(n) < 10000 THEN printf('%.1fk', abs(n) / 1000.0::DOUBLE) WHEN abs(n) < 1000000 THEN (abs(n) // 1000) || 'k' WHEN abs(n) < 10000000 THEN printf('%.1fM', abs(n) / 1000000.0::DOUBLE) ELSE (abs(n) // 1000000) || 'M' END, '.0k', 'k'), '.0M', 'M') AS shown FROM (SELECT id, stargazers * 37 - 40 AS n FROM cat)""")
on_view(
    "relative_time", lambda v: v.select("id", display.relative_time(F.col("last_commit_at"), F.lit(_NOW).cast("timestamp")).alias("ago")),
    f"""SELECT id, CASE WHEN s IS NULL THEN '—' WHEN s >= 31536000 THEN (s // 31536000) || 'y' WHEN s >= 2592000 THEN (s // 2592000) || 'mo' WHEN s >= 86400 THEN (s // 86400) || 'd' WHEN s >= 3600 THEN (s // 3600) || 'h' WHEN s >= 60 THEN (s // 60) || 'm' ELSE 'now' END AS ago
FROM (SELECT id, (epoch_us(TIMESTAMPTZ '{_NOW}+00') - epoch_us(last_commit_at)) // 1000000 AS s FROM cat)""",
)
on_view("absolute_date", lambda v: v.select("id", display.absolute_date(F.col("starred_at")).alias("day")), "SELECT id, coalesce(strftime(starred_at AT TIME ZONE 'UTC', '%-d %b %Y'), '—') AS day FROM cat")
on_view(
    "language_shares", lambda v: v.select("id", F.array_join(F.transform(display.language_shares(F.col("languages")), lambda s: F.concat(s["name"], F.lit("="), F.round(s["share"] * 1000).cast("bigint").cast("string"))), ", ").alias("shares")),
    """SELECT c.id, coalesce(s, '') AS shares FROM cat c LEFT JOIN (
  SELECT id, string_agg(k || '=' || round(v::DOUBLE / t * 1000)::BIGINT, ', ' ORDER BY v DESC, k) AS s
  FROM (SELECT id, unnest(map_keys(languages)) AS k, unnest(map_values(languages)) AS v, list_sum(map_values(languages)) AS t FROM cat) WHERE t > 0 AND v::DOUBLE / t >= 0.005 GROUP BY id) x ON x.id = c.id""",
)
on_view("stable_hue", lambda v: v.where(F.col("primary_language").isNotNull()).select("id", display.stable_hue(F.col("primary_language")).alias("hue")), """SELECT id, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substring(h, (2 * i + 1)::INTEGER, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 360)::INTEGER AS hue FROM (SELECT id, hex(encode(primary_language)) AS h FROM cat WHERE primary_language IS NOT NULL)""")
on_view("owner_and_name", lambda v: v.select("id", display.owner_part(F.col("full_name")).alias("owner_part"), display.name_part(F.col("full_name")).alias("name_part")), "SELECT id, split_part(full_name, '/', 1) AS owner_part, substring(full_name, instr(full_name, '/') + 1) AS name_part FROM cat WHERE instr(full_name, '/') > 0")
on_view("format_time", lambda v: v.select("id", display.format_time(F.col("synced_at")).alias("at")), "SELECT id, strftime(synced_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM cat")
on_view("normalise_tag", lambda v: model.tag_links(v).select(enrich.normalise_tag(F.col("name")).alias("tag")).distinct(), f"SELECT DISTINCT regexp_replace(lower({trimmed_sql('name')}), '{SQL_SPACE}+', '-', 'g') AS tag FROM links")


@query("SELECT snapshot_no, slice_no, page, pos, epoch_us(CASE WHEN regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?([Zz]|[+-]\\d{2}:\\d{2})$') THEN TRY_CAST(s AS TIMESTAMPTZ) END) AS at FROM (SELECT snapshot_no, slice_no, page, pos, json_extract_string(payload, '$.starred_at') AS s FROM star_items WHERE json_valid(payload))")
def parse_time(spark, sf_dir):
    items = read_table(spark, sf_dir, "star_items").select("snapshot_no", "slice_no", "page", "pos", wire.parse_items(F.col("payload")).alias("i")).where(F.col("i.repo").isNotNull())
    return items.select("snapshot_no", "slice_no", "page", "pos", F.unix_micros(display.parse_time(F.col("i.starred_at"))).alias("at"))


@query("SELECT doc_id, rtrim(array_to_string(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\\r?\\n$', ''), '\\r?\\n'), lambda x: NOT starts_with(ltrim(x), '<!--'))[1:40], chr(10)), ' ') AS shown FROM documents")
def preview_lines(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", display.preview(F.coalesce("text", F.lit(""))).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(t) > 200 THEN substring(t, 1, 200) || '…' ELSE t END AS shown FROM (SELECT doc_id, replace(coalesce(text, ''), 'the', '[redacted]') AS t FROM documents)")
def redacted_text(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", display.redact(F.coalesce("text", F.lit("")), "the").alias("shown"))


on_view(
    "languages_by_size", lambda v: v.select("id", F.array_join(F.transform(display.languages_by_size(F.col("languages")), lambda e: e["key"]), "|").alias("languages")),
    """SELECT c.id, coalesce(s, '') AS languages FROM cat c LEFT JOIN (SELECT id, string_agg(k, '|' ORDER BY v DESC, k) AS s FROM (SELECT id, unnest(map_keys(languages)) AS k, unnest(map_values(languages)) AS v FROM cat) GROUP BY id) x ON x.id = c.id""",
)
on_view("tags_text", lambda v: model.tag_links(v).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("text")), "SELECT repo_id, string_agg(name, ' ' ORDER BY name) AS text FROM links GROUP BY ALL")


@query("SELECT snapshot_no, slice_no, page, pos, json_extract_string(payload, '$.repo.owner.login') AS login, json_extract_string(payload, '$.repo.topics[0]') AS topic FROM star_items WHERE json_valid(payload)")
def json_pointer(spark, sf_dir):
    items = read_table(spark, sf_dir, "star_items").where(wire.parse_items(F.col("payload"))["repo"].isNotNull())
    return items.select("snapshot_no", "slice_no", "page", "pos", enrich.pointer(F.col("payload"), "/repo/owner/login").alias("login"), enrich.pointer(F.col("payload"), "/repo/topics/0").alias("topic"))


@query("SELECT id, to_json(groups)::VARCHAR AS groups, len(topics)::INTEGER AS topics FROM cat")
def list_columns(spark, sf_dir):
    return view(spark, sf_dir).select("id", F.to_json("groups").alias("groups"), F.size("topics").alias("topics"))


# Wire formats.

_WIRE = """, wire AS (SELECT snapshot_no, slice_no, page, pos, payload::JSON AS p, TRY_CAST(json_extract_string(payload, '$.repo.id') AS BIGINT) AS id FROM star_items WHERE json_valid(payload)),
seen AS (SELECT id, p->>'$.repo.full_name' AS full_name, p->>'$.repo.description' AS description, coalesce(TRY_CAST(p->>'$.repo.stargazers_count' AS BIGINT), 0) AS stargazers, p->>'$.repo.language' AS primary_language,
  coalesce(TRY_CAST(p->>'$.repo.archived' AS BOOLEAN), false) AS archived, coalesce(TRY_CAST(p->'$.repo.topics' AS VARCHAR[]), []) AS topics, CASE WHEN regexp_matches(p->>'$.starred_at', '^\\d{4}-') THEN TRY_CAST(p->>'$.starred_at' AS TIMESTAMPTZ) END AS starred_at, snapshot_no, slice_no, page, pos FROM wire WHERE id IS NOT NULL),
latest AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_no DESC, page DESC, pos DESC, full_name DESC) = 1)"""


def wire_rows(spark, sf_dir):
    items = read_table(spark, sf_dir, "star_items").select("snapshot_no", "slice_no", "page", "pos", wire.parse_items(F.col("payload")).alias("i")).where(F.col("i.repo").isNotNull())
    rows = wire.to_repos(items.select("snapshot_no", "slice_no", "page", "pos", "i.*"))
    return rows.withColumn("ordinal", F.struct("snapshot_no", "page", "pos", "full_name"))


@query(_WIRE + " SELECT id, full_name, description, stargazers, primary_language, archived, array_to_string(topics, '|') AS topics, epoch_us(starred_at) AS starred, snapshot_no, slice_no, page, pos FROM seen")
def wire_mapping(spark, sf_dir):
    return wire_rows(spark, sf_dir).select("id", "full_name", "description", "stargazers", "primary_language", "archived", F.array_join("topics", "|").alias("topics"), F.unix_micros("starred_at").alias("starred"), "snapshot_no", "slice_no", "page", "pos")


@query(""", nodes AS (SELECT unnest(json_extract(languages_json, '$.data.*')) AS n FROM repos WHERE json_valid(languages_json) AND json_type(languages_json) = 'OBJECT' AND json_type(languages_json, '$.data') = 'OBJECT'),
edges AS (SELECT row_number() OVER () AS k, (n->>'$.databaseId')::BIGINT AS id, n FROM nodes WHERE (n->>'$.databaseId') IS NOT NULL),
each AS (SELECT k, id, unnest(json_extract(n, '$.languages.edges[*]')) AS e, unnest(range(len(json_extract(n, '$.languages.edges[*]')))) AS i FROM edges),
named AS (SELECT k, e->>'$.node.name' AS name, coalesce((e->>'$.size')::BIGINT, 0) AS size, i FROM each WHERE (e->>'$.node.name') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, e->>'$.node.name' ORDER BY i DESC) = 1)
SELECT id, coalesce(s, '') AS languages FROM edges LEFT JOIN (SELECT k, string_agg(name || '=' || size, '|' ORDER BY name) AS s FROM named GROUP BY k) x ON x.k = edges.k""")
def language_batches(spark, sf_dir):
    told = wire.language_batches(read_table(spark, sf_dir, "repos"), "languages_json")
    shown = F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return told.select("id", F.array_join(shown, "|").alias("languages"))


@query("SELECT status, count(*) AS rows FROM (SELECT CASE WHEN r.id IS NULL THEN 404 WHEN c.etag = r.etag THEN 304 ELSE 200 END AS status FROM cat c LEFT JOIN (SELECT id, etag FROM repos WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) r ON r.id = c.id) GROUP BY ALL")
def conditional_fetch(spark, sf_dir):
    remote = current_rows(read_table(spark, sf_dir, "repos"), "id", ["seq"], ["etag"])
    return wire.conditional(view(spark, sf_dir), remote).groupBy("status").agg(F.count("*").alias("rows"))


# Maintenance.

# Row by row a known starring time, languages or contributors stay until a row brings others:
# so the last row that brings them counts, and the last row for everything else.
@query(_WIRE + """, timed AS (SELECT id, starred_at FROM seen WHERE starred_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_no DESC, page DESC, pos DESC, full_name DESC) = 1)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.full_name ELSE n.full_name END AS full_name, CASE WHEN n.id IS NULL THEN o.description ELSE n.description END AS description, CASE WHEN n.id IS NULL THEN o.stargazers ELSE n.stargazers END AS stargazers,
  epoch_us(coalesce(t.starred_at, o.starred_at)) AS starred, coalesce(cardinality(o.languages), 0)::BIGINT AS n_languages, o.etag FROM cat o FULL JOIN latest n ON n.id = o.id LEFT JOIN timed t ON t.id = n.id""")
def upsert_preserving(spark, sf_dir):
    out = store.upsert(view(spark, sf_dir).drop("tags", "groups"), wire_rows(spark, sf_dir).drop("slice_no", "snapshot_no", "page", "pos"), "ordinal", F.lit(_NOW).cast("timestamp"))
    return out.select("id", "full_name", "description", "stargazers", F.unix_micros("starred_at").alias("starred"), F.coalesce(F.size("languages"), F.lit(0)).cast("bigint").alias("n_languages"), "etag")


_STORED = """, stored AS (SELECT seq, id, full_name, description, stargazers, starred_at, etag, topics,
  CASE WHEN json_valid(languages_json) AND json_type(languages_json) = 'OBJECT' THEN TRY_CAST(languages_json::JSON AS MAP(VARCHAR, BIGINT)) END AS m,
  CASE WHEN json_valid(contributors_json) AND json_type(contributors_json) = 'ARRAY' THEN json_array_length(contributors_json) END AS people FROM repos WHERE id IS NOT NULL),
languaged AS (SELECT id, cardinality(m) AS n FROM stored WHERE cardinality(m) > 0 AND len(list_filter(map_values(m), lambda v: v IS NULL)) = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
peopled AS (SELECT id, people FROM stored WHERE people > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
starred AS (SELECT id, starred_at FROM stored WHERE starred_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
final AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""


def stored_rows(spark, sf_dir):
    """The rows of the store in the order of their delivery, ids repeated."""
    return read_table(spark, sf_dir, "repos").where(F.col("id").isNotNull()).select(
        F.col("seq").alias("ordinal"), "id", "full_name", "description", F.coalesce("stargazers", F.lit(0)).alias("stargazers"), "starred_at", model.texts("topics").alias("topics"), F.lit(None).cast("timestamp").alias("synced_at"),
        model.stored_languages(F.col("languages_json")).alias("languages"), model.stored_contributors(F.col("contributors_json")).alias("contributors"),
    )


@query(_STORED + """ SELECT f.id, f.full_name, f.description, coalesce(f.stargazers, 0) AS stargazers, epoch_us(s.starred_at) AS starred, coalesce(l.n, 0)::INTEGER AS n_languages, p.people::INTEGER AS n_contributors, true AS stamped
FROM final f LEFT JOIN languaged l ON l.id = f.id LEFT JOIN peopled p ON p.id = f.id LEFT JOIN starred s ON s.id = f.id""")
def upsert_row_by_row(spark, sf_dir):
    """All rows of the store put into an empty table, in the order in which they came."""
    rows = stored_rows(spark, sf_dir)
    out = store.upsert(rows.drop("ordinal").limit(0), rows, "ordinal", F.lit(_NOW).cast("timestamp"))
    people = F.size("contributors")
    return out.select("id", "full_name", "description", "stargazers", F.unix_micros("starred_at").alias("starred"), F.size("languages").alias("n_languages"), F.when(people > 0, people).alias("n_contributors"), (F.col("synced_at") == F.lit(_NOW).cast("timestamp")).alias("stamped"))


@query(_STORED + """ SELECT repo_id, name, source FROM links WHERE source <> 'github' OR repo_id NOT IN (SELECT id FROM final)
UNION ALL SELECT DISTINCT id, t, 'github' FROM (SELECT id, unnest(topics) AS t FROM final) WHERE t IS NOT NULL""")
def mirror_topics_row_by_row(spark, sf_dir):
    """Topics of repeated ids: those of the last row become tags, those of rows before don't."""
    return store.mirror_topics(_links(spark, sf_dir), stored_rows(spark, sf_dir), "ordinal").select("repo_id", "name", "source")


@query(_WIRE + """ SELECT repo_id, name, source, round(confidence, 6) AS confidence FROM links WHERE source <> 'github' OR repo_id NOT IN (SELECT id FROM latest)
UNION ALL SELECT DISTINCT id, t, 'github', 1.0 FROM (SELECT id, unnest(topics) AS t FROM latest) WHERE t IS NOT NULL""")
def mirror_topics(spark, sf_dir):
    return store.mirror_topics(_links(spark, sf_dir), wire_rows(spark, sf_dir), "ordinal").withColumn("confidence", F.round("confidence", 6))


_INCOMING = """, incoming AS (SELECT id AS repo_id, t.topic AS name, max(t.place) AS place FROM (SELECT id, unnest(list_transform(topics, lambda x, i: struct_pack(topic := x, place := i))) AS t FROM cat) GROUP BY ALL)"""


def _incoming_tags(v: DataFrame) -> DataFrame:
    return v.select(F.col("id").alias("repo_id"), F.posexplode("topics").alias("ordinal", "name")).withColumn("confidence", (F.col("ordinal") + 1) / F.lit(100.0))


@query(_INCOMING + """ SELECT repo_id, name, source, round(confidence, 6) AS confidence FROM links WHERE source <> 'ai' OR repo_id NOT IN (SELECT repo_id FROM incoming)
UNION ALL SELECT repo_id, name, 'ai', round(place / 100.0, 6)::DOUBLE FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.repo_id = i.repo_id AND l.source = 'user' AND lower(l.name) = lower(i.name))""")
def ai_tags_user_wins(spark, sf_dir):
    v = view(spark, sf_dir)
    return store.replace_ai_tags(model.tag_links(v), _incoming_tags(v)).withColumn("confidence", F.round("confidence", 6))


@query(""" SELECT repo_id, name, source FROM links WHERE NOT (source = 'ai' AND confidence >= 0.9)
UNION SELECT repo_id, """ + f"{trimmed_sql('name')}, 'user' FROM links WHERE source = 'ai' AND confidence >= 0.9 AND {trimmed_sql('name')} <> ''")
def promote_tags(spark, sf_dir):
    links = _links(spark, sf_dir)
    return store.promote_tags(links, links.where((F.col("source") == "ai") & (F.col("confidence") >= 0.9)).select("repo_id", "name")).select("repo_id", "name", "source")


@query(f"""SELECT repo_id, name, source FROM links
UNION ALL SELECT DISTINCT id, t, 'user' FROM (SELECT id, {trimmed_sql('x')} AS t FROM (SELECT id, unnest(topics) AS x FROM cat)) n
WHERE t <> '' AND NOT EXISTS (SELECT 1 FROM links l WHERE l.repo_id = n.id AND l.name = n.t AND l.source = 'user')""")
def add_user_tags(spark, sf_dir):
    v = view(spark, sf_dir)
    added = v.select(F.col("id").alias("repo_id"), F.explode("topics").alias("name"))
    return store.add_user_tags(model.tag_links(v), added).select("repo_id", "name", "source")


@query("SELECT repo_id, name, source FROM links WHERE NOT (source = 'ai' AND confidence < 0.5)")
def remove_tags(spark, sf_dir):
    links = _links(spark, sf_dir)
    return store.remove_tags(links, links.where((F.col("source") == "ai") & (F.col("confidence") < 0.5))).select("repo_id", "name", "source")


@query("SELECT DISTINCT t.name AS name, t.source AS source FROM (SELECT unnest(tags) AS t FROM repos) WHERE t.name IS NOT NULL AND EXISTS (SELECT 1 FROM links l WHERE l.name = t.name AND l.source = t.source)")
def prune_orphan_tags(spark, sf_dir):
    tags = read_table(spark, sf_dir, "repos").select(F.explode("tags").alias("t")).select("t.name", "t.source").where(F.col("name").isNotNull()).distinct()
    return store.prune_tags(tags, _links(spark, sf_dir))


_LISTED = "incoming AS (SELECT DISTINCT primary_language AS name FROM cat WHERE primary_language IS NOT NULL)"


@query(f""", {_LISTED}, kept AS (SELECT * FROM group_list WHERE source <> 'ai')
SELECT repo_id, group_name FROM members WHERE group_name NOT IN (SELECT name FROM group_list WHERE source = 'ai')
UNION SELECT b.id, a.primary_language FROM cat a JOIN cat b ON a.full_name = b.full_name WHERE a.primary_language IS NOT NULL""")
def replace_ai_group_members(spark, sf_dir):
    v = view(spark, sf_dir)
    members = v.where(F.col("primary_language").isNotNull()).select(F.col("primary_language").alias("name"), "full_name")
    incoming = members.select("name").distinct().withColumns({"summary": F.lit("by language"), "ordinal": F.lit(0)})
    return store.replace_ai_groups(read_table(spark, sf_dir, "group_list"), model.group_links(v), incoming, members, v)[1]


@query(f""", {_LISTED} SELECT coalesce(k.name, i.name) AS name, CASE WHEN i.name IS NULL THEN k.summary ELSE 'by language' END AS summary, coalesce(k.source, 'ai') AS source
FROM (SELECT * FROM group_list WHERE source <> 'ai') k FULL JOIN incoming i ON i.name = k.name""")
def replace_ai_groups(spark, sf_dir):
    v = view(spark, sf_dir)
    members = v.where(F.col("primary_language").isNotNull()).select(F.col("primary_language").alias("name"), "full_name")
    incoming = members.select("name").distinct().withColumns({"summary": F.lit("by language"), "ordinal": F.lit(0)})
    return store.replace_ai_groups(read_table(spark, sf_dir, "group_list"), model.group_links(v), incoming, members, v)[0]


_UNSEEN = _WIRE + ", gone AS (SELECT id FROM cat WHERE id NOT IN (SELECT id FROM seen WHERE snapshot_no = (SELECT max(snapshot_no) FROM star_items)))"


def _unseen(spark, sf_dir, v):
    rows = wire_rows(spark, sf_dir)
    return store.unseen(v, rows.join(read_table(spark, sf_dir, "star_items").agg(F.max("snapshot_no").alias("snapshot_no")), "snapshot_no", "left_semi"))


@query(_UNSEEN + " SELECT id FROM gone")
def sync_unstarred(spark, sf_dir):
    return _unseen(spark, sf_dir, view(spark, sf_dir))


@query(_UNSEEN + """ SELECT 'repos' AS kept, id, full_name AS what FROM cat WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'tag_links', repo_id, source || '/' || name FROM links WHERE repo_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'group_members', repo_id, group_name FROM members WHERE repo_id NOT IN (SELECT id FROM gone)""")
def delete_cascade(spark, sf_dir):
    """What stays of the three tables when the repositories no longer listed are deleted."""
    v = cut_lineage(view(spark, sf_dir).select("id", "full_name", "tags", "groups"))
    gone = cut_lineage(_unseen(spark, sf_dir, v))
    repos, links, members = store.delete_repos(gone, v, model.tag_links(v), model.group_links(v))
    what = {"repos": (repos, "id", F.col("full_name")), "tag_links": (links, "repo_id", F.concat_ws("/", "source", "name")), "group_members": (members, "repo_id", F.col("group_name"))}
    parts = [df.select(F.lit(n).alias("kept"), F.col(key).alias("id"), told.alias("what")) for n, (df, key, told) in what.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_UNSEEN + """ SELECT c.id, coalesce(n.full_name, c.full_name) AS full_name FROM cat c LEFT JOIN latest n ON n.id = c.id WHERE c.id NOT IN (SELECT id FROM gone)
UNION ALL SELECT id, full_name FROM latest WHERE id NOT IN (SELECT id FROM cat) AND id NOT IN (SELECT id FROM gone)""")
def merge_delta(spark, sf_dir):
    v = cut_lineage(view(spark, sf_dir).select("id", "full_name"))
    latest = store.last_of(wire_rows(spark, sf_dir).select("id", "full_name", "ordinal"), ["id"], "ordinal").select("id", "full_name")
    return store.merge_delta(v, latest, _unseen(spark, sf_dir, v))


@query("SELECT c.id, coalesce(d.n, -1)::BIGINT AS documents FROM cat c LEFT JOIN (SELECT repo_id, count(*) AS n FROM documents GROUP BY ALL) d ON d.repo_id = c.id")
def point_updates(spark, sf_dir):
    delta = read_table(spark, sf_dir, "documents").groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("value"))
    rows = view(spark, sf_dir).select("id", F.lit(-1).cast("bigint").alias("documents"))
    return store.set_column(rows, delta, "documents")


# Synchronisation.

_MARK = "2026-01-15 00:00:00"


@query(_WIRE + f""", stale AS (SELECT snapshot_no, slice_no, min((page, pos)) AS stop FROM seen WHERE starred_at <= TIMESTAMPTZ '{_MARK}+00' GROUP BY ALL)
SELECT s.id, s.snapshot_no, s.slice_no, s.page, s.pos FROM seen s LEFT JOIN stale t ON t.snapshot_no = s.snapshot_no AND t.slice_no = s.slice_no WHERE t.stop IS NULL OR (s.page, s.pos) < t.stop""")
def newer_than_watermark(spark, sf_dir):
    fresh = store.newer_than(wire_rows(spark, sf_dir), F.lit(_MARK).cast("timestamp"), ["page", "pos"], ["snapshot_no", "slice_no"])
    return fresh.select("id", "snapshot_no", "slice_no", "page", "pos")


@query(_WIRE + " SELECT snapshot_no, count(DISTINCT id) AS remote, (SELECT count(*) FROM cat) AS local, count(DISTINCT id) <> (SELECT count(*) FROM cat) AS drift FROM seen GROUP BY ALL")
def count_drift(spark, sf_dir):
    local = view(spark, sf_dir).count()
    remote = wire_rows(spark, sf_dir).groupBy("snapshot_no").agg(F.count_distinct("id").alias("remote"))
    return remote.select("snapshot_no", "remote", F.lit(local).cast("bigint").alias("local"), (F.col("remote") != local).alias("drift"))


@query(f""", fetched AS (SELECT c.id, r.stargazers, CASE WHEN r.id IS NULL THEN 404 WHEN c.etag = r.etag THEN 304 ELSE 200 END AS status FROM cat c LEFT JOIN (SELECT id, etag, stargazers FROM repos WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) r ON r.id = c.id)
SELECT c.id, CASE WHEN f.status = 200 THEN f.stargazers ELSE c.stargazers END AS stargazers, epoch_us(c.starred_at) AS starred, epoch_us(TIMESTAMPTZ '{_NOW}+00') AS synced FROM cat c JOIN fetched f ON f.id = c.id""")
def refresh_by_status(spark, sf_dir):
    v = view(spark, sf_dir)
    remote = current_rows(read_table(spark, sf_dir, "repos"), "id", ["seq"], ["etag", "stargazers", "starred_at"])
    out = store.apply_refresh(v.select("id", "stargazers", "starred_at", "synced_at"), wire.conditional(v, remote), F.lit(_NOW).cast("timestamp"))
    return out.select("id", "stargazers", F.unix_micros("starred_at").alias("starred"), F.unix_micros("synced_at").alias("synced"))


# Enrichment.

on_view(
    "enrich_union_tags",
    lambda v: enrich.union_tags(v.select("full_name", F.col("tags.name").alias("tags")), v.select("full_name", F.col("topics").alias("tags"))).select("full_name", F.array_join("tags", "|").alias("tags")),
    f", each AS (SELECT full_name, unnest(list_transform(list_concat(string_split(coalesce(t, ''), chr(1)), topics), lambda x: {trimmed_sql('x')})) AS x," + """ unnest(range(len(string_split(coalesce(t, ''), chr(1))) + len(topics))) AS i
  FROM cat LEFT JOIN (SELECT id AS k, string_agg(y.name, chr(1) ORDER BY y.source DESC, y.confidence DESC, y.name) AS t FROM (SELECT id, unnest(tags) AS y FROM cat) GROUP BY id) ON k = id)
SELECT c.full_name, coalesce(s, '') AS tags FROM cat c LEFT JOIN (SELECT full_name, string_agg(x, '|' ORDER BY i) AS s FROM (SELECT full_name, x, min(i) AS i FROM each WHERE x <> '' GROUP BY ALL) GROUP BY ALL) e ON e.full_name = c.full_name""",
)
_OBJECT = """'{"full_name":' || to_json(full_name) || coalesce(',"description":' || to_json(description), '') || CASE WHEN len(topics) > 0 THEN ',"topics":' || to_json(topics) ELSE '' END || coalesce(',"language":' || to_json(primary_language), '') || '}'"""
SQL_BATCHES = f"""batched AS (SELECT id, full_name, primary_language, {_OBJECT} AS o, (row_number() OVER (ORDER BY {_TIES}) - 1) // 25 AS batch FROM cat)"""
on_view("enrich_batches", lambda v: enrich.batches(v, ordering.tie_break()).select("batch", "repos", "prompt"), f", {SQL_BATCHES} SELECT batch, count(*)::INTEGER AS repos, '[' || string_agg(o, ',' ORDER BY full_name) || ']' AS prompt FROM batched GROUP BY ALL")


@query(f""", told AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '\\{{.*\\}}', 0, 's') AS j FROM documents WHERE lower({trimmed_sql('source')}) = 'tag_reply'),
fine AS (SELECT doc_id, j::JSON AS j FROM told WHERE j <> '' AND json_valid(j)),
listed AS (SELECT doc_id, r->>'$.full_name' AS full_name, t, i FROM (SELECT doc_id, r, unnest(json_extract(r, '$.tags[*]')) AS t, unnest(range(len(json_extract(r, '$.tags[*]')))) AS i FROM (SELECT doc_id, unnest(json_extract(j, '$.repos[*]')) AS r FROM fine))),
named AS (SELECT doc_id, trim(full_name) AS full_name, regexp_replace(lower({trimmed_sql("t->>'$.name'")}), '{SQL_SPACE}+', '-', 'g') AS name, coalesce(least(greatest((t->>'$.confidence')::DOUBLE, 0), 1), 0.5) AS confidence, i FROM listed),
firsts AS (SELECT * FROM named WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, full_name, name ORDER BY i) = 1),
six AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY doc_id, full_name ORDER BY i) <= 6)
SELECT doc_id AS batch, true AS ok, full_name, name, confidence FROM six UNION ALL SELECT doc_id, true, NULL, NULL, NULL FROM fine WHERE doc_id NOT IN (SELECT doc_id FROM six) UNION ALL SELECT doc_id, false, NULL, NULL, NULL FROM told WHERE doc_id NOT IN (SELECT doc_id FROM fine)""")
def enrich_replies(spark, sf_dir):
    """Tags in the model replies among the documents; a reply that can't be used is one row that isn't ok."""
    replies = read_table(spark, sf_dir, "documents").where(F.lower(trimmed(F.col("source"))) == "tag_reply").select(F.col("doc_id").alias("batch"), F.coalesce("text", F.lit("")).alias("prompt"))
    return enrich.tag_batches(replies, lambda reply: reply, again="").drop("error", "entry", "place")
