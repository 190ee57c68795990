"""Changes between consecutive star listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.snapshot_diff import diff_snapshots
from quern.session import read_table

# Leaves are read as text: any JSON value is then accepted where a string is wanted,
# and the corrupt column is set exactly when the JSON is broken.
_FIELDS = ("id", "full_name", "description", "language", "archived", "fork", "topics")
_WIRE = "array<struct<r: struct<starred_at: string, repo: struct<" + ", ".join(f"{f}: string" for f in _FIELDS) + ">>>>"
# Spark's reader takes more than JSON unless told otherwise.
_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_RFC3339 = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def rfc3339_second(text: Column) -> Column:
    """The instant of an RFC 3339 time, cut to the second, as epoch seconds; else null."""
    cut = F.regexp_replace(F.upper(text), "\\.[0-9]+", "")
    return F.when(text.rlike(_RFC3339), F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(cut, " ", "T"))))


def listed_rows(items: DataFrame) -> DataFrame:
    """The counting row of each (snapshot, repository): the greatest (page, pos), then the last received.

    snapshot_no, slice_no, repo_id and content, the canonical text of what may change.
    A payload that is not valid JSON, or that has no integer id, is no row. The text is
    parsed inside a list of one object, so that anything after its end shows as broken.
    """
    wrapped = F.concat(F.lit('[{"r":'), F.col("payload"), F.lit("}]"))
    parsed = items.select("snapshot_no", "slice_no", "page", "pos", "received_at", F.from_json(wrapped, _WIRE, _STRICT).alias("_p"))
    one = parsed.where(F.size("_p") == 1).select("snapshot_no", "slice_no", "page", "pos", "received_at", F.col("_p")[0]["r"].alias("_r"))
    repo = F.col("_r.repo")
    topics = F.array_sort(F.array_distinct(F.filter(F.from_json(repo["topics"], "array<string>"), lambda t: t.isNotNull())))
    content = F.to_json(
        F.struct(
            repo["full_name"].alias("full_name"), repo["description"].alias("description"), repo["language"].alias("language"),
            F.coalesce(repo["archived"], F.lit("false")).alias("archived"), F.coalesce(repo["fork"], F.lit("false")).alias("fork"),
            F.coalesce(topics, F.array().cast("array<string>")).alias("topics"), rfc3339_second(F.col("_r.starred_at")).alias("starred_at"),
        ),
        {"ignoreNullFields": "false"},
    )
    rows = one.select("snapshot_no", "slice_no", "page", "pos", "received_at", repo["id"].try_cast("bigint").alias("repo_id"), F.md5(content).alias("content"))
    best = F.max(F.struct("page", "pos", "received_at", "content", "slice_no"))
    return (
        rows.where(F.col("repo_id").isNotNull() & F.col("snapshot_no").isNotNull())
        .groupBy("snapshot_no", "repo_id").agg(best.alias("_b"))
        .select("snapshot_no", "repo_id", F.col("_b.content").alias("content"), F.col("_b.slice_no").alias("slice_no"))
    )


def snapshot_numbers(items: DataFrame) -> list[int]:
    """The snapshots delivered, in order: one number each, a short list."""
    return [r[0] for r in items.where(F.col("snapshot_no").isNotNull()).select("snapshot_no").distinct().orderBy("snapshot_no").collect()]


def changes(items: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """snapshot_no, repo_id, change, slice_no; see diff_snapshots. numbers: the snapshots
    delivered, looked for if not given."""
    numbers = snapshot_numbers(items) if numbers is None else numbers
    out = diff_snapshots(listed_rows(items), "snapshot_no", "repo_id", F.col("content"), "slice_no", numbers)
    return out.select(F.col("version").cast("int").alias("snapshot_no"), F.col("key").alias("repo_id"), "change", F.col("carried").cast("int").alias("slice_no"))


def removed_counts(items: DataFrame, runs: DataFrame) -> DataFrame:
    """For each run from the second snapshot on: what was removed, and what the log says.

    snapshot_no, slice_no, removed (derived, 0 if nothing), logged (may be null), agrees.
    """
    numbers = snapshot_numbers(items)
    gone = changes(items, numbers).where(F.col("change") == "removed").groupBy("snapshot_no", "slice_no").agg(F.count("*").alias("n"))
    later = runs.where(F.col("snapshot_no") > F.lit(min(numbers, default=0))).select("snapshot_no", "slice_no", F.col("removed").alias("logged"))
    joined = later.join(gone, ["snapshot_no", "slice_no"], "left")
    removed = F.coalesce("n", F.lit(0))
    return joined.select("snapshot_no", "slice_no", removed.alias("removed"), "logged", removed.eqNullSafe(F.col("logged")).alias("agrees"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(read_table(spark, sf_dir, "star_items")).select("snapshot_no", "repo_id", "change")


def p4_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_counts(read_table(spark, sf_dir, "star_items"), read_table(spark, sf_dir, "sync_runs"))


_SQL_ROWS = """
WITH listed AS (
  SELECT snapshot_no, slice_no, page, pos, received_at, payload::JSON AS p
  FROM star_items WHERE json_valid(payload)
), told AS (
  SELECT snapshot_no, slice_no, page, pos, received_at,
    TRY_CAST(p->>'$.repo.id' AS BIGINT) AS repo_id,
    p->>'$.repo.full_name' AS full_name, p->>'$.repo.description' AS description, p->>'$.repo.language' AS language,
    coalesce(p->>'$.repo.archived', 'false') AS archived, coalesce(p->>'$.repo.fork', 'false') AS fork,
    coalesce(list_sort(list_distinct(TRY_CAST(p->'$.repo.topics' AS VARCHAR[]))), []::VARCHAR[]) AS topics,
    CASE WHEN regexp_matches(p->>'$.starred_at', '^\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?([Zz]|[+-]\\d{2}:\\d{2})$')
      THEN floor(epoch(TRY_CAST(p->>'$.starred_at' AS TIMESTAMPTZ)))::BIGINT END AS starred
  FROM listed
), best AS (
  SELECT * FROM told WHERE repo_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, repo_id ORDER BY page DESC, pos DESC, received_at DESC) = 1
), diff AS (
  SELECT coalesce(n.snapshot_no, o.snapshot_no + 1) AS snapshot_no, coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.slice_no, o.slice_no) AS slice_no,
    CASE WHEN o.repo_id IS NULL THEN 'added' WHEN n.repo_id IS NULL THEN 'removed'
      WHEN (n.full_name, n.description, n.language, n.archived, n.fork, n.topics, n.starred)
        IS DISTINCT FROM (o.full_name, o.description, o.language, o.archived, o.fork, o.topics, o.starred) THEN 'changed' END AS change
  FROM best n FULL JOIN best o ON n.repo_id = o.repo_id AND n.snapshot_no = o.snapshot_no + 1
), change AS (
  SELECT * FROM diff WHERE change IS NOT NULL
    AND snapshot_no > (SELECT min(snapshot_no) FROM star_items) AND snapshot_no <= (SELECT max(snapshot_no) FROM star_items)
)
"""

QUERIES = {"p4_found": p4_found, "p4_removed": p4_removed}
SQL = {
    "p4_found": _SQL_ROWS + "SELECT snapshot_no::INTEGER AS snapshot_no, repo_id, change FROM change",
    "p4_removed": _SQL_ROWS + """
SELECT r.snapshot_no, r.slice_no, coalesce(g.n, 0) AS removed, r.removed AS logged, coalesce(g.n, 0) IS NOT DISTINCT FROM r.removed AS agrees
FROM sync_runs r LEFT JOIN (SELECT snapshot_no, slice_no, count(*) AS n FROM change WHERE change = 'removed' GROUP BY ALL) g
  ON g.snapshot_no = r.snapshot_no AND g.slice_no = r.slice_no
WHERE r.snapshot_no > (SELECT min(snapshot_no) FROM star_items)""",
}
