"""The JSON columns of the catalog as flat tables (contributors, weeks, languages, owners)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import WHITE_SPACE, trimmed_sql
from quern.operators import json_index as J
from quern.operators.nested import Rule, flatten_json
from quern.session import read_table
from quern.sources.wire import first_contributors

_PERSON = {"login": ("login",), "avatar_url": ("avatar_url",), "contributions": ("contributions",)}
_OBJECT = frozenset({J.OBJ})


def _people(*path: str, **more: tuple[str, ...]) -> list[Rule]:
    return [
        Rule("contributor", path, {**_PERSON, **more}, _OBJECT, needs=("login",)),
        Rule("week", (*path, "weeks", "[*]"), {"login": ("^", "^", "login"), "w": ("w",), "c": ("c",)}, _OBJECT),
    ]


#: Every shape in which contributors come: a list, one alone, pages of items or nodes, edges.
CONTRIBUTORS = [
    *_people("[*]"),
    *_people(),
    *_people("items", "[*]"),
    *_people("nodes", "[*]"),
    *_people("edges", "[*]", "node", contributions=("^", "contributions")),
]

_NAMED = {"language": ("name",), "size": ("size",)}
_EDGE = {"language": ("name",), "size": ("^", "size"), "color": ("color",)}
_EDGES = ("edges", "[*]", "node")
#: Every shape in which languages come: sizes by name, a list, edges bare or in an envelope.
LANGUAGES = [
    Rule("language", ("*",), {"language": ("@key",), "size": ("@value",)}, frozenset({J.NUM, J.NULL}), unless=(("name", J.STR),), without=frozenset({"edges", "data", "languages"})),
    Rule("language", ("[*]",), {"language": ("name",), "size": ("bytes",), "color": ("color",)}, _OBJECT),
    Rule("language", (), {"language": ("name",), "size": ("bytes",), "color": ("color",)}, _OBJECT, needs=("name",)),
    Rule("language", _EDGES, _EDGE, _OBJECT),
    Rule("language", ("languages", *_EDGES), _EDGE, _OBJECT),
    Rule("language", ("data", "*", "languages", *_EDGES), _EDGE, _OBJECT),
]

OWNERS = [Rule("owner", ("repo",), {"repo_id": ("id",), "login": ("owner", "login"), "owner_id": ("owner", "id"), "type": ("owner", "type")}, _OBJECT)]


def _named(column: str):
    """Neither null nor blank."""
    return F.regexp_replace(F.col(column), WHITE_SPACE, "") != ""


def contributor_rows(repos: DataFrame) -> DataFrame:
    """Contributors and their weeks in one pass over contributors_json; see flatten_json."""
    return flatten_json(repos, "seq", "contributors_json", CONTRIBUTORS)


def contributors(repos: DataFrame) -> DataFrame:
    """seq, node, login, avatar_url, contributions of each contributor with a name."""
    rows = contributor_rows(repos).where((F.col("child") == "contributor") & _named("login"))
    return rows.select(F.col("record_id").alias("seq"), "node", "login", "avatar_url", F.expr("try_cast(contributions AS BIGINT)").alias("contributions"))


def weeks(repos: DataFrame) -> DataFrame:
    """seq, node, parent_node, login, w, c of each week with a name, of a contributor with
    one; parent_node is the contributor's node in the same record."""
    rows = contributor_rows(repos).where((F.col("child") == "week") & _named("login") & _named("w"))
    return rows.select(F.col("record_id").alias("seq"), "node", "parent_node", "login", "w", F.expr("try_cast(c AS BIGINT)").alias("c"))


def languages(repos: DataFrame) -> DataFrame:
    """seq, node, language, size, color of each language named, whatever its size."""
    rows = flatten_json(repos, "seq", "languages_json", LANGUAGES).where(_named("language"))
    return rows.select(F.col("record_id").alias("seq"), "node", "language", F.expr("try_cast(size AS BIGINT)").alias("size"), "color")


#: What tells one payload from all others: a page may be fetched again.
PAYLOAD = ["snapshot_no", "slice_no", "page", "pos", "received_at"]


def owners(items: DataFrame) -> DataFrame:
    """The key of the payload (PAYLOAD), node, repo_id, login, owner_id, type of each
    payload's owner with a name."""
    rows = flatten_json(items, "snapshot_no", "payload", OWNERS, PAYLOAD).where(_named("login"))
    return rows.select("record.*", "node", F.expr("try_cast(repo_id AS BIGINT)").alias("repo_id"), "login", F.expr("try_cast(owner_id AS BIGINT)").alias("owner_id"), "type")


def found(repos: DataFrame, items: DataFrame) -> DataFrame:
    """child, parent_id, child_key of every named child in the three JSON columns."""
    people = contributor_rows(repos).where(_named("login"))
    people = people.where((F.col("child") == "contributor") | _named("w"))
    key = F.when(F.col("child") == "week", F.concat("login", F.lit("/"), "w")).otherwise(F.col("login"))
    parts = [
        people.select("child", F.col("record_id").alias("parent_id"), key.alias("child_key")),
        languages(repos).select(F.lit("language").alias("child"), F.col("seq").alias("parent_id"), F.col("language").alias("child_key")),
        owners(items).select(F.lit("owner").alias("child"), F.col("repo_id").alias("parent_id"), F.col("login").alias("child_key")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.where(F.col("parent_id").isNotNull()).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(read_table(spark, sf_dir, "repos"), read_table(spark, sf_dir, "star_items"))


def p3_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributors(read_table(spark, sf_dir, "repos"))


def p3_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weeks(read_table(spark, sf_dir, "repos"))


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read_table(spark, sf_dir, "repos"))


def p3_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = owners(read_table(spark, sf_dir, "star_items"))
    return rows.withColumn("received_at", F.unix_micros("received_at"))


def p3_first_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three contributors of each record, in listed order."""
    return first_contributors(contributors(read_table(spark, sf_dir, "repos")), "seq", 3)


QUERIES = {f.__name__: f for f in (p3_found, p3_contributors, p3_weeks, p3_languages, p3_owners, p3_first_contributors)}

_UNWRAP = """SELECT {key} AS k, CASE WHEN json_type(t) = 'VARCHAR' THEN TRY_CAST(t->>'$' AS JSON) ELSE t END AS j
  FROM (SELECT {key}, TRY_CAST({column} AS JSON) AS t FROM {table} WHERE json_valid({column}))"""
_EACH = "SELECT k, unnest(json_extract(j, '{}')) AS p FROM {}"
_HAS = lambda x: f"({x}) IS NOT NULL AND {trimmed_sql(x)} <> ''"

# The same nodes in SQL: the values of a text in order of position, from 0.
_TREE = """{name} AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t.id) - 1 AS node, t.id AS id, t.parent AS parent, t.key AS key, t.value AS value, t.type AS type, t.fullkey AS place, t.path AS path FROM {source} s, json_tree(s.j) t)"""
_PERSON_AT = r"^\$(\[\d+\]|\.items\[\d+\]|\.nodes\[\d+\]|\.edges\[\d+\]\.node)?$"
_PEOPLE = f"""WITH c AS ({_UNWRAP.format(key="seq", column="contributors_json", table="repos")}), {_TREE.format(name="t", source="c")},
people AS (SELECT p.k, p.node, p.id, p.value->>'$.login' AS login, p.value->>'$.avatar_url' AS avatar_url,
    TRY_CAST(coalesce(p.value->>'$.contributions', CASE WHEN p.key = 'node' THEN e.value->>'$.contributions' END) AS BIGINT) AS contributions
  FROM t p LEFT JOIN t e ON e.k = p.k AND e.id = p.parent WHERE p.type = 'OBJECT' AND regexp_matches(p.place, '{_PERSON_AT}') AND {_HAS("p.value->>'$.login'")})"""
_SIZE = "TRY_CAST(TRY_CAST({} AS DOUBLE) AS BIGINT)"

SQL = {
    "p3_found": f"""WITH c AS ({_UNWRAP.format(key="seq", column="contributors_json", table="repos")}),
l AS ({_UNWRAP.format(key="seq", column="languages_json", table="repos")}),
o AS ({_UNWRAP.format(key="snapshot_no", column="payload", table="star_items")}),
people AS (SELECT k, p, p->>'$.login' AS login FROM ({" UNION ALL ".join([_EACH.format(x, "c") for x in ("$[*]", "$.items[*]", "$.nodes[*]", "$.edges[*].node")])} UNION ALL SELECT k, j FROM c) WHERE json_type(p) = 'OBJECT' AND {_HAS("p->>'$.login'")}),
weeks AS (SELECT k, login, w->>'$.w' AS w FROM (SELECT k, login, unnest(json_extract(p, '$.weeks[*]')) AS w FROM people) WHERE json_type(w) = 'OBJECT' AND {_HAS("w->>'$.w'")}),
keys AS (SELECT k, j, unnest(json_keys(j)) AS name FROM l WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.name') IS DISTINCT FROM 'VARCHAR'),
named AS (
  SELECT k, name FROM keys WHERE name NOT IN ('edges', 'data', 'languages') AND json_type(j, '/' || replace(replace(name, '~', '~0'), '/', '~1')) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT', 'NULL')
  UNION ALL SELECT k, p->>'$.name' FROM ({" UNION ALL ".join([_EACH.format(x, "l") for x in ("$[*]", "$.edges[*].node", "$.languages.edges[*].node", "$.data.*.languages.edges[*].node")])} UNION ALL SELECT k, j FROM l) WHERE json_type(p) = 'OBJECT'
)
SELECT DISTINCT * FROM (
  SELECT 'contributor' AS child, k AS parent_id, login AS child_key FROM people
  UNION ALL SELECT 'week', k, login || '/' || w FROM weeks
  UNION ALL SELECT 'language', k, name FROM named WHERE {_HAS("name")}
  UNION ALL SELECT 'owner', TRY_CAST(j->>'$.repo.id' AS BIGINT), j->>'$.repo.owner.login' FROM o WHERE {_HAS("j->>'$.repo.owner.login'")}
) WHERE parent_id IS NOT NULL""",
    "p3_contributors": _PEOPLE + " SELECT k AS seq, node, login, avatar_url, contributions FROM people",
    "p3_weeks": _PEOPLE + f""" SELECT k AS seq, w.node, p.node AS parent_node, login, w.value->>'$.w' AS w, TRY_CAST(w.value->>'$.c' AS BIGINT) AS c
FROM people p JOIN t l USING (k) JOIN t w USING (k) WHERE l.parent = p.id AND l.key = 'weeks' AND l.type = 'ARRAY' AND w.parent = l.id AND w.type = 'OBJECT' AND {_HAS("w.value->>'$.w'")}""",
    "p3_first_contributors": _PEOPLE + " SELECT k AS seq, login, contributions FROM people QUALIFY row_number() OVER (PARTITION BY k ORDER BY node) <= 3",
    "p3_owners": f"""WITH o AS (SELECT {', '.join(PAYLOAD)}, payload::JSON AS j FROM star_items WHERE json_valid(payload))
SELECT * REPLACE (epoch_us(received_at) AS received_at) FROM (SELECT {', '.join(PAYLOAD)}, (SELECT count(*) FROM json_tree(o.j) t WHERE t.id < (SELECT r.id FROM json_tree(o.j) r WHERE r.fullkey = '$.repo')) AS node, TRY_CAST(j->>'$.repo.id' AS BIGINT) AS repo_id, j->>'$.repo.owner.login' AS login, TRY_CAST(j->>'$.repo.owner.id' AS BIGINT) AS owner_id, j->>'$.repo.owner.type' AS type
FROM o WHERE {_HAS("j->>'$.repo.owner.login'")})""",
    "p3_languages": f"""WITH l AS ({_UNWRAP.format(key="seq", column="languages_json", table="repos")}), {_TREE.format(name="t", source="l")},
flat AS (SELECT t.k, t.node, t.key AS language, t.value::VARCHAR AS size, NULL AS color FROM t JOIN l ON l.k = t.k WHERE t.path = '$' AND json_type(l.j) = 'OBJECT' AND json_type(l.j, '$.name') IS DISTINCT FROM 'VARCHAR' AND t.key NOT IN ('edges', 'data', 'languages') AND t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT', 'NULL')),
objects AS (SELECT p.k, p.node, p.value->>'$.name' AS language, CASE WHEN p.key = 'node' THEN e.value->>'$.size' ELSE p.value->>'$.bytes' END AS size, p.value->>'$.color' AS color
  FROM t p LEFT JOIN t e ON e.k = p.k AND e.id = p.parent WHERE p.type = 'OBJECT' AND regexp_matches(p.place, '^\\$(\\[\\d+\\]|(\\.languages|\\.data\\..*\\.languages)?\\.edges\\[\\d+\\]\\.node)?$'))
SELECT k AS seq, node, language, TRY_CAST(size AS BIGINT) AS size, color FROM (SELECT * FROM flat UNION ALL SELECT * FROM objects) WHERE {_HAS("language")}""",
}
