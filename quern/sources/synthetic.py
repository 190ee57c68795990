"""A synthetic catalog of any size: every value is a hash of (seed, id, field), so rows
are made in parallel and are the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYLLABLES = ("ba", "do", "ki", "lu", "me", "no", "ra", "si", "tu", "ve")


def _words(n: int, parts: int = 2) -> list[str]:
    """n words of `parts` syllables, by rule."""
    base = len(SYLLABLES)
    return ["".join(SYLLABLES[(i // base**p + p) % base] for p in range(parts)) for i in range(n)]


OWNERS, WORDS, LANGUAGES, TOPICS = _words(35), _words(40, 3), [w.capitalize() for w in _words(16)], _words(16, 3)


def _below(n: int, seed: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(n)).cast("int")


def _pick(items: list[str], seed: int, salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), _below(len(items), seed, salt) + 1)


def synthetic_catalog(spark: SparkSession, n: int, seed: int = 1, now: str = "2026-03-01 00:00:00", partitions: int | None = None) -> DataFrame:
    """n catalog rows: a twentieth archived, a twelfth forks, every seventh with one
    contributor, one to three topics, stars skewed to small numbers."""
    at = F.lit(now).cast("timestamp")
    ago = lambda hours, salt: F.timestamp_seconds(F.unix_timestamp(at) - _below(hours, seed, salt).cast("bigint") * 3600)
    owner, language = _pick(OWNERS, seed, "owner"), _pick(LANGUAGES, seed, "language")
    name = F.concat(_pick(WORDS, seed, "first"), F.lit("-"), _pick(WORDS, seed, "second"), F.lit("-"), F.col("id"))
    main = F.create_map(language, (_below(400_000, seed, "bytes") + 20_000).cast("bigint"))
    extra = F.create_map(F.lit("Shell"), (_below(4_000, seed, "shell") + 500).cast("bigint"))
    topics = F.slice(F.array(*[_pick(TOPICS, seed, f"topic{i}") for i in range(3)]), F.lit(1), _below(3, seed, "topics") + 1)
    person = F.struct(F.lit("seed-bot").alias("login"), F.lit("").alias("avatar_url"), F.lit(100).cast("bigint").alias("contributions"))
    return spark.range(1, n + 1, 1, partitions or spark.sparkContext.defaultParallelism).select(
        "id", F.concat(F.lit("R_seed"), "id").alias("node_id"), F.concat(owner, F.lit("/"), name).alias("full_name"), name.alias("name"), owner.alias("owner"), F.concat(F.lit("https://forge.example/"), owner, F.lit("/"), name).alias("html_url"),
        F.concat(F.lit("A "), _pick(WORDS, seed, "kind"), F.lit(" for "), _pick(TOPICS, seed, "use"), F.lit(" workloads")).alias("description"),
        F.floor(_below(200_000, seed, "stars") / (_below(40, seed, "scale") + 1)).cast("bigint").alias("stargazers"),
        ago(21_600, "commit").alias("last_commit_at"), ago(30_000, "starred").alias("starred_at"), ago(720, "updated").alias("updated_at"), at.alias("synced_at"), language.alias("primary_language"),
        F.when(_below(3, seed, "more") == 0, F.map_concat(main, extra)).otherwise(main).alias("languages"), F.when(F.col("id") % 7 == 0, F.array(person)).alias("contributors"),
        (_below(20, seed, "archived") == 0).alias("archived"), (_below(12, seed, "fork") == 0).alias("fork"), topics.alias("topics"),
    )
