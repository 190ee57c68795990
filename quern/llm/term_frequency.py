"""Occurrences and records of every distinct term, by heavy-light aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import name_key_sql, name_keys
from quern.llm import repo_names
from quern.session import cut_lineage

#: A term is heavy if it makes up at least one in HEAVY_SHARE of all occurrences, so at most that many are.
HEAVY_SHARE = 512
#: Counters of the summary each partition keeps while it looks for heavy terms.
SUMMARY_COUNTERS = 8 * HEAVY_SHARE
#: A longer term is counted like a light one, so the broadcast stays below HEAVY_SHARE * HEAVY_BYTES.
HEAVY_BYTES = 256


def _tagged(terms: dict[str, Column]) -> Column:
    """All terms of a record in one array, each marked with the number of its field."""

    def marked(i: int, column: Column) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{i}:"), x))

    arrays = [marked(i, column) for i, column in enumerate(terms.values())]
    return F.filter(F.concat(*arrays), lambda x: x.isNotNull())


def _summarise(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """A mergeable frequent-items summary of one partition. Counts are lower bounds,
    short by at most (occurrences / counters); the row without a term has the total."""
    kept: dict[str, int] = {}
    total = 0
    for batch in batches:
        values = batch.column(0).flatten()
        total += len(values)
        counts = pc.value_counts(values)
        for term, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
            kept[term] = kept.get(term, 0) + n
        if len(kept) > counters:
            cut = sorted(kept.values(), reverse=True)[counters]
            kept = {t: n - cut for t, n in kept.items() if n > cut}
    yield pa.RecordBatch.from_arrays([pa.array([None, *kept], pa.string()), pa.array([total, *kept.values()], pa.int64())], names=["term", "n"])


def heavy_terms(df: DataFrame, terms: dict[str, Column], share: int = HEAVY_SHARE) -> list[str]:
    """The terms that provably make up at least one in `share` of all occurrences.

    One pass over all rows; at most `share` + 1 rows reach the driver.
    """
    counters = 8 * share
    found = df.select(_tagged(terms).alias("t")).mapInArrow(lambda b: _summarise(b, counters), "term string, n bigint")
    top = found.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("term")).limit(share + 1).collect()
    total = next((r.n for r in top if r.term is None), 0)
    return [r.term for r in top if r.term is not None and r.n * share >= total and len(r.term.encode()) <= HEAVY_BYTES]


def _count(batches: Iterator[pa.RecordBatch], heavy: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of one partition: light terms batch by batch, heavy ones in arrays until the end."""
    names = ["term", "occurrences", "records"]
    known = pa.array(heavy, pa.string())
    counters = np.zeros((2, len(heavy)), np.int64)
    for batch in batches:
        lists = batch.column(0)
        encoded = lists.flatten().dictionary_encode()
        size = len(encoded.dictionary)
        if not size:
            continue
        codes = encoded.indices.to_numpy().astype(np.int64)
        rows = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        counts = np.stack([np.bincount(codes, minlength=size), np.bincount(np.unique(rows * size + codes) % size, minlength=size)])
        place = pc.fill_null(pc.index_in(encoded.dictionary, value_set=known), -1).to_numpy()
        is_heavy = place >= 0
        counters[:, place[is_heavy]] += counts[:, is_heavy]
        light = np.flatnonzero(~is_heavy)
        if len(light):
            yield pa.RecordBatch.from_arrays([encoded.dictionary.take(pa.array(light)), pa.array(counts[0, light]), pa.array(counts[1, light])], names=names)
    seen = np.flatnonzero(counters[0])
    yield pa.RecordBatch.from_arrays([known.take(pa.array(seen)), pa.array(counters[0, seen]), pa.array(counters[1, seen])], names=names)


def term_counts(records: DataFrame, terms: dict[str, Column], heavy_from: DataFrame | None = None, share: int = HEAVY_SHARE) -> DataFrame:
    """field, term, occurrences, records: one row for every distinct term of every field.

    records: one row per record. terms: field name to an ARRAY<STRING> column. Heavy
    terms, looked for in `heavy_from` (default the records), are broadcast, at most
    `share` of them, and counted in exact arrays that leave a partition as one row per
    term; only the remaining terms are shuffled, summed per batch before. Which terms
    count as heavy affects the cost alone, never a count.

    A null array and null terms count as absent; an empty string is a term like any
    other; repeats within a record raise occurrences only. No rows give no rows.
    """
    heavy = records.sparkSession.sparkContext.broadcast(heavy_terms(heavy_from if heavy_from is not None else records, terms, share))
    parts = records.select(_tagged(terms).alias("t")).mapInArrow(lambda b: _count(b, heavy.value), "term string, occurrences bigint, records bigint")
    total = parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    fields = F.array(*[F.lit(f) for f in terms])
    number = F.substring_index("term", ":", 1)
    return total.select(
        F.get(fields, number.cast("int")).alias("field"),
        F.expr("substring(term, instr(term, ':') + 1)").alias("term"),
        "occurrences", "records",
    )


def mark_terms(counts: DataFrame, n_records: int, too_rare: int = 3, too_common: int = 10) -> DataFrame:
    """Adds mark: `too_rare` if fewer than `too_rare` records hold the term, else
    `too_common` if more than one in `too_common` of all records do, else null."""
    mark = F.when(F.col("records") < too_rare, "too_rare").when(F.col("records") * too_common > n_records, "too_common")
    return counts.withColumn("mark", mark)


def repo_terms(rows: DataFrame) -> DataFrame:
    """field, term, occurrences, repos, mark of tag names and languages in the current repos.

    The keys of the current rows are made and written once, and read for the heavy terms,
    the counts and the number of repositories."""
    keys = {"tag": name_keys(F.col("tags.name")), "language": name_keys(F.array("primary_language"))}
    held = cut_lineage(repo_names.current(rows, "tags", "primary_language").select(*[c.alias(n) for n, c in keys.items()]))
    counts = term_counts(held, {n: F.col(n) for n in keys})
    return mark_terms(counts, held.count()).withColumnRenamed("records", "repos")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_terms(repo_names.repos(spark, sf_dir)).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_terms(repo_names.repos(spark, sf_dir))


_SQL = f"""WITH {repo_names.CURRENT_SQL}, held AS (
  SELECT id, 'tag' AS field, {name_key_sql('t.name')} AS term FROM (SELECT id, unnest(tags) AS t FROM current)
  UNION ALL SELECT id, 'language', {name_key_sql('primary_language')} FROM current
), counted AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS repos FROM held WHERE term IS NOT NULL GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN repos < 3 THEN 'too_rare' WHEN repos * 10 > (SELECT count(*) FROM current) THEN 'too_common' END AS mark FROM counted
) """

QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms}
SQL = {"p1_found": _SQL + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL", "p1_terms": _SQL + "SELECT * FROM marked"}
