"""Mixing sources to target weights, by subset-sum budget fitting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.names import trimmed, trimmed_sql
from quern.functions.tokens import token_count, token_count_sql
from quern.session import cut_lineage, read_table

SEED = 20240229
#: Bits of the hash that name a bucket of the documents of one source and length, and one within that.
SALT_BITS, FINE_BITS = 6, 12
#: Budget left to the exact fit; above it, documents are taken length by length.
EXACT_BUDGET = 1 << 17
#: Budget that the exact fit is given at least, where as much was taken before.
ROOM = 1 << 15
#: Budget of a second exact fit, in units of the lengths' common divisor, where the first leaves more than it must.
WIDE_BUDGET = 1 << 22


def exact_fit(lengths: list[int], counts: list[int], budget: int) -> tuple[list[int], int]:
    """How many of each length to take for the greatest total not above `budget`.

    Bounded knapsack over sums: the counts are split into pieces of 1, 2, 4, ... and a
    bit set holds the reachable sums; for each sum the piece that first reached it is
    kept, which gives the choice back. Stops as soon as the budget itself is reached.
    """
    mask = (1 << (budget + 1)) - 1
    reached, pieces = 1, []
    by = np.full(budget + 1, -1, np.int64)
    for i, (length, count) in enumerate(zip(lengths, counts)):
        if not 0 < length <= budget:
            continue
        count, k = min(count, budget // length), 1
        while count and not reached >> budget & 1:
            n = min(k, count)
            new = (reached << (n * length)) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(pieces)
                reached |= new
            pieces.append((i, n))
            count -= n
            k *= 2
    total = reached.bit_length() - 1
    take, at = [0] * len(lengths), total
    while at:
        i, n = pieces[by[at]]
        take[i] += n
        at -= n * lengths[i]
    return take, total


def fit_source(lengths: list[int], counts: list[int], budget: int, max_repeats: int, seed: int) -> list[int]:
    """How many draws of each length: between 0 and max_repeats for each of its documents.

    If even max_repeats of everything doesn't reach the budget, it is that. Else draws as
    even as can be are tried first: whole passes, and the rest once more;
    if that leaves more of the budget than the lengths' common divisor forces, any number
    of draws up to max_repeats is, and the better of the two counts.

    So the total is as near below the budget as whole documents allow wherever it meets
    the budget (less the remainder by the common divisor), and wherever the budget is at
    most WIDE_BUDGET divisors; else it is the nearest that changing about WIDE_BUDGET
    divisors of the draw gives.
    """
    size = sum(length * n for length, n in zip(lengths, counts))
    if size <= 0 or max_repeats <= 0 or budget <= 0:
        return [0] * len(lengths)
    if budget // size >= max_repeats:
        return [n * max_repeats for n in counts]
    passes, rest = divmod(budget, size)
    least = budget % math.gcd(*(length for length, n in zip(lengths, counts) if n))
    once, left = _choose(lengths, counts, rest, seed)
    draws = [n * passes + t for n, t in zip(counts, once)]
    if left > least and max_repeats > 1:
        uneven, more = _choose(lengths, [n * max_repeats for n in counts], budget, seed)
        if more < left:
            draws = uneven
    return draws


def _choose(lengths: list[int], counts: list[int], rest: int, seed: int) -> tuple[list[int], int]:
    """How many of each length to take for a total near below `rest`, which is less than
    all of them, and what is left.

    Each length gives its share, rounded down; then lengths in seeded order close most of
    the gap, or open it to ROOM, and exact_fit closes the rest. If that leaves more than
    the lengths' common divisor forces, a second fit gives back up to WIDE_BUDGET
    divisors, and the better of the two counts.
    """
    size = sum(length * n for length, n in zip(lengths, counts))
    unit = math.gcd(*(length for length, n in zip(lengths, counts) if n))
    least = rest % unit
    take = [n * rest // size for n in counts]
    rest -= sum(length * n for length, n in zip(lengths, take))
    order = np.random.default_rng(seed).permutation(len(lengths)).tolist()
    for i in order:
        if rest <= EXACT_BUDGET:
            break
        if lengths[i] > 0:
            n = min(counts[i] - take[i], (rest - EXACT_BUDGET) // lengths[i] + 1, rest // lengths[i])
            take[i] += n
            rest -= n * lengths[i]
    wide, wide_rest = list(take), rest
    while rest < ROOM:  # too little to choose from: give some documents back, none that leaves too much
        before = rest
        for i in order:
            if rest < ROOM and take[i] and 0 < lengths[i] <= EXACT_BUDGET - rest:
                take[i] -= 1
                rest += lengths[i]
        if rest == before:
            break
    take, rest = _fill(lengths, counts, take, order, rest, unit)
    if rest > least:
        for most in (1, max(counts)):  # one of each length first, for choice
            for i in order:
                if lengths[i] > 0:
                    n = max(min(wide[i], most, (WIDE_BUDGET * unit - wide_rest) // lengths[i]), 0)
                    wide[i] -= n
                    wide_rest += n * lengths[i]
        wide, wide_rest = _fill(lengths, counts, wide, order, wide_rest, unit)
        if wide_rest < rest:
            take, rest = wide, wide_rest
    return take, rest


def _fill(lengths: list[int], counts: list[int], take: list[int], order: list[int], rest: int, unit: int) -> tuple[list[int], int]:
    """The take with the best fit into the rest added, and what is left then. A rest above
    the budgets of the fits is one that no document left fits into."""
    fits = [i for i in order if counts[i] > take[i] and 0 < lengths[i] <= rest]
    if not fits:
        return take, rest
    more, total = exact_fit([lengths[i] // unit for i in fits], [counts[i] - take[i] for i in fits], rest // unit)
    take = list(take)
    for i, n in zip(fits, more):
        take[i] += n
    return take, rest - total * unit


def _fitted(frame: pd.DataFrame, budgets: dict[str, tuple[int, int]], seed: int) -> pd.DataFrame:
    """The draws of each length of one source."""
    budget, most = budgets[frame["source"].iloc[0]]
    frame = frame.sort_values("size").reset_index(drop=True)
    frame["draws"] = fit_source(frame["size"].tolist(), frame["n"].tolist(), budget, most, seed)
    return frame[["source", "size", "n", "draws"]]


def clean_targets(targets: DataFrame) -> DataFrame:
    """One row per source: weight (null counts as 0; repeated rows add up), max_repeats (null as 1)."""
    return targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("bigint").alias("max_repeats"))


class Mix:
    """A mix of documents by source; see draws() and shares().

    documents: id, source (as spelled in targets), size BIGINT; targets: source,
    weight, max_repeats: one row per source, so a short table. Documents with a null
    source or of a source without a target are never drawn; a null size counts as 0.
    The total asked for is that of all documents of the target sources, or `total`.
    Documents of size 0 are drawn like others of their length. The same seed, data and
    targets give the same draw.

    Documents are counted by source and length; a source's counts, never its documents,
    come together to be fitted. A length's draws are spread evenly over its documents,
    and what remains goes to those with the least seeded hashes: two levels of hash
    buckets are dealt out whole, and only within the one bucket at the limit, a
    262 144th of the documents of one length, are documents ranked.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED):
        self.spark, self.seed = documents.sparkSession, seed
        wanted = clean_targets(targets).collect()  # one row per source
        key = F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
        sized = documents.select("id", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
        sized = sized.where(F.col("source").isin([r.source for r in wanted]))
        bucket = lambda at, bits: F.shiftright("order", at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        sized = sized.withColumn("order", key).select("*", bucket(0, SALT_BITS).alias("salt"), bucket(SALT_BITS, FINE_BITS).alias("fine"))
        self.documents = cut_lineage(sized)
        self.counts = cut_lineage(self.documents.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
        by_length = self.counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
        held = {r.source: r.s for r in by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()}
        self.total = sum(held.values()) if total is None else total
        self.targets = [(r.source, r.weight, r.max_repeats, held.get(r.source, 0), int(round(r.weight * self.total))) for r in wanted]
        budgets = {r[0]: (r[4], r[2]) for r in self.targets}
        self.fitted = cut_lineage(by_length.groupBy("source").applyInPandas(lambda f: _fitted(f, budgets, seed), "source string, size bigint, n bigint, draws bigint"))

    def draws(self) -> DataFrame:
        """id, source, size, draws: the documents drawn and how often, at most max_repeats times."""
        keys = ["source", "size", "salt"]
        each = self.fitted.select("source", "size", F.expr("if(n > 0, draws div n, 0)").alias("passes"), F.expr("draws % n").alias("more"))
        salts = _dealt(self.counts.join(each, ["source", "size"]), keys)
        told = self.documents.join(salts, keys)
        sure = told.where("take = 0 OR take = n").select("id", "source", "size", (F.col("passes") + F.expr("if(take = n, 1, 0)")).alias("draws"))
        part = told.where("take > 0 AND take < n").select("id", *keys, "fine", "order", "passes", F.col("take").alias("more"))
        keys = [*keys, "fine"]
        fine = _dealt(part.groupBy(*keys).agg(F.count("*").alias("n"), F.first("more").alias("more")), keys).select(*keys, "take", "n")
        told = part.join(fine, keys)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("order", "id"))
        ranked = told.where("take > 0 AND take < n").withColumn("rank", rank).select("id", "source", "size", (F.col("passes") + F.expr("if(rank <= take, 1, 0)")).alias("draws"))
        settled = told.where("take = 0 OR take = n").select("id", "source", "size", (F.col("passes") + F.expr("if(take = n, 1, 0)")).alias("draws"))
        return sure.unionByName(settled).unionByName(ranked).where(F.col("draws") > 0)

    def shares(self) -> DataFrame:
        """One row per target: source, weight, max_repeats, available and budget and
        drawn (sizes), share (of the total asked for), mix_share (of what was drawn),
        short (every document is drawn max_repeats times and that is below the weight)."""
        told = self.spark.createDataFrame(self.targets, "source string, weight double, max_repeats bigint, available bigint, budget bigint")
        drawn = self.fitted.groupBy("source").agg(F.sum(F.col("size") * F.col("draws")).alias("drawn"), F.sum("draws").alias("draws"), F.sum("n").alias("n"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        joined = told.join(drawn, "source", "left").withColumns({"drawn": zero("drawn"), "used_up": zero("draws") == zero("n") * F.col("max_repeats")})
        part = lambda of: F.coalesce(F.try_divide(F.col("drawn").cast("double"), of), F.lit(0.0))
        short = F.col("used_up") & (F.col("drawn").cast("double") < F.col("weight") * F.lit(float(self.total)))
        return joined.select("source", "weight", "max_repeats", "available", "budget", "drawn", part(F.lit(float(self.total))).alias("share"), part(F.sum("drawn").over(Window.partitionBy())).alias("mix_share"), short.alias("short"))


def _dealt(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Adds take: how many of each bucket's n documents are among the first `more` of
    their group, the buckets of a group (all keys but the last) taken in order."""
    before = F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return buckets.withColumn("take", F.greatest(F.least(F.col("more") - before, F.col("n")), F.lit(0)))


def source_key(source: Column) -> Column:
    """The source of a document: trimmed and lower-cased."""
    return F.lower(trimmed(source))


def document_mix(spark: SparkSession, sf_dir: str) -> Mix:
    documents = read_table(spark, sf_dir, "documents")
    sized = documents.select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("source"), token_count(F.coalesce("text", F.lit(""))).alias("size"))
    return Mix(sized, read_table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_mix(spark, sf_dir).shares().where("short").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_mix(spark, sf_dir).shares()


def p7_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_mix(spark, sf_dir).draws().withColumnRenamed("id", "doc_id")


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws held against what was asked, by source: available and missing (the budget,
    or all repeats if these are less, without what was drawn) in tokens, documents drawn
    too often, drawn twice over, and drawn with another source or size than they have."""
    mix = document_mix(spark, sf_dir)
    caps = spark.createDataFrame([(r[0], r[2], r[3], min(r[4], r[2] * r[3])) for r in mix.targets], "source string, most bigint, available bigint, wanted bigint")
    own = mix.documents.select("id", F.col("source").alias("own_source"), F.col("size").alias("own_size"))
    draws = mix.draws().join(own, "id", "left").join(caps, "source")
    wrong = ~F.col("source").eqNullSafe(F.col("own_source")) | ~F.col("size").eqNullSafe(F.col("own_size"))
    told = draws.groupBy("source").agg(F.sum(F.col("size") * F.col("draws")).alias("drawn"), F.count_if(F.col("draws") > F.col("most")).alias("too_often"), (F.count("*") - F.count_distinct("id")).alias("twice"), F.count_if(wrong).alias("strange"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return caps.join(told, "source", "left").select("source", "available", (F.col("wanted") - zero("drawn")).alias("missing"), *[zero(c).alias(c) for c in ("too_often", "twice", "strange")])


QUERIES = {"p7_found": p7_found, "p7_shares": p7_shares, "p7_draws": p7_draws, "p7_kept": p7_kept}
_SQL = f"""WITH s AS (SELECT lower({trimmed_sql('source')}) AS source, sum({token_count_sql("coalesce(text, '')")})::BIGINT AS n FROM documents GROUP BY 1),
m AS (SELECT t.source, weight, max_repeats::BIGINT AS max_repeats, coalesce(n, 0) AS available FROM mix_targets t LEFT JOIN s ON s.source = t.source),
a AS (SELECT *, (SELECT sum(available) FROM m)::BIGINT AS total, round_even(weight * (SELECT sum(available) FROM m), 0)::BIGINT AS budget FROM m),
b AS (SELECT *, least(budget, max_repeats * available) AS drawn, max_repeats * available < weight * total AS short FROM a) """
SQL = {
    "p7_found": _SQL + "SELECT source FROM b WHERE short",
    "p7_shares": _SQL + "SELECT source, weight, max_repeats, available, budget, drawn, drawn::DOUBLE / total AS share, drawn::DOUBLE / (SELECT sum(drawn) FROM b)::DOUBLE AS mix_share, short FROM b",
    "p7_kept": _SQL + "SELECT source, available, 0::BIGINT AS missing, 0::BIGINT AS too_often, 0::BIGINT AS twice, 0::BIGINT AS strange FROM b",
}
