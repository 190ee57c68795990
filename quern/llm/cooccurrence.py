"""Items that appear together: pair counts, lift and pointwise mutual information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import name_key_sql
from quern.llm import repo_names
from quern.session import cut_lineage

#: Items of a basket whose pairs are emitted by one row at once; a larger basket is
#: spread over the cluster as pairs of blocks of this size.
BLOCK = 128
#: Bytes of item names, with 16 more for each item, that are broadcast at most; beyond, items are joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: An item is hot if it makes up at least one in HOT_SHARE of what baskets hold, so at most that many are.
HOT_SHARE = 1024


def _pairs(baskets: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), w: each pair of each basket once. baskets: items, sorted and distinct,
    and w, how many baskets the row stands for."""
    size = F.size("items")
    small = baskets.where(size <= block).select("w", "items", F.posexplode("items").alias("i", "a"))
    small = small.select("w", "a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("b"))
    # Blocks i <= j of a large basket become rows of their own and are dealt out evenly.
    blocks = F.expr(f"transform(sequence(0, cast((size(items) - 1) div {block} as int)), k -> slice(items, k * {block} + 1, {block}))")
    large = baskets.where(size > block).select("w", blocks.alias("blocks"))
    large = large.select("w", "blocks", F.posexplode("blocks").alias("i", "left"))
    large = large.select("w", "left", F.posexplode(F.expr("slice(blocks, i + 1, size(blocks))")).alias("d", "right"))
    large = large.repartition(baskets.sparkSession.sparkContext.defaultParallelism * 4)
    large = large.select("w", "right", "d", F.posexplode("left").alias("i", "a"))
    large = large.select("w", "a", F.explode(F.expr("if(d = 0, slice(right, i + 2, size(right)), right)")).alias("b"))
    return small.unionByName(large).select("a", "b", "w")


def item_counts(baskets: DataFrame) -> DataFrame:
    """item, n: the number of baskets that hold it."""
    return baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def _encoded(baskets: DataFrame, known: list[str]) -> DataFrame:
    """The baskets with the numbers of known items in place of items, others left out:
    one pass over Arrow batches. known: sorted, so numbers sort as items do."""
    shared = baskets.sparkSession.sparkContext.broadcast(known)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(0)
            codes = pc.index_in(lists.flatten(), value_set=table)
            kept = codes.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            offsets = np.concatenate(([0], np.cumsum(kept)))[ends]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), codes.drop_null())], names=["items"])

    return baskets.select("items").mapInArrow(convert, "items array<int>").where(F.size("items") > 1).select("items", F.lit(1).cast("bigint").alias("w"))


def _pruned(baskets: DataFrame, counts: DataFrame) -> DataFrame:
    """The baskets without the items that aren't in counts, by shuffle; equal baskets
    become one row. Hot items meet their counts by broadcast, so no task gets all rows
    of one item."""
    baskets = baskets.where(F.size("items") > 1).groupBy("items").agg(F.count("*").alias("w"))
    each = baskets.select("w", F.xxhash64("items").alias("h1"), F.xxhash64(F.lit(7), "items").alias("h2"), F.explode("items").alias("item"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * HOT_SHARE >= total).select("item", F.lit(True).alias("hot")))  # at most HOT_SHARE rows
    told = each.join(hot, "item", "left")
    kept = told.where("hot").drop("hot").unionByName(told.where("hot IS NULL").drop("hot").join(counts.select("item"), "item", "left_semi"))
    return kept.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("w").alias("w")).where(F.size("items") > 1).select("items", "w")


def cooccurring(baskets: DataFrame, n_baskets: int, min_item: int = 1, min_pair: int = 1, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """item_a, item_b (item_a < item_b by code point), n_a, n_b, n_ab, lift, pmi.

    baskets: a column items ARRAY<STRING>, sorted, each item once, one row per basket;
    other columns don't matter, null and empty baskets give nothing. min_item,
    min_pair: counts that items and pairs must reach; since a pair is never more
    frequent than its items, items below min_item leave the baskets before any pair is
    made, which loses no pair that is asked for. lift is n_ab * N / (n_a * n_b), pmi its
    natural logarithm.

    Pairs are counted map-side before their shuffle. Where the names of the items that
    are left have at most `broadcast_bytes`, these are numbered and broadcast, baskets
    become sorted lists of numbers, and pairs are counted as one number; otherwise
    baskets are pruned and pairs named by shuffle joins, with the same result.
    """
    spark = baskets.sparkSession
    baskets = baskets.select("items")
    counts = cut_lineage(item_counts(baskets).where(F.col("n") >= min_item))
    size, held = counts.agg(F.sum(F.octet_length("item") + 16), F.count("*")).first()
    if (size or 0) <= broadcast_bytes:
        known = sorted(tuple(r) for r in counts.collect())  # bounded by the size just measured
        table = spark.createDataFrame([(item, n, i) for i, (item, n) in enumerate(known)], "item string, n bigint, code bigint")
        pairs = _pairs(_encoded(baskets, [item for item, _ in known]), block)
        width = max(held, 1)
        joint = pairs.groupBy((F.col("a").cast("bigint") * width + F.col("b")).alias("pair")).agg(F.sum("w").alias("n_ab"))
        joint = joint.where(F.col("n_ab") >= min_pair).select(F.expr(f"pair div {width}").alias("a_code"), (F.col("pair") % width).alias("b_code"), "n_ab")
        side = lambda s: F.broadcast(table.select(F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"), F.col("code").alias(f"{s}_code")))
        joint = joint.join(side("a"), "a_code").join(side("b"), "b_code")
    else:
        kept = _pruned(baskets, counts) if min_item > 1 else baskets.where(F.size("items") > 1).withColumn("w", F.lit(1).cast("bigint"))
        joint = _pairs(kept, block).groupBy("a", "b").agg(F.sum("w").alias("n_ab")).where(F.col("n_ab") >= min_pair)
        for s in ("a", "b"):
            joint = joint.join(counts.select(F.col("item").alias(s), F.col("n").alias(f"n_{s}")), s)
        joint = joint.withColumnsRenamed({"a": "item_a", "b": "item_b"})
    lift = F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return joint.select("item_a", "item_b", "n_a", "n_b", "n_ab", lift.alias("lift"), F.log(lift).alias("pmi"))


def repo_baskets(rows: DataFrame) -> DataFrame:
    """items: the keys of topics and tag names of each current repository."""
    return repo_names.current(rows, "topics", "tags").select(repo_names.keys_of("topics", "tags").alias("items"))


def at_least(share_num: int, share_den: int, n: int) -> int:
    """The least whole number that is at least share_num / share_den of n."""
    return -(-share_num * n // share_den)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = cut_lineage(repo_baskets(repo_names.repos(spark, sf_dir)))  # written once, read for N, items and pairs
    n = baskets.count()
    pairs = cooccurring(baskets, n, max(1, at_least(5, 1000, n)), max(5, at_least(1, 1000, n)))
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    strong = exact("n_ab") * F.lit(n).cast("decimal(18,0)") >= exact("n_a") * exact("n_b") * F.lit(3)
    return pairs.where(strong).select("item_a", "item_b")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = cut_lineage(repo_baskets(repo_names.repos(spark, sf_dir)))
    pairs = cooccurring(baskets, baskets.count())
    return pairs.withColumns({c: F.round(c, 9) for c in ("lift", "pmi")})


_SQL = f"""WITH {repo_names.CURRENT_SQL}, held AS (
  SELECT DISTINCT id, item FROM (
    SELECT id, {name_key_sql('t.name')} AS item FROM (SELECT id, unnest(tags) AS t FROM current)
    UNION ALL SELECT id, {name_key_sql('t')} FROM (SELECT id, unnest(topics) AS t FROM current)
  ) WHERE item IS NOT NULL
), n AS (SELECT item, count(*) AS n FROM held GROUP BY ALL), total AS (SELECT count(*) AS t FROM current
), pairs AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM held a JOIN held b ON a.id = b.id AND a.item < b.item GROUP BY ALL
), measured AS (
  SELECT item_a, item_b, x.n AS n_a, y.n AS n_b, n_ab, t,
    n_ab * t::DOUBLE / (x.n::DOUBLE * y.n) AS lift, ln(n_ab * t::DOUBLE / (x.n::DOUBLE * y.n)) AS pmi
  FROM pairs JOIN n x ON x.item = item_a JOIN n y ON y.item = item_b, total
) """

QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs}
SQL = {
    "p5_found": _SQL + "SELECT item_a, item_b FROM measured WHERE n_a * 1000 >= 5 * t AND n_b * 1000 >= 5 * t AND n_ab >= 5 AND n_ab * 1000 >= t AND n_ab * t >= 3 * n_a * n_b",
    "p5_pairs": _SQL + "SELECT item_a, item_b, n_a, n_b, n_ab, round(lift, 9) AS lift, round(pmi, 9) AS pmi FROM measured",
}
