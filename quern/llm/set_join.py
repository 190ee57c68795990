"""All similar pairs between set-valued records, by a prefix-filtered join."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import name_key_sql
from quern.llm import repo_names
from quern.session import cut_lineage

#: Width of the table of token counts by hash, from which tokens get their order.
RARITY_WIDTH = 1 << 16
#: A prefix token, or a class of equal sets, is hot if it holds at least one in HOT_SHARE of
#: the rows, so at most that many are; and at least HOT_LEAST of them.
HOT_SHARE, HOT_LEAST = 1024, 4096
#: Rows of either side of a hot token, or members of a hot class, that meet in one task.
BLOCK_ROWS = 4096


def _blocks(rows: Column, block_rows: int) -> Column:
    return F.greatest(F.ceil(rows / F.lit(block_rows)), F.lit(1)).cast("int")


def _number(of: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(of), blocks).cast("int")


def _all(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def classes_of(sets: DataFrame, min_size: int, hot_least: int = HOT_LEAST, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with equal sets are one class. Returns the clean sets, the members (side,
    id, class) and the classes (class, tokens, sides).

    sets: side INT, id BIGINT, tokens ARRAY<STRING>. A class is named by its least
    (side, id); sets are held equal by 128 bits of hash. Null tokens don't count,
    repeated ones count once, and records with a null id, a null set or fewer than
    min_size tokens are in no class. The clean sets are written once and read for the
    rarity table, the classes and the members. Members of a hot class meet its name in
    several blocks.
    """
    clean = sets.where(F.col("id").isNotNull()).select("side", "id", F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull()))).alias("tokens"))
    clean = clean.where(F.size("tokens") >= max(min_size, 1)).select("side", "id", "tokens", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(7), "tokens").alias("h2"))
    clean = cut_lineage(clean)
    bit, keys = F.col("side") + 1, ["h1", "h2"]
    grouped = cut_lineage(clean.groupBy(*keys).agg(F.min(F.struct("side", "id")).alias("class"), F.min(bit).bitwiseOR(F.max(bit)).alias("sides"), F.first("tokens").alias("tokens"), F.count("*").alias("copies")))
    members = _met(clean.select(*keys, "side", "id"), grouped.select(*keys, "class", "copies"), keys, clean.count(), hot_least, block_rows)
    return clean, cut_lineage(members.select("side", "id", "class")), grouped.select("class", "tokens", "sides")


def _small(rows: DataFrame) -> DataFrame | None:
    """A table of hot keys (at most 2 * HOT_SHARE rows) to be broadcast; None if there are none."""
    held = rows.collect()
    return F.broadcast(rows.sparkSession.createDataFrame(held, rows.schema)) if held else None


def _met(rows: DataFrame, one: DataFrame, keys: list[str], total: int, hot_least: int, block_rows: int) -> DataFrame:
    """rows (keys, id, ...) joined with the one row of `one` (keys, copies, ...) that each
    key has; a hot key's rows are dealt to blocks and its one row goes to each."""
    hot = one.where((F.col("copies") >= hot_least) & (F.col("copies") * HOT_SHARE >= total))
    hot = _small(hot.select(*keys, _blocks(F.col("copies"), block_rows).alias("blocks")))
    if hot is None:
        return rows.join(one.drop("copies"), keys)
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("block", _number(F.col("id"), blocks)).drop("blocks")
    spread = one.drop("copies").join(hot, keys, "left").withColumn("block", _all(blocks)).drop("blocks")
    return dealt.join(spread, [*keys, "block"]).drop("block")


def order_by_rarity(classes: DataFrame, sets: DataFrame, width: int = RARITY_WIDTH) -> DataFrame:
    """Sorts the tokens of each class, rarest first, by one total order for all classes.

    The order is (number of sets with a token in the slot of a table of `width` counts,
    token). The table has a fixed size, so it can be broadcast whatever the number of
    tokens; sharing a slot costs some rarity, never a pair.
    """
    slots = sets.select(F.explode("tokens").alias("t")).groupBy(F.pmod(F.crc32(F.encode("t", "UTF-8")), F.lit(width)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    table = np.zeros(width, np.int64)
    for slot, n in slots.collect():  # at most `width` rows
        table[slot] = n
    shared = classes.sparkSession.sparkContext.broadcast(table)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            encoded = lists.flatten().dictionary_encode()
            words = encoded.dictionary
            rank = np.empty(len(words), np.int64)
            rank[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
            slot = np.array([zlib.crc32(w.encode()) % len(shared.value) for w in words.to_pylist()], np.int64)
            codes = encoded.indices.to_numpy()
            rows = pc.list_parent_indices(lists).to_numpy()
            order = np.lexsort((rank[codes], shared.value[slot][codes], rows)) if len(codes) else np.zeros(0, np.int64)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            tokens = pa.ListArray.from_arrays(offsets, words.take(pa.array(codes[order])))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, batch.column(2)], names=["class", "tokens", "sides"])

    return classes.mapInArrow(convert, classes.select("class", "tokens", "sides").schema)


def _ceil(num: int, den: int, of: Column) -> Column:
    return F.floor((of * num + (den - 1)) / F.lit(den)).cast("int")


def similar_classes(classes: DataFrame, sets: DataFrame, threshold: str, between: bool = False, hot_least: int = HOT_LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """class_a, class_b, overlap, n_union: all pairs of different sets whose Jaccard
    similarity is at least `threshold`, each once.

    between: only pairs with one side in the left and one in the right table. Tokens
    are ordered by rarity; a set of n tokens is indexed under its first
    n - ceil(2t/(1+t) n) + 1 and looked up under its first n - ceil(t n) + 1, among
    sets no longer than itself. Length and position bound the overlap before it is
    counted. Where a token holds a large part of the index or of the lookups, both are
    split into blocks of `block_rows`, and each block of the one meets each of the other.

    The index holds tokens as 32-bit hashes, a third of their size. Equal tokens have
    equal hashes, so no pair is lost: overlaps counted on hashes are too large, or, where
    hashes agree within a set, short by at most the number that agree, which is added.
    The few candidates left are verified on the tokens themselves.
    """
    t = Fraction(threshold)
    num, den = t.numerator, t.denominator
    base = cut_lineage(order_by_rarity(classes, sets))
    codes = F.transform("tokens", lambda t: F.hash(t))
    sized = base.select("class", codes.alias("codes"), "sides", F.size("tokens").alias("n"))
    # Sets of similar length are in the same or in neighbouring length bands.
    band = lambda c: F.floor(F.log(c) / F.lit(float(np.log(1 / float(t))))).cast("int") if t < 1 else c.cast("int")
    size = F.col("n")
    index_len = size - _ceil(2 * num, num + den, size) + 1
    probe_len = size - _ceil(num, den, size) + 1
    index = sized.select("class", "codes", "sides", "n", band(size).alias("band"), F.posexplode(F.slice("codes", F.lit(1), index_len)).alias("pos", "code"))
    probe = sized.select("class", "codes", "sides", "n", F.explode(F.sequence(band(_ceil(num, den, size)), band(size))).alias("band"), F.slice("codes", F.lit(1), probe_len).alias("prefix"))
    probe = probe.select("class", "codes", "sides", "n", "band", F.posexplode("prefix").alias("pos", "code"))

    # Every index row is a lookup row too, so one pass over the lookups counts both.
    own = (F.col("pos") < index_len) & (F.col("band") == band(size))
    per_key = probe.groupBy("code", "band").agg(F.count("*").alias("probes"), F.count_if(own).alias("rows"))
    bands = band(size) - band(_ceil(num, den, size)) + 1
    rows, probes = sized.agg(F.sum(index_len), F.sum(probe_len * bands)).first()
    large = lambda c, total: (F.col(c) >= hot_least) & (F.col(c) * HOT_SHARE >= (total or 0))
    hot = per_key.where(large("rows", rows) | large("probes", probes))
    hot = _small(hot.select("code", "band", _blocks(F.col("rows"), block_rows).alias("nx"), _blocks(F.col("probes"), block_rows).alias("ny")))
    keys = ["code", "band"]
    if hot is not None:
        nx, ny = F.coalesce("nx", F.lit(1)), F.coalesce("ny", F.lit(1))
        index = index.join(hot, keys, "left").withColumn("bx", _number(F.col("class"), nx)).withColumn("by", _all(ny))
        probe = probe.join(hot, keys, "left").withColumn("by", _number(F.col("class"), ny)).withColumn("bx", _all(nx))
        keys += ["bx", "by"]
    x = index.select(*keys, *[F.col(c).alias(f"x_{c}") for c in ("class", "codes", "sides", "n", "pos")])
    y = probe.select(*keys, *[F.col(c).alias(f"y_{c}") for c in ("class", "codes", "sides", "n", "pos")])
    both = x.join(y, keys).where(
        ((F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_class") < F.col("y_class"))))
        & (F.col("x_n") * den >= F.col("y_n") * num)
        # No common token stands before this one, so it and what follows is all there can be.
        & ((F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))) * (num + den) >= (F.col("x_n") + F.col("y_n")) * num)
        & ~F.arrays_overlap(F.slice("x_codes", F.lit(1), F.col("x_pos")), F.slice("y_codes", F.lit(1), F.col("y_pos")))
    )
    if between:
        both = both.where(F.col("x_sides").bitwiseOR(F.col("y_sides")) == 3)
    alike = F.size(F.array_intersect("x_codes", "y_codes")) + F.col("x_n") - F.size(F.array_distinct("x_codes"))
    # Candidates: overlap / (n + m - overlap) >= num / den, with all that the overlap can be.
    maybe = both.where(alike * (num + den) >= (F.col("x_n") + F.col("y_n")) * num)
    maybe = maybe.select(F.least("x_class", "y_class").alias("class_a"), F.greatest("x_class", "y_class").alias("class_b")).distinct()
    for s in "ab":
        maybe = maybe.join(base.select(F.col("class").alias(f"class_{s}"), F.col("tokens").alias(f"tokens_{s}")), f"class_{s}")
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
    out = maybe.select("class_a", "class_b", overlap.alias("overlap"), (F.size("tokens_a") + F.size("tokens_b") - overlap).alias("n_union"))
    return out.where(F.col("overlap") * den >= F.col("n_union") * num)


def similar_sets(left: DataFrame, threshold: str = "0.8", min_size: int = 1, right: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (side, id, class) and pairs of classes (class_a, class_b, overlap, n_union).

    left, right: id BIGINT, tokens ARRAY<STRING>; other columns don't matter. With
    `right`, pairs are those between the two tables (a class with members in both is
    such a pair itself); side is 0 for left and 1 for right. Empty tables give empty
    results; ids may repeat, each row is a member. Pairs of records are made by expand
    and links, with `right` by expand_between and links_between.
    """
    sets = left.select(F.lit(0).alias("side"), F.col("id").cast("bigint").alias("id"), "tokens")
    if right is not None:
        sets = sets.unionByName(right.select(F.lit(1).alias("side"), F.col("id").cast("bigint").alias("id"), "tokens"))
    clean, members, classes = classes_of(sets, min_size)
    return members, similar_classes(classes, clean, threshold, between=right is not None)


def _in_blocks(members: DataFrame, hot_least: int, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The members with the number of their block among `blocks` of their class, and the
    hot classes (at most HOT_SHARE rows, None for none) with theirs; others are one block."""
    sizes = members.groupBy("class").agg(F.count("*").alias("copies")).where(F.col("copies") >= hot_least)
    hot = sizes.where(F.col("copies") * HOT_SHARE >= members.count())
    hot = _small(hot.select("class", _blocks(F.col("copies"), block_rows).alias("blocks")))
    if hot is None:
        return members, None
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = members.join(hot, "class", "left").select("class", "side", "id", blocks.alias("blocks"))
    return dealt.withColumn("block", _number(F.col("id"), F.col("blocks"))), hot


def _with_members(rows: DataFrame, name: str, to: str, dealt: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with each member of the class in column `name`, as column `to`: a row goes to
    each block of a hot class."""
    each = dealt.withColumnsRenamed({"class": name, "id": to})
    if hot is None:
        return rows.join(each.select(name, to), name)
    spread = rows.join(hot.withColumnRenamed("class", name), name, "left").withColumn("block", _all(F.coalesce("blocks", F.lit(1)))).drop("blocks")
    return spread.join(each.select(name, "block", to), [name, "block"]).drop("block")


def _within(dealt: DataFrame, hot: DataFrame | None) -> DataFrame:
    """m_a, m_b: each pair of members of one class, block by block: block i as the one side
    meets every block from i on as the other."""
    if hot is None:
        left, right = (dealt.select("class", F.col("id").alias(f"m_{s}")) for s in "ab")
        return left.join(right, "class").where(F.col("m_a") < F.col("m_b"))
    one, two = F.col("block"), F.col("blocks")
    left = dealt.select("class", F.col("id").alias("m_a"), one.alias("i"), F.explode(F.sequence(one, two - 1)).alias("j"))
    right = dealt.select("class", F.col("id").alias("m_b"), one.alias("j"), F.explode(F.sequence(F.lit(0), one)).alias("i"))
    return left.join(right, ["class", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("m_a") < F.col("m_b")))


def expand(members: DataFrame, pairs: DataFrame, hot_least: int = HOT_LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id_a, id_b (id_a < id_b): the pairs of one table's records, equal sets included.

    Members of a hot class are in blocks, and pairs of blocks are what meets in a task."""
    dealt, hot = _in_blocks(members, hot_least, block_rows)
    across = pairs.select("class_a", "class_b")
    for s in "ab":
        across = _with_members(across, f"class_{s}", f"m_{s}", dealt, hot)
    both = across.select("m_a", "m_b").unionByName(_within(dealt, hot).select("m_a", "m_b"))
    return both.select(F.least("m_a", "m_b").alias("id_a"), F.greatest("m_a", "m_b").alias("id_b")).where(F.col("id_a") < F.col("id_b"))


def links(members: DataFrame, pairs: DataFrame, hot_least: int = HOT_LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, class_id, copies, links: for each record its class, the class's size and the
    number of other records with a similar or equal set. No pair of records is made."""
    sizes = members.groupBy("class").agg(F.count("*").alias("copies"))
    both = pairs.select(F.col("class_a").alias("class"), F.col("class_b").alias("other")).unionByName(pairs.select(F.col("class_b").alias("class"), F.col("class_a").alias("other")))
    linked = both.join(sizes.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("near"))
    told = sizes.join(linked, "class", "left").select("class", "copies", F.col("copies").alias("n"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    met = _met(members, told, ["class"], members.count(), hot_least, block_rows)
    return met.select("id", F.col("class.id").alias("class_id"), F.col("n").alias("copies"), "links")


def _both_ways(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """class, other: similar classes in both orders, and each class with itself."""
    one, two = F.col("class_a"), F.col("class_b")
    own = members.select("class", F.col("class").alias("other")).distinct()
    return pairs.select(one.alias("class"), two.alias("other")).unionByName(pairs.select(two.alias("class"), one.alias("other"))).unionByName(own)


def expand_between(members: DataFrame, pairs: DataFrame, hot_least: int = HOT_LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id_left, id_right: the pairs of a left and a right record, of similar_sets with
    `right`; equal sets and equal ids included, pairs within one table not."""
    dealt, hot = _in_blocks(members, hot_least, block_rows)
    rows = _with_members(_both_ways(members, pairs), "class", "id_left", dealt.where("side = 0"), hot)
    return _with_members(rows, "other", "id_right", dealt.where("side = 1"), hot).select("id_left", "id_right")


def links_between(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """side, id, class_side, class_id, copies, links: for each record of either table its
    class, the number of records of its own table in it, and the number of records of the
    other table with a similar or equal set. No pair of records is made."""
    sizes = members.groupBy("class", "side").agg(F.count("*").alias("copies"))
    across = sizes.select(F.col("class").alias("other"), (1 - F.col("side")).alias("side"), F.col("copies").alias("n"))
    linked = _both_ways(members, pairs).join(across, "other").groupBy("class", "side").agg(F.sum("n").alias("links"))
    one = sizes.join(linked, ["class", "side"], "left").withColumn("n", F.col("copies"))
    told = _met(members, one, ["class", "side"], members.count(), HOT_LEAST, BLOCK_ROWS).withColumnRenamed("n", "copies")
    return told.select("side", "id", F.col("class.side").alias("class_side"), F.col("class.id").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def repo_sets(rows: DataFrame) -> DataFrame:
    """id, tokens: the keys of topics, tag names and groups of each current repository."""
    return repo_names.current(rows, "topics", "tags", "groups").select("id", repo_names.keys_of("topics", "tags", "groups").alias("tokens"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = expand(*similar_sets(repo_sets(repo_names.repos(spark, sf_dir)), "0.8", 4))
    return pairs.select(F.col("id_a").alias("repo_a"), F.col("id_b").alias("repo_b"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(*similar_sets(repo_sets(repo_names.repos(spark, sf_dir)), "0.8", 4))


_SQL = f"""WITH {repo_names.CURRENT_SQL}, held AS (
  SELECT DISTINCT id, item FROM (
    SELECT id, {name_key_sql('t.name')} AS item FROM (SELECT id, unnest(tags) AS t FROM current)
    UNION ALL SELECT id, {name_key_sql('t')} FROM (SELECT id, unnest(topics) AS t FROM current)
    UNION ALL SELECT id, {name_key_sql('t')} FROM (SELECT id, unnest(groups) AS t FROM current)
  ) WHERE item IS NOT NULL
), sizes AS (SELECT id, count(*) AS n FROM held GROUP BY ALL HAVING n >= 4
), inter AS (
  SELECT a.id AS x, b.id AS y, count(*) AS i FROM held a JOIN held b ON a.item = b.item AND a.id < b.id GROUP BY ALL
), pairs AS (
  SELECT x AS repo_a, y AS repo_b, i, s.n + r.n - i AS u FROM inter JOIN sizes s ON s.id = x JOIN sizes r ON r.id = y WHERE i * 10 >= (s.n + r.n - i) * 8
) """

QUERIES = {"p2_found": p2_found, "p2_links": p2_links}
SQL = {
    "p2_found": _SQL + "SELECT repo_a, repo_b FROM pairs",
    "p2_links": _SQL + """, linked AS (SELECT repo_a AS id, repo_b AS other, i, u FROM pairs UNION ALL SELECT repo_b, repo_a, i, u FROM pairs)
SELECT s.id, least(s.id, coalesce(min(other) FILTER (i = u), s.id)) AS class_id, 1 + count(other) FILTER (i = u) AS copies, count(other) AS links
FROM sizes s LEFT JOIN linked b ON b.id = s.id GROUP BY s.id""",
}
