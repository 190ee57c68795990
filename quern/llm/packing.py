"""Filling fixed-capacity containers with whole items, by hierarchical residual packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.tokens import token_count, token_count_sql
from quern.session import cut_lineage, read_table

CAPACITY = 1024
#: Items that are packed together in memory.
BLOCK = 1 << 16
#: Partitions whose underfull bins are packed together in the next round.
FAN_IN = 8
#: Rounds at most, by the names that bins have; FAN_IN to that power exceeds any number of partitions.
MOST_ROUNDS = 31
#: A bin is nearly full, and leaves, if at most one in SLACK of its capacity is free.
SLACK = 100


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, fill of each bin.

    Each item goes into the bin with the least room that still takes it; bins are
    kept by their room, and a bit mask over the rooms finds the next one.
    """
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        room -= size
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    return bin_of, offset, np.array(fill, np.int64)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, block: int, slack: int, level: int) -> Iterator[pa.RecordBatch]:
    """Adds bin, offset, fill and closed to batches whose last column is the size."""
    held: list[pa.RecordBatch] = []
    # Names of bins: 5 bits of round, 22 of partition, 36 of number.
    count, first_bin = 0, level << 58 | TaskContext.get().partitionId() << 36

    def flush():
        nonlocal held, count, first_bin
        table = pa.Table.from_batches(held).combine_chunks()
        bin_of, offset, fill = best_fit(table.column(table.num_columns - 1).to_numpy(), capacity)
        given = {"bin": bin_of + first_bin, "offset": offset, "fill": fill[bin_of], "closed": capacity - fill[bin_of] <= slack, "head": offset == 0}
        # Items without size share their offset with the next one: one head per bin.
        if (offset == 0).sum() > len(fill):
            head = np.zeros(len(offset), bool)
            head[np.unique(bin_of, return_index=True)[1]] = True
            given["head"] = head
        for name, values in given.items():
            table = table.append_column(name, pa.array(values))
        first_bin += len(fill)
        held, count = [], 0
        return table.to_batches(max_chunksize=10_000)

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, block - count)
            batch = batch.slice(len(part))
            held.append(part)
            count += len(part)
            if count == block:
                yield from flush()
    if count:
        yield from flush()


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """id, part, start, size: each item whole, or cut into pieces of `capacity` if it is larger."""
    size = F.coalesce(F.col("size"), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(size / F.lit(capacity)) - 1, F.lit(0)).cast("int")
    cut = items.select("id", size.alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    start = F.col("part").cast("bigint") * capacity
    return cut.select("id", "part", start.alias("start"), F.least(F.col("whole") - start, F.lit(capacity)).cast("bigint").alias("size"))


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, fan_in: int = FAN_IN, slack: int | None = None) -> DataFrame:
    """id, part, start, size, bin, offset, fill: the container and place of every item.

    items: id BIGINT, size BIGINT (null counts as 0). An item larger than `capacity`
    is cut into pieces, which get a place each: the piece holds the item's units from
    `start`. No other item is cut. bin names the container, offset is the piece's place
    in it, fill what the container holds in all.

    Partitions pack their own items best-fit, `block` at a time, and keep nearly full
    bins. The others are items of the next round, in which bins of `fan_in` partitions
    meet; that ends when one group is left or a round no longer saves a bin in a
    hundred. A task never holds more than `block` items. Items of size 0 take no room
    but get a place. Repeated ids are items of their own; no items give no rows.
    """
    slack = capacity // SLACK if slack is None else slack
    cut = pieces(items, capacity)
    placed = "bin bigint, offset bigint, fill bigint, closed boolean, head boolean"
    base = cut_lineage(cut.mapInArrow(lambda b: _pack(b, capacity, block, slack, 0), f"id bigint, part int, start bigint, size bigint, {placed}"))
    groups, level = base.rdd.getNumPartitions(), 0
    open_bins = base.where(~F.col("closed") & F.col("head")).select(F.col("bin").alias("child"), F.col("fill").alias("size"))
    left = open_bins.count()
    moved = None
    while left > 1 and level < MOST_ROUNDS:
        level += 1
        groups = max(-(-groups // fan_in), -(-left // block))
        merge = lambda b, level=level: _pack(b, capacity, block, slack, level)
        merged = cut_lineage(open_bins.repartition(groups).mapInArrow(merge, f"child bigint, size bigint, {placed}"))
        step = merged.select("child", F.col("bin").alias("parent"), F.col("offset").alias("shift"), F.col("fill").alias("filled"))
        if moved is None:
            moved = step.withColumnRenamed("child", "bin")
        else:  # underfull bins only, so this join stays small against the items
            old = moved.select("bin", F.col("parent").alias("child"), F.col("shift").alias("before"), F.col("filled").alias("was"))
            moved = old.join(step, "child", "left").select("bin", F.coalesce("parent", "child").alias("parent"), (F.col("before") + F.coalesce("shift", F.lit(0))).alias("shift"), F.coalesce("filled", "was").alias("filled"))
        open_bins = merged.where(~F.col("closed") & F.col("head")).select(F.col("bin").alias("child"), F.col("fill").alias("size"))
        before, left = left, open_bins.count()
        if groups == 1 or merged.where("head").count() * 100 > before * 99:
            break
    columns = ["id", "part", "start", "size"]
    done = base.where("closed").select(*columns, "bin", "offset", "fill")
    rest = base.where(~F.col("closed"))
    if moved is None:
        return done.unionByName(rest.select(*columns, "bin", "offset", "fill"))
    rest = rest.join(moved, "bin").select(*columns, F.col("parent").alias("bin"), (F.col("offset") + F.col("shift")).alias("offset"), F.col("filled").alias("fill"))
    return done.unionByName(rest)


def document_places(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, part, start, size, bin, offset, fill; sizes in WordPunct tokens.

    A null text counts as empty."""
    sized = documents.select(F.col("doc_id").cast("bigint").alias("id"), token_count(F.coalesce("text", F.lit(""))).alias("size"))
    return pack(sized, capacity).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that came to lie in more than one container."""
    places = document_places(read_table(spark, sf_dir, "documents"))
    split = places.groupBy("doc_id").agg(F.min("bin").alias("least"), F.max("bin").alias("greatest"))
    return split.where(F.col("least") != F.col("greatest")).select("doc_id")


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_places(read_table(spark, sf_dir, "documents"))


def p6_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin, pieces, fill of every container."""
    return document_places(read_table(spark, sf_dir, "documents")).groupBy("bin").agg(F.count("*").alias("pieces"), F.sum("size").alias("fill"))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, part, start, size of every piece placed; fits: its container holds what its
    fill says and no more than the capacity; clear: it begins where the pieces before it end."""
    places = document_places(read_table(spark, sf_dir, "documents"))
    inside = Window.partitionBy("bin")
    before = F.sum("size").over(inside.orderBy("offset", "size", "doc_id", "part").rowsBetween(Window.unboundedPreceding, -1))
    fits = (F.sum("size").over(inside) == F.col("fill")) & (F.col("fill") <= CAPACITY)
    return places.select("doc_id", "part", "start", "size", fits.alias("fits"), (F.coalesce(before, F.lit(0)) == F.col("offset")).alias("clear"))


def p6_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the containers have at most a hundredth of their room to spare, but for one in a
    hundred and one more: items, tokens, and filled."""
    bins = p6_bins(spark, sf_dir)
    told = bins.agg(F.sum("pieces").alias("pieces"), F.sum("fill").alias("tokens"), F.count("*").alias("bins"))
    least = F.ceil(F.col("tokens") / F.lit(CAPACITY))
    return told.select("pieces", "tokens", (F.col("bins") <= least + F.ceil(least / F.lit(100)) + 1).alias("filled"))


_SQL = f"""WITH sized AS (SELECT doc_id, {token_count_sql("coalesce(text, '')")} AS size FROM documents),
pieces AS (SELECT doc_id, size, unnest(range(greatest((size + {CAPACITY - 1}) // {CAPACITY}, 1)))::INTEGER AS part FROM sized) """
QUERIES = {"p6_found": p6_found, "p6_places": p6_places, "p6_bins": p6_bins, "p6_kept": p6_kept, "p6_filled": p6_filled}
SQL = {
    "p6_found": f"SELECT doc_id FROM documents WHERE {token_count_sql('text')} > {CAPACITY}",
    "p6_kept": _SQL + f"SELECT doc_id, part, part::BIGINT * {CAPACITY} AS start, least(size - part::BIGINT * {CAPACITY}, {CAPACITY}) AS size, true AS fits, true AS clear FROM pieces",
    "p6_filled": _SQL + "SELECT count(*)::BIGINT AS pieces, (SELECT sum(size) FROM sized)::BIGINT AS tokens, true AS filled FROM pieces",
}
