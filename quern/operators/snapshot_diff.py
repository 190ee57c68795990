"""What changed between consecutive full snapshots of a table.

Snapshots are sorted by key together and cut into content-defined chunks: a chunk
begins at every key whose hash is a multiple of the wanted chunk size, so the cuts
of two snapshots agree however many keys were added or removed between them. Chunks
whose digests agree in both snapshots are discarded; only rows of the other chunks
are joined by key and classified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk on average: smaller chunks let more rows be discarded, larger ones need fewer digests.
CHUNK_ROWS = 4
#: Rows held back at most for a chunk that has not ended; then it is cut at the next key.
CHUNK_LIMIT = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unmatched(rows: dict[str, np.ndarray], versions: np.ndarray, chunk_rows: int) -> pa.RecordBatch | None:
    """The old and new rows of chunks whose digests differ from the snapshot before."""
    key, at = rows["key"], np.searchsorted(versions, rows["version"])
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    cut = new_key & (_mix(key) % np.uint64(chunk_rows) == 0)
    cut[0] = True
    chunk = np.cumsum(cut) - 1
    shape = (int(chunk[-1]) + 1, len(versions))
    cell = chunk * shape[1] + at
    order = np.argsort(cell, kind="stable")
    begin = np.flatnonzero(np.diff(cell[order], prepend=-1))
    digest = np.zeros((2, shape[0] * shape[1]), np.uint64)
    for i, name in enumerate(("d1", "d2")):
        each = _mix(_mix(key) + rows[name].astype(np.uint64) + np.uint64(i))
        digest[i, cell[order][begin]] = np.add.reduceat(each[order], begin)
    digest = digest.reshape(2, *shape)
    differs = (digest[:, :, 1:] != digest[:, :, :-1]).any(axis=0)
    pad = np.zeros((shape[0], 1), bool)
    as_new, as_old = np.hstack([pad, differs]), np.hstack([differs, pad])
    new, old = np.flatnonzero(as_new[chunk, at]), np.flatnonzero(as_old[chunk, at])
    if not len(new) and not len(old):
        return None
    take = np.concatenate([new, old])
    version = np.concatenate([versions[at[new]], versions[at[old] + 1]])
    is_new = np.arange(len(take)) < len(new)
    return pa.RecordBatch.from_arrays([pa.array(version), pa.array(key[take]), pa.array(is_new), *[pa.array(rows[c][take]) for c in ("d1", "d2", "carried")]], names=["version", "key", "is_new", "d1", "d2", "carried"])


def diff_snapshots(rows: DataFrame, version: str, key: str, content: Column, carried: str, versions: list[int], chunk_rows: int = CHUNK_ROWS, limit: int = CHUNK_LIMIT) -> DataFrame:
    """Added, removed and changed keys of each snapshot against the one before it.

    rows: one row per (version, key), both integers; content: a STRING that is equal
    exactly where rows count as unchanged; carried: an integer column that comes out
    with the change, of the newer row, of a removed one of the older. versions: the
    snapshots in order; each is held against the one before it in this list, also
    where that one has no rows.

    Result: version, key BIGINT, change STRING, carried BIGINT. Rows with a null
    version or key are left out, null content counts as a value of its own. One
    shuffle brings the rows into key order; then only rows of unmatched chunks move.
    Content is compared by 128 bits of hash under one key.
    """
    if len(versions) < 2:
        return rows.sparkSession.createDataFrame([], "version bigint, key bigint, change string, carried bigint")
    told = F.coalesce(F.concat(F.lit("="), content), F.lit(""))
    narrow = rows.where(F.col(version).isNotNull() & F.col(key).isNotNull()).select(
        F.col(version).cast("bigint").alias("version"), F.col(key).cast("bigint").alias("key"),
        F.xxhash64(told).alias("d1"), F.xxhash64(F.lit(7), told).alias("d2"), F.coalesce(F.col(carried).cast("bigint"), F.lit(-1)).alias("carried"),
    )
    known = np.array(sorted(versions), np.int64)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("version", "key", "d1", "d2", "carried")
        held = {n: np.zeros(0, np.int64) for n in names}

        def ready(upto: int):
            cut = {n: a[:upto] for n, a in held.items()}
            rest = {n: a[upto:] for n, a in held.items()}
            known_only = np.isin(cut["version"], known)
            cut = {n: a[known_only] for n, a in cut.items()}
            return (_unmatched(cut, known, chunk_rows) if len(cut["key"]) else None), rest

        for batch in batches:
            more = {n: batch.column(i).to_numpy() for i, n in enumerate(names)}
            held = {n: np.concatenate([held[n], more[n]]) for n in names}
            keys = held["key"]
            if not len(keys):
                continue
            fresh = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            cuts = fresh[_mix(keys[fresh]) % np.uint64(chunk_rows) == 0]
            if not len(cuts) and len(keys) > limit:
                cuts = fresh
            if len(cuts):
                out, held = ready(int(cuts[-1]))
                if out is not None:
                    yield out
        if len(held["key"]):
            out, _ = ready(len(held["key"]))
            if out is not None:
                yield out

    in_order = narrow.repartitionByRange("key").sortWithinPartitions("key", "version")
    unmatched = in_order.mapInArrow(convert, "version bigint, key bigint, is_new boolean, d1 bigint, d2 bigint, carried bigint")
    side = {s: [F.max(F.when(F.col("is_new") == (s == "new"), F.col(c))).alias(f"{s}_{c}") for c in ("d1", "d2", "carried")] for s in ("old", "new")}
    joined = unmatched.groupBy("version", "key").agg(*side["old"], *side["new"])
    change = F.when(F.col("old_d1").isNull(), "added").when(F.col("new_d1").isNull(), "removed").when((F.col("old_d1") != F.col("new_d1")) | (F.col("old_d2") != F.col("new_d2")), "changed")
    return joined.select("version", "key", change.alias("change"), F.coalesce("new_carried", "old_carried").alias("carried")).where(F.col("change").isNotNull())
