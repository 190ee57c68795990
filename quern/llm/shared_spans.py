"""Long spans that stand verbatim in more than one record, found exactly.

Every window of `length` characters has an anchor: the q-gram in it with the least
hash. Equal windows have equal anchors, so a window occurs at most as often as its
anchor. A first pass counts anchors in one sketch per partition; the merged sketch
overestimates how often a window occurs. A second pass takes only the windows whose
anchor is estimated repeated, and groups them exactly. Neighbouring windows with the
same anchor travel together as one stretch of text (a run), so that text is moved
about four times, not `length` times.

The width of the sketch follows the input. Up to BROADCAST_BITS the merged sketch is a
bit map that every task gets; beyond, it stays a table of blocks, anchors are looked up
in it by joins, and the texts get the anchors found by one more join. Both ways let the
same windows through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.session import cut_lineage, read_table

LENGTH = 200
#: Characters of an anchor.
GRAM = 64
#: Characters that are hashed at once; windows that cross a cut are made on both sides of it.
CHUNK = 1 << 20
#: Slots of the sketch per expected anchor, its least width in bits, and the width up to which it is broadcast (64 MB).
SLOTS_PER_ANCHOR, LEAST_BITS, BROADCAST_BITS = 8, 16, 28
#: Characters of text expected per byte of a stored table; more let the sketch be wider than needed.
CHARS_PER_BYTE = 2
#: Slots that are merged as one block.
BLOCK_BITS = 16
#: Anchors of a partition after which its sketch is passed on.
SKETCH_FLUSH = 1 << 22
#: Repeated runs that a task holds to pass equal ones on once.
RUNS_HELD = 100_000
#: Different runs of one anchor that are compared in one task; beyond, their windows are grouped across the cluster.
RUNS_PER_ANCHOR = 8192
#: Anchors that make up one in ANCHOR_SHARE of a part are told with it: those that are one in HOT_SHARE of all are among them.
ANCHOR_SHARE = 4096
#: A run is hot if it makes up at least one in HOT_SHARE of all occurrences, so at most
#: that many are, and has HOT_LEAST of them; its occurrences are split into HOT_PARTS.
HOT_SHARE, HOT_LEAST, HOT_PARTS = 1024, 10_000, 64

_POSITION = np.uint64(22)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the odd bases and of their inverses modulo 2^64, as far as needed."""

    def __init__(self):
        self.size = 0

    def upto(self, n: int):
        if n > self.size:
            self.size = max(n, CHUNK + LENGTH)
            self.up, self.down = [], []
            for base in _BASES:
                for store, b in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                    steps = np.full(self.size, b, np.uint64)
                    steps[0] = 1
                    store.append(np.multiply.accumulate(steps))
        return self


_powers = _Powers()


def _letters(points: np.ndarray, which: int) -> np.ndarray:
    """A pseudo-random 64-bit number for each character."""
    low = points.max(initial=0) + 1
    if low <= 1 << 16:
        return _mix(np.arange(low, dtype=np.uint64) + np.uint64(_BASES[which]))[points]
    return _mix(points.astype(np.uint64) + np.uint64(_BASES[which]))


class _Hashes:
    """Hashes of all substrings of one text: those of equal substrings are equal."""

    def __init__(self, points: np.ndarray, which: int):
        n = len(points)
        _powers.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters(points, which) * _powers.up[which][:n], out=self.sums[1:])
        self.down = _powers.down[which]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


@dataclass
class _Runs:
    """Runs of windows with one anchor in a chunk of texts laid end to end."""

    text: str
    points: np.ndarray
    first: _Hashes
    doc: np.ndarray  # id of the document
    offset: np.ndarray  # of the first window in its document
    start: np.ndarray  # of the first window in the chunk
    count: np.ndarray  # of windows
    anchor_at: np.ndarray  # in the chunk
    anchor: np.ndarray  # its hash, as a signed number


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Texts, ids and offsets, about CHUNK characters together. A longer text is cut
    into pieces that overlap by a window less one character."""
    texts, ids, offsets, size = [], [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at in range(0, max(len(text) - length + 1, 0), CHUNK):
                piece = text[at : at + CHUNK + length - 1]
                if size and size + len(piece) > CHUNK:
                    yield texts, ids, offsets
                    texts, ids, offsets, size = [], [], [], 0
                texts.append(piece)
                ids.append(doc)
                offsets.append(at)
                size += len(piece)
    if texts:
        yield texts, ids, offsets


def _runs(texts: list[str], ids: list[int], offsets: list[int], length: int, gram: int) -> _Runs:
    text = "".join(texts)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = _Hashes(points, 0)
    grams = hashes.all(gram)
    order = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    # The least hash, then the least position, of the grams of each window.
    packed = (order >> _POSITION << _POSITION) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(packed, length - gram + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    inside = np.ones(len(at), bool)
    for end in ends[:-1].tolist():  # windows that reach into the next text
        inside[max(end - length + 1, 0) : end] = False
    fresh = np.zeros(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    fresh[0] = True
    start = np.flatnonzero(fresh & inside)
    stop = np.append(np.flatnonzero(fresh | ~inside), len(at))
    count = stop[np.searchsorted(stop, start, side="right")] - start
    piece = np.searchsorted(ends, start, side="right")
    anchor = _mix(grams[at[start]] + np.uint64(_BASES[1])).view(np.int64)
    return _Runs(text, points, hashes, np.array(ids, np.int64)[piece], start - begins[piece] + np.array(offsets, np.int64)[piece], start, count, at[start], anchor)


def _slots(anchor: np.ndarray, bits: int) -> np.ndarray:
    """The slots of each anchor in the two rows of the sketch, as numbers over both."""
    key = anchor.view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    turned = (key >> np.uint64(32)) | (key << np.uint64(32))
    return np.stack([key & mask, (turned & mask) + np.uint64(1 << bits)]).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], length: int, gram: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The partition's sketch, as the touched slots of each block, with the number of
    touches; a slot that was touched more than once is there twice, since 2 is as much as
    matters. Rows without a block tell frequent anchors, and one the number of all."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        anchors = np.concatenate(held)
        both = _slots(anchors, bits)
        slots, n = np.unique(both, return_counts=True)
        place = np.repeat(slots, np.minimum(n, 2))
        block, first = np.unique(place >> BLOCK_BITS, return_index=True)
        touches = np.add.reduceat(n, np.searchsorted(slots, block << BLOCK_BITS)) if len(block) else n
        low = (place & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        parts = [p.tobytes() for p in np.split(low, first[1:])]
        # A frequent anchor has a frequent slot, so hardly any are left to be counted.
        busy = slots[n * ANCHOR_SHARE >= len(anchors)]
        anchor, times = np.unique(anchors[np.isin(both[0], busy)], return_counts=True)
        often = times * ANCHOR_SHARE >= len(anchors)
        anchor, times = anchor[often], times[often]
        none = len(anchor) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([*block.tolist(), *[None] * none], pa.int64()), pa.array([*parts, *[None] * none], pa.binary()), pa.array([*[None] * len(block), *anchor.tolist(), None], pa.int64()), pa.array(np.concatenate((touches, times, [len(anchors)])))],
            names=["block", "slots", "anchor", "n"],
        )

    held, count = [], 0
    for chunk in _chunks(batches, length):
        held.append(_runs(*chunk, length, gram).anchor)
        count += len(held[-1])
        if count >= SKETCH_FLUSH:
            yield flush(held)
            held, count = [], 0
    if count:
        yield flush(held)


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of the merged sketch: a bit for each slot that was touched twice."""
    total = np.zeros(1 << BLOCK_BITS, np.uint8)
    for part in frame["slots"]:
        slots = np.frombuffer(part, np.uint16)
        total = np.minimum(total + np.minimum(np.bincount(slots, minlength=1 << BLOCK_BITS), 2).astype(np.uint8), 2)
    return pd.DataFrame({"block": frame["block"].iloc[:1], "n": [int(frame["n"].sum())], "twice": [np.packbits(total >= 2, bitorder="little").tobytes()]})


def _width(texts: DataFrame, length: int, gram: int) -> int:
    """The width in bits for texts of this volume: that of the files where they are read
    from files, else the number of characters, counted."""
    leaves = texts._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    chars = sum(sizes) * CHARS_PER_BYTE
    if any(size >= 1 << 60 for size in sizes):  # Spark's way to say that it doesn't know
        chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    anchors = chars * 2 // (length - gram + 2) + 1
    return min(62, max(LEAST_BITS, (anchors * SLOTS_PER_ANCHOR // 2).bit_length()))


@dataclass
class _Sketch:
    """The merged sketch: a table of blocks (block, n, twice), its width, and the hot anchors."""

    blocks: DataFrame
    bits: int
    hot: list[int]
    anchors: int

    def bit_map(self) -> np.ndarray:
        """All of it, as bits over both rows; for a width of BROADCAST_BITS at most."""
        block_bytes = 1 << (BLOCK_BITS - 3)
        twice = np.zeros((2 << self.bits) // 8, np.uint8)
        for block, bytes_ in self.blocks.select("block", "twice").toLocalIterator():  # blocks of a fixed number and size
            twice[block * block_bytes : (block + 1) * block_bytes] = np.frombuffer(bytes_, np.uint8)
        return twice


def sketch(texts: DataFrame, length: int, gram: int, bits: int | None = None) -> _Sketch:
    """One pass over the texts. A fuller sketch lets more windows through and loses none."""
    bits = _width(texts, length, gram) if bits is None else bits
    parts = cut_lineage(texts.mapInArrow(lambda b: _sketch(b, length, gram, bits), "block bigint, slots binary, anchor bigint, n bigint"))
    told = parts.where("block IS NULL").groupBy("anchor").agg(F.sum("n").alias("n"))
    total = told.where("anchor IS NULL").agg(F.sum("n")).first()[0] or 0
    # What the parts don't tell of an anchor is at most one in ANCHOR_SHARE of all.
    often = told.where(F.col("anchor").isNotNull() & ((F.col("n") + total / ANCHOR_SHARE) * HOT_SHARE >= total)).collect()  # fewer than 2 * HOT_SHARE
    merged = parts.where("block IS NOT NULL").groupBy("block").applyInPandas(_merge, "block bigint, n bigint, twice binary")
    return _Sketch(merged, bits, [r.anchor for r in often if r.n > 1], total)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The anchors of each row (its key stands in the third column), each once, with their slots."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            found = [_runs(*chunk, length, gram).anchor for chunk in _chunks(iter([one]), length)]
            if found:
                anchor = np.unique(np.concatenate(found))
                slot1, slot2 = _slots(anchor, bits)
                key = np.full(len(anchor), one.column(2)[0].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, anchor, slot1, slot2)], names=["row", "anchor", "slot1", "slot2"])


def _marked(texts: DataFrame, found: _Sketch, length: int, gram: int) -> DataFrame:
    """doc_id, text, anchors: the texts that have anchors estimated repeated, with these.

    The way for a sketch too wide to broadcast: anchors meet the blocks of the sketch by
    two joins; those of a hot block are dealt to HOT_PARTS tasks, and the block goes to
    each. Then each text meets its own anchors; rows with equal doc_id and text are one.
    """
    bits = found.bits
    keyed = texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    rows = keyed.mapInArrow(lambda b: _anchors(b, length, gram, bits), "row bigint, anchor bigint, slot1 bigint, slot2 bigint").distinct()
    blocks = cut_lineage(found.blocks)
    hot = F.broadcast(blocks.where(F.col("n") * HOT_SHARE >= found.anchors).select("block", F.lit(HOT_PARTS).alias("parts")))  # at most 2 * HOT_SHARE rows
    spread = blocks.join(hot, "block", "left").select("block", "twice", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    for slot in ("slot1", "slot2"):
        asked = rows.withColumn("block", F.shiftright(slot, BLOCK_BITS)).join(hot, "block", "left")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        bit = F.expr(f"shiftright(cast(conv(hex(substring(twice, cast(({slot} & {(1 << BLOCK_BITS) - 1}) div 8 as int) + 1, 1)), 16, 10) as int), cast({slot} & 7 as int)) & 1")
        rows = asked.join(spread, ["block", "part"]).where(bit == 1).select("row", "anchor", "slot1", "slot2")
    held = rows.groupBy("row").agg(F.collect_list("anchor").alias("anchors"))  # no more than a text has
    return keyed.dropDuplicates(["row"]).join(held, "row").select("doc_id", "text", "anchors")


def _estimated(anchor: np.ndarray, twice: np.ndarray, bits: int) -> np.ndarray:
    one, two = _slots(anchor, bits)
    bit = lambda s: twice[s >> 3] >> (s & 7).astype(np.uint8) & 1
    return np.flatnonzero(bit(one) & bit(two))


def _contents(runs: _Runs, pick: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a run: its text and where in it the windows and the anchor are."""
    start, end = runs.start[pick], runs.start[pick] + runs.count[pick] + length - 1
    place = _mix((runs.count[pick] * 4096 + (runs.anchor_at[pick] - start)).astype(np.uint64))
    second = _Hashes(runs.points, 1)
    return tuple(_mix(h.of(start, end) + place).view(np.int64) for h in (runs.first, second))


def _repeated_runs(batches, length, gram, shared) -> Iterator[tuple[_Runs, np.ndarray, np.ndarray, np.ndarray]]:
    """shared: the broadcast bit map and its width, or None where rows bring their anchors."""

    def chunks():
        if shared is not None:
            twice, bits = shared.value
            for chunk in _chunks(batches, length):
                runs = _runs(*chunk, length, gram)
                yield runs, _estimated(runs.anchor, twice, bits)
            return
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                known = one.column(2).flatten().to_numpy()
                for chunk in _chunks(iter([one]), length):
                    runs = _runs(*chunk, length, gram)
                    yield runs, np.flatnonzero(np.isin(runs.anchor, known))

    for runs, pick in chunks():
        if len(pick):
            yield runs, pick, *_contents(runs, pick, length)


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, and where in it each group of equal keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new)


def _summed(order: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, greatest and sum within each group."""
    return np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(times[order], first)


_RUN_COLUMNS = ("anchor", "c1", "c2", "windows", "low", "high", "times")


def _distinct_runs(batches, length, gram, shared) -> Iterator[pa.RecordBatch]:
    """Repeated runs of a partition, equal ones once, with the least and greatest id of
    their documents and their number."""

    def flush(held: list[list[np.ndarray]], texts: list[str]) -> pa.RecordBatch:
        anchor, c1, c2, windows, low, high, times = (np.concatenate(x) for x in zip(*held))
        order, first = _first_of_each(c1, c2)
        keep = order[first]
        summed = _summed(order, first, low, high, times)
        return pa.RecordBatch.from_arrays([*[pa.array(x[keep]) for x in (anchor, c1, c2, windows)], *map(pa.array, summed), pa.array([texts[i] for i in keep.tolist()], pa.string())], names=[*_RUN_COLUMNS, "text"])

    held, texts = [], []
    for runs, pick, c1, c2 in _repeated_runs(batches, length, gram, shared):
        doc = runs.doc[pick]
        order, first = _first_of_each(c1, c2)
        keep = order[first]
        held.append([runs.anchor[pick][keep], c1[keep], c2[keep], runs.count[pick][keep], *_summed(order, first, doc, doc, np.ones(len(doc), np.int64))])
        begin = runs.start[pick][keep]
        end = begin + runs.count[pick][keep] + length - 1
        texts += [runs.text[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        if len(texts) >= RUNS_HELD:
            yield flush(held, texts)
            held, texts = [], []
    if texts:
        yield flush(held, texts)


def _places(batches, length, gram, shared) -> Iterator[pa.RecordBatch]:
    """Where the repeated runs of a partition stand."""
    for runs, pick, c1, c2 in _repeated_runs(batches, length, gram, shared):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c1, c2, runs.doc[pick], runs.offset[pick])], names=["c1", "c2", "doc_id", "offset"])


def _window_hashes(texts: pa.Array, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of all runs: the run, the number in it, and two hashes."""
    joined = "".join(texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    run = np.repeat(np.arange(len(windows)), windows)
    number = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.cumsum(windows + length - 1) - (windows + length - 1)
    start = begin[run] + number
    return run, number, *[_Hashes(points, k).of(start, start + length).view(np.int64) for k in (0, 1)]


_RESOLVED = "c1 bigint, c2 bigint, begin bigint, stop bigint, times bigint, w1 bigint, w2 bigint, low bigint, high bigint"


def _resolve(batches: Iterator[pa.RecordBatch], length: int, most: int, frequent: list[int]) -> Iterator[pa.RecordBatch]:
    """For runs in order of their anchor: which windows of which run stand in another
    document (begin, stop; w1 null), or, for a frequent anchor, whose runs are in several
    tasks, and one with more than `most` runs, the windows themselves, which are still to
    be grouped (w1, w2)."""
    names = [*_RUN_COLUMNS, "text"]

    def out(c1, c2, begin, stop, times, windows=None) -> pa.RecordBatch:
        n = len(c1)
        rest = [pa.array(x) for x in windows] if windows else [pa.nulls(n, pa.int64())] * 4
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c1, c2, begin, stop, times)] + rest, names=["c1", "c2", "begin", "stop", "times", "w1", "w2", "low", "high"])

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, c1, c2, windows, low, high, times = (table.column(n).to_numpy() for n in _RUN_COLUMNS)
        order, first = _first_of_each(anchor, c1, c2)
        keep = order[first]
        low, high, times = _summed(order, first, low, high, times)
        anchor, c1, c2, windows = anchor[keep], c1[keep], c2[keep], windows[keep]
        whole = low != high
        if whole.any():
            yield out(c1[whole], c2[whole], np.zeros(whole.sum(), np.int64), windows[whole], times[whole])
        # Runs that stand in one document alone may share windows with other runs of their anchor.
        group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
        size = np.bincount(group)
        alone = np.bincount(group, weights=~whole) > 0
        open_ = np.flatnonzero((size > 1)[group] & alone[group])
        if not len(open_):
            return
        texts = table.column("text").combine_chunks().take(pa.array(keep[open_]))
        for a, b in _cuts(group[open_], 20_000):
            sub = open_[a:b]
            run, number, h1, h2 = _window_hashes(texts.slice(a, b - a), windows[sub], length)
            order, first = _first_of_each(h1, h2)
            least, most_ = np.minimum.reduceat(low[sub][run][order], first), np.maximum.reduceat(high[sub][run][order], first)
            shared = np.zeros(len(run), bool)
            shared[order] = np.repeat(least != most_, np.diff(np.r_[first, len(order)]))
            shared &= ~whole[sub][run]
            begin = np.flatnonzero(shared & ~np.r_[False, shared[:-1] & (run[1:] == run[:-1])])
            stop = np.flatnonzero(shared & ~np.r_[shared[1:] & (run[1:] == run[:-1]), False])
            if len(begin):
                yield out(c1[sub][run[begin]], c2[sub][run[begin]], number[begin], number[stop] + 1, times[sub][run[begin]])

    def spread(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, c1, c2, windows, low, high, times = (table.column(n).to_numpy() for n in _RUN_COLUMNS)
        run, number, h1, h2 = _window_hashes(table.column("text"), windows, length)
        yield out(c1[run], c2[run], number, number + 1, times[run], (h1, h2, low[run], high[run]))

    held, hot = None, None
    for batch in batches:
        table = pa.Table.from_batches([batch.select(names)])
        if frequent:
            known = np.isin(table.column("anchor").to_numpy(), frequent)
            if known.any():
                yield from spread(table.filter(pa.array(known)))
                table = table.filter(pa.array(~known))
                if not table.num_rows:
                    continue
        if hot is not None:
            anchors = table.column("anchor").to_numpy()
            same = int(np.searchsorted(anchors != hot, True)) if (anchors != hot).any() else len(anchors)
            if same:
                yield from spread(table.slice(0, same))
            table = table.slice(same)
            if not table.num_rows:
                continue
            hot = None
        held = pa.concat_tables([held, table]) if held is not None else table
        anchors = held.column("anchor").to_numpy()
        last = int(np.searchsorted(anchors, anchors[-1]))
        if last:
            yield from settle(held.slice(0, last))
            held = held.slice(last)
        if held.num_rows > most:
            hot = held.column("anchor")[0].as_py()
            yield from spread(held)
            held = None
    if held is not None and held.num_rows:
        yield from settle(held)


def _cuts(group: np.ndarray, about: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about `about` rows that keep groups whole."""
    at = 0
    while at < len(group):
        end = min(at + about, len(group))
        end = int(np.searchsorted(group, group[end - 1], side="right"))
        yield at, end
        at = end


def shared_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int | None = None, most: int = RUNS_PER_ANCHOR, hot_least: int = HOT_LEAST, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """doc_id, span_start, span_end: the maximal stretches of characters that lie in some
    window of `length` characters which also stands in a document with another doc_id.
    Positions count code points from 0; span_end is the first character after the span.

    documents: doc_id BIGINT, text STRING; other columns don't matter. Null texts and
    those shorter than `length` share nothing; a null doc_id names no document, its rows
    are left out; rows that repeat a doc_id are one document, and their spans are united.

    Texts are read whole, three times: for the sketch, the runs and the places of the
    runs; what is shuffled are the slots of the sketch, each different repeated run once
    per task, and two hashes and a place for each occurrence. A sketch wider than
    `broadcast_bits` costs one more reading and a shuffle of anchors and of texts that
    have repeated ones. Windows are held equal by 128 bits of hash.
    """
    gram = min(gram, length)
    texts = documents.where(F.col("doc_id").isNotNull() & (F.char_length("text") >= length)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark, found = documents.sparkSession, sketch(texts, length, gram, bits)
    if found.bits <= broadcast_bits:
        shared = spark.sparkContext.broadcast((found.bit_map(), found.bits))
    else:
        shared, texts = None, cut_lineage(_marked(texts, found, length, gram))
    runs = texts.mapInArrow(lambda b: _distinct_runs(b, length, gram, shared), "anchor bigint, c1 bigint, c2 bigint, windows bigint, low bigint, high bigint, times bigint, text string")
    frequent = found.hot
    # The runs of a frequent anchor go to several tasks.
    salt = F.when(F.col("anchor").isin(frequent), F.pmod("c1", F.lit(HOT_PARTS))).otherwise(0) if frequent else F.lit(0)
    in_order = runs.withColumn("salt", salt).repartition("anchor", "salt").sortWithinPartitions("anchor")
    resolved = cut_lineage(in_order.mapInArrow(lambda b: _resolve(b, length, most, frequent), _RESOLVED))
    columns = ["c1", "c2", "begin", "stop", "times"]
    ready = resolved.where(F.col("w1").isNull()).select(*columns)
    loose = resolved.where(F.col("w1").isNotNull())
    again = loose.groupBy("w1", "w2").agg(F.min("low").alias("least"), F.max("high").alias("greatest")).where(F.col("least") != F.col("greatest"))
    ready = ready.unionByName(loose.join(again, ["w1", "w2"]).select(*columns).distinct())
    places = texts.mapInArrow(lambda b: _places(b, length, gram, shared), "c1 bigint, c2 bigint, doc_id bigint, offset bigint")
    # The occurrences of a hot run are dealt to several tasks, and the run goes to each.
    total = resolved.agg(F.sum("times")).first()[0] or 0
    hot = resolved.where((F.col("times") >= hot_least) & (F.col("times") * HOT_SHARE >= total)).select("c1", "c2").distinct().withColumn("parts", F.lit(HOT_PARTS))
    hot = F.broadcast(hot)  # at most HOT_SHARE rows
    parts = F.coalesce("parts", F.lit(1))
    places = places.join(hot, ["c1", "c2"], "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "offset"), parts).cast("int")).drop("parts")
    ready = ready.join(hot, ["c1", "c2"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    spans = places.join(ready, ["c1", "c2", "part"]).select("doc_id", (F.col("offset") + F.col("begin")).alias("s"), (F.col("offset") + F.col("stop") + (length - 1)).alias("e"))
    return united(spans)


def united(spans: DataFrame) -> DataFrame:
    """doc_id, span_start, span_end: spans (doc_id, s, e) of a document that overlap or touch, as one."""
    by = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    numbered = marked.withColumn("stretch", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "stretch").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).select("doc_id", "span_start", "span_end")


def shared_amounts(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_chars, spans, shared_chars: for every document how much of it is shared."""
    spans = shared_spans(documents, length).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = documents.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    zero = F.lit(0).cast("bigint")
    return sizes.join(spans, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("spans", zero).alias("spans"), F.coalesce("shared_chars", zero).alias("shared_chars"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(read_table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_amounts(read_table(spark, sf_dir, "documents"))


_SQL = f"""WITH windows AS (
  SELECT doc_id, p, md5(substring(text, p + 1, {LENGTH})) AS w
  FROM (SELECT doc_id, text, unnest(range(length(text) - {LENGTH} + 1)) AS p FROM documents WHERE length(text) >= {LENGTH})
), again AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) <> max(doc_id)
), hits AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM windows WHERE w IN (SELECT w FROM again)
), stretches AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hits
), spans AS (SELECT doc_id, min(p)::BIGINT AS span_start, (max(p) + {LENGTH})::BIGINT AS span_end FROM stretches GROUP BY doc_id, k) """

QUERIES = {"p8_found": p8_found, "p8_shared": p8_shared}
SQL = {
    "p8_found": _SQL + "SELECT * FROM spans",
    "p8_shared": _SQL + """SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS spans, coalesce(c, 0)::BIGINT AS shared_chars
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(span_end - span_start) AS c FROM spans GROUP BY doc_id) s ON s.doc_id = d.doc_id""",
}
