"""Deeply nested JSON texts as related flat tables with parent-child links."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from quern.operators import json_index as J

#: Bytes of text that are indexed at once; a longer text is indexed alone, whole.
SLICE_BYTES = 4 << 20

ANY_MEMBER, ANY_ELEMENT, UP, KEY, SELF = "*", "[*]", "^", "@key", "@value"


@dataclass(frozen=True)
class Rule:
    """Which values become rows of a flat table, and what the rows hold.

    table: its name. path: steps from the root to the values: a member name, `*`
    (any member) or `[*]` (any element). fields: column to steps from such a value:
    member names, `^` (to the enclosing value), last `@key` (its own member name) or
    `@value` (itself). kinds: kinds of values that count, default all but null.
    unless: (member, kind) of the enclosing object whose presence voids the row;
    without: member names that don't count under `*`; needs: members the value must have.
    """

    table: str
    path: tuple[str, ...]
    fields: dict[str, tuple[str, ...]]
    kinds: frozenset[int] = frozenset({J.OBJ, J.ARR, J.STR, J.NUM, J.BOOL})
    unless: tuple[tuple[str, int], ...] = ()
    without: frozenset[str] = field(default_factory=frozenset)
    needs: tuple[str, ...] = ()


def _names(rules: list[Rule]) -> list[str]:
    steps = {s for r in rules for p in (r.path, *r.fields.values()) for s in p}
    steps |= {name for r in rules for name, _ in r.unless} | {name for r in rules for name in (*r.without, *r.needs)}
    return sorted(steps - {ANY_MEMBER, ANY_ELEMENT, UP, KEY, SELF})


class _Matcher:
    """Finds the values that rules name in one structural index."""

    def __init__(self, index: J.Index, names: list[str]):
        self.ix = index
        self.code = {name: i + 1 for i, name in enumerate(names)}
        self.names = self._member_codes(names)
        order = np.argsort(index.level, kind="stable")
        cuts = np.searchsorted(index.level[order], np.arange((index.level.max() if len(order) else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]

    def _member_codes(self, names: list[str]) -> np.ndarray:
        ix, out = self.ix, np.zeros(len(self.ix.row), np.int32)
        length = ix.key_end - ix.key_start
        member = ix.key_start >= 0
        slash = np.concatenate(([0], np.cumsum(ix.data == 92)))
        escaped = member & (slash[np.where(member, ix.key_end, 0)] > slash[np.where(member, ix.key_start, 0)])
        for name in names:
            raw = name.encode()
            at = np.flatnonzero(member & (length == len(raw)))
            for k, c in enumerate(raw):
                at = at[ix.data[ix.key_start[at] + k] == c]
            out[at] = self.code[name]
        at = np.flatnonzero(escaped)
        if len(at):
            told = J.strings(ix, ix.key_start[at], ix.key_end[at]).to_pylist()
            out[at] = [self.code.get(k, 0) for k in told]
        return out

    def children(self, of: np.ndarray, level: int, step: str) -> np.ndarray:
        """Values one level below those flagged in `of`."""
        ix = self.ix
        if level >= len(self.levels):
            return np.zeros(0, np.int64)
        here = self.levels[level]
        here = here[of[ix.parent[here]]]
        if step == ANY_ELEMENT:
            return here[ix.kind[ix.parent[here]] == J.ARR]
        if step == ANY_MEMBER:
            return here[ix.key_start[here] >= 0]
        here = here[self.names[here] == self.code[step]]
        last = np.ones(len(here), bool)  # of repeated members the last counts
        last[:-1] = ix.parent[here][1:] != ix.parent[here][:-1]
        return here[last]

    def rows(self, rule: Rule) -> np.ndarray:
        ix = self.ix
        found = self.levels[0] if self.levels else np.zeros(0, np.int64)
        flags = np.zeros(len(ix.row), bool)
        for depth, step in enumerate(rule.path, 1):
            flags[:] = False
            flags[found] = True
            found = self.children(flags, depth, step)
        found = found[np.isin(ix.kind[found], list(rule.kinds))]
        for name in rule.without:
            found = found[self.names[found] != self.code[name]]
        for name in rule.needs:
            has = np.zeros(len(ix.row) + 1, bool)
            has[ix.parent[self.names == self.code[name]]] = True
            found = found[has[found]]
        if rule.unless and len(found):
            for name, kind in rule.unless:
                void = np.zeros(len(ix.row) + 1, bool)
                at = np.flatnonzero((self.names == self.code[name]) & (ix.kind == kind))
                void[ix.parent[at]] = True
                void[-1] = False
                found = found[~void[ix.parent[found]]]
        return found

    def field(self, rows: np.ndarray, steps: tuple[str, ...]) -> pa.Array:
        """The field's text for each row: of a string its text, of other values
        their JSON text; null where missing or null."""
        ix = self.ix
        at = rows.copy()
        for step in steps:
            if step == UP:
                at = np.where(at >= 0, ix.parent[at], -1)
            elif step == KEY:
                return J.strings(ix, np.where(at >= 0, ix.key_start[at], -1), np.where(at >= 0, ix.key_end[at], -1))
            elif step != SELF:
                child = np.full(len(ix.row) + 1, -1, np.int64)
                owners = np.zeros(len(ix.row) + 1, bool)
                owners[at] = True
                owners[-1] = False
                named = np.flatnonzero(self.names == self.code[step])
                named = named[owners[ix.parent[named]]]
                child[ix.parent[named]] = named  # of repeated members the last counts
                child[-1] = -1
                at = child[at]
        there = (at >= 0) & (ix.kind[at] != J.NULL) if len(ix.row) else at >= 0
        start, end = np.where(there, ix.start[at], -1), np.where(there, ix.end[at], -1)
        return J.strings(ix, start, end, (ix.kind[at] == J.STR) & there)


def flatten_texts(texts: pa.Array, rules: list[Rule]) -> tuple[np.ndarray, list[tuple[Rule, np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]], np.ndarray]:
    """Whether each text is valid JSON, and for each rule the rows found in them:
    (rule, number of the text, number of the value, number of the nearest enclosing
    value that is a row too or -1, fields). A text that is a string holding JSON counts as the JSON held."""
    names, out = _names(rules), []
    data, offsets = J.text_buffers(texts)
    origin = np.arange(len(offsets) - 1)
    valid = np.ones(len(origin), bool)
    while True:
        index = J.build(data, offsets)
        valid[origin[~index.valid]] = False
        held = np.flatnonzero((index.level == 0) & (index.kind == J.STR))
        match = _Matcher(index, names)
        first = np.full(len(offsets), 0, np.int64)
        roots = np.flatnonzero(index.level == 0)
        first[index.row[roots]] = roots
        found, is_row = [], np.zeros(len(index.row), bool)
        for rule in rules:
            rows = match.rows(rule)
            if len(held):
                rows = rows[~((index.level[rows] == 0) & (index.kind[rows] == J.STR))]
            found.append(rows)
            is_row[rows] = True
        for rule, rows in zip(rules, found):
            if len(rows):
                base, up = first[index.row[rows]], index.parent[rows]
                while (climb := (up >= 0) & ~is_row[up]).any():
                    up = np.where(climb, index.parent[up], up)
                up = np.where(up >= 0, up - base, -1)
                out.append((rule, origin[index.row[rows]], rows - base, up, [match.field(rows, s) for s in rule.fields.values()]))
        if not len(held):
            return valid, out
        inner = J.strings(index, index.start[held], index.end[held])
        origin = origin[index.row[held]]
        data, offsets = J.text_buffers(inner)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Cuts of whole rows of about SLICE_BYTES of text each."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")
        stop = max(int(upto), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def flatten_json(df: DataFrame, record_id: str, text: str, rules: list[Rule], record: list[str] | None = None) -> DataFrame:
    """Rows of all flat tables that `rules` find in the JSON column `text`.

    Result: record_id BIGINT (of the row the text stands in), with `record` also record
    STRUCT (the named columns of that row, for a key of several columns), child STRING
    (the table), node BIGINT (the number of the value within the record), parent_node
    BIGINT (the node of the row that encloses it most closely, -1 if none does), and all
    fields of all rules as STRING columns, null where a rule has no such field. Narrow:
    no shuffle.

    Null, empty and invalid texts give no rows; a null record_id is kept as null.
    Other columns of `df`, whatever their names, don't matter. Fields hold strings
    as their text and other values as JSON text; JSON null and missing are null.
    Of repeated members the last counts, but under `*` all come out.
    """
    columns = list(dict.fromkeys(c for r in rules for c in r.fields))
    carried = [F.struct(*record).alias("record")] if record else []

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                for rule, rows, node, up, fields in flatten_texts(batch.column(1), rules)[1]:
                    given, at = dict(zip(rule.fields, fields)), pa.array(rows)
                    of_record = {n: batch.column(n).take(at) for n in ("record_id", *(["record"] if record else []))}
                    values = {**of_record, "child": pa.repeat(pa.scalar(rule.table), len(rows)), "node": pa.array(node), "parent_node": pa.array(up)}
                    values |= {c: given[c] if c in given else pa.nulls(len(rows), pa.string()) for c in columns}
                    # Spark reads plain strings: large ones are cast on the way out.
                    yield pa.RecordBatch.from_arrays([v.cast(pa.string()) if pa.types.is_large_string(v.type) else v for v in values.values()], names=list(values))

    narrow = df.where(F.col(text).isNotNull()).select(F.col(record_id).cast("bigint").alias("record_id"), F.col(text).cast("string").alias("text"), *carried)
    schema = StructType(narrow.select("record_id", *(["record"] if record else [])).schema.fields)
    for name, kind in [("child", StringType()), ("node", LongType()), ("parent_node", LongType()), *[(c, StringType()) for c in columns]]:
        schema = schema.add(name, kind)
    return narrow.mapInArrow(convert, schema)


def parse(text: str):
    """The plain meaning of a text, for comparisons: (valid, value)."""
    try:
        value = json.loads(text, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
    except ValueError:
        return False, None
    return parse(value) if isinstance(value, str) else (True, value)
