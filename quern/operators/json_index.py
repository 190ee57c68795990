"""A vectorised structural index of JSON texts.

Many texts are indexed at once, as one byte array: bitmaps of quotes, brackets and
delimiters come from a lookup table, the inside of strings from a running sum over
the quotes, nesting depth from a running sum over the brackets; the rest works on
the (far fewer) structural positions. The index also proves each text valid or not
by RFC 8259: grammar, bracket kinds, numbers, literals, escapes, control characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import json

import numpy as np
import pyarrow as pa

OBJ, ARR, STR, NUM, BOOL, NULL = range(6)

# Classes of bytes outside strings.
_OTHER, _LBRACE, _RBRACE, _LBRACKET, _RBRACKET, _COLON, _COMMA, _SKIP, _STRING = range(9)
_START = 0  # as the previous token: none
_CLASS = np.full(256, _OTHER, np.uint8)
for _c, _k in zip(b"{}[]:, \t\n\r\"", (1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7)):
    _CLASS[_c] = _k

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True

# The numbers of JSON as an automaton over classes of bytes; 0 is the dead state.
_NUM_CLASS = np.zeros(256, np.uint8)
for _c, _k in ((b"0", 1), (b"123456789", 2), (b"-", 3), (b"+", 4), (b".", 5), (b"eE", 6)):
    _NUM_CLASS[list(_c)] = _k
_NUM_STEP = np.zeros((10, 7), np.uint8)
_NUM_STEP[1, [1, 2, 3]] = 3, 4, 2  # start
_NUM_STEP[2, [1, 2]] = 3, 4  # after the minus
_NUM_STEP[3, [5, 6]] = 5, 7  # a leading zero
_NUM_STEP[4, [1, 2, 5, 6]] = 4, 4, 5, 7  # whole part
_NUM_STEP[5, [1, 2]] = 6, 6  # after the point
_NUM_STEP[6, [1, 2, 6]] = 6, 6, 7  # fraction
_NUM_STEP[7, [1, 2, 3, 4]] = 9, 9, 8, 8  # after the e
_NUM_STEP[8, [1, 2]] = 9, 9  # after its sign
_NUM_STEP[9, [1, 2]] = 9, 9  # exponent
_NUM_END = np.array([0, 0, 0, 1, 1, 0, 1, 0, 0, 1], bool)


@dataclass
class Index:
    """The values of all valid texts, in order of position.

    row: the text it stands in; parent: index of the enclosing value or -1; kind;
    start, end: its bytes (of a string without the quotes); key_start, key_end: the
    bytes of its member name, -1 where it is no member; level: how many values
    enclose it. valid: of each text.
    """

    data: np.ndarray
    valid: np.ndarray
    row: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    level: np.ndarray


def _odd_escapes(data: np.ndarray, row_start: np.ndarray, row_of) -> np.ndarray:
    """Positions of the bytes that a backslash escapes."""
    at = np.flatnonzero(data == 92)
    if not len(at):
        return at
    rows = row_of(at)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(rows) != 0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - first) % 2 == 0] + 1


def build(data: np.ndarray, offsets: np.ndarray) -> Index:
    """Index texts laid end to end: text i is data[offsets[i]:offsets[i + 1]]."""
    n, total = len(offsets) - 1, len(data)
    valid = np.diff(offsets) > 0
    row_start = offsets[:-1]

    def row_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, at, side="right") - 1

    # Quote bitmap and the inside of strings.
    escaped = _odd_escapes(data, row_start, row_of)
    if len(escaped):  # a backslash that ends a text escapes nothing of the next
        rows = row_of(escaped - 1)
        beyond = escaped >= offsets[rows + 1]
        valid[rows[beyond]] = False
        escaped = escaped[~beyond]
    quotes = np.flatnonzero(data == 34)
    if len(escaped):
        escaped_set = np.zeros(total + 1, bool)
        escaped_set[escaped] = True
        quotes = quotes[~escaped_set[quotes]]
    quote_rows = row_of(quotes)
    odd = np.bincount(quote_rows, minlength=n) % 2 == 1
    valid &= ~odd
    if odd.any():
        quotes = quotes[~odd[quote_rows]]
    opening, closing = quotes[0::2], quotes[1::2]
    turn = np.zeros(total + 1, np.int8)
    turn[opening] = 1
    turn[closing] = -1
    inside = np.cumsum(turn[:total], dtype=np.int8).view(bool)

    # Bracket and delimiter bitmaps; scalars are runs of anything else.
    kinds = _CLASS[data]
    kinds[inside] = _SKIP
    kinds[opening] = _STRING
    scalar = kinds == _OTHER
    starts = scalar.copy()
    starts[1:] &= ~scalar[:-1]
    at_row_start = row_start[row_start < total]
    starts[at_row_start] = scalar[at_row_start]
    kinds[scalar & ~starts] = _SKIP
    tokens = np.flatnonzero(kinds != _SKIP)
    token_rows = row_of(tokens)

    control = np.flatnonzero(inside & (data < 32))
    valid[row_of(control)] = False
    if len(escaped):
        rows = row_of(escaped)
        valid[rows[~_ESCAPE[data[escaped]]]] = False
        wide = escaped[data[escaped] == 117]
        rows = row_of(wide)
        for k in range(1, 5):
            at = wide + k
            good = (at < offsets[rows + 1]) & _HEX[data[np.minimum(at, total - 1)]]
            valid[rows[~good]] = False

    def keep_valid(tokens, token_rows):
        if valid.all():
            return tokens, token_rows
        keep = valid[token_rows]
        return tokens[keep], token_rows[keep]

    # Depth by a running sum; a text that dips below 0 or doesn't end at 0 is out.
    tokens, token_rows = keep_valid(tokens, token_rows)
    for _ in range(2):
        kind = kinds[tokens]
        is_open = (kind == _LBRACE) | (kind == _LBRACKET)
        is_close = (kind == _RBRACE) | (kind == _RBRACKET)
        step = is_open.astype(np.int64) - is_close
        run = np.cumsum(step)
        first = np.ones(len(tokens), bool)
        first[1:] = token_rows[1:] != token_rows[:-1]
        first_at = np.flatnonzero(first)
        before = np.repeat(run[first_at] - step[first_at], np.diff(np.append(first_at, len(tokens))))
        level = run - before - is_open
        last_at = np.append(first_at[1:], len(tokens)) - 1 if len(first_at) else first_at
        bad = token_rows[level < 0]
        bad_end = token_rows[last_at][(run - before)[last_at] != 0]
        if not len(bad) and not len(bad_end):
            break
        valid[bad] = False
        valid[bad_end] = False
        tokens, token_rows = keep_valid(tokens, token_rows)
    seen = np.zeros(n, bool)
    seen[token_rows] = True
    valid &= seen

    # The bracket that encloses each token; of a closing one, the bracket it closes.
    owner = np.full(len(tokens), -1, np.int64)
    if len(tokens):
        order = np.argsort(level.astype(np.int16) if level.max() < 32767 else level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(level.max() + 2))
        opens_above = None
        for d in range(level.max() + 1):
            here = order[cuts[d] : cuts[d + 1]]
            opens = here[is_open[here]]
            closes = here[is_close[here]]
            owner[closes] = opens[np.searchsorted(opens, closes) - 1] if len(opens) else -1
            if d:
                rest = here[~is_close[here]]
                owner[rest] = opens_above[np.searchsorted(opens_above, rest) - 1]
            opens_above = opens

    # Grammar, each token against the one before it.
    previous = np.zeros(len(tokens), np.uint8)
    previous[1:] = kind[:-1]
    previous[first] = _START
    scalar_start = kind == _OTHER
    within = np.where(owner >= 0, kind[owner], 0) if len(tokens) else kind
    is_key = (kind == _STRING) & (within == _LBRACE) & ((previous == _LBRACE) | (previous == _COMMA))
    key_before = np.zeros(len(tokens), bool)
    key_before[1:] = is_key[:-1]
    value_before = np.zeros(len(tokens), bool)
    value_before[1:] = (is_close | (kind == _STRING) | scalar_start)[:-1]
    value_before &= ~first & ~key_before
    is_value = is_open | scalar_start | (kind == _STRING)
    in_obj, in_arr = within == _LBRACE, within == _LBRACKET
    good = np.where(
        is_value,
        np.where(
            in_obj,
            is_key | (previous == _COLON),
            np.where(in_arr, (previous == _LBRACKET) | (previous == _COMMA), first),
        ),
        False,
    )
    good |= (kind == _COLON) & in_obj & key_before
    good |= (kind == _COMMA) & (in_obj | in_arr) & value_before
    good |= (kind == _RBRACE) & in_obj & ((previous == _LBRACE) | value_before)
    good |= (kind == _RBRACKET) & in_arr & ((previous == _LBRACKET) | value_before)
    valid[token_rows[~good]] = False

    # Scalars: where they end, and what they are.
    places = np.flatnonzero(scalar_start)
    s_start = tokens[places]
    ends = np.flatnonzero(scalar & ~np.append(scalar[1:], False))
    s_end = ends[np.searchsorted(ends, s_start)] + 1 if len(ends) else s_start
    s_end = np.minimum(s_end, offsets[token_rows[places] + 1])
    s_kind = np.full(len(places), -1, np.int8)
    length = s_end - s_start
    for word, what in ((b"true", BOOL), (b"false", BOOL), (b"null", NULL)):
        at = np.flatnonzero((length == len(word)) & (data[s_start] == word[0]))
        for k, c in enumerate(word):
            at = at[data[s_start[at] + k] == c]
        s_kind[at] = what
    live = np.flatnonzero(s_kind < 0)
    state = np.ones(len(live), np.uint8)
    k = 0
    while len(live):
        state = _NUM_STEP[state, _NUM_CLASS[data[s_start[live] + k]]]
        k += 1
        done = (length[live] == k) | (state == 0)
        s_kind[live[done & _NUM_END[state]]] = NUM
        live, state = live[~done], state[~done]
    valid[token_rows[places[s_kind < 0]]] = False

    # Spans of values, and their links.
    end_of = np.zeros(len(tokens), np.int64)
    end_of[owner[is_close]] = tokens[is_close] + 1
    end_of[places] = s_end
    strings = np.flatnonzero(kind == _STRING)
    end_of[strings] = closing[np.searchsorted(opening, tokens[strings])]
    value_kind = np.full(len(tokens), -1, np.int8)
    value_kind[kind == _LBRACE] = OBJ
    value_kind[kind == _LBRACKET] = ARR
    value_kind[strings] = STR
    value_kind[places] = s_kind
    pick = np.flatnonzero(is_value & ~is_key & valid[token_rows])
    number = np.full(len(tokens) + 1, -1, np.int64)
    number[pick] = np.arange(len(pick))
    member = in_obj[pick]
    key_token = np.where(member, pick - 2, 0)
    start = tokens[pick] + (value_kind[pick] == STR)
    key_start = np.where(member, tokens[key_token] + 1, -1) if len(tokens) else start
    key_end = np.where(member, end_of[key_token], -1) if len(tokens) else start
    return Index(data, valid, token_rows[pick], number[owner[pick]], value_kind[pick], start, end_of[pick], key_start, key_end, level[pick])


def strings(index: Index, start: np.ndarray, end: np.ndarray, decode: bool | np.ndarray = True) -> pa.Array:
    """The texts of the spans as an Arrow array; start < 0 gives null.

    decode: whether a span is the inside of a JSON string, whose escapes are resolved.
    """
    data = index.data
    absent = start < 0
    length = np.where(absent, 0, end - start)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    take = np.repeat(np.where(absent, 0, start) - offsets[:-1], length) + np.arange(offsets[-1])
    body = data[take]
    bitmap = None if not absent.any() else pa.py_buffer(np.packbits(~absent, bitorder="little").tobytes())
    out = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(body), bitmap)
    slashes = np.flatnonzero(body == 92)
    if len(slashes):
        rows = np.unique(np.searchsorted(offsets, slashes, side="right") - 1)
        rows = rows[np.broadcast_to(decode, len(start))[rows]]
        if len(rows):
            mended = [unescape(v) for v in out.take(pa.array(rows)).to_pylist()]
            mask = np.zeros(len(start), bool)
            mask[rows] = True
            out = pa.compute.replace_with_mask(out, pa.array(mask), pa.array(mended, pa.large_string()))
    return out


def unescape(inside: str) -> str:
    """The text a JSON string stands for. Half a surrogate pair, which is no
    character, becomes U+FFFD."""
    return json.loads(f'"{inside}"').encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls become empty texts."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


import pyarrow.compute  # noqa: E402, F401
