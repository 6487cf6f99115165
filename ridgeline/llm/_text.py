"""Words of whole Arrow string columns as numpy arrays: no Python loop over words.

A word is a maximal run of bytes that a 256-entry table calls word bytes; A-Z count as a-z. Each word gets a 64-bit
hash: a polynomial over random byte values, read off one cumulative sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in pieces of about so many bytes, which bounds the memory of the arrays beside them.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _lower(table: np.ndarray) -> np.ndarray:
    table[65:91] = table[97:123]
    return table


_BASE = (0x9E3779B97F4A7C15 & ~7) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_EXACT = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_VALUES = _lower(_EXACT.copy())
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

_B = np.arange(256)
#: Words between ASCII white space.
SPACED = ~((_B == 0x20) | ((_B >= 9) & (_B <= 13)))
#: Words of ASCII letters, digits and all non-ASCII characters.
ALNUM = (_B >= 0x80) | ((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x41) & (_B <= 0x5A)) | ((_B >= 0x61) & (_B <= 0x7A))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, PIECE * 2)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each row starts and ends in them (n + 1 offsets); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def _within(starts: np.ndarray, ends: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which bytes lie in a word that holds a marked byte."""
    held = np.unique(np.searchsorted(starts, np.flatnonzero(marked), "right") - 1)
    change = np.zeros(len(marked) + 1, np.int8)
    change[starts[held]] += 1
    change[ends[held]] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def _scan(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, values: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of data; no word crosses a bound. With classes, of the parts of words."""
    n = len(data)
    word = table[data]
    before = np.empty(n, bool)
    before[1:] = word[:-1]
    after = np.empty(n, bool)
    after[:-1] = word[1:]
    inner = bounds[(bounds < n)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    after[n - 1] = before[0] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    value = values[data]
    if classes is not None and len(starts):
        kind = classes[data]
        plain = (kind > 0) & (kind < 4)
        cut = word & before
        cut[1:] &= plain[1:] & plain[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        cut &= ~_within(starts, ends, word & (kind == 0))
        last = word & ~after
        last[:-1] |= cut[1:]
        starts, ends = np.flatnonzero(word & ~before | cut), np.flatnonzero(last) + 1
        other = _within(starts, ends, word & ~plain)
        value[other] = _EXACT[data[other]]
    power, inverse = _powers(n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(value * power[:n], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def _long(data: np.ndarray, table: np.ndarray, values: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one long text, in pieces cut between words."""
    parts, at = [], 0
    while at < len(data):
        to = at + PIECE
        while to < len(data):
            gap = np.flatnonzero(~table[data[to : to + PIECE]])
            if len(gap):
                to += int(gap[0])
                break
            to += PIECE
        to = min(to, len(data))
        s, e, h = _scan(data[at:to], np.array([0, to - at]), table, values, classes)
        parts.append((s + at, e + at, h))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts))


def words(column: pa.Array, table: np.ndarray, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows first..last-1: where each row's words begin among the run's (n + 1), then the words' hashes,
    starts and ends in bytes, and those bytes. Without fold, A-Z and a-z hash differently."""
    return _runs(column, table, _VALUES if fold else _EXACT, None)


def parts_of(column: pa.Array, table: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same for parts of words: a word is cut where the class of its bytes changes, and beside each byte of class 2,
    but not beside class 4; a word that holds class 0 stays whole. A-Z count as a-z in parts of classes 1 to 3 alone."""
    return _runs(column, table, _VALUES, classes)


def _runs(column: pa.Array, table: np.ndarray, values: np.ndarray, classes: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = byte_views(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        last = min(last, n)
        part, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if not len(part):
            empty = np.zeros(0, np.int64)
            yield first, last, np.zeros(last - first + 1, np.int64), np.zeros(0, U), empty, empty, part
        else:
            starts, ends, hashes = _scan(part, bounds, table, values, classes) if len(part) <= 2 * PIECE else _long(part, table, values, classes)
            yield first, last, np.searchsorted(starts, bounds), hashes, starts, ends, part
        first = last


def word_hash(text: str, table: np.ndarray) -> np.ndarray:
    """The hashes of the words of one text."""
    found = [h for _, _, _, h, _, _, _ in words(pa.array([text], pa.string()), table)]
    return np.concatenate(found) if found else np.zeros(0, U)


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, k, U)
    for i in range(k):
        out = out * U(0x9FB21C651E98DF25) + mix(hashes[i : i + n] + U(i))
    return mix(out)
