"""Vectorised word kernel over Arrow string columns.

A batch of texts is one byte buffer with offsets.  Words are found by a byte class table and hashed eight
bytes at a time over whole arrays, with a mixing step after each, so no Python object is made for a word.
Work goes in slices of about ``SLICE_BYTES`` of whole texts, so memory does not follow the batch size;
a longer single text is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 1 << 20

#: Bytes of words [^\x20\x09-\x0D]+ (every non-ASCII byte belongs to a word).
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z, non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

#: Spans of up to this many bytes are hashed in whole arrays, eight bytes at a time; longer ones one by one.
SHORT = 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Masks that leave the first 0 to 8 bytes of a little-endian 64-bit integer.
_FRONT = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """Some whole texts: bytes (after the case table) and n + 1 offsets."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def counted(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text that are in a class table."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(table[self.data], out=total[1:])
        return np.diff(total[self.offsets])


@dataclass
class Words:
    """Words in text order: byte span, text number, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    code: np.ndarray

    def per_text(self, n: int) -> np.ndarray:
        return np.bincount(self.text, minlength=n).astype(np.int64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit integers, with two more at the end."""
    out = np.zeros(len(data) // 8 + 3, dtype="<u8")
    out.view(np.uint8)[: len(data)] = data
    return out


def _eight(wide: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, those beyond the span's end as zeros."""
    place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    value = wide[place] >> shift
    value |= (wide[place + 1] << np.uint64(1)) << (np.uint64(63) - shift)
    return value & _FRONT[np.minimum(left, 8)]


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal for equal bytes wherever they stand."""
    size = end - start
    wide = _eights(data)
    code = _eight(wide, start, size) ^ (size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for k in range(8, SHORT, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        code[more] = mix64(code[more]) * _SPREAD ^ _eight(wide, start[more] + k, size[more] - k)
    code = mix64(code * _SPREAD)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        body = memoryview(np.ascontiguousarray(data))
        code[long] = [xxh3_64_intdigest(body[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return code


def same_spans(data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether pairs of spans of one size, in two buffers, hold the same bytes."""
    wide, wide_other = _eights(data), _eights(other)
    same = np.ones(len(size), dtype=bool)
    for k in range(0, SHORT, 8):
        live = np.flatnonzero(same & (size > k))
        if not len(live):
            break
        left = size[live] - k
        same[live] = _eight(wide, start[live] + k, left) == _eight(wide_other, other_start[live] + k, left)
    for i in np.flatnonzero(same & (size > SHORT)).tolist():
        a, b, n = start[i], other_start[i], size[i]
        same[i] = np.array_equal(data[a + SHORT : a + n], other[b + SHORT : b + n])
    return same


def find_words(texts: Texts, table: np.ndarray, hashed: bool = True) -> Words:
    inside = table[texts.data]
    n = len(inside)
    first = np.zeros(n + 1, dtype=bool)
    first[texts.offsets] = True
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1] | first[1:n]
        closes[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(texts.offsets, start, side="right") - 1
    code = span_codes(texts.data, start, end) if hashed else np.zeros(0, dtype=np.uint64)
    return Words(start, end, text, code)


def slices(column: pa.Array, case: np.ndarray = SAME, limit: int = 0) -> Iterator[Texts]:
    """The texts of a string column (null: empty) in slices of whole texts, in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(what, dtype=np.uint8) if what is not None and what.size else np.zeros(0, dtype=np.uint8)
    at = 0
    limit = limit or SLICE_BYTES
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield Texts(case[data[offsets[at] : offsets[to]]], (offsets[at : to + 1] - offsets[at]).astype(np.int64))
        at = to


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (into the words) of windows of `size` words of one text, and their hashes."""
    n = len(words.code) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
    code = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        code = code * np.uint64(0xD6E8FEB86659FD93) + words.code[k : k + n]
    return at, mix64(code[at])


def repeated(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries (group, code): which have an equal one at all, and which have an earlier equal one."""
    key = mix64(code + group.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later
