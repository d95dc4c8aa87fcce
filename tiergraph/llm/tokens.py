"""Token ids by a public tokenizer, with a bounded cache of chunks, over whole Arrow buffers.

A text is cut where every tokenizer of the kind starts a new piece anyway, so that chunks can be encoded
by themselves and frequent ones only once per Python worker:

- white space dropped ("dropped"): at runs of ASCII white space;
- byte level, space kept in front ("spaced"): before each run of ASCII white space.

Texts in which that might not hold (other white space, strings of special tokens) are encoded whole.
Chunks are known by their 64-bit hashes, looked up for all words of a slice at a time.  The cache holds
CACHED chunks at most; rarer ones are encoded again when they come up.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tiergraph.llm.textops import SPACED, Texts, find_words, slices, span_codes

#: Chunks kept (about 40 bytes each), and bits of the table that finds most of them at once.
CACHED, SLOT_BITS = 500_000, 20
#: Chunks that are encoded at one go.
JOINED = 64

#: UTF-8 of white space beyond the six ASCII characters and of separators; a byte-level
#: pre-tokenizer treats them as white space.
_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[0x1C:0x20] = True
_OTHER_SPACE = "\x85\xa0                　"
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[c.encode()[0] for c in _OTHER_SPACE]] = True
_SPACES = np.array(sorted(int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in _OTHER_SPACE), dtype=np.int64)


def _odd_space(t: Texts) -> np.ndarray:
    """Which texts hold white space beyond the six ASCII characters."""
    out = np.zeros(t.n, dtype=bool)
    at = np.flatnonzero(_LEADS[t.data])
    data = np.concatenate([t.data, np.zeros(2, dtype=np.uint8)])
    lead, second, third = (data[at + k].astype(np.int64) for k in range(3))
    value = lead << 16 | second << 8 | np.where(lead >= 0xE0, third, 0)
    found = np.concatenate([at[np.isin(value, _SPACES)], np.flatnonzero(_SEPARATORS[t.data])])
    out[np.searchsorted(t.offsets, found, side="right") - 1] = True
    return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; exactly those of encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, kind: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = kind
        added = self.model.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        # A special token that takes nothing from its neighbours can part chunks that are encoded at one go.
        self.part = next(((i, t.content) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.cached = cached
        self.slot = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.codes, self.first = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.size, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
        # Chunks that share a slot with another one: sorted codes and their entries.
        self.other, self.other_at = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _by_itself(self, column: pa.Array) -> np.ndarray:
        """Which texts must be encoded whole."""
        out = np.zeros(len(column), dtype=bool)
        for s in self.special:
            out |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        if self.kind != "dropped" and len(column):
            out |= np.concatenate([_odd_space(t) for t in slices(column)])
        return out

    def _find(self, codes: np.ndarray) -> np.ndarray:
        """Entries of chunks, -1 where there is none."""
        if not len(self.codes):
            return np.full(len(codes), -1, dtype=np.int64)
        at = self.slot[(codes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
        at[self.codes[at] != codes] = -1
        missed = np.flatnonzero(at < 0)
        if len(missed) and len(self.other):
            place = np.minimum(np.searchsorted(self.other, codes[missed]), len(self.other) - 1)
            at[missed] = np.where(self.other[place] == codes[missed], self.other_at[place], -1)
        return at

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and all ids, of chunks without special tokens."""
        if self.part is None:
            ids = [e.ids for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]
            return np.array([len(x) for x in ids], dtype=np.int64), np.array([i for x in ids for i in x], dtype="<u4")
        part, mark = self.part
        joined = (mark.join(chunks[k : k + JOINED]) + mark for k in range(0, len(chunks), JOINED))
        ids = np.array([i for e in self.model.encode_batch_fast(list(joined), add_special_tokens=False) for i in e.ids], dtype="<u4")
        ends = np.flatnonzero(ids == part)
        return np.diff(ends, prepend=-1) - 1, ids[ids != part]

    def _learn(self, codes: np.ndarray, chunks: list[str]) -> None:
        """Add entries for distinct new chunks; only those within the bound get a place to be found by."""
        size, flat = self._encoded(chunks)
        base = len(self.codes)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.codes, self.size, self.ids = np.concatenate([self.codes, codes]), np.concatenate([self.size, size]), np.concatenate([self.ids, flat])
        entry = np.arange(base, min(base + len(codes), self.cached))
        slot = (self.codes[entry] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        free = self.slot[slot] < 0
        self.slot[slot[free]] = entry[free]
        rest = entry[self.slot[slot] != entry]
        rest = rest[np.argsort(self.codes[rest])]
        place = np.searchsorted(self.other, self.codes[rest])
        self.other, self.other_at = np.insert(self.other, place, self.codes[rest]), np.insert(self.other_at, place, rest)

    def _cut(self) -> None:
        """Drop the entries beyond the bound."""
        if len(self.codes) > self.cached:
            self.ids = self.ids[: self.first[self.cached]].copy()
            self.codes, self.first, self.size = (x[: self.cached].copy() for x in (self.codes, self.first, self.size))

    def _chunks(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of the chunks, in order."""
        words = find_words(t, SPACED, hashed=False)
        if self.kind == "dropped":
            return words.start, words.end, words.text
        start = np.concatenate([[0], words.end[:-1]])[: len(words.end)]
        start = np.maximum(start, t.offsets[words.text])
        # What stands behind a text's last word is a chunk of its own.
        last = t.offsets[:-1].copy()
        last[words.text] = words.end  # the last assignment of a text stays
        tail = np.flatnonzero(last < t.offsets[1:])
        start, end, text = np.concatenate([start, last[tail]]), np.concatenate([words.end, t.offsets[1:][tail]]), np.concatenate([words.text, tail])
        order = np.argsort(start, kind="stable")
        return start[order], end[order], text[order]

    def _slice(self, t: Texts) -> Iterator[bytes]:
        start, end, text = self._chunks(t)
        codes = span_codes(t.data, start, end)
        at = self._find(codes)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            new, index, back = np.unique(codes[missed], return_index=True, return_inverse=True)
            body = t.data.tobytes()
            where = missed[index]
            base = len(self.codes)
            self._learn(new, [body[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            at[missed] = base + back
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.first[at] - total[:-1], size)]
        bound = total[np.searchsorted(text, np.arange(t.n + 1))]
        self._cut()
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            yield ids[a:b].tobytes()

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """Ids of each text (null: empty), in order."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        alone = self._by_itself(column)
        chunked = pc.if_else(pa.array(alone), "", column) if alone.any() else column
        at = 0
        for t in slices(chunked):
            for body in self._slice(t):
                yield self.whole(column[at].as_py()) if alone[at] else body
                at += 1


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a vocabulary file; of several, only the latest stays."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, kind)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, kind)
    return _encoders[key]
