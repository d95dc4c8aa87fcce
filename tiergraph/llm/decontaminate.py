"""Benchmark decontamination: a prefix-filtered containment join of item windows against documents.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z.  Every window of ten
consecutive item words (an item with fewer is one window) must be found wherever it occurs in a document.
A window of words contains shingles of up to three words; for full containment a document must hold every
one of them, so a prefix of one shingle suffices.  Shingles are ordered by their rarity in the whole
corpus (counted in a first scan), and the rarest of a window is its prefix token.  A document shingle that
equals a token proposes the window at one position; positional and length bounds discard proposals that
would stick out of the document; the rest are verified over the whole window, word by word: first by hash,
then by their bytes.

The items are the stated query set.  They are taken in blocks of at most ITEM_BYTES of text on average (a
hash of the item picks the block), each broadcast by itself, and documents stream past one block after the
other with no shuffle of text, collecting a bit a word and the items found.

Defined cases: null or empty texts have no words: such documents have no hits and such items no windows;
repeated documents each get their row; items that share an id count as one; items with a null id count as
one item that the list of ids leaves out; an empty benchmark hits nothing; input columns named like the
operator's own are replaced; texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.llm.tables import named, others, released, small_batches
from tiergraph.llm.textops import ALNUM, LOWER, Texts, Words, find_words, mix64, same_spans, slices, windows

WINDOW = 10
SHINGLE = 3
ITEM_BYTES = 8 << 20

RESULT = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("n_items", T.LongType()),
    ("items_sha256", T.StringType()),
    ("contaminated", T.BooleanType()),
]


class CodeSet:
    """A sorted set of 64-bit codes with a bitmap in front of the binary search."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.codes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `codes` that are members, and their member numbers."""
        if not len(self.codes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[(codes >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.codes, codes[maybe]), len(self.codes) - 1)
        real = self.codes[place] == codes[maybe]
        return maybe[real], place[real]


@dataclass
class Block:
    """The words of some items, their distinct windows, and which items hold each."""

    item_ids: list[str | None]
    data: np.ndarray  # the items' bytes
    start: np.ndarray  # of each word: first byte, bytes, hash
    size: np.ndarray
    code: np.ndarray
    first: np.ndarray  # of each window: first word, words
    length: np.ndarray
    held: np.ndarray  # where the holders of each window begin; one more entry at the end
    holder: np.ndarray
    tokens: dict[int, CodeSet]  # shingle size: all shingles of windows that use that size


def _shingles(words: Words, k: int) -> np.ndarray:
    """The shingle of k words from each word on; meaningless where an item ends before."""
    out = np.zeros(len(words.code), dtype=np.uint64)
    at, code = windows(words, k)
    out[at] = code
    return out


def build_block(rows: list[tuple[str | None, str | None]]) -> Block:
    column = pa.array([t for _, t in rows], type=pa.string())
    (t,) = slices(column, LOWER, 1 << 62) if rows else (Texts(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)),)
    words = find_words(t, ALNUM)
    bound = np.searchsorted(words.text, np.arange(t.n + 1))
    many = np.diff(bound)
    full = np.arange(len(words.code)) + WINDOW <= bound[words.text + 1]
    first = np.concatenate([np.flatnonzero(full), bound[:-1][(many > 0) & (many < WINDOW)]])
    length = np.minimum(many[words.text[first]], WINDOW)
    # Equal windows are one: sorted by a hash, and told apart by their bytes where hashes meet.
    key = np.zeros(len(first), dtype=np.uint64)
    for j in range(WINDOW):
        live = np.flatnonzero(length > j)
        key[live] = mix64(key[live] + words.code[first[live] + j])
    order = np.lexsort((first, length, key))
    first, length, key = first[order], length[order], key[order]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
    for j in range(WINDOW):
        live = np.flatnonzero(~new & (length > j))
        a, b = first[live] + j, first[live - 1] + j
        size = words.end[a] - words.start[a]
        same = size == words.end[b] - words.start[b]
        alike = np.flatnonzero(same)
        same[alike] = same_spans(t.data, words.start[a[alike]], t.data, words.start[b[alike]], size[alike])
        new[live] = ~same
    window = np.cumsum(new) - 1
    pairs = np.unique(np.stack([window, words.text[first]], 1), axis=0) if len(first) else np.zeros((0, 2), dtype=np.int64)
    first, length = first[new], length[new]
    tokens = {}
    for k in range(1, SHINGLE + 1):
        own = np.flatnonzero(np.minimum(length, SHINGLE) == k)
        if len(own):
            places = np.unique(np.concatenate([first[own[length[own] >= k + j]] + j for j in range(WINDOW - k + 1)]))
            tokens[k] = CodeSet(_shingles(words, k)[places])
    return Block([i for i, _ in rows], t.data, words.start, words.end - words.start, words.code, first, length, np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1], tokens)


def count_shingles(docs: DataFrame, text: str, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in the whole corpus."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(block.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        total = {k: np.zeros(len(v.codes), dtype=np.int64) for k, v in tokens.items()}
        for batch in batches:
            for t in slices(batch.column(0), LOWER):
                words = find_words(t, ALNUM)
                for k, known in tokens.items():
                    _, member = known.find(windows(words, k)[1])
                    total[k] += np.bincount(member, minlength=len(known.codes))
        for k, v in total.items():
            seen = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k), pa.int32()), pa.array(seen, pa.int64()), pa.array(v[seen], pa.int64())], names=["k", "member", "n"])

    parts = docs.select(F.col(named(text)).cast("string")).mapInArrow(released(run), "k int, member long, n long")
    counts = {k: np.zeros(len(v.codes), dtype=np.int64) for k, v in block.tokens.items()}
    for r in parts.groupBy("k", "member").agg(F.sum("n").alias("n")).collect():  # as many rows as the block has shingles
        counts[r["k"]][r["member"]] = r["n"]
    return counts


@dataclass
class Plan:
    """For each shingle size: tokens, and for each token the windows it stands for with its offset in them."""

    block: Block
    size: dict[int, tuple[CodeSet, np.ndarray, np.ndarray, np.ndarray]]


def plan_block(block: Block, counts: dict[int, np.ndarray]) -> Plan:
    none = np.zeros(len(block.code), dtype=np.int64)
    size = {}
    for k, known in block.tokens.items():
        # Windows lie inside one item, so shingles are taken as if all words were one text's.
        shingle = _shingles(Words(none, none, none, block.code), k)
        place = np.minimum(np.searchsorted(known.codes, shingle), len(known.codes) - 1)
        rank = np.empty(len(known.codes), dtype=np.int64)
        rank[np.lexsort((known.codes, counts[k]))] = np.arange(len(known.codes))
        chosen, offset = [], []
        for n in range(k, WINDOW + 1):
            own = np.flatnonzero((block.length == n) & (min(n, SHINGLE) == k))
            if len(own):
                rarity = np.stack([rank[place[block.first[own] + j]] for j in range(n - k + 1)])
                chosen.append(own)
                offset.append(rarity.argmin(0))
        window, at = np.concatenate(chosen), np.concatenate(offset)
        codes = shingle[block.first[window] + at]
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        tokens = CodeSet(codes)
        size[k] = (tokens, np.append(np.searchsorted(codes, tokens.codes), len(codes)), window[order], at[order])
    return Plan(block, size)


def find_windows(t: Texts, words: Words, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Verified occurrences: first word (number in the slice) and window."""
    block = plan.block
    bound = np.searchsorted(words.text, np.arange(t.n + 1))
    starts, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for k, (known, first, window, offset) in plan.size.items():
        at, code = windows(words, k)
        hit, member = known.find(code)
        if not len(hit):
            continue
        many = first[member + 1] - first[member]
        rows = np.repeat(np.arange(len(hit)), many)
        entry = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + first[member][rows]
        begin = at[hit][rows] - offset[entry]
        win = window[entry]
        text = words.text[at[hit][rows]]
        fits = (begin >= bound[text]) & (begin + block.length[win] <= bound[text + 1])
        begin, win = begin[fits], win[fits]
        good = np.ones(len(begin), dtype=bool)
        for j in range(WINDOW):
            live = np.flatnonzero(good & (block.length[win] > j))
            good[live] = words.code[begin[live] + j] == block.code[block.first[win[live]] + j]
        starts.append(begin[good])
        found.append(win[good])
    begin, win = np.concatenate(starts), np.concatenate(found)
    # Equal hashes are not taken at their word: each pair of a document word and an item word is compared once.
    length = block.length[win]
    row = np.repeat(np.arange(len(win)), length)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    pairs, back = np.unique(np.stack([begin[row] + nth, block.first[win][row] + nth], 1), axis=0, return_inverse=True) if len(row) else (np.zeros((0, 2), dtype=np.int64), row)
    size = words.end[pairs[:, 0]] - words.start[pairs[:, 0]]
    same = size == block.size[pairs[:, 1]]
    live = np.flatnonzero(same)
    same[live] = same_spans(t.data, words.start[pairs[live, 0]], block.data, block.start[pairs[live, 1]], size[live])
    good = np.bincount(row, weights=~same[back], minlength=len(win)) == 0
    return begin[good], win[good]


def _sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _covered(n: int, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length, -1)
    return np.cumsum(edge[:-1]) > 0


_WORDS, _MARKS, _FOUND = "__words__", "__marks__", "__found__"


def gather(docs: DataFrame, text: str, plan: Plan) -> DataFrame:
    """One block's scan: documents go through whole, with hit words and items so far."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    names = docs.columns
    at, marks_at, found_at = names.index(text), names.index(_MARKS), names.index(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        block = plan.block
        for batch in batches:
            marks, found = batch.column(marks_at).to_pylist(), batch.column(found_at).to_pylist()
            row = 0
            for t in slices(batch.column(at), LOWER):
                words = find_words(t, ALNUM)
                bound = np.searchsorted(words.text, np.arange(t.n + 1))
                begin, win = find_windows(t, words, plan)
                hit = _covered(len(words.code), begin, block.length[win])
                for d, w in set(zip(words.text[begin].tolist(), win.tolist(), strict=True)):
                    found[row + d] = [*{*(found[row + d] or ()), *(block.item_ids[i] for i in block.holder[block.held[w] : block.held[w + 1]])}]
                for d in set(words.text[begin].tolist()):
                    now = hit[bound[d] : bound[d + 1]]
                    if marks[row + d]:
                        now = now | np.unpackbits(np.frombuffer(marks[row + d], dtype=np.uint8))[: len(now)].astype(bool)
                    marks[row + d] = np.packbits(now).tobytes()
                row += t.n
            columns = [batch.column(i) for i in range(len(names))]
            columns[marks_at], columns[found_at] = pa.array(marks, pa.binary()), pa.array(found, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(released(run), docs.schema)


def _finish(docs: DataFrame, text: str, keep: list[str] | None) -> DataFrame:
    names = [n for n, _ in RESULT]
    kept = [c for c in others(docs, names) if c not in (_MARKS, _FOUND) and (keep is None or c in keep)]
    source = docs.select(*[named(c) for c in kept], F.col(named(text)).alias(_WORDS), _MARKS, _FOUND)
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(n, t) for n, t in RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = [n for t in slices(batch.column(len(kept)), LOWER) for n in find_words(t, ALNUM, hashed=False).per_text(t.n).tolist()]
            n_hit = [int(np.unpackbits(np.frombuffer(m or b"", dtype=np.uint8)).sum()) for m in batch.column(len(kept) + 1).to_pylist()]
            found = [f or [] for f in batch.column(len(kept) + 2).to_pylist()]
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([_sha([i for i in f if i is not None]) for f in found]), pa.array([n > 0 for n in n_hit])]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + made, names=[*kept, *names])

    return source.mapInArrow(released(run), schema)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items_sha256 and contaminated; see the module's text for odd cases."""
    small_batches(docs.sparkSession)
    query = items.select(F.col(named(item_id)).cast("string").alias("id"), F.col(named(item_text)).cast("string").alias("text"))
    size = query.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(size) // item_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks))
    out = docs.withColumn(_MARKS, F.lit(None).cast("binary")).withColumn(_FOUND, F.lit(None).cast("array<string>"))
    out = out.withColumn(text, F.col(named(text)).cast("string"))
    kept = [c for c in out.columns if keep is None or c in keep or c in (text, _MARKS, _FOUND)]
    out = out.select(*[named(c) for c in kept])
    for k in range(n_blocks):
        block = build_block([(r["id"], r["text"]) for r in query.where(part == k).orderBy("id", "text").collect()])  # one bounded block
        if block.tokens:
            out = gather(out, text, plan_block(block, count_shingles(docs, text, block)))
    return _finish(out, text, keep)
