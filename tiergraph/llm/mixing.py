"""LM scoring by online logistic mixing of hashed-context bit predictors.

A text is a sequence of words (A-Z lower-cased, white space apart) and an end.  A token is a path of binary
decisions in a code tree over the head (words with LEAST_SHARE of the training tokens or more), an escape
and the end (below nodes with less than WORD_SHARE of all a word's chance is its share); any other word is spelled after the escape, byte by byte in a second code tree, up to a
terminator.  So the probabilities of all token sequences add up to one at most.

A bit has several predictors, each a pair of counts in a table slot that a hash of the tree node and one
context chooses.  For words the contexts are the text's register so far and the previous word; for spelled bytes
the last two, three, four and five bytes of the word, with the register.  Registers are groups of very frequent words that share texts (languages,
mostly); at each token a text's register is the one with most words so far.  The predictors' log-odds are
mixed by logistic weights; a gate (kind of token, depth of the node, place in the word) selects the weight
set.  An adaptive probability map, by gate and mixed log-odds, then refines the result.

Training goes online through the training documents of each task: a block of text is predicted from the
counts so far, weights and map are corrected, and then the block is counted.  Counts, weights and map take
in every block; blocks grow from FIRST_BYTES to BLOCK_BYTES.  Counts of all tasks are added up, weights are
averaged by their numbers of decisions; so scores depend a little on how the table is partitioned, and not
at all on anything else.  Equal tokens in equal contexts are worked on once in a block, with their number as
weight, and in scoring once in a task, as far as CACHED goes.

The table has a slot for 64 bytes of training text, up to 2 ** MOST_BITS; the vocabulary is a table without
bound, in shared storage.  Only the head, the counts of the KNOWN most frequent words, slots, weights and map
are broadcast, and a bitmap of all other words that occur more than once, of TOLD_BITS bits or more a word.

Every previous word that occurs more than once in the training texts has a context of its own, however many
there are: KNOWN decides which counts are broadcast and no more.  Words seen once or never share one context by
register, save the few (1.4 % at most) that the bitmap takes for others.

The base score is the add-one unigram model with exact counts of all words: those of the KNOWN words come
with the broadcast, all others by a join on the word.

Defined cases: null texts count as empty (an end alone); a null doc_id counts as the empty string in the
choice of held-out rows; repeated rows are scored, and counted, each; with no training rows every token is
unknown and the model is the untrained one; an empty table gives an empty result; other columns play no
part; texts and words of any length are scored whole.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm.tables import named, released, small_batches, staged
from tiergraph.llm.textops import LOWER, SPACED, Texts, find_words, mix64, slices

#: Share of the training tokens that makes a word one of the head, and share from which a tree's node is mixed
#: over; words whose counts are broadcast.
LEAST_SHARE, WORD_SHARE, KNOWN = 1 / 8192, 1 / 8192, 1 << 17
#: Bits of the bitmap for a word that is in the training texts more than once, and not among the KNOWN, at least.
TOLD_BITS = 16
#: Slots of the table: a slot for so many bytes of training text, within these bounds; slices of the table.
SLOT_BYTES, LEAST_BITS, MOST_BITS, SLICES = 8, 18, 23, 64
#: Bytes of text whose decisions are held at a time: the first block of a task, and the largest.
FIRST_BYTES, BLOCK_BYTES = 1 << 16, 3 << 20
#: The most frequent words, which tell the register; registers at most.
HINTS, REGISTERS = 64, 8
#: Depths of the word tree and of the letter tree that have gates of their own, places in a word, buckets of the map.
WORD_DEPTHS, LETTER_DEPTHS, PLACES, BUCKETS = 16, 8, 4, 33
INPUTS, GATES = 4, WORD_DEPTHS + LETTER_DEPTHS * PLACES
#: The contexts' shares of the table, as first and number of 16ths: of words (register, previous word), of letters
#: (last two, three, four, five).
WORD_SHARES, LETTER_SHARES = ((0, 1), (1, 3)), ((4, 1), (5, 2), (7, 4), (11, 5))
#: Steps of the table's log-odds.
FINE = 10
#: How far curvature fades from block to block, and what steadies it.
FADE, RIDGE = 0.9, 20.0
#: Words in their contexts, and spelled words, whose scores a task keeps.
CACHED = 1 << 20
SPACE = 0x20  # ends a spelled word; no word holds it
HELD_OUT_OF, HELD_OUT = 7, 2

_END = np.uint64(0x5EED0E4D)


@dataclass
class Tree:
    """A binary code: for each symbol its path of mixed decisions (node, its hash, bit), and log10 of the chance of
    what follows them."""

    first: np.ndarray
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    tail: np.ndarray

    def __post_init__(self) -> None:
        self.mark = mix64(self.node.astype(np.uint64) + np.uint64(1))


def code_tree(weights: np.ndarray, share: float = 0.0) -> Tree:
    """Huffman's code for the weights (each at least 1); ties go by symbol, so the tree is a function of them.

    Decisions are mixed at nodes that hold at least `share` of the weight.  Below them contexts have next to
    nothing to tell, and a symbol's chance is its share of the node's weight.
    """
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    weight = np.zeros(2 * n)
    weight[:n] = weights
    parent, side = np.zeros(2 * n, dtype=np.int64), np.zeros(2 * n, dtype=np.uint8)
    top = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = top
        side[j] = 1
        weight[top] = a + b
        heapq.heappush(heap, (a + b, top))
        top += 1
    root = top - 1
    nodes, bits = [np.full(n, -1)], [np.zeros(n, dtype=np.uint8)]
    at, reached = np.arange(n), np.full(n, root)
    while (climbing := at != root).any():  # all symbols climb one level at a time
        above = parent[at]
        mixed = climbing & (weight[above] >= share * weight[root])
        # The last node on the way up whose parent is not mixed over is where the mixed path ends.
        reached = np.where(mixed & (reached == root), at, reached)
        nodes.append(np.where(mixed, above, -1))
        bits.append(side[at])
        at = np.where(climbing, above, root)
    grid, bit_grid = np.stack(nodes[::-1], 1), np.stack(bits[::-1], 1)  # from the root down, gaps in front
    used = grid >= 0
    size = used.sum(1)
    return Tree(np.cumsum(size) - size, size, (root - grid[used]).astype(np.int64), bit_grid[used], np.log10(weight[:n] / weight[reached]))


def letter_trees(pairs: np.ndarray) -> Tree:
    """A code tree for the byte after each byte, from counts of pairs; symbols are 256 * byte before + byte."""
    trees = [code_tree(row + 1) for row in pairs.reshape(256, 256)]
    sizes = np.cumsum([0, *(len(t.node) for t in trees)])
    return Tree(np.concatenate([t.first + n for t, n in zip(trees, sizes, strict=False)]), np.concatenate([t.size for t in trees]), np.concatenate([t.node + 256 * k for k, t in enumerate(trees)]), np.concatenate([t.bit for t in trees]), np.zeros(1))


@dataclass
class Lexicon:
    """The most frequent words with their counts, the head among them, registers, and the two code trees."""

    codes: np.ndarray  # sorted
    counts: np.ndarray  # of the codes
    symbol: np.ndarray  # of the codes: rank by frequency; words outside the head have ranks from `escape` on
    words: Tree  # symbols by rank, then escape, then end
    letters: Tree
    total: int  # training tokens N
    distinct: int  # training types V
    ends: int  # training texts
    escape: int
    register: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # of the HINTS first symbols
    bits: int = LEAST_BITS
    told: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint8))  # bitmap of other words with own contexts

    def own_context(self, codes: np.ndarray) -> np.ndarray:
        """Whether the bitmap has these words."""
        if not len(self.told):
            return np.zeros(len(codes), dtype=bool)
        one, two = _told_slots(codes, (8 * len(self.told)).bit_length() - 1)
        return (self.told[one >> 3] >> (one & 7).astype(np.uint8) & self.told[two >> 3] >> (two & 7).astype(np.uint8) & 1) == 1


def _told_slots(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A word's two places in the bitmap."""
    one = mix64(codes ^ np.uint64(0x7A3D9E51))
    return tuple((x >> np.uint64(64 - bits)).astype(np.int64) for x in (one, mix64(one)))


@dataclass
class Decisions:
    """Binary decisions at one depth of a tree, all of one gate: the item each belongs to, slots by context, bits."""

    item: np.ndarray
    slots: list[np.ndarray]
    bit: np.ndarray
    gate: int


@dataclass
class Tokens:
    """What a block of texts holds: counts for the base score, head decisions, words to spell."""

    n_tokens: np.ndarray
    known: np.ndarray  # tokens with a broadcast count, by text
    logs: np.ndarray  # sum of log10(count + 1) over those
    rest: list[bytes]  # codes of the other words, by text
    symbol: np.ndarray  # of all tokens, ends included
    text: np.ndarray
    contexts: list[np.ndarray]  # of all tokens
    spelled: np.ndarray  # words outside the head: positions among the words
    word: np.ndarray  # their codes
    register: np.ndarray  # their registers
    span: tuple[np.ndarray, np.ndarray]  # their bytes


_NODE, _SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _decide(tree: Tree, symbol: np.ndarray, item: np.ndarray, contexts: list[np.ndarray], shares: tuple[tuple[int, int], ...], bits: int, gate: int, depths: int) -> Iterator[Decisions]:
    """The decisions of symbols, depth by depth; gates go up by one with the depth.  Each context has its share of
    the table (first and number of 16ths), so that sparse ones do not blur dense ones."""
    first, left = tree.first[symbol], tree.size[symbol]
    live = np.flatnonzero(left > 0)
    depth = 0
    while len(live):
        at = first[live] + depth
        own = tree.mark[at]
        slots = []
        for c, (begin, many) in zip(contexts, shares, strict=True):
            mixed = (own ^ c[live]) * _SLOT  # contexts are mixed already
            mixed >>= np.uint64(32)
            mixed *= np.uint64(many << (bits - 4))
            mixed >>= np.uint64(32)
            mixed += np.uint64(begin << (bits - 4))
            slots.append(mixed.view(np.int64))
        yield Decisions(item[live], slots, tree.bit[at], gate + min(depth, depths - 1))
        depth += 1
        live = live[left[live] > depth]


def registers_of(symbol: np.ndarray, text: np.ndarray, register: np.ndarray) -> np.ndarray:
    """For each token the register with most words before it in its text; 0 where there is none."""
    out = np.zeros(len(symbol), dtype=np.int64)
    if not len(symbol) or not len(register):
        return out
    own = np.where(symbol < len(register), register[np.minimum(symbol, len(register) - 1)], -1)
    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    size = np.diff(np.append(begin, len(text)))
    most = np.zeros(len(symbol), dtype=np.int32)
    for r in range(int(register.max()) + 1):
        seen = np.cumsum(own == r, dtype=np.int32)
        seen -= own == r  # before the token
        seen -= np.repeat(seen[begin], size)
        better = seen > most
        out[better] = r + 1
        most[better] = seen[better]
    return out


def read_tokens(t: Texts, lexicon: Lexicon) -> Tokens:
    """Tokens of whole texts with their contexts."""
    words = find_words(t, SPACED)
    bound = np.searchsorted(words.text, np.arange(t.n + 1))
    n_codes = len(lexicon.codes)
    place, inside, rank = np.zeros(len(words.code), dtype=np.int64), np.zeros(len(words.code), dtype=bool), np.full(len(words.code), lexicon.escape)
    if n_codes:
        place = np.minimum(np.searchsorted(lexicon.codes, words.code), n_codes - 1)
        inside = lexicon.codes[place] == words.code
        rank = np.where(inside, np.minimum(lexicon.symbol[place], lexicon.escape), lexicon.escape)
    logs = np.bincount(words.text[inside], weights=np.log10(lexicon.counts[place[inside]] + 1.0), minlength=t.n) + np.log10(lexicon.ends + 1.0)
    known = np.bincount(words.text[inside], minlength=t.n) + (lexicon.ends > 0)
    rare = np.flatnonzero(~inside)
    cut = np.searchsorted(words.text[rare], np.arange(t.n + 1)).tolist()
    codes = words.code[rare]
    rest = [codes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    # The token sequence: words with an end after each text's.
    total = len(words.code) + t.n
    symbol, text, code = np.full(total, lexicon.escape + 1), np.zeros(total, dtype=np.int64), np.full(total, _END, dtype=np.uint64)
    at = np.arange(len(words.code)) + words.text
    ends = bound[1:] + np.arange(t.n)
    symbol[at], text[at], code[at] = rank, words.text, words.code
    text[ends] = np.arange(t.n)
    before = np.concatenate([[_END], code[:-1]])[:total]  # an end stands before a text's first word
    before[bound[:-1] + np.arange(t.n)] = _END
    register = registers_of(symbol, text, lexicon.register)
    near = register.astype(np.uint64)
    # Previous words that the training texts do not have twice are one, by register.
    plain = mix64(near + np.uint64(2 << 32))
    told = np.zeros(total, dtype=bool)
    told[at] = inside
    told[at[rare]] = lexicon.own_context(codes)
    one = np.where(np.concatenate([[True], told[:-1]])[:total] | (before == _END), mix64(before), plain)
    contexts = [mix64(near + np.uint64(1 << 32)), one]
    spelled = np.flatnonzero(rank == lexicon.escape)
    return Tokens(np.diff(bound) + 1, known, logs, rest, symbol, text, contexts, spelled, words.code[spelled], register[at[spelled]], (words.start[spelled], words.end[spelled]))


def spell(t: Texts, start: np.ndarray, end: np.ndarray, register: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of words, a space behind included: the word it belongs to, and its key, which holds the
    five bytes before it in the word (spaces where there are fewer), itself, and the register."""
    size = end - start + 1
    owner = np.repeat(np.arange(len(start)), size)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    letter = np.full(len(owner), SPACE, dtype=np.uint64)
    real = nth < size[owner] - 1
    letter[real] = t.data[start[owner[real]] + nth[real]]
    key = letter << np.uint64(40) | register[owner].astype(np.uint64) << np.uint64(48)
    for k in range(1, 6):
        back = np.full(len(letter), SPACE, dtype=np.uint64)
        back[k:] = letter[:-k]
        back[nth < k] = SPACE
        key |= back << np.uint64(8 * (k - 1))
    return owner, key


def letter_decisions(key: np.ndarray, lexicon: Lexicon) -> Iterator[Decisions]:
    """The decisions over letters in their contexts."""
    near = key >> np.uint64(48)
    contexts = [mix64((key & np.uint64((1 << 8 * k) - 1) | near << np.uint64(40)) + np.uint64(k << 48)) for k in (2, 3, 4, 5)]
    symbol = ((key & np.uint64(255)) << np.uint64(8) | key >> np.uint64(40) & np.uint64(255)).astype(np.int64)
    place = sum((key >> np.uint64(8 * k) & np.uint64(255) != SPACE).astype(np.int64) for k in range(PLACES - 1))
    for p in range(PLACES):
        at = np.flatnonzero(place == p)
        yield from _decide(lexicon.letters, symbol[at], at, [c[at] for c in contexts], LETTER_SHARES, lexicon.bits, WORD_DEPTHS + LETTER_DEPTHS * p, LETTER_DEPTHS)


def odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)), dtype=np.float32)


def fine_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Log-odds in steps of 1 / FINE, as bytes."""
    return np.clip(np.rint(odds(ones.astype(np.float32), zeros.astype(np.float32)) * FINE), -127, 127).astype(np.int8)


class Mixer:
    """Gated weights and the probability map.

    Weights follow online Newton steps: a block's gradient of a gate, by the curvature of that block and,
    fading, of those before.
    """

    def __init__(self) -> None:
        self.weights = np.full((GATES, INPUTS + 1), 0.3)
        self.weights[:, INPUTS] = 0
        self.curve = np.zeros((GATES, INPUTS + 1, INPUTS + 1))
        self.map_ones, self.map_all = np.zeros((GATES, BUCKETS)), np.zeros((GATES, BUCKETS))
        self.seen = np.zeros(GATES)

    def mixed(self, inputs: np.ndarray, gate: int) -> np.ndarray:
        own = self.weights[gate].astype(np.float32)
        out = own[: len(inputs)] @ inputs
        out += own[INPUTS]
        return np.clip(out, -12, 12, out=out)

    @staticmethod
    def _cell(stretch: np.ndarray) -> np.ndarray:
        return ((np.clip(stretch, -8, 8) + np.float32(8)) * np.float32((BUCKETS - 1) / 16) + np.float32(0.5)).astype(np.int64)

    def train(self, inputs: np.ndarray, gate: int, bit: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Correct weights and map by decisions, each of which occurred `weight` times (once)."""
        stretch = self.mixed(inputs, gate)
        p = 1 / (1 + np.exp(-stretch))
        error, bend = bit - p, p * (1 - p)
        if weight is not None:
            error, bend = error * weight, bend * weight
        k = [*range(len(inputs)), INPUTS]
        own = (gate, *np.ix_(k, k))
        curve = np.empty((len(k), len(k)))
        bent = inputs * bend
        curve[:-1, :-1] = bent @ inputs.T
        curve[-1, :-1] = curve[:-1, -1] = bent.sum(1)
        curve[-1, -1] = bend.sum()
        self.curve[own] = FADE * self.curve[own] + curve
        slope = np.append(inputs @ error, error.sum())
        step = np.linalg.solve(self.curve[own] + RIDGE * np.eye(len(k)), slope)
        self.weights[gate, k] += np.clip(step, -0.5, 0.5)
        cell = self._cell(stretch)
        every = np.bincount(cell, weights=weight, minlength=BUCKETS)
        self.map_all[gate] += every
        self.map_ones[gate] += np.bincount(cell, weights=bit if weight is None else weight * bit, minlength=BUCKETS)
        self.seen[gate] += every.sum()

    def log10(self, inputs: np.ndarray, gate: int, bit: np.ndarray) -> np.ndarray:
        """Log10 of the probability of the bits."""
        stretch = self.mixed(inputs, gate)
        cell = self._cell(stretch)
        ones, every = self.map_ones[gate], self.map_all[gate]
        p = 1 / (1 + np.exp(-stretch))
        p = 0.5 * p + 0.5 * (ones[cell] + 16 * p) / (every[cell] + 16)
        return np.log10(np.clip(np.where(bit == 1, p, 1 - p), 1e-7, 1 - 1e-7))


def block_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """The texts of a task's batches in blocks of whole texts, which grow from FIRST_BYTES to BLOCK_BYTES."""
    limit, held, size = FIRST_BYTES, [], 0
    for batch in batches:
        for t in slices(batch.column(0), LOWER, FIRST_BYTES):
            held.append(t)
            size += len(t.data)
            if size >= limit:
                yield joined(held)
                limit, held, size = min(2 * limit, BLOCK_BYTES), [], 0
    if held:
        yield joined(held)


def joined(parts: list[Texts]) -> Texts:
    ends = np.cumsum([0, *(len(t.data) for t in parts)])
    return Texts(np.concatenate([t.data for t in parts]), np.concatenate([[0], *(t.offsets[1:] + e for t, e in zip(parts, ends[:-1], strict=True))]))


def _counted(counts: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    """The predictors' log-odds from the counts so far."""
    out = np.empty((len(slots), len(slots[0])), dtype=np.float32)
    both = counts.view(np.uint64).reshape(-1)
    for row, s in zip(out, slots, strict=True):
        pair = both.take(s)
        row[:] = odds((pair >> np.uint64(32)).astype(np.float32), (pair & np.uint64(0xFFFFFFFF)).astype(np.float32))
    return out


def _keys(tokens: Tokens) -> np.ndarray:
    """Keys of the tokens' decisions over words: equal for equal symbols in equal contexts."""
    out = mix64(tokens.symbol.astype(np.uint64))
    for c in tokens.contexts:
        out = (out ^ c) * _SLOT
    return mix64(out)


def learn(t: Texts, lexicon: Lexicon, counts: np.ndarray, mixer: Mixer) -> None:
    """Predict the decisions of a block from the counts so far, correct weights and map, and count them."""
    tokens = read_tokens(t, lexicon)
    flat = counts.reshape(-1)
    _, index, often = np.unique(_keys(tokens), return_index=True, return_counts=True)
    for d in _decide(lexicon.words, tokens.symbol[index], np.arange(len(index)), [c[index] for c in tokens.contexts], WORD_SHARES, lexicon.bits, 0, WORD_DEPTHS):
        weight = often[d.item].astype(np.uint32)
        mixer.train(_counted(counts, d.slots), d.gate, d.bit, weight.astype(np.float32))
        for s in d.slots:
            np.add.at(flat, 2 * s + d.bit, weight)
    _, index, often = np.unique(tokens.word + tokens.register.astype(np.uint64) * _NODE, return_index=True, return_counts=True)
    owner, key = spell(t, tokens.span[0][index], tokens.span[1][index], tokens.register[index])
    key, back = np.unique(key, return_inverse=True)
    often = np.bincount(back, weights=often[owner], minlength=len(key))
    for d in letter_decisions(key, lexicon):
        weight = often[d.item]
        mixer.train(_counted(counts, d.slots), d.gate, d.bit, weight.astype(np.float32))
        weight = weight.astype(np.uint32)
        for s in d.slots:
            np.add.at(flat, 2 * s + d.bit, weight)


class Kept:
    """Values by key, up to a number of keys; the first ones stay."""

    def __init__(self, most: int):
        self.keys, self.values, self.most = np.zeros(0, dtype=np.uint64), np.zeros(0), most

    def find(self, keys: np.ndarray, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The value of each key; make() gives those of keys that are not there, from where they first occur."""
        if not len(keys):
            return np.zeros(0)
        key, index, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, key)
        value, new = np.zeros(len(key)), np.ones(len(key), dtype=bool)
        if len(self.keys):
            near = np.minimum(place, len(self.keys) - 1)
            new = self.keys[near] != key
            value = np.where(new, 0.0, self.values[near])
        fresh = np.flatnonzero(new)
        if len(fresh):
            value[fresh] = make(index[fresh])
            if len(self.keys) + len(fresh) <= self.most:
                self.keys, self.values = np.insert(self.keys, place[fresh], key[fresh]), np.insert(self.values, place[fresh], value[fresh])
        return value[back]


class Scorer:
    """Scores texts by a trained model; what it finds for a token in its contexts it keeps."""

    def __init__(self, lexicon: Lexicon, table: np.ndarray, mixer: Mixer):
        self.lexicon, self.table, self.mixer = lexicon, table, mixer
        self.words, self.spelled, self.letters = Kept(CACHED), Kept(CACHED), Kept(CACHED)

    def _sums(self, decisions: Iterator[Decisions], n: int) -> np.ndarray:
        """Log10 of the probability of the items' decisions."""
        out = np.zeros(n)
        for d in decisions:
            inputs = np.empty((len(d.slots), len(d.bit)), dtype=np.float32)
            for row, s in zip(inputs, d.slots, strict=True):
                np.multiply(self.table.take(s), np.float32(1 / FINE), out=row)
            out += np.bincount(d.item, weights=self.mixer.log10(inputs, d.gate, d.bit), minlength=n)
        return out

    def score(self, t: Texts) -> tuple[Tokens, np.ndarray]:
        """Tokens and the log10 probability of each text."""
        x, tokens = self.lexicon, read_tokens(t, self.lexicon)

        def words(at: np.ndarray) -> np.ndarray:
            decisions = _decide(x.words, tokens.symbol[at], np.arange(len(at)), [c[at] for c in tokens.contexts], WORD_SHARES, x.bits, 0, WORD_DEPTHS)
            return self._sums(decisions, len(at)) + x.words.tail[tokens.symbol[at]]

        def spelled(at: np.ndarray) -> np.ndarray:
            owner, key = spell(t, tokens.span[0][at], tokens.span[1][at], tokens.register[at])
            return np.bincount(owner, weights=self.letters.find(key, lambda i: self._sums(letter_decisions(key[i], x), len(i))), minlength=len(at))

        own = self.words.find(_keys(tokens), words)
        own[tokens.symbol == x.escape] += self.spelled.find(mix64(tokens.word + tokens.register.astype(np.uint64) * _NODE), spelled)
        return tokens, np.bincount(tokens.text, weights=own, minlength=t.n)


def letter_pairs(t: Texts) -> np.ndarray:
    """Counts of 256 * byte before + byte in words, white space counting as one byte before and behind a word."""
    own = np.where(SPACED[t.data], t.data, np.uint8(SPACE)).astype(np.int64)
    before = np.concatenate([[SPACE], own[:-1]])[: len(own)]
    inner = t.offsets[:-1][t.offsets[:-1] < len(own)]
    before[inner] = SPACE
    return np.bincount((before << 8) + own, minlength=1 << 16)


def count_words(source: DataFrame) -> DataFrame:
    """(kind, code, n): training words of kind 0, pairs of bytes in words and behind them of kind 1, ends of kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = np.zeros(1 << 16, dtype=np.int64)
        texts = size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, place = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def out(kind: int, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), kind, dtype=np.int32)), pa.array(codes.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "code", "n"])

        for batch in batches:
            for t in slices(batch.column(0), LOWER):
                words = find_words(t, SPACED)
                held.append(np.unique(words.code, return_counts=True))
                pairs += letter_pairs(t)
                texts += t.n
                size += len(held[-1][0])
                if size > 1_000_000:
                    codes, n = merged()
                    held, size = [(codes, n)], len(codes)
                    if size > 700_000:
                        yield out(0, codes, n)
                        held, size = [], 0
        if held:
            yield out(0, *merged())
        if texts:
            seen = np.flatnonzero(pairs)
            yield out(1, seen, pairs[seen])
            yield out(2, np.array([_END]), np.array([texts]))

    return source.mapInArrow(released(run), "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def build_lexicon(counts: DataFrame, learn_from: DataFrame) -> Lexicon:
    """The lexicon from the counts of all training words, and registers from all training texts."""
    words = counts.where("kind = 0")
    told = {r["kind"]: r for r in counts.where("kind <> 1").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    ends = told[2]["n"] if 2 in told else 0
    total = (told[0]["n"] if 0 in told else 0) + ends
    distinct = (told[0]["v"] if 0 in told else 0) + (ends > 0)
    most = max(KNOWN, int(np.ceil(1 / LEAST_SHARE)))  # no more words can be of the head
    rows = words.where("n > 1").orderBy(F.desc("n"), "code").limit(most).select("code", "n").collect()
    codes = np.array([r["code"] for r in rows], dtype=np.int64).view(np.uint64)
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    head = int((n >= LEAST_SHARE * total).sum())
    tree = code_tree(np.concatenate([n[:head], [max(1, total - ends - int(n[:head].sum())), max(1, ends)]]), WORD_SHARE)
    letters = np.zeros(1 << 16, dtype=np.int64)
    for r in counts.where("kind = 1").collect():  # 2 ** 16 rows at most
        letters[r["code"]] = r["n"]
    order = np.argsort(codes)
    bits = min(MOST_BITS, max(LEAST_BITS, (int(letters.sum()) // SLOT_BYTES).bit_length()))
    return Lexicon(codes[order], n[order], order, tree, letter_trees(letters), total, distinct, ends, head, group_hints(learn_from, codes[: min(head, HINTS)]), bits, told_words(words, *rows[-1]) if len(rows) == most else np.zeros(0, dtype=np.uint8))


def told_words(words: DataFrame, code: int, n: int) -> np.ndarray:
    """A bitmap of all words that occur more than once and come behind this one, by count and then code."""
    rest = words.where((F.col("n") > 1) & ((F.col("n") < n) | (F.col("n") == n) & (F.col("code") > code))).select("code")
    many = rest.count()
    if not many:
        return np.zeros(0, dtype=np.uint8)
    bits = max(12, (TOLD_BITS * many - 1).bit_length())
    per = (1 << bits) // 8 // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(SLICES * per, dtype=np.uint8)
        for batch in batches:
            for slot in _told_slots(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(own, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(own[k * per : (k + 1) * per].tobytes(), 1) for k in range(SLICES)], pa.binary())], names=["slice", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) | np.frombuffer(zlib.decompress(body), dtype=np.uint8)
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())], names=["slice", "body"])

    schema = "slice int, body binary"
    out = np.zeros(SLICES * per, dtype=np.uint8)
    for r in rest.mapInArrow(released(run), schema).repartition(SLICES, "slice").mapInArrow(released(add), schema).collect():  # 2 to 4 bytes a word
        out[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(zlib.decompress(r["body"]), dtype=np.uint8)
    return out


def group_hints(source: DataFrame, codes: np.ndarray) -> np.ndarray:
    """Registers of the most frequent words, by the texts that they share."""
    k = len(codes)
    if not k:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(codes)
    ranked = codes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for t in slices(batch.column(0), LOWER):
                words = find_words(t, SPACED)
                place = np.minimum(np.searchsorted(ranked, words.code), k - 1)
                hit = ranked[place] == words.code
                often = np.zeros((t.n, k))
                np.add.at(often, (words.text[hit], order[place[hit]]), 1.0)
                often = np.sqrt(often)
                total += often.T @ often
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["cell", "x"])

    shared = np.zeros(k * k)
    for r in source.mapInArrow(released(run), "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():  # HINTS ** 2 rows
        shared[r["cell"]] = r["x"]
    return cluster(shared.reshape(k, k), REGISTERS)


def cluster(shared: np.ndarray, most: int) -> np.ndarray:
    """Groups of items by how far they share texts: the two groups most alike are merged until `most` are left
    and no two are more alike than not."""
    norm = np.sqrt(np.maximum(np.diag(shared), 1e-9))
    like = shared / norm[:, None] / norm
    groups = [[i] for i in range(len(like))]
    while len(groups) > 1:
        mean = np.array([[like[np.ix_(a, b)].mean() if a is not b else -1.0 for b in groups] for a in groups])
        i, j = divmod(int(mean.argmax()), len(groups))
        if len(groups) <= most and mean[i, j] < 0.5:
            break
        groups[min(i, j)] += groups.pop(max(i, j))
    out = np.zeros(len(like), dtype=np.int64)
    for g, own in enumerate(sorted(groups, key=min)):
        out[own] = g
    return out


def train(source: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, Mixer]:
    """Log-odds of all slots from the counts of all training texts, and the mixer."""
    context = source.sparkSession.sparkContext
    shared = context.broadcast(lexicon)
    bits = lexicon.bits
    per = (1 << bits) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, mixer = shared.value, Mixer()
        counts = np.zeros((1 << bits, 2), dtype=np.uint32)
        for t in block_slices(batches):
            learn(t, lexicon, counts, mixer)
        if mixer.seen.any():
            body = []
            for k in range(SLICES):
                own = counts[k * per : (k + 1) * per].reshape(-1)
                at = np.flatnonzero(own)
                body.append(zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + own[at].astype("<u4").tobytes(), 1))
            body.append(pickle.dumps((mixer.weights * mixer.seen[:, None], mixer.map_ones, mixer.map_all, mixer.seen)))
            for k, b in enumerate(body):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.binary())], names=["slice", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        learned: list = []
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == SLICES:
                    own = pickle.loads(body)
                    learned = [a + b for a, b in zip(learned, own, strict=True)] if learned else list(own)
                else:
                    at, n = np.frombuffer(zlib.decompress(body), dtype="<u4").reshape(2, -1)
                    sums = total.setdefault(k, np.zeros(2 * per, dtype=np.int64))
                    sums[np.cumsum(at, dtype=np.int64)] += n
        for k, v in total.items():
            body = zlib.compress(fine_odds(v[1::2], v[::2]).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([body], pa.binary())], names=["slice", "body"])
        if learned:
            yield pa.RecordBatch.from_arrays([pa.array([SLICES], pa.int32()), pa.array([pickle.dumps(tuple(learned))], pa.binary())], names=["slice", "body"])

    schema = "slice int, body binary"
    table, mixer = np.zeros(1 << bits, dtype=np.int8), Mixer()
    for r in source.mapInArrow(released(run), schema).repartition(SLICES + 1, "slice").mapInArrow(released(add), schema).collect():  # 2 ** bits bytes
        if r["slice"] == SLICES:
            weights, ones, every, seen = pickle.loads(r["body"])
            mixer.weights = np.where(seen[:, None] > 0, weights / np.maximum(seen, 1)[:, None], mixer.weights)
            mixer.map_ones, mixer.map_all, mixer.seen = ones, every, seen
        else:
            table[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(zlib.decompress(r["body"]), dtype=np.int8)
    return table, mixer


_SCORED = "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_bytes bigint, n_head bigint, head_logs double, score double, rest binary"


def score_texts(source: DataFrame, lexicon: Lexicon, table: np.ndarray, mixer: Mixer) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast((lexicon, table, mixer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            n_tokens, n_bytes, known, logs, score, rest = [], [], [], [], [], []
            for t in slices(batch.column(0), LOWER, BLOCK_BYTES):
                tokens, own = scorer.score(t)
                score.append(own)
                n_tokens.append(tokens.n_tokens)
                n_bytes.append(np.diff(t.offsets))
                known.append(tokens.known)
                logs.append(tokens.logs)
                rest.extend(tokens.rest)
            n = batch.num_rows
            if n:
                made = [np.concatenate(x) for x in (n_tokens, n_bytes, known, logs, score)]
                columns = [pa.array(np.arange(rid, rid + n)), batch.column(1), batch.column(2), pa.array(made[0]), pa.array(made[1]), pa.array(made[2].astype(np.int64)), pa.array(made[3]), pa.array(made[4]), pa.array(rest, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "held_out", "n_tokens", "n_bytes", "n_head", "head_logs", "score", "rest"])
            rid += n

    return source.mapInArrow(released(run), _SCORED)


def lm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col(named(doc_id)).cast("string"), F.lit(""))
    held = F.crc32(key.cast("binary")) % HELD_OUT_OF == HELD_OUT
    source = docs.select(F.col(named(text)).cast("string").alias("text"), F.col(named(doc_id)).cast("long").alias("doc_id"), held.alias("held_out"))
    learn_from = source.where(~F.col("held_out")).select("text")
    counts = staged(count_words(learn_from), "words")
    lexicon = build_lexicon(counts, learn_from)
    table, mixer = train(learn_from, lexicon)
    scored = staged(score_texts(source, lexicon, table, mixer), "scored")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rest:
                    codes, n = np.unique(np.frombuffer(rest, dtype=np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.full(len(codes), rid)), pa.array(n.astype(np.int64))], names=["code", "rid", "tf"])

    rare = scored.select("rid", "rest").mapInArrow(released(spread), "code bigint, rid bigint, tf bigint")
    found = rare.join(counts.where("kind = 0").select("code", "n"), "code")
    added = found.groupBy("rid").agg(F.sum("tf").alias("n_rare"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    space = float(np.log10(lexicon.total + lexicon.distinct + 1.0))
    joined = scored.drop("rest").join(added, "rid", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2.0))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
