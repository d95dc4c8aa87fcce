"""Grouped prefix join on word n-gram sets under a Jaccard threshold, and its connected components.

A document's set holds its distinct shingles of SIZE words (fewer words: the whole sequence as one).  Two
sets link when their Jaccard similarity reaches the threshold.  The join is exact:

1. A count sketch over the shingles of all documents gives their global order: rare first, ties by hash.
   Any fixed order keeps the prefix filter exact; this one keeps common passages out of prefixes.
2. One pass over the texts stores each document's class (equal sets), its group (identical prefix and
   size), its prefix, and a parity sketch of its set, two to four bits a shingle.
3. Groups meet in the buckets of their prefix shingles.  The length bound and the positional bound filter
   group pairs there.  A bucket of at most SMALL groups gives all its pairs; in a larger one each group is
   paired with one earlier one only, picked by a hash.  A shingle with very many rows is dealt out over
   several buckets, which all count as large.
4. Group pairs expand to their members.  The distance of two parity sketches is never more than the
   symmetric difference of the sets, so pairs that are too far apart are dropped without their sets.
5. The whole sets of what is left are made again from their texts, meet, and are verified; components of
   the links are found.
6. Large buckets are taken up again, as far as they hold more than one component: whoever is outside the
   main one meets all others of the bucket by sketch, in blocks of BLOCK rows.  First the nearest one is
   verified for each, then every pair left between components.  No link that could change a component
   is lost; a family of n copies that hang together costs n pairs, and one that does not costs
   comparisons of sketches inside tasks, not rows.

The count sketch has a size bound (2 ** MOST_BITS bytes), and so have the bitmaps that say which texts are
read again, and which rows may not stay as they are.  Nothing else is broadcast or collected.

Defined cases: null, empty or blank texts have an empty set, link with nothing and are their own component;
repeated rows are members of one class; rows without a doc_id get a null component, and never lend it to
others; an empty table gives an empty result; other columns play no part; long texts are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.llm.components import components
from tiergraph.llm.tables import named, released, small_batches, staged, unstage
from tiergraph.llm.textops import LOWER, SPACED, Texts, find_words, mix64, slices, windows

SIZE = 5
#: The threshold as a fraction.
NUM, DEN = 4, 5
#: Groups of a bucket that all meet; rows that a dealt-out shingle has in a bucket, roughly; rows of a block.
SMALL, HOT, BLOCK = 32, 1 << 15, 4096
LEAST_BITS, MOST_BITS, SLICES = 18, 24, 16
#: Bits of a parity sketch at least.
LEAST_WIDTH = 256


def _narrow(owner: np.ndarray) -> np.ndarray:
    """The same numbers in 16 bits if they fit, which stable sorts take much less time for."""
    return owner.astype(np.uint16) if len(owner) and owner.max() < 1 << 16 else owner


def shingle_sets(t: Texts, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of the distinct shingles, by text and then hash."""
    words = find_words(t, SPACED)
    at, code = windows(words, size)
    owner = words.text[at]
    many = words.per_text(t.n)
    few = np.flatnonzero((many > 0) & (many < size))
    if len(few):
        first = np.searchsorted(words.text, few)
        whole = np.full(len(few), 0x51ED270B, dtype=np.uint64)
        for k in range(size - 1):
            live = many[few] > k
            whole[live] = mix64(whole[live] * np.uint64(0xD6E8FEB86659FD93) + words.code[first[live] + k])
        owner, code = np.concatenate([owner, few]), np.concatenate([code, whole])
    order = np.argsort(code)
    order = order[np.argsort(_narrow(owner)[order], kind="stable")]
    owner, code = owner[order], code[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], code[new]


def _sums(owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """A hash of each text's set of codes."""
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(mix64(code ^ np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
    bound = np.searchsorted(owner, np.arange(n + 1))
    return mix64(total[bound[1:]] - total[bound[:-1]] + np.diff(bound).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefixes(owner: np.ndarray, code: np.ndarray, n: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) of the prefixes of sets, in the global order."""
    shift = np.uint64(65 - int(len(levels)).bit_length())
    order = np.argsort(levels[(code >> shift).astype(np.int64)], kind="stable")  # codes ascend within an owner
    order = order[np.argsort(_narrow(owner)[order], kind="stable")]
    place = np.arange(len(code)) - (np.cumsum(n) - n)[owner]
    front = place < (n - -(-NUM * n // DEN) + 1)[owner]
    return owner[front], code[order][front]


def parity(code: np.ndarray) -> bytes:
    """For each of some number of slots, whether an odd number of the set's shingles falls there."""
    width = LEAST_WIDTH
    while width < 2 * len(code):
        width *= 2
    bits = np.bincount((code & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they would be with fewer slots."""
    while rows.shape[-1] > words:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def sketch(rows: DataFrame, bits: int, codes) -> np.ndarray:
    """Counts of codes by their leading bits, over all rows, as levels: 0 none, else 1 + 8 * log2(count).

    `codes` turns a batch into arrays of codes.  Each task adds up its own counts, tasks' counts are added
    up slice by slice, and 2 ** bits bytes arrive.
    """
    per = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for c in codes(batch):
                np.add.at(total, (c >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(total[k * per : (k + 1) * per].tobytes(), 1) for k in range(SLICES)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(c), dtype=np.uint32)
                total[k] = total[k] + own if k in total else own.astype(np.int64)
        for k, v in total.items():
            level = np.where(v > 0, 1 + 8 * np.log2(np.maximum(v, 1)), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    out = np.zeros(1 << bits, dtype=np.uint8)
    for r in rows.mapInArrow(released(count), schema).repartition(SLICES, "slice").mapInArrow(released(add), schema).collect():  # 2 ** bits bytes
        out[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint8)
    return out


def _fits(n1, p1, n2, p2):
    """Length and positional bounds for pairs whose first common prefix shingle has these places."""
    return (NUM * np.maximum(n1, n2) <= DEN * np.minimum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) * (NUM + DEN) >= NUM * (n1 + n2))


def _near(distance, n1, n2):
    """Whether sets of these sizes can reach the threshold if at least so many shingles are in one of them only."""
    return (NUM + DEN) * distance <= (DEN - NUM) * (n1 + n2)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows with equal first columns of sorted batches, as arrays; only the open run is held.

    Runs of a single row inside a batch are passed over, as they make no pairs.
    """
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not len(columns[0]):
            continue
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])) + 1
        begins, ends = np.append(0, edges), np.append(edges, len(columns[0]))
        wanted = ends - begins > 1
        wanted[[0, -1]] = True  # these may go on in other batches
        for a, b in zip(begins[wanted].tolist(), ends[wanted].tolist(), strict=True):
            part = [c[a:b] for c in columns]
            if held and any(held[0][k][0] != part[k][0] for k in range(keys)):
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            held.append(part)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


_FOUND = "kind int, a bigint, b bigint, n bigint, place bigint"
_PAIR = "a bigint, b bigint"


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """Sorted batches as columns of `rows` rows or more, cut only between rows that differ in the first columns."""
    held: list[list[np.ndarray]] = []
    size, limit = 0, rows
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
        size += batch.num_rows
        if size >= limit:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])) + 1
            cut = int(edges[-1]) if len(edges) else 0
            if cut:
                yield [c[:cut] for c in columns]
            held, size = [[c[cut:] for c in columns]], size - cut
            limit = max(rows, 2 * size)
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _first_pairs(small: int):
    """From (token, salt, n, place, id) rows sorted in this order (place apart): kind 0 pairs, kind 1 rows of large buckets."""

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in columns)], names=["kind", "a", "b", "n", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_runs(batches, 2):
            token, salt, _, _, ident = columns
            again = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (ident[1:] == ident[:-1])
            token, salt, n, place, ident = (c[np.append(True, ~again)] for c in columns)
            begin = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
            many = np.diff(np.append(begin, len(token)))
            used = np.flatnonzero(np.repeat((many > 1) | (salt[begin] > 0), many))
            nth = (np.arange(len(token)) - np.repeat(begin, many))[used]
            large = np.repeat((many > small) | (salt[begin] > 0), many)[used]
            yield out(1, *(c[used[large]] for c in (token, ident, n, place)))
            # In a large bucket each row meets one earlier row, in a small one all of them.
            late = np.flatnonzero(large & (nth > 0))
            i = [used[late]]
            j = [i[0] - nth[late] + ((ident[i[0]] ^ token[i[0]]).view(np.uint64) % nth[late].astype(np.uint64)).astype(np.int64)]
            live, lag = np.flatnonzero(~large & (nth > 0)), 1
            while len(live):
                i.append(used[live])
                j.append(used[live] - lag)
                lag += 1
                live = live[nth[live] >= lag]
            i, j = np.concatenate(i), np.concatenate(j)
            good = _fits(n[i], place[i], n[j], place[j])
            x, y = ident[i[good]], ident[j[good]]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            none = np.zeros(len(pairs), dtype=np.int64)
            yield out(0, pairs[:, 0], pairs[:, 1], none, none)

    return released(run)


def _meet(nearest: bool):
    """From (token, rows, side, n, place, id, root, sketch) rows of blocks, in which side 0 meets side 1: pairs of
    unlike roots that sketches do not rule out, for each row of side 1 the nearest one or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, side, n, place, ident, root, sk in _runs(batches, 2):
            words = np.array([len(x) // 8 for x in sk])
            # Members by the width of their sketches, so that one operation compares a row with all of them.
            members = {w: np.flatnonzero((side == 0) & (words == w)) for w in np.unique(words[side == 0]).tolist()}
            table: dict[tuple[int, int], np.ndarray] = {}
            found: list[tuple[int, int]] = []
            for i in np.flatnonzero(side == 1).tolist():
                best: list[tuple[int, int]] = []
                for w, at in members.items():
                    if not words[i] // 2 <= w <= words[i] * 2:
                        continue  # sizes too far apart for a link
                    least = min(w, int(words[i]))
                    if (w, least) not in table:
                        table[w, least] = folded(np.frombuffer(b"".join(sk[at]), dtype="<u8").reshape(-1, w), least)
                    fits = _fits(n[at], place[at], n[i], place[i]) & (root[at] != root[i])
                    live = np.flatnonzero(fits)
                    if not len(live):
                        continue
                    own = folded(np.frombuffer(sk[i], dtype="<u8"), least)
                    distance = np.bitwise_count(table[w, least][live] ^ own).sum(1, dtype=np.int64)
                    near = _near(distance, n[at[live]], n[i])
                    best.extend(zip(distance[near].tolist(), at[live[near]].tolist(), strict=True))
                found.extend((i, j) for _, j in ([min(best)] if nearest and best else best))
            if found:
                i, j = np.array(found).T
                own = np.unique(np.stack([np.minimum(ident[i], ident[j]), np.maximum(ident[i], ident[j])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())], names=["a", "b"])

    return released(run)


def text_hash(text: str) -> Column:
    """Equal for equal texts."""
    return F.xxhash64(F.col(text).cast("string"))


class _Join:
    """One run of the join over a table of documents."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.docs = docs.select(F.col(named(doc_id)).cast("long").alias("doc_id"), F.col(named(text)).cast("string").alias("text")).withColumn("th", text_hash("text"))
        self.texts = self.docs.select("text")
        self.bits = min(MOST_BITS, max(LEAST_BITS, (8 * docs.count()).bit_length()))
        levels = sketch(self.texts, self.bits, lambda batch: (shingle_sets(t)[1] for t in slices(batch.column(0), LOWER)))
        self.levels: Broadcast = self.spark.sparkContext.broadcast(levels)

    def classes(self) -> DataFrame:
        """(doc_id, th, n, cls, grp, prefix, sketch) of all documents; the last four are null for empty sets.

        th tells equal texts.  A task gives the prefix of a group and the sketch of a class once.
        """
        levels = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups: set[int] = set()
            known: set[int] = set()
            for batch in batches:
                doc_ids, th, at = batch.column(0), batch.column(2), 0
                for t in slices(batch.column(1), LOWER):
                    owner, code = shingle_sets(t)
                    n = np.bincount(owner, minlength=t.n).astype(np.int64)
                    cls = _sums(owner, code, t.n).view(np.int64)
                    front, shingle = prefixes(owner, code, n, levels.value)
                    grp = mix64(_sums(front, shingle, t.n) + n.astype(np.uint64)).view(np.int64)
                    bound, cut = np.searchsorted(owner, np.arange(t.n + 1)).tolist(), np.searchsorted(front, np.arange(t.n + 1)).tolist()
                    prefix, parities = [None] * t.n, [None] * t.n
                    for i, (many, c, g) in enumerate(zip(n.tolist(), cls.tolist(), grp.tolist(), strict=True)):
                        if many and c not in known:
                            known.add(c)
                            parities[i] = parity(code[bound[i] : bound[i + 1]])
                            if g not in groups:
                                groups.add(g)
                                prefix[i] = shingle[cut[i] : cut[i + 1]].tobytes()
                    if len(known) > 200_000:
                        known.clear()
                        groups.clear()
                    columns = [doc_ids[at : at + t.n], th[at : at + t.n], pa.array(n), pa.array(cls, mask=n == 0), pa.array(grp, mask=n == 0), pa.array(prefix, pa.binary()), pa.array(parities, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "cls", "grp", "prefix", "sketch"])
                    at += t.n

        return self.docs.mapInArrow(released(run), "doc_id bigint, th bigint, n bigint, cls bigint, grp bigint, prefix binary, sketch binary")

    def tokens(self, known: DataFrame) -> DataFrame:
        """(token, salt, n, place, id) of the prefixes; shingles with very many rows get salts from 1 on."""
        levels, bits, hot = self.levels, self.bits, HOT

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.append(0.0, np.exp2(np.arange(255) / 8))  # by level
            mean = count @ np.bincount(levels.value, minlength=256) / len(levels.value)
            parts = np.where(count > hot + 2 * mean, np.ceil(count / hot), 1).astype(np.uint64)
            for batch in batches:
                held = batch.column(0).to_pylist()
                if not held:
                    continue
                many = np.array([len(x) // 8 for x in held])
                owner = np.repeat(np.arange(len(held)), many)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                code = np.frombuffer(b"".join(held), dtype=np.uint64)
                n, ident = (batch.column(i).to_numpy()[owner] for i in (1, 2))
                part = parts[levels.value[(code >> np.uint64(64 - bits)).astype(np.int64)]]
                salt = np.where(part > 1, 1 + mix64(ident.view(np.uint64)) % part, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code.view(np.int64), salt, n, place, ident)], names=["token", "salt", "n", "place", "id"])

        return known.where("prefix IS NOT NULL").select("prefix", "n", "grp").mapInArrow(released(run), "token bigint, salt int, n bigint, place bigint, id bigint")

    def sets(self, wanted: np.ndarray) -> DataFrame:
        """(cls, codes) of the texts whose slot is wanted, each class once per task."""
        shared, bits = self.spark.sparkContext.broadcast(np.packbits(wanted > 0)), self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = np.unpackbits(shared.value).astype(bool)
            seen: set[int] = set()
            for batch in batches:
                th = batch.column(1).to_numpy().view(np.uint64)
                live = [i for i in np.flatnonzero(slots[(th >> np.uint64(64 - bits)).astype(np.int64)]).tolist() if int(th[i]) not in seen]
                seen.update(th[live].tolist())
                if len(seen) > 200_000:
                    seen.clear()
                for t in slices(batch.column(0).take(pa.array(live, pa.int64())), LOWER):
                    owner, code = shingle_sets(t)
                    cut = np.searchsorted(owner, np.arange(t.n + 1)).tolist()
                    cls = _sums(owner, code, t.n).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([code[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["cls", "codes"])

        return self.docs.select("text", "th").mapInArrow(released(run), "cls bigint, codes binary")

    def keep(self, known: DataFrame, classes: DataFrame) -> DataFrame:
        """(cls, codes): the whole sets of these classes (and of some more), stored."""
        texts = known.select("cls", "th").join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("th").alias("th")).select("th")
        wanted = sketch(texts, self.bits, lambda batch: [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
        return staged(self.sets(wanted).groupBy("cls").agg(F.first("codes").alias("codes")), "sets")


def _near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that the sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n1, one, n2, two in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(one, dtype="<u8"), np.frombuffer(two, dtype="<u8")
                least = min(len(x), len(y))
                good.append(bool(_near(int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum()), n1, n2)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    a, b = sketches.toDF("a", "na", "sa"), sketches.toDF("b", "nb", "sb")
    met = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "sa", "nb", "sb")
    return met.mapInArrow(released(run), _PAIR)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(one, dtype=np.uint64), np.frombuffer(two, dtype=np.uint64)]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(DEN * shared >= NUM * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    met = pairs.join(sets.toDF("a", "ca"), "a").join(sets.toDF("b", "cb"), "b").select("a", "b", "ca", "cb")
    return met.mapInArrow(released(run), _PAIR)


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "id").mapInArrow(_first_pairs(SMALL), _FOUND)


def _between(rows: DataFrame, roots: DataFrame, sketches: DataFrame, nearest: bool) -> DataFrame:
    """Pairs between components inside large buckets, from (token, n, place, id) rows."""
    rooted = rows.join(roots.withColumnRenamed("vertex", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    parts = rooted.groupBy("token", "root").agg(F.count("*").alias("m"))
    buckets = parts.groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("rows"), (F.sum("m") - F.max("m")).alias("outside")).where("outside > 0")
    live = rooted.join(buckets, "token").join(sketches.select(F.col("cls").alias("id"), "sketch"), "id")
    spread = F.xxhash64("id")
    n_rows, n_outside = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("rows", "outside"))
    own, other = F.pmod(spread, n_rows.cast("long")).cast("int"), F.pmod(spread, n_outside.cast("long")).cast("int")
    # Every row meets every block of outsiders, and each outsider every block of rows.
    all_rows = live.withColumn("outer", F.explode(F.sequence(F.lit(0), n_outside - 1))).withColumn("block", own * n_outside + F.col("outer")).withColumn("side", F.lit(0))
    outsiders = live.where("root <> main").withColumn("inner", F.explode(F.sequence(F.lit(0), n_rows - 1))).withColumn("block", F.col("inner") * n_outside + other).withColumn("side", F.lit(1))
    columns = ["token", "block", "side", "n", "place", "id", "root", "sketch"]
    blocks = all_rows.select(*columns).union(outsiders.select(*columns)).repartition("token", "block").sortWithinPartitions("token", "block")
    return blocks.mapInArrow(_meet(nearest), _PAIR).distinct()


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, th, n, cls and more), th being text_hash of the text and cls null without words; and the
    components (vertex, root) of the classes that have links.  Both are stored, and nothing else stays stored."""
    join = _Join(docs, text, doc_id)
    known = staged(join.classes(), "classes")
    members = known.where("cls IS NOT NULL").select("grp", "cls", "n").distinct()
    many = members.groupBy("grp").agg(F.count("*").alias("many"))
    members = staged(members.join(many, "grp"), "members")

    found = staged(_bucketed(join.tokens(known)), "found")
    # Members of one group are candidates of each other: a bucket of their own.
    inner = members.where("many > 1").select(F.col("grp").alias("token"), F.lit(0).alias("salt"), "n", F.lit(0).cast("bigint").alias("place"), F.col("cls").alias("id"))
    within = staged(_bucketed(inner), "found")
    side = members.select("grp", "cls", "n", "many")
    met = found.where("kind = 0").select("a", "b").distinct().join(side.toDF("a", "ca", "na", "ma"), "a")
    few = met.join(many.toDF("b", "mb"), "b").where(F.col("ma") * F.col("mb") <= SMALL * SMALL).select("a", "b", "ca")
    across = few.join(side.toDF("b", "cb", "nb", "mb"), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    tried = staged(across.union(within.where("kind = 0").select("a", "b")).distinct(), "pairs")
    # Two groups with too many pairs of members are a large bucket; so are the buckets of many groups.
    wide = found.where("kind = 0").select("a", "b").distinct().join(many.toDF("a", "ma"), "a").join(many.toDF("b", "mb"), "b").where(F.col("ma") * F.col("mb") > SMALL * SMALL)
    wide = wide.select(F.xxhash64("a", "b").alias("token"), F.explode(F.array("a", "b")).alias("grp"), F.lit(0).cast("bigint").alias("place"))
    large = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("grp"), "place").union(wide.select("token", "grp", "place"))
    rows = large.join(side, "grp").select("token", "n", "place", F.col("cls").alias("id"))
    rows = staged(rows.union(within.where("kind = 1").select(F.col("a").alias("token"), "n", "place", F.col("b").alias("id"))), "large")
    unstage(found, within, members)

    paired = tried.select(F.col("a").alias("cls")).union(tried.select("b")).union(rows.select("id")).distinct()
    sketches = staged(known.where("sketch IS NOT NULL").select("cls", "n", "sketch").join(paired, "cls", "left_semi").groupBy("cls", "n").agg(F.first("sketch").alias("sketch")), "sketches")
    near = staged(_near_pairs(tried, sketches), "near")
    sets = join.keep(known, near.select(F.col("a").alias("cls")).union(near.select("b")).union(rows.select("id")).distinct())
    links = staged(_verified(near, sets), "links")
    roots = components(links)
    stored = [tried, rows, sketches, near, sets, links]
    # Large buckets again: first the nearest partner of whoever is outside, then all that is left between components.
    for nearest in (True, False) if not rows.isEmpty() else ():
        fresh = staged(_between(rows, roots, sketches, nearest).join(tried, ["a", "b"], "left_anti"), "pairs")
        stored.append(fresh)
        if fresh.isEmpty():
            continue
        tried = tried.union(fresh)
        more = staged(_verified(fresh, sets), "links")
        stored.append(more)
        if not more.isEmpty():
            links = links.union(more)
            stored.append(roots)
            roots = components(links)
    unstage(*stored)

    return known, roots


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    known, roots = linked(docs, text, doc_id)
    least = known.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = staged(least, "least")
    top = least.groupBy("root").agg(F.min("least").alias("component_id"))
    out = known.select("doc_id", "n", "cls").join(least.join(top, "root").select("cls", "component_id"), "cls", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of one document of each component: the one with the smallest doc_id, rows without one last.

    Of repeated rows (one doc_id, one text) one stays; rows without words, which link with nothing, all stay.
    """
    known, roots = linked(docs, text, doc_id)
    rooted = known.where("cls IS NOT NULL").join(roots.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rows = staged(rooted.groupBy("doc_id", "th").agg(F.min("root").alias("root"), F.count("*").alias("many")), "rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    kept = rows.groupBy("root").agg(best.alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th"))
    told = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th")), "left")
    other = staged(told.where("kept_th IS NULL OR many > 1").select("doc_id", "th", F.col("kept_th").isNotNull().alias("again")), "other")
    unstage(known, roots, rows)
    keyed = docs.select(F.struct(*[F.col(named(c)) for c in docs.columns]).alias("row"), F.col(named(doc_id)).cast("long").alias("d"), text_hash(named(text)).alias("t"))
    # Only rows that a bitmap of the others' keys does not rule out are joined with them, so other texts stay where they are.
    key, bits = F.xxhash64("d", "t"), min(MOST_BITS, max(LEAST_BITS, (64 * other.count()).bit_length()))
    wanted = sketch(other.select(F.xxhash64("doc_id", "th")), bits, lambda batch: [batch.column(0).to_numpy().view(np.uint64)])
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted > 0))

    @F.arrow_udf("boolean")
    def hit(keys: pa.Array) -> pa.Array:
        slot = (keys.to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        return pa.array(shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1)

    match = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))
    alone = keyed.where(hit(key)).join(other, match, "left_anti")
    again = keyed.where(hit(key)).join(other.where("again"), match, "left_semi").dropDuplicates(["d", "t"])
    return keyed.where(~hit(key)).union(alone).union(again).select("row.*")
