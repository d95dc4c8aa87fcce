"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are encoded and, if longer than the capacity, cut into full pieces with the rest in front.  The
histogram of piece lengths (at most `capacity` rows) goes to the driver, where best-fit decreasing runs on
counts: all pieces of one length are placed together into groups of like sequences, each time the group
with the least room that still fits.  The plan is a list of placements, whose number depends on the number
of lengths and not on the corpus.  Pieces take the planned slots by their rank within their length.

Ranks need no task that sees a whole length: within (length, bucket) they come from a window, and the
buckets of a length are added up from counts, so a length that a third of all pieces share is dealt out.

Defined cases: a null text counts as empty (one id, the end); rows that share a doc_id are packed each;
an empty table gives an empty result; other columns and their names play no part; very long texts become
many pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiergraph.llm.tables import named, released, small_batches, staged
from tiergraph.llm.tokens import encoder

CAPACITY = 2048
#: Pieces per bucket of a length, roughly, and buckets at most.
BUCKET_ROWS, BUCKETS = 20_000, 4096


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements (length, first rank, number, first sequence, offset, sequences) and the number of sequences.

    The i-th of a placement's pieces goes to sequence first + i % sequences, at offset + i // sequences * length.
    """
    rooms: list[int] = []  # rooms left that some group has, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: groups (first sequence, sequences)
    placements = []
    opened = 0

    def add(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, many))

    def put(length: int, rank: int, count: int, first: int, many: int, room: int) -> int:
        """Fill sequences of a group with as many pieces as go; returns how many were placed."""
        each = room // length
        full = min(many, count // each)
        if full:
            placements.append((length, rank, full * each, first, capacity - room, full))
            add(room - each * length, first, full)
            rest = (first + full, many - full)
            placed = full * each
        else:
            placements.append((length, rank, count, first, capacity - room, 1))
            add(room - count * length, first, 1)
            rest = (first + 1, many - 1)
            placed = count
        add(room, *rest)
        return placed

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while rank < count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
                rank += put(length, rank, count - rank, first, many, room)
            else:
                many = -(-(count - rank) // (capacity // length))
                opened += many
                rank += put(length, rank, count - rank, opened - many, many, capacity)
    return placements, opened


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be shorter."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces with doc_id, piece, start, length, ids_crc32 (and ids as little-endian u32, if asked for)."""
    small_batches(docs.sparkSession)
    ends = np.array([end_id], dtype="<u4").tobytes()
    source = docs.select(F.col(named(doc_id)).cast("long").alias("doc_id"), F.col(named(text)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer, kind)
        for batch in batches:
            rows: list[tuple] = []
            for d, body in zip(batch.column(0).to_pylist(), model.encode(batch.column(1)), strict=True):
                body += ends
                for k, (s, n) in enumerate(cut(len(body) // 4, capacity)):
                    own = body[4 * s : 4 * (s + n)]
                    rows.append((d, k, s, n, zlib.crc32(own), *[own] * ids))
            columns = list(zip(*rows, strict=True)) or [()] * (5 + ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    return source.mapInArrow(released(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids)


def place(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of a stored table of pieces its sequence_id and offset."""
    spark = cut_up.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    placements, _ = plan(histogram, capacity)
    n_buckets = int(min(BUCKETS, max(16, -(-sum(histogram.values()) // BUCKET_ROWS))))
    dealt = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(own) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("nth") + F.col("before"))
    slots = spark.createDataFrame(placements, "length bigint, first_rank bigint, number bigint, first_sequence bigint, first_offset bigint, sequences bigint")
    joined = ranked.join(F.broadcast(slots), "length").where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number")))
    nth = F.col("rank") - F.col("first_rank")
    return joined.withColumn("sequence_id", F.col("first_sequence") + nth % F.col("sequences")).withColumn("offset", F.col("first_offset") + F.expr("(rank - first_rank) div sequences") * F.col("length")).select(*cut_up.columns, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, tokenizer: str, kind: str, end_id: int, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; see the module's text for odd cases."""
    return place(staged(pieces(docs, tokenizer, kind, end_id, text, doc_id, capacity, ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, n_ids, ids (little-endian u32)."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), rows.alias("rows"))  # `capacity` ids at most
    return joined.select("sequence_id", "n_ids", F.expr("aggregate(rows.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))
