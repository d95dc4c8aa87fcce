"""Token ids in patched frame-of-reference blocks.

File format.  The ids of all documents, in ascending doc_id order, are one sequence, cut into segments of
whole documents (SEGMENT_IDS ids or one longer document).  Each row of the table written is a segment:

    part, segment      place in the order; rows of a part are consecutive
    doc_ids, lengths   the segment's documents and their numbers of ids
    local_start        ids before the segment within its part
    n_ids, starts      number of ids; byte offset of every block, as little-endian u32 (the index)
    payload            the blocks

A block holds BLOCK ids (the last one fewer): u32 minimum, u8 width, u8 number of exceptions, then the
differences from the minimum packed at `width` bits, lowest bits first, then for each exception u8 its
position and u32 its difference.  The width is that of the PERCENTILE-th percentile of the differences, so
that a few large ones do not widen the block; they stay in the exception list.

Documents go to parts by doc_id ranges, so nothing is sampled twice and no task holds more than one
segment; ids before a part come from the parts' totals (PARTS at most).

Defined cases: null text counts as empty (one id, the end); rows with a null doc_id come first; rows that
share a doc_id stand next to each other, ordered by their ids' checksum; empty tables give empty files and
an empty result; other columns are not written; very long texts are one segment each.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiergraph.llm.tables import named, shared_folder, released, small_batches
from tiergraph.llm.tokens import encoder

BLOCK, PERCENTILE, SEGMENT_IDS = 128, 90, 1 << 19
DOCS_PER_PART, PARTS = 1024, 1 << 16

_WIDE = np.dtype("<u4")


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Blocks and the index of their starts."""
    n = len(ids)
    if not n:
        return b"", b""
    count = -(-n // BLOCK)
    grid = np.full(count * BLOCK, ids[-1], dtype=np.int64)
    grid[:n] = ids
    grid = grid.reshape(count, BLOCK)
    low = grid.min(1)
    delta = grid - low[:, None]
    typical = np.sort(delta, axis=1)[:, (BLOCK * PERCENTILE) // 100]
    width = np.ceil(np.log2(typical + 1)).astype(np.int64)
    odd = delta >= (np.int64(1) << width)[:, None]
    n_odd = odd.sum(1)
    used = np.full(count, BLOCK)
    used[-1] = n - (count - 1) * BLOCK
    size = 6 + -(-used * width // 8) + 5 * n_odd
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], dtype=np.uint8)
    head = np.zeros((count, 6), dtype=np.uint8)
    head[:, :4] = low.astype(_WIDE).view(np.uint8).reshape(count, 4)
    head[:, 4], head[:, 5] = width, n_odd
    out[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width[width > 0]):
        for last in (False, True):
            rows = np.flatnonzero((width == w) & ((np.arange(count) == count - 1) == last))
            if not len(rows):
                continue
            k = int(used[rows[0]])
            bits = np.unpackbits(delta[rows, :k].astype(_WIDE).view(np.uint8).reshape(len(rows), k, 4), axis=2, bitorder="little")[:, :, :w]
            body = np.packbits(bits.reshape(len(rows), k * int(w)), axis=1, bitorder="little")
            out[starts[rows, None] + 6 + np.arange(body.shape[1])] = body
    row, col = np.nonzero(odd)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(n_odd) - n_odd)[row]
        at = starts[row + 1] - 5 * n_odd[row] + 5 * nth
        out[at] = col
        out[at[:, None] + np.arange(1, 5)] = delta[row, col].astype(_WIDE).view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts[:-1].astype(_WIDE).tobytes()


def unpack(payload: bytes, index: bytes, n: int) -> np.ndarray:
    """The ids of a segment."""
    data, starts = np.frombuffer(payload, dtype=np.uint8), np.frombuffer(index, dtype=_WIDE).astype(np.int64)
    count = len(starts)
    if not count:
        return np.zeros(0, dtype=_WIDE)
    head = data[starts[:, None] + np.arange(6)]
    low = np.ascontiguousarray(head[:, :4]).view(_WIDE).ravel().astype(np.int64)
    width, n_odd = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    used = np.full(count, BLOCK)
    used[-1] = n - (count - 1) * BLOCK
    delta = np.zeros((count, BLOCK), dtype=np.int64)
    for w in np.unique(width[width > 0]):
        for last in (False, True):
            rows = np.flatnonzero((width == w) & ((np.arange(count) == count - 1) == last))
            if not len(rows):
                continue
            k, w = int(used[rows[0]]), int(w)
            body = data[starts[rows, None] + 6 + np.arange(-(-k * w // 8))]
            bits = np.zeros((len(rows), k, 32), dtype=np.uint8)
            bits[:, :, :w] = np.unpackbits(body, axis=1, bitorder="little")[:, : k * w].reshape(len(rows), k, w)
            delta[rows, :k] = np.packbits(bits, axis=2, bitorder="little").reshape(len(rows), -1).view(_WIDE)
    if n_odd.any():
        row = np.repeat(np.arange(count), n_odd)
        nth = np.arange(len(row)) - (np.cumsum(n_odd) - n_odd)[row]
        at = starts[row] + 6 + -(-used[row] * width[row] // 8) + 5 * nth
        delta[row, data[at]] = np.ascontiguousarray(data[at[:, None] + np.arange(1, 5)]).view(_WIDE).ravel()
    return (delta + low[:, None]).ravel()[:n].astype(_WIDE)


_SEGMENTS = "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, local_start bigint, n_ids bigint, starts binary, payload binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> str:
    """Encode the documents, append end_id to each, and write segments to `path`."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(named(doc_id)).cast("long").alias("doc_id"), F.col(named(text)).cast("string").alias("text"))
    n_parts = min(PARTS, max(1, -(-source.count() // DOCS_PER_PART)))
    bounds: list[int] = []
    if n_parts > 1:
        steps = [k / n_parts for k in range(1, n_parts)]
        bounds = source.agg(F.percentile_approx("doc_id", steps, 20 * n_parts)).first()[0] or []  # PARTS numbers at most
    shared = spark.sparkContext.broadcast(np.unique(np.array(bounds, dtype=np.int64)))
    ends = np.array([end_id], dtype=_WIDE).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer, kind)
        for batch in batches:
            ids = [x + ends for x in model.encode(batch.column(1))]
            where = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            part = np.searchsorted(shared.value, where, side="right").astype(np.int32)
            small = [np.frombuffer(x, dtype=_WIDE) for x in ids]
            narrow = [x.astype("<u2").tobytes() if len(x) and x.max() < 65536 else b"" for x in small]
            wide = [None if y else x for x, y in zip(ids, narrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([y or None for y in narrow], pa.binary()), pa.array(wide, pa.binary())], names=["doc_id", "part", "crc", "narrow", "wide"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, local, held, doc_ids = None, 0, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal segment, local
            ids = np.concatenate(held)
            payload, starts = pack(ids)
            row = [[part], [segment], [doc_ids], [[len(x) for x in held]], [local], [len(ids)], [starts], [payload]]
            segment, local = segment + 1, local + len(ids)
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["part", "segment", "doc_ids", "lengths", "local_start", "n_ids", "starts", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        size = 0
        for batch in batches:
            for d, p, narrow, wide in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(narrow, dtype="<u2").astype(_WIDE) if wide is None else np.frombuffer(wide, dtype=_WIDE)
                if held and (p != part or size + len(ids) > SEGMENT_IDS):
                    yield close()
                    held, doc_ids, size = [], [], 0
                if p != part:
                    part, segment, local = p, 0, 0
                held.append(ids)
                doc_ids.append(d)
                size += len(ids)
        if held:
            yield close()

    encoded = source.mapInArrow(released(encode), "doc_id bigint, part int, crc bigint, narrow binary, wide binary")
    dealt = encoded.repartition(F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "crc")
    dealt.select("doc_id", "part", "narrow", "wide").mapInArrow(released(segments), _SEGMENTS).write.option("compression", "none").parquet(path)
    return path


def read_ids(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32 (and the ids, if asked for)."""
    small_batches(spark)
    files = spark.read.schema(_SEGMENTS).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # PARTS rows at most

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = unpack(row["payload"], row["starts"], row["n_ids"])
                ends = np.cumsum(row["lengths"])
                firsts = ends - row["lengths"]
                bodies = [data[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)]
                columns = [
                    pa.array(np.full(len(ends), row["part"], dtype=np.int32)),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(firsts + row["local_start"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(x) for x in bodies], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([np.frombuffer(x, dtype=_WIDE).astype(np.int64) for x in bodies], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "local", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    read = files.select("part", "doc_ids", "lengths", "local_start", "n_ids", "starts", "payload").mapInArrow(released(decode), schema)
    out = read.join(F.broadcast(before), "part").withColumn("start", F.col("local") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tiergraph/ids-{uuid.uuid4().hex}"
