"""Versions over time: frames of truth values, mutation logs, backup chains."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.schema import Graph, GraphError

#: Opcodes of the binary log.
OPS = {0x01: "truth", 0x02: "rank", 0x03: "lut"}
CHECKPOINT = 0xF0


def changes(frames: DataFrame, every: int) -> DataFrame:
    """What is stored of (tick, node_id, truth): all rows of every `every`-th tick, else changed ones."""
    from pyspark.sql.window import Window

    before = F.lag("truth").over(Window.partitionBy("node_id").orderBy("tick"))
    return frames.withColumn("before", before).where((F.col("tick") % every == 0) | F.col("before").isNull() | (F.col("before") != F.col("truth"))).select("tick", "node_id", "truth")


def state_at(stored: DataFrame, tick: int, every: int) -> DataFrame:
    """(node_id, truth) at a tick; one beyond the end gives the last state."""
    last = stored.agg(F.max("tick")).first()[0]
    if last is None:
        return stored.select("node_id", "truth")
    tick = min(tick, last)
    key = tick // every * every
    return stored.where(F.col("tick").between(key, tick)).groupBy("node_id").agg(F.max_by("truth", "tick").alias("truth"))


def xor_state(deltas: DataFrame, tick: int, every: int) -> DataFrame:
    """(cell, value) from a chain of keyframes and exclusive-or frames (tick, cell, value)."""
    key = tick // every * every
    return deltas.where(F.col("tick").between(key, tick)).groupBy("cell").agg(F.bit_xor("value").alias("value"))


def recent(frames: DataFrame, capacity: int) -> DataFrame:
    """What a ring buffer of so many ticks still holds."""
    last = frames.agg(F.max("tick").alias("last"))
    return frames.join(F.broadcast(last), F.col("tick") > F.col("last") - capacity).drop("last")  # one row


def replay(graph: Graph, log: DataFrame) -> Graph:
    """Apply a mutation log (seq, op, node_id, value) from after its last checkpoint; the last write wins.

    op is truth, rank, lut or checkpoint; others are skipped.
    """
    mark = log.where("op = 'checkpoint'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("mark"))
    live = log.join(F.broadcast(mark), F.col("seq") > F.col("mark")).where(F.col("op").isin(list(OPS.values())))  # one row
    last = live.groupBy("node_id").agg(*[F.max_by(F.when(F.col("op") == c, F.col("value")), F.when(F.col("op") == c, F.col("seq"))).alias(f"new_{c}") for c in OPS.values()])
    joined = graph.nodes.join(last, "node_id", "left")
    kinds = dict(graph.nodes.dtypes)
    return graph.with_nodes(joined.select(*[F.coalesce(F.col(f"new_{c}").cast(kinds[c]), F.col(c)).alias(c) if c in OPS.values() else F.col(c) for c in graph.nodes.columns]))


def encode_log(rows: list[tuple[str, int, int]], n_nodes: int) -> bytes:
    """The binary log of (op, node_id, value); a checkpoint's value is its epoch."""
    codes = {v: k for k, v in OPS.items()}
    out = [b"DAGW" + struct.pack("<3I", 1, n_nodes, 0)]
    for op, node, value in rows:
        if op == "checkpoint":
            body = bytes([CHECKPOINT]) + struct.pack("<Q", value)
        else:
            body = bytes([codes[op]]) + struct.pack("<I", node) + (struct.pack("<B", value) if op == "truth" else struct.pack("<Q", value & (1 << 64) - 1))
        out.append(struct.pack("<I", len(body) - 1) + body)
    return b"".join(out)


def decode_log(spark: SparkSession, data: bytes) -> DataFrame:
    """(seq, op, node_id, value); a torn last record and unknown opcodes are left out."""
    if data[:4] != b"DAGW":
        raise GraphError("bad_format", "not a log")
    rows, at, seq = [], 16, 0
    while at + 5 <= len(data):
        (size,) = struct.unpack_from("<I", data, at)
        if at + 5 + size > len(data):
            break
        op, body = data[at + 4], data[at + 5 : at + 5 + size]
        at += 5 + size
        if op == CHECKPOINT:
            rows.append((seq, "checkpoint", None, None))
        elif op in OPS and size >= 5:
            node, value = struct.unpack_from("<I", body)[0], int.from_bytes(body[4:], "little", signed=len(body) == 12)
            rows.append((seq, OPS[op], node, value))
        seq += 1
    return spark.createDataFrame(rows, "seq bigint, op string, node_id bigint, value bigint")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` that `old` lacks or has with other values, and keys that went (gone)."""
    values = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("was"))
    b = new.select(*keys, F.struct(*values).alias("now"))
    both = a.join(b, keys, "full").where("NOT (was <=> now)")
    return both.select(*keys, *[F.col(f"now.{v}").alias(v) for v in values], F.col("now").isNull().alias("gone"))


class Backup:
    """A base and numbered differences in one folder, as Parquet."""

    KEYS = {"nodes": ["node_id"], "edges": ["dst", "slot"]}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, seq: int, part: str, rows: DataFrame) -> None:
        rows.withColumn("seq", F.lit(seq).cast("bigint")).coalesce(8).write.mode("overwrite").parquet(f"{self.path}/{part}/{seq:06d}")

    def _chain(self, part: str, seq: int) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{part}/{k:06d}" for k in range(seq + 1)])

    def last(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/info").agg(F.max("seq")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raise GraphError("no_backup", self.path) from None

    def _note(self, seq: int, mode: str) -> None:
        self.spark.createDataFrame([(seq,)], "seq bigint").write.mode(mode).parquet(f"{self.path}/info")

    def init(self, graph: Graph) -> None:
        """Begin anew."""
        for part in self.KEYS:
            self._write(0, part, getattr(graph, part).withColumn("gone", F.lit(False)))
        self._note(0, "overwrite")

    def append(self, graph: Graph) -> int:
        seq = self.last() + 1
        tip = self.restore()
        for part, keys in self.KEYS.items():
            now = getattr(graph, part)
            self._write(seq, part, diff(getattr(tip, part).select(now.columns), now, keys))
        self._note(seq, "append")
        return seq

    def restore(self, seq: int | None = None) -> Graph:
        """The latest row of every key, up to a number."""
        seq = self.last() if seq is None else seq
        out = {}
        for part, keys in self.KEYS.items():
            rows = self._chain(part, seq)
            values = [c for c in rows.columns if c not in (*keys, "seq")]
            newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "seq").alias("v")).where("NOT v.gone")
            out[part] = newest.select(*keys, *[F.col(f"v.{v}").alias(v) for v in values if v != "gone"])
        return Graph(out["nodes"].select("node_id", "rank", "truth", "node_type", "lut"), out["edges"].select("dst", "slot", "src", "weight"))

    def compact(self) -> None:
        """Fold the chain into a new base."""
        from tiergraph.schema import stored

        tip = self.restore()
        self.init(Graph(stored(tip.nodes), stored(tip.edges)))

    def info(self) -> DataFrame:
        """(seq, part, rows) of the chain."""
        parts = [self._chain(p, self.last()).groupBy("seq").agg(F.count("*").alias("rows")).select("seq", F.lit(p).alias("part"), "rows") for p in self.KEYS]
        return parts[0].unionByName(parts[1])


def encode_frames(frames: list[np.ndarray], rank: np.ndarray, lut: np.ndarray, kind: np.ndarray, every: int, max_rank: int) -> bytes:
    """The binary truth series: static columns, then keyframes and exclusive-or frames, each deflated."""
    n = len(rank)
    pattern = lut.astype(np.int64).view(np.uint64)
    out = [b"DAGB" + struct.pack("<IB3xII", n, max_rank, len(frames), every)]
    out += [rank.astype("<u1").tobytes(), (pattern & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (pattern >> np.uint64(32)).astype("<u4").tobytes(), kind.astype("<u1").tobytes()]
    before = np.zeros(n, dtype=np.uint8)
    for k, frame in enumerate(frames):
        now = frame.astype(np.uint8)
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress((now if k % every == 0 else now ^ before).tobytes()) + packer.flush()
        out.append(struct.pack("<I", len(body)) + body)
        before = now
    return b"".join(out)


def decode_frames(spark: SparkSession, data: bytes) -> DataFrame:
    """(tick, node_id, truth) of a binary truth series."""
    if data[:4] != b"DAGB":
        raise GraphError("bad_format", "not a truth series")
    n, _, count, every = struct.unpack("<IB3xII", data[4:20])
    at, before, rows = 20 + n * 10, np.zeros(n, dtype=np.uint8), []
    for k in range(count):
        (size,) = struct.unpack_from("<I", data, at)
        now = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size], -15), dtype=np.uint8)
        at += 4 + size
        before = now if k % every == 0 else now ^ before
        rows += [(k, i, int(v)) for i, v in enumerate(before)]
    return spark.createDataFrame(rows, "tick bigint, node_id bigint, truth smallint")
