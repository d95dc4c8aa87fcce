"""Graphs in files: Parquet versions, CSV, JSON, binary snapshots, raw buffers, text seeds."""

from __future__ import annotations

import json
import shlex
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.functions.bits import lut_high, lut_join, lut_low
from tiergraph.operators.validate import validate
from tiergraph.schema import BACK_EDGES, EDGES, NODES, SLOTS, Graph, GraphError, signed


def save(graph: Graph, path: str) -> None:
    """Write a version: nodes sorted by truth and rank, so that lookups skip row groups, and edges."""
    graph.nodes.repartitionByRange("truth", "rank").sortWithinPartitions("truth", "rank", "node_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/edges")
    if graph.back_edges is not None:
        graph.back_edges.write.mode("overwrite").parquet(f"{path}/back_edges")
    meta = [(graph.tick, graph.back_edges is not None, json.dumps(graph.labels))]
    graph.spark.createDataFrame(meta, "tick bigint, back boolean, labels string").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """Read a version; it is validated before anyone gets it."""
    meta = spark.read.parquet(f"{path}/meta").first()
    back = spark.read.schema(BACK_EDGES).parquet(f"{path}/back_edges") if meta["back"] else None
    graph = Graph(spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges"), back, meta["tick"], json.loads(meta["labels"]))
    if check:
        validate(graph)
    return graph


_CSV_NODES = "id bigint, rank decimal(20,0), truth smallint, nodeType smallint, lut6_low bigint, lut6_high bigint"


def save_csv(graph: Graph, path: str) -> None:
    nodes = graph.nodes.select(F.col("node_id").alias("id"), "rank", "truth", F.col("node_type").alias("nodeType"), lut_low(F.col("lut")).alias("lut6_low"), lut_high(F.col("lut")).alias("lut6_high"))
    nodes.write.mode("overwrite").csv(f"{path}/nodes.csv", header=True)
    graph.edges.select("dst", "slot", "src").write.mode("overwrite").csv(f"{path}/edges.csv", header=True)


def _checked_ranks(nodes: DataFrame) -> DataFrame:
    """Ranks are unsigned in files; those beyond 63 bits are refused."""
    worst = nodes.agg(F.max("rank"), F.min("rank")).first()
    if worst[0] is not None and (worst[0] >= 1 << 63 or worst[1] < 0):
        raise GraphError("bad_rank", str(worst[0]))
    return nodes.withColumn("rank", F.col("rank").cast("bigint"))


def load_csv(spark: SparkSession, path: str, n: int | None = None) -> Graph:
    """Nodes without a row (of n) are empty cells."""
    rows = spark.read.csv(f"{path}/nodes.csv", schema=_CSV_NODES, header=True, mode="FAILFAST")
    nodes = _checked_ranks(rows).select(F.col("id").alias("node_id"), "rank", "truth", F.col("nodeType").alias("node_type"), lut_join(F.col("lut6_low"), F.col("lut6_high")).alias("lut"))
    edges = spark.read.csv(f"{path}/edges.csv", schema="dst bigint, slot tinyint, src bigint", header=True, mode="FAILFAST").withColumn("weight", F.lit(1.0).cast("float"))
    graph = Graph(nodes, edges)
    graph = graph.pad_to(n) if n else graph
    validate(graph)
    return graph


#: Here the array formats are one value in the driver, for exchange of small graphs; arrays.py has them in files, for any size.
ARRAY_NODES = 5_000_000


def _frames(graph: Graph) -> tuple[pd.DataFrame, np.ndarray]:
    """Nodes by id (gaps filled with empty cells) and the neighbour slots, -1 for none."""
    top = graph.nodes.agg(F.max("node_id")).first()[0]
    n = 0 if top is None else top + 1
    if n > ARRAY_NODES:
        raise GraphError("too_large", f"array formats take {ARRAY_NODES} nodes")
    nodes = graph.nodes.select("node_id", "rank", "truth", "node_type", "lut").toPandas().set_index("node_id").reindex(range(n), fill_value=0)
    slots = np.full((n, SLOTS), -1, dtype=np.int32)
    for r in [graph.edges.select("dst", "slot", "src").toPandas()]:
        slots[r.dst.to_numpy(), r.slot.to_numpy()] = r.src.to_numpy()
    return nodes, slots


def _graph(spark: SparkSession, rank: np.ndarray, truth: np.ndarray, kind: np.ndarray, lut: np.ndarray, slots: np.ndarray, tick: int = 0) -> Graph:
    if len(rank) and int(rank.max()) >= 1 << 63:
        raise GraphError("bad_rank", str(int(rank.max())))
    nodes = pd.DataFrame({"node_id": np.arange(len(rank)), "rank": rank.astype(np.int64), "truth": truth.astype(np.int16), "node_type": kind.astype(np.int16), "lut": lut.astype(np.uint64).view(np.int64)})
    dst, slot = np.nonzero(slots >= 0)
    edges = pd.DataFrame({"dst": dst.astype(np.int64), "slot": slot.astype(np.int8), "src": slots[dst, slot].astype(np.int64), "weight": np.ones(len(dst), dtype=np.float32)})
    graph = Graph(spark.createDataFrame(nodes, NODES) if len(nodes) else spark.createDataFrame([], NODES), spark.createDataFrame(edges, EDGES) if len(edges) else spark.createDataFrame([], EDGES), tick=tick)
    validate(graph)
    return graph


def to_json(graph: Graph) -> str:
    nodes, slots = _frames(graph)
    lut = nodes.lut.to_numpy().astype(np.int64).view(np.uint64)
    body = {"format": "graph-json", "version": 1, "meta": {"nodeCount": len(nodes), "gridW": len(nodes), "gridH": 1, "tickCount": graph.tick}}
    body |= {"rank": nodes["rank"].tolist(), "truth": nodes.truth.tolist(), "nodeType": nodes.node_type.tolist(), "lut6Low": (lut & np.uint64(0xFFFFFFFF)).tolist(), "lut6High": (lut >> np.uint64(32)).tolist(), "neighbors": slots.tolist()}
    return json.dumps(body)


def from_json(spark: SparkSession, text: str) -> Graph:
    body = json.loads(text)
    if not str(body.get("format")).endswith("-json") or body.get("version") != 1:
        raise GraphError("bad_format", str(body.get("format")))
    n = body["meta"]["nodeCount"]
    columns = [body[k] for k in ("rank", "truth", "nodeType", "lut6Low", "lut6High", "neighbors")]
    if any(len(c) != n for c in columns):
        raise GraphError("bad_format", "array lengths differ from nodeCount")
    rank, truth, kind, low, high = (np.array(c, dtype=np.uint64) for c in columns[:5])
    return _graph(spark, rank, truth, kind, low | high << np.uint64(32), np.array(columns[5], dtype=np.int64).reshape(n, SLOTS), body["meta"].get("tickCount", 0))


_MAGIC = b"DAGS"
_RANK_BYTES = {1: "<u1", 2: "<u4", 3: "<u8"}


def to_snapshot(graph: Graph, compressed: bool = False) -> bytes:
    """The binary snapshot, version 3: a header of eight 4-byte fields, then whole columns."""
    nodes, slots = _frames(graph)
    lut = nodes.lut.to_numpy().astype(np.int64).view(np.uint64)
    body = b"".join(
        [
            nodes["rank"].to_numpy().astype("<u8").tobytes(),
            nodes.truth.to_numpy().astype("<u1").tobytes(),
            nodes.node_type.to_numpy().astype("<u1").tobytes(),
            (lut & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
            (lut >> np.uint64(32)).astype("<u4").tobytes(),
            slots.astype("<i4").tobytes(),
        ]
    )
    if compressed:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(body) + packer.flush()
    return _MAGIC + struct.pack("<7I", 3, len(nodes), len(nodes), 1, graph.tick, int(compressed), len(body)) + body


def from_snapshot(spark: SparkSession, data: bytes) -> Graph:
    """Versions 1 to 3, which differ in the width of ranks."""
    if data[:4] != _MAGIC or len(data) < 32:
        raise GraphError("bad_format", "not a snapshot")
    version, n, width, height, tick, flags, size = struct.unpack("<7I", data[4:32])
    if version not in _RANK_BYTES or width * height != n:
        raise GraphError("bad_format", f"version {version}, {n} nodes on {width} x {height}")
    body = zlib.decompress(data[32 : 32 + size], -15) if flags & 1 else data[32 : 32 + size]
    fields = [(_RANK_BYTES[version], n), ("<u1", n), ("<u1", n), ("<u4", n), ("<u4", n), ("<i4", SLOTS * n)]
    if len(body) != sum(np.dtype(t).itemsize * k for t, k in fields):
        raise GraphError("bad_format", "truncated body")
    out, at = [], 0
    for kind, many in fields:
        out.append(np.frombuffer(body, dtype=kind, count=many, offset=at))
        at += np.dtype(kind).itemsize * many
    rank, truth, kinds, low, high, slots = out
    return _graph(spark, rank, truth, kinds, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), slots.reshape(n, SLOTS).astype(np.int64), tick)


def to_buffers(graph: Graph) -> dict[str, bytes]:
    """The six raw column files."""
    nodes, slots = _frames(graph)
    lut = nodes.lut.to_numpy().astype(np.int64).view(np.uint64)
    return {
        "rank.bin": nodes["rank"].to_numpy().astype("<u8").tobytes(),
        "truth.bin": nodes.truth.to_numpy().astype("<u1").tobytes(),
        "nodeType.bin": nodes.node_type.to_numpy().astype("<u1").tobytes(),
        "lut_low.bin": (lut & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
        "lut_high.bin": (lut >> np.uint64(32)).astype("<u4").tobytes(),
        "neighbors.bin": slots.astype("<i4").tobytes(),
    }


def from_buffers(spark: SparkSession, files: dict[str, bytes]) -> Graph:
    rank, truth, kind, low, high, slots = (np.frombuffer(files[f], dtype=t) for f, t in (("rank.bin", "<u8"), ("truth.bin", "<u1"), ("nodeType.bin", "<u1"), ("lut_low.bin", "<u4"), ("lut_high.bin", "<u4"), ("neighbors.bin", "<i4")))
    if not len(rank) == len(truth) == len(kind) == len(low) == len(high) == len(slots) / SLOTS:
        raise GraphError("bad_format", "buffers differ in length")
    return _graph(spark, rank, truth, kind, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), slots.reshape(-1, SLOTS).astype(np.int64))


def seed_commands(text: str) -> list[str]:
    """The commands of a seed script: one a line, # starts a comment."""
    return [" ".join(shlex.split(line, posix=False)) for line in (x.split("#")[0].strip() for x in text.splitlines()) if line]


def lut_from_parts(low: int, high: int) -> int:
    return signed(high << 32 | low)
