"""Array formats of any size, in their files: JSON, binary snapshots, raw buffers.

A file is whole columns over all nodes, so it is cut into blocks of consecutive ids.  Tasks make or read a
block's share of every column; the driver only moves bytes between the file and the blocks, in a stream.
"""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.operators.validate import validate
from tiergraph.schema import SLOTS, Graph, GraphError, shared_folder, stored
from tiergraph.sources.files import _MAGIC, _RANK_BYTES

#: Nodes of a block: 22 MB of columns, which one task holds.
BLOCK = 1 << 19
#: Bytes of a JSON file that the driver looks at in one go.
SCAN = 8 << 20
#: The format keeps counts and sizes in 4 bytes, and ids as signed ones.
MOST_NODES, MOST_BYTES = (1 << 31) - 1, (1 << 32) - 1

#: The columns in the order of a snapshot: name, type in files, file among raw buffers, key in JSON.
COLUMNS = [
    ("rank", "<u8", "rank.bin", "rank"),
    ("truth", "<u1", "truth.bin", "truth"),
    ("kind", "<u1", "nodeType.bin", "nodeType"),
    ("low", "<u4", "lut_low.bin", "lut6Low"),
    ("high", "<u4", "lut_high.bin", "lut6High"),
    ("slots", "<i4", "neighbors.bin", "neighbors"),
]


class _Files:
    """Streams of the cluster's own file system; bytes stay in the JVM."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def fs(self, path: str):
        return self.path(path).getFileSystem(self.conf)

    def open(self, path: str):
        return self.fs(path).open(self.path(path))

    def create(self, path: str):
        return self.fs(path).create(self.path(path), True)

    def size(self, path: str) -> int:
        return self.fs(path).getFileStatus(self.path(path)).getLen()

    def copy(self, source, target, count: int) -> None:
        if self.jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, count) != count:
            raise GraphError("bad_format", "a file ends early")

    def read(self, source, count: int) -> bytes:
        """The next bytes, by a file that only the driver sees: its two processes share no memory."""
        with tempfile.NamedTemporaryFile() as held:
            out = self.jvm.java.io.FileOutputStream(held.name)
            self.jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, count)
            out.close()
            return held.read()

    def join(self, path: str, parts: list[bytes | tuple[str, int]]) -> None:
        """One file of given bytes and of the first bytes of other files; it gets its name when it is whole."""
        fs, part = self.fs(path), f"{path}.part"
        out = self.create(part)
        for x in parts:
            if isinstance(x, bytes):
                out.write(x)
            else:
                source = self.open(x[0])
                self.copy(source, out, x[1])
                source.close()
        out.close()
        fs.delete(self.path(path), False)
        if not fs.rename(self.path(part), self.path(path)):
            raise OSError(f"{part} could not get its name")

    def inflate(self, source, path: str) -> None:
        """The rest of a raw deflate stream, unpacked into a file."""
        zipped = self.jvm.java.util.zip
        out = self.create(path)
        stream = zipped.InflaterInputStream(source, zipped.Inflater(True))
        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, True)


def _temporary(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/graph/{uuid.uuid4().hex}"


# -- writing -----------------------------------------------------------------------------


def _block_task(n: int, block: int, form: str):
    """A block's columns, from its nodes and the edges into them, as bytes of one form."""

    def run(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        many = min(block, n - b * block)
        nodes = nodes[nodes.node_id >= 0]
        at, dst, slot = nodes.node_id.to_numpy() - b * block, edges.dst.to_numpy() - b * block, edges.slot.to_numpy()
        if len(dst) and not (dst.min() >= 0 and dst.max() < many and slot.min() >= 0 and slot.max() < SLOTS):
            raise ValueError("an edge into no node, or in no slot")
        columns = {c: np.zeros(many, dtype=np.int64) for c in ("rank", "truth", "node_type", "lut")}
        for c, values in columns.items():
            values[at] = nodes[c].to_numpy()
        slots = np.full((many, SLOTS), -1, dtype="<i4")
        slots[dst, slot] = edges.src.to_numpy()
        lut = columns["lut"].view(np.uint64)
        values = [columns["rank"], columns["truth"], columns["node_type"], lut & np.uint64(0xFFFFFFFF), lut >> np.uint64(32), slots]
        if form == "json":
            # A list's own brackets go: blocks stand one after the other in one list.
            data = [json.dumps(v.tolist(), separators=(",", ":"))[1:-1].encode() for v in values]
        else:
            data = [v.astype(kind).tobytes() for v, (_, kind, _, _) in zip(values, COLUMNS, strict=True)]
        if form == "deflate":
            # Each block ends on a whole byte and refers to no other, so that they can be joined.
            packers = [zlib.compressobj(6, zlib.DEFLATED, -15) for _ in data]
            data = [p.compress(x) + p.flush(zlib.Z_SYNC_FLUSH) for p, x in zip(packers, data, strict=True)]
        return pd.DataFrame({"name": [c[0] for c in COLUMNS], "b": b, "value": data})

    return run


def _pieces(graph: Graph, form: str, block: int) -> tuple[int, dict[str, list[tuple[str, int]]]]:
    """The number of nodes (gaps count as empty cells), and by column the blocks' files and sizes."""
    spark = graph.spark
    top = graph.nodes.agg(F.max("node_id")).first()[0]
    n = 0 if top is None else top + 1
    if n > MOST_NODES:
        raise GraphError("too_large", f"ids of the array formats end at {MOST_NODES}")
    blocks = -(-n // block)
    where = lambda c: F.expr(f"{c} div {block}").alias("k")
    nodes = graph.nodes.select(where("node_id"), "node_id", "rank", "truth", "node_type", "lut")
    none = F.lit(0)
    every = spark.range(blocks).select(F.col("id").alias("k"), F.lit(-1).cast("bigint").alias("node_id"), none.cast("bigint").alias("rank"), none.cast("smallint").alias("truth"), none.cast("smallint").alias("node_type"), none.cast("bigint").alias("lut"))
    edges = graph.edges.select(where("dst"), "dst", F.col("slot").cast("int").alias("slot"), "src")
    rows = nodes.unionByName(every).groupBy("k").cogroup(edges.groupBy("k")).applyInPandas(_block_task(n, block, form), "name string, b bigint, value binary")
    # The text writer writes a string's bytes as they are, and a line end, which is left out later.
    folder = _temporary(spark)
    rows.select("name", "b", F.col("value").cast("string").alias("value")).write.partitionBy("name", "b").option("compression", "none").text(folder)
    fs, found = _Files(spark), {c[0]: [None] * blocks for c in COLUMNS}
    for status in (fs.fs(folder).globStatus(fs.path(f"{folder}/name=*/b=*/part-*")) or []) if blocks else []:
        path = status.getPath().toString()
        _, name, b, _ = path.rsplit("/", 3)
        found[name[5:]][int(b[2:])] = (path, status.getLen() - 1)
    if any(x is None for v in found.values() for x in v):
        raise OSError(f"a block is missing in {folder}")
    return n, found


def write_buffers(graph: Graph, path: str, block: int = BLOCK) -> None:
    """The six raw column files, in a folder."""
    _, pieces = _pieces(graph, "raw", block)
    for name, _, file, _ in COLUMNS:
        _Files(graph.spark).join(f"{path}/{file}", pieces[name])


def write_snapshot(graph: Graph, path: str, compressed: bool = False, block: int = BLOCK) -> None:
    """The binary snapshot, version 3: a header of eight 4-byte fields, then whole columns."""
    n, pieces = _pieces(graph, "deflate" if compressed else "raw", block)
    body: list = [x for c in COLUMNS for x in pieces[c[0]]]
    if compressed:
        body.append(zlib.compressobj(6, zlib.DEFLATED, -15).flush())
    size = sum(len(x) if isinstance(x, bytes) else x[1] for x in body)
    if size > MOST_BYTES:
        raise GraphError("too_large", f"a snapshot's body ends at {MOST_BYTES} bytes")
    _Files(graph.spark).join(path, [_MAGIC + struct.pack("<7I", 3, n, n, 1, graph.tick, int(compressed), size), *body])


def write_json(graph: Graph, path: str, block: int = BLOCK) -> None:
    n, pieces = _pieces(graph, "json", block)
    head = {"format": "graph-json", "version": 1, "meta": {"nodeCount": n, "gridW": n, "gridH": 1, "tickCount": graph.tick}}
    parts: list = [json.dumps(head)[:-1].encode()]
    for name, _, _, key in COLUMNS:
        parts.append(f', "{key}": ['.encode())
        for i, piece in enumerate(pieces[name]):
            parts += [b",", piece] if i else [piece]
        parts.append(b"]")
    _Files(graph.spark).join(path, [*parts, b"}"])


# -- reading -----------------------------------------------------------------------------


def _cells(many: int, first: int, columns: list[np.ndarray]) -> pd.DataFrame:
    rank, truth, kind, low, high, slots = columns
    lut = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64)
    out = {"node_id": np.arange(first, first + many), "rank": rank.astype(np.uint64).view(np.int64), "truth": truth.astype(np.int16), "node_type": kind.astype(np.int16), "lut": lut}
    slots = slots.reshape(many, SLOTS)
    return pd.DataFrame(out | {f"s{k}": slots[:, k].astype(np.int64) for k in range(SLOTS)})


def _parse_raw(kinds: list[str], n: int, block: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b, data in zip(frame.b, frame.content, strict=True):
                many, at, columns = min(block, n - int(b) * block), 0, []
                for kind in kinds:
                    count = many * (SLOTS if kind == "<i4" else 1)
                    columns.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
                    at += columns[-1].nbytes
                yield _cells(many, int(b) * block, columns)

    return run


def _parse_json(n: int, block: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b, data in zip(frame.b, frame.content, strict=True):
                many = min(block, n - int(b) * block)
                parts = [json.loads(b"[" + x + b"]") for x in bytes(data).split(b";")]
                columns = [np.array(x, dtype=np.uint64) for x in parts[:5]]
                yield _cells(many, int(b) * block, [*columns, np.array(parts[5], dtype=np.int64)])

    return run


def _read(spark: SparkSession, n: int, blocks: Iterator[list[tuple[str, int, int]]], parse, tick: int, between: bytes = b"") -> Graph:
    """A validated graph: each block's ranges (path, offset, bytes) go into one file, which one task reads."""
    fs, folder, sources, count = _Files(spark), _temporary(spark), {}, 0
    for b, ranges in enumerate(blocks):
        out = fs.create(f"{folder}/{b:09d}.block")
        for i, (path, offset, size) in enumerate(ranges):
            if path not in sources:
                sources[path] = fs.open(path)
            if i and between:
                out.write(between)
            sources[path].seek(offset)
            fs.copy(sources[path], out, size)
        out.close()
        count += 1
    for source in sources.values():
        source.close()
    schema = "node_id bigint, rank bigint, truth smallint, node_type smallint, lut bigint, " + ", ".join(f"s{k} bigint" for k in range(SLOTS))
    if count:
        number = F.regexp_extract("path", r"(\d+)\.block$", 1).cast("bigint").alias("b")
        cells = stored(spark.read.format("binaryFile").load(f"{folder}/*.block").select(number, "content").mapInPandas(parse, schema))
    else:
        cells = spark.createDataFrame([], schema)
    worst = cells.where("rank < 0").agg(F.max("rank")).first()[0]
    if worst is not None:
        raise GraphError("bad_rank", str(worst + (1 << 64)))
    slot = F.explode(F.array(*[F.struct(F.lit(k).cast("tinyint").alias("slot"), F.col(f"s{k}").alias("src")) for k in range(SLOTS)])).alias("e")
    edges = cells.select(F.col("node_id").alias("dst"), slot).where("e.src >= 0").select("dst", "e.slot", "e.src", F.lit(1.0).cast("float").alias("weight"))
    graph = Graph(cells.select("node_id", "rank", "truth", "node_type", "lut"), edges, tick=tick)
    validate(graph)
    return graph


def _raw_blocks(columns: list[tuple[str, int, int]], n: int, block: int) -> Iterator[list[tuple[str, int, int]]]:
    """Ranges of each block, of columns that begin at an offset of a file and have so many bytes a node."""
    for first in range(0, n, block):
        yield [(path, offset + first * width, min(block, n - first) * width) for path, offset, width in columns]


def _width(kind: str) -> int:
    return np.dtype(kind).itemsize * (SLOTS if kind == "<i4" else 1)


def read_buffers(spark: SparkSession, path: str, block: int = BLOCK) -> Graph:
    fs = _Files(spark)
    kinds = [c[1] for c in COLUMNS]
    columns = [(f"{path}/{file}", 0, _width(kind)) for _, kind, file, _ in COLUMNS]
    sizes = [fs.size(p) for p, _, _ in columns]
    n = sizes[0] // columns[0][2]
    if any(size != n * width for size, (_, _, width) in zip(sizes, columns, strict=True)):
        raise GraphError("bad_format", "buffers differ in length")
    return _read(spark, n, _raw_blocks(columns, n, block), _parse_raw(kinds, n, block), 0)


def read_snapshot(spark: SparkSession, path: str, block: int = BLOCK) -> Graph:
    """Versions 1 to 3, which differ in the width of ranks."""
    fs = _Files(spark)
    source = fs.open(path)
    head = fs.read(source, 32)
    if head[:4] != _MAGIC or len(head) < 32:
        raise GraphError("bad_format", "not a snapshot")
    version, n, width, height, tick, flags, size = struct.unpack("<7I", head[4:])
    if version not in _RANK_BYTES or width * height != n:
        raise GraphError("bad_format", f"version {version}, {n} nodes on {width} x {height}")
    start, held = 32, min(size, fs.size(path) - 32)
    if flags & 1:
        start, path = 0, f"{_temporary(spark)}.body"
        fs.inflate(source, path)
        held = fs.size(path)
    source.close()
    kinds = [_RANK_BYTES[version], *[c[1] for c in COLUMNS[1:]]]
    columns = []
    for kind in kinds:
        columns.append((path, start, _width(kind)))
        start += n * _width(kind)
    if held != n * sum(map(_width, kinds)):
        raise GraphError("bad_format", "truncated body")
    return _read(spark, n, _raw_blocks(columns, n, block), _parse_raw(kinds, n, block), tick)


class _Scan:
    """A JSON object in a file, read once from front to end: small values, and where the lists' blocks are."""

    def __init__(self, files: _Files, source, block: int, chunk: int):
        self.files, self.source, self.block, self.chunk, self.data, self.at, self.base = files, source, block, chunk, b"", 0, 0

    def more(self) -> bool:
        """Take in another chunk behind what has not been used yet."""
        fresh = self.files.read(self.source, self.chunk)
        self.data, self.base, self.at = self.data[self.at :] + fresh, self.base + self.at, 0
        return bool(fresh)

    def peek(self) -> bytes:
        """The next byte that is no space; empty at the end."""
        while True:
            while self.at < len(self.data) and self.data[self.at] in b" \t\r\n":
                self.at += 1
            if self.at < len(self.data):
                return self.data[self.at : self.at + 1]
            if not self.more():
                return b""

    def take(self, want: bytes) -> None:
        if self.peek() != want:
            raise GraphError("bad_format", f"no {want.decode()} at byte {self.base + self.at}")
        self.at += 1

    def value(self):
        """A small value, as a whole."""
        self.peek()
        while True:
            # A number could go on in the next chunk, so the byte after a value has to be there too.
            try:
                text = self.data[self.at :].decode("utf-8", "surrogateescape")
                found, end = json.JSONDecoder().raw_decode(text)
                if end < len(text):
                    self.at += len(text[:end].encode("utf-8", "surrogateescape"))
                    return found
            except ValueError:
                pass
            if not self.more():
                raise GraphError("bad_format", f"no value at byte {self.base + self.at}")

    def blocks(self) -> tuple[int, list[tuple[int, int]]]:
        """A list's number of elements, and the offset and size of each block of them."""
        self.take(b"[")
        if self.peek() == b"]":
            self.at += 1
            return 0, []
        depth, seen, first, out = 1, 0, self.base + self.at, []
        while True:
            part = np.frombuffer(self.data, dtype=np.uint8, offset=self.at) if self.at < len(self.data) else np.zeros(0, dtype=np.uint8)
            marks = np.flatnonzero((part == 91) | (part == 93) | (part == 44))
            kind = part[marks]
            level = depth + np.cumsum((kind == 91).astype(np.int64) - (kind == 93))
            ends = np.flatnonzero(level == 0)
            stop = ends[0] if len(ends) else len(marks)
            commas = marks[:stop][(kind[:stop] == 44) & (level[:stop] == 1)]
            for i in range((self.block - 1 - seen) % self.block, len(commas), self.block):
                here = self.base + self.at + int(commas[i])
                out.append((first, here - first))
                first = here + 1
            seen += len(commas)
            if len(ends):
                end = int(marks[stop])
                out.append((first, self.base + self.at + end - first))
                self.at += end + 1
                return seen + 1, out
            depth = int(level[-1]) if len(level) else depth
            self.at = len(self.data)
            if not self.more():
                raise GraphError("bad_format", "a list has no end")


def read_json(spark: SparkSession, path: str, block: int = BLOCK, chunk: int = SCAN) -> Graph:
    fs = _Files(spark)
    source = fs.open(path)
    scan, body, lists = _Scan(fs, source, block, chunk), {}, {}
    scan.take(b"{")
    while scan.peek() != b"}":
        if body or lists:
            scan.take(b",")
        key = scan.value()
        scan.take(b":")
        if key in {c[3] for c in COLUMNS}:
            lists[key] = scan.blocks()
        else:
            body[key] = scan.value()
    source.close()
    if not str(body.get("format")).endswith("-json") or body.get("version") != 1:
        raise GraphError("bad_format", str(body.get("format")))
    n = body["meta"]["nodeCount"]
    if any(lists.get(c[3], (None,))[0] != n for c in COLUMNS):
        raise GraphError("bad_format", "array lengths differ from nodeCount")
    ranges = ([(path, *lists[c[3]][1][b]) for c in COLUMNS] for b in range(-(-n // block)))
    return _read(spark, n, ranges, _parse_json(n, block), body["meta"].get("tickCount", 0), b";")
