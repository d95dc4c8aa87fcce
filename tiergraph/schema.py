"""The data model: nodes, edges, truth tables, errors.

A graph is a table of nodes and a table of edge slots.  Ranks fall from sources to sinks; each node has at
most six inputs and a 64-bit truth table, kept as a signed pattern.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_id bigint, rank bigint, truth smallint, node_type smallint, lut bigint"
EDGES = "dst bigint, slot tinyint, src bigint, weight float"
BACK_EDGES = "dst bigint, src bigint"

SLOTS = 6
#: Highest rank (exclusive) that evaluation touches unless told otherwise.
MAX_RANK = 16
TOP_RANK = 4294967295

#: Truth tables of the named gates, as unsigned 64-bit numbers.
GATES = {
    "AND": 0x8000000000000000,
    "OR": 0xFFFFFFFFFFFFFFFE,
    "XOR": 0x6996966996696996,
    "MAJ": 0xFEE8E880E8808000,
    "ID": 0xAAAAAAAAAAAAAAAA,
    "NOR": 0x0000000000000001,
    "NAND": 0x7FFFFFFFFFFFFFFF,
    "AND3": 0x8080808080808080,
    "OR3": 0xFEFEFEFEFEFEFEFE,
    "MAJ3": 0xE8E8E8E8E8E8E8E8,
    "CONST0": 0x0,
    "CONST1": 0xFFFFFFFFFFFFFFFF,
}
#: Other names of gates.
ALIASES = {"AND6": "AND", "VETO": "AND", "OR6": "OR", "XOR6": "XOR", "MAJ6": "MAJ", "MAJORITY": "MAJ", "IDENTITY": "ID", "NOR6": "NOR", "NAND6": "NAND", "FALSE": "CONST0", "TRUE": "CONST1"}


class GraphError(Exception):
    """A refused command; `category` is the first word of its reply."""

    def __init__(self, category: str, message: str):
        super().__init__(f"{category}: {message}")
        self.category, self.message = category, message


def signed(pattern: int) -> int:
    """An unsigned 64-bit pattern as the BIGINT that stores it."""
    return pattern - (1 << 64) if pattern >> 63 else pattern


def gate(name: str) -> int:
    """The stored truth table of a gate's name or of 0x followed by hexadecimal digits."""
    key = name.upper()
    if key.startswith("0X"):
        try:
            value = int(key[2:], 16)
        except ValueError:
            value = -1
        if not 0 <= value < 1 << 64:
            raise GraphError("unknown_preset", name)
        return signed(value)
    key = ALIASES.get(key, key)
    if key not in GATES:
        raise GraphError("unknown_preset", name)
    return signed(GATES[key])


def lut_bit(lut: Column, index: Column) -> Column:
    """The table's bit for an input pattern."""
    return F.call_function("shiftrightunsigned", lut, index.cast("int")).bitwiseAND(F.lit(1).cast("bigint"))


@dataclass(frozen=True)
class Graph:
    """An immutable version of a graph; every change makes another."""

    nodes: DataFrame
    edges: DataFrame
    back_edges: DataFrame | None = None
    tick: int = 0
    labels: dict[str, int] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def pad_to(self, n: int) -> Graph:
        """Add undeclared nodes below n as empty cells: rank 0, truth 0, no table."""
        empty = self.spark.range(n).select(F.col("id").alias("node_id")).join(self.nodes.select("node_id"), "node_id", "left_anti")
        blank = empty.select("node_id", F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("smallint").alias("truth"), F.lit(0).cast("smallint").alias("node_type"), F.lit(0).cast("bigint").alias("lut"))
        return self.with_nodes(self.nodes.select(blank.columns).unionByName(blank))


def make_graph(spark: SparkSession, nodes: list[tuple], edges: list[tuple], back_edges: list[tuple] = ()) -> Graph:
    """A graph of given rows: (node_id, rank, truth, node_type, lut) and (dst, slot, src)."""
    rows = [(d, s, x, 1.0) for d, s, x in edges]
    back = spark.createDataFrame(list(back_edges), BACK_EDGES) if back_edges else None
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES), back)


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir, else one of our own (as in tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = "/tmp/tiergraph-shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back, so that plans of loops stay short."""
    path = f"{shared_folder(df.sparkSession)}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition where a join or a window sorts them; by bytes, Spark would join partitions of numbers that compress well.
PART_ROWS = 250_000


def parts(rows: int) -> int:
    """Partitions for so many rows."""
    return max(4, -(-rows // PART_ROWS))


def numbered(df: DataFrame, order: list[str], name: str = "node_id", keep: list[str] | None = None) -> DataFrame:
    """Number rows 0.. in a total order without one task seeing them all; `keep` names the columns wanted after (default: all).

    Rows are dealt by ranges and sorted there; a row's number is its place in its range plus the rows of
    the ranges before, of which there are as many as partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = stored(ranged if keep is None else ranged.select(*keep, "__at"))
    part = F.call_function("shiftright", F.col("__at"), F.lit(33))
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()  # one row a partition
    before, total = [], 0
    for r in sizes:
        before.append((int(r["__part"]), total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "__part bigint, __before bigint")
    own = held.withColumn("__part", part.cast("bigint")).join(F.broadcast(offsets), "__part")
    return own.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__at")
