"""Construction and change: builder, ghosts, hubs, trees, edits, rank policies."""

from __future__ import annotations

import math
from dataclasses import replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiergraph.operators.traverse import reached
from tiergraph.schema import EDGES, SLOTS, TOP_RANK, Graph, GraphError, gate, make_graph, numbered, stored


class Builder:
    """A graph put together node by node, by id or label."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.inputs: list[list[int]] = []
        self.labels: dict[str, int] = {}

    def _add(self, rank: int, truth: int, kind: int, lut: int, label: str | None) -> int:
        if rank < 0 or rank >= 1 << 63:
            raise GraphError("bad_rank", str(rank))
        self.rows.append([len(self.rows), rank, truth, kind, lut])
        self.inputs.append([])
        if label is not None:
            self.labels[label] = len(self.rows) - 1
        return len(self.rows) - 1

    def leaf(self, rank: int, truth: int = 0, label: str | None = None) -> int:
        return self._add(rank, truth, 0, gate("CONST1" if truth == 1 else "CONST0"), label)

    def gate(self, rank: int, name: str, label: str | None = None, kind: int = 0) -> int:
        return self._add(rank, 0, kind, gate(name), label)

    def ghost(self, rank: int, label: str | None = None) -> int:
        return self._add(rank, 0, 2, gate("ID"), label)

    def _id(self, node: int | str) -> int:
        found = self.labels.get(node, -1) if isinstance(node, str) else node
        if not 0 <= found < len(self.rows):
            raise GraphError("out_of_range", str(node))
        return found

    def connect(self, src: int | str, dst: int | str) -> None:
        """An edge into the first free slot; one that is there already is left as it is."""
        a, b = self._id(src), self._id(dst)
        if a == b:
            raise GraphError("self_loop", str(src))
        if self.rows[a][1] <= self.rows[b][1]:
            raise GraphError("rank", f"{src} does not rank above {dst}")
        if a in self.inputs[b]:
            return
        if len(self.inputs[b]) >= SLOTS:
            raise GraphError("full", str(dst))
        self.inputs[b].append(a)

    def connect_with_ghosts(self, src: int | str, dst: int | str) -> list[int]:
        """A path with a pass-through node at every rank between; returns these."""
        a, b = self._id(src), self._id(dst)
        made, at = [], a
        for rank in range(self.rows[a][1] - 1, self.rows[b][1], -1):
            made.append(self.ghost(rank))
            self.connect(at, made[-1])
            at = made[-1]
        self.connect(at, b)
        return made

    def split_hub(self, sources: list[int | str], dst: int | str, name: str = "OR6") -> list[int]:
        """Feed any number of sources to a node through a six-way tree of gates; returns the gates.

        The tree's depth is known first, so that every level gets a rank of its own below the sources.
        """
        own, hub = [self._id(s) for s in sources], self._id(dst)
        levels = max(0, math.ceil(math.log(max(1, len(own)), SLOTS) - 1e-9) - 1)
        room = min((self.rows[s][1] for s in own), default=levels + 1 + self.rows[hub][1]) - self.rows[hub][1]
        if own and room < levels + 1:
            raise GraphError("rank", f"{len(own)} sources need {levels} ranks between them and {dst}")
        made, at = [], own
        for level in range(levels, 0, -1):
            gates = []
            for i in range(0, len(at), SLOTS):
                g = self.gate(self.rows[hub][1] + level, name, kind=1)
                for s in at[i : i + SLOTS]:
                    self.connect(s, g)
                gates.append(g)
            made += gates
            at = gates
        for s in at:
            self.connect(s, hub)
        return made

    def build(self, spark: SparkSession) -> Graph:
        edges = [(d, k, s) for d, own in enumerate(self.inputs) for k, s in enumerate(own)]
        return replace(make_graph(spark, [tuple(r) for r in self.rows], edges), labels=dict(self.labels))

    def describe(self) -> dict[int, int]:
        """Nodes per rank."""
        out: dict[int, int] = {}
        for r in self.rows:
            out[r[1]] = out.get(r[1], 0) + 1
        return dict(sorted(out.items()))


def tree_levels(n: int) -> list[int]:
    """Sizes of the levels of a six-way tree, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // SLOTS))
    return out


def tree(spark: SparkSession, n: int, gates: list[str] = ("MAJ",), leaves: DataFrame | None = None) -> Graph:
    """A six-way tree over n leaves; gates go by level, in turn.  `leaves` (node_id, truth) default to all 1."""
    sizes = tree_levels(n) if n else []
    first = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    top = len(sizes) - 1
    if leaves is None:
        leaves = spark.range(n).select(F.col("id").alias("node_id"), F.lit(1).alias("truth"))
    truth = F.col("truth").cast("smallint")
    nodes = leaves.select("node_id", F.lit(top).cast("bigint").alias("rank"), truth.alias("truth"), F.lit(0).cast("smallint").alias("node_type"), F.when(F.col("truth") == 1, F.lit(gate("CONST1"))).otherwise(F.lit(0)).cast("bigint").alias("lut"))
    edges = spark.createDataFrame([], EDGES)
    for k in range(1, len(sizes)):
        level = spark.range(first[k], first[k] + sizes[k])
        zero = F.lit(0).cast("smallint")
        nodes = nodes.unionByName(level.select(F.col("id").alias("node_id"), F.lit(top - k).cast("bigint").alias("rank"), zero.alias("truth"), zero.alias("node_type"), F.lit(gate(gates[(k - 1) % len(gates)])).cast("bigint").alias("lut")))
        below = spark.range(sizes[k - 1])
        edges = edges.unionByName(below.select((F.expr(f"id div {SLOTS}") + first[k]).alias("dst"), (F.col("id") % SLOTS).cast("tinyint").alias("slot"), (F.col("id") + first[k - 1]).alias("src"), F.lit(1.0).cast("float").alias("weight")))
    return Graph(nodes, edges)


def set_values(graph: Graph, column: str, values: DataFrame) -> Graph:
    """Replace a node column where `values` (node_id, value) has a row; the rest stays."""
    kind = dict(graph.nodes.dtypes)[column]
    new = values.select("node_id", F.col("value").cast(kind).alias("__new"))
    return graph.with_nodes(graph.nodes.join(new, "node_id", "left").withColumn(column, F.coalesce("__new", column)).select(graph.nodes.columns))


def clear_edges(graph: Graph, node: int) -> Graph:
    return graph.with_edges(graph.edges.where(F.col("dst") != node))


def add_edges(graph: Graph, pairs: DataFrame) -> Graph:
    """Append edges (dst, src), in order of source, to the slots after those in use."""
    used = graph.edges.groupBy("dst").agg((F.max("slot") + 1).alias("used"))
    slot = F.row_number().over(Window.partitionBy("dst").orderBy("src")) - 1
    fresh = pairs.select("dst", "src").distinct().join(graph.edges.select("dst", "src"), ["dst", "src"], "left_anti").withColumn("nth", slot).join(used, "dst", "left")
    place = F.col("nth") + F.coalesce("used", F.lit(0))
    return graph.with_edges(graph.edges.unionByName(fresh.select("dst", place.cast("tinyint").alias("slot"), "src", F.lit(1.0).cast("float").alias("weight"))))


def ghost_paths(graph: Graph, pairs: DataFrame) -> Graph:
    """Connect many (dst, src) pairs with a pass-through node at every rank between, all at once."""
    ranks = graph.nodes.select("node_id", "rank")
    ends = pairs.select("dst", "src").distinct().join(ranks.select(F.col("node_id").alias("src"), F.col("rank").alias("hi")), "src").join(ranks.select(F.col("node_id").alias("dst"), F.col("rank").alias("lo")), "dst")
    long = stored(ends.where("hi - lo > 1").select("dst", "src", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("rank")))
    base = graph.nodes.agg(F.max("node_id")).first()[0] + 1
    made = stored(numbered(long, ["dst", "src", "rank"], "nth").withColumn("node_id", F.col("nth") + base))
    ghosts = made.select("node_id", "rank", F.lit(0).cast("smallint").alias("truth"), F.lit(2).cast("smallint").alias("node_type"), F.lit(gate("ID")).cast("bigint").alias("lut"))
    path = Window.partitionBy("dst", "src").orderBy("rank")
    hops = made.select("dst", "src", "node_id", F.lag("node_id").over(path).alias("before"), F.lead("node_id").over(path).alias("after"))
    inner = hops.select(F.col("node_id").alias("dst"), F.coalesce("after", "src").alias("src"))
    outer = hops.where("before IS NULL").select("dst", F.col("node_id").alias("src"))
    near = ends.where("hi - lo = 1").select("dst", "src")
    return add_edges(graph.with_nodes(graph.nodes.unionByName(ghosts)), stored(inner.unionByName(outer).unionByName(near)))


class RankPolicy(Protocol):
    """Ranks for rows; the place where users bring their own rule."""

    def assign(self, df: DataFrame) -> DataFrame: ...


def _checked(df: DataFrame, bad: Column, message: str) -> DataFrame:
    worst = df.where(bad).limit(1).collect()
    if worst:
        raise GraphError("bad_rank", f"{message}: {worst[0].asDict()}")
    return df


class SequencePosition:
    """rank = top - seq."""

    def __init__(self, top: int, column: str = "seq"):
        self.top, self.column = top, column

    def assign(self, df: DataFrame) -> DataFrame:
        seq = F.col(self.column)
        return _checked(df, (seq < 0) | (seq > self.top), "position out of range").withColumn("rank", (F.lit(self.top) - seq).cast("bigint"))


class ChainBands:
    """Chains share the ranks in equal bands: (chain + 1) * band - 1 - position, band = ceil(top / chains)."""

    def __init__(self, top: int, chain: str = "chain_id", position: str = "pos"):
        self.top, self.chain, self.position = top, chain, position

    def assign(self, df: DataFrame) -> DataFrame:
        row = df.agg(F.max(self.chain).alias("c"), F.max(self.position).alias("p")).first()
        if row["c"] is None:
            return df.withColumn("rank", F.lit(None).cast("bigint"))
        band = -(-self.top // (row["c"] + 1))
        if band <= row["p"]:
            raise GraphError("bad_rank", f"a band of {band} ranks is too narrow for position {row['p']}")
        return df.withColumn("rank", ((F.col(self.chain) + 1) * band - 1 - F.col(self.position)).cast("bigint"))


class TopologicalSort:
    """rank = top - breadth-first depth from a root over undirected edges; unreached nodes go one deeper."""

    def __init__(self, top: int, root: int, edges: DataFrame):
        self.top, self.root, self.edges = top, root, edges

    def assign(self, df: DataFrame) -> DataFrame:
        found = stored(reached(Graph(df.withColumn("rank", F.lit(0)), self.edges), self.root, undirected=True))
        deepest = found.agg(F.max("depth")).first()[0]
        if deepest + 1 >= self.top:
            raise GraphError("bad_rank", f"depth {deepest} does not fit below {self.top}")
        return df.join(found, "node_id", "left").withColumn("rank", (F.lit(self.top) - F.coalesce("depth", F.lit(deepest + 1))).cast("bigint")).drop("depth")


class InsertCounter:
    """rank = top - node_id: earlier nodes rank higher."""

    def __init__(self, top: int = TOP_RANK):
        self.top = top

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn("rank", (F.lit(self.top).cast("bigint") - F.col("node_id")).cast("bigint"))
