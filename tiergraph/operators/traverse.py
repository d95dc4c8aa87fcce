"""Traversal: breadth-first depths, ancestry, levels, induced edges, structural similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.schema import Graph, GraphError, stored

#: Up to so many edges, one task does an unbounded search on arrays.
LOCAL_EDGES = 2_000_000


def _require(graph: Graph, node: int) -> None:
    if node < 0 or graph.nodes.where(F.col("node_id") == node).isEmpty():
        raise GraphError("out_of_range", str(node))


def _steps(edges: DataFrame, undirected: bool) -> DataFrame:
    """(a, b): from a one step leads to b."""
    steps = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return steps.unionByName(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))) if undirected else steps


def _search(seed: int):
    """Depths of a search from the seed over (a, b) steps, level by level on arrays."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows.a.to_numpy(), rows.b.to_numpy()
        ids = np.unique(np.concatenate([a, b]))
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        order = np.argsort(a, kind="stable")
        first = np.searchsorted(a[order], np.arange(len(ids) + 1))
        b = b[order]
        depth = np.full(len(ids), -1, dtype=np.int64)
        level, now = np.searchsorted(ids, [seed]), 0
        depth[level] = 0
        while len(level):
            now += 1
            many = first[level + 1] - first[level]
            steps = np.arange(many.sum()) + np.repeat(first[level] - np.cumsum(many) + many, many)
            level = np.unique(b[steps])
            level = level[depth[level] < 0]
            depth[level] = now
        found = depth >= 0
        return pd.DataFrame({"node_id": ids[found], "depth": depth[found]})

    return run


def reached(graph: Graph, seed: int, undirected: bool = False, limit: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node_id, depth) of the nodes a breadth-first search from the seed finds, to a depth if one is given.

    A bounded search is a join a level.  An unbounded one may need as many levels as there are nodes: one task
    searches as many edges as it can hold, and beyond that it goes level by level as well, with equal results.
    """
    _require(graph, seed)
    spark = graph.spark
    steps = stored(_steps(graph.edges, undirected))
    if limit is None and steps.select(F.lit(1)).limit(local_edges + 1).count() <= local_edges:
        # A row for the seed keeps the group alive in a graph without edges.
        rows = steps.unionByName(spark.createDataFrame([(seed, seed)], "a bigint, b bigint"))
        return rows.groupBy(F.lit(0).alias("k")).applyInPandas(_search(seed), "node_id bigint, depth bigint")
    frontier = spark.createDataFrame([(seed, 0)], "node_id bigint, depth bigint")
    visited, depth = frontier, 0
    while limit is None or depth < limit:
        depth += 1
        step = steps.join(frontier.select(F.col("node_id").alias("a")), "a").select(F.col("b").alias("node_id")).distinct()
        frontier = stored(step.join(visited, "node_id", "left_anti").withColumn("depth", F.lit(depth).cast("bigint")))
        if frontier.isEmpty():
            break
        visited = stored(visited.unionByName(frontier)) if depth % 8 == 0 else visited.unionByName(frontier)
    return visited


def bfs_depths(graph: Graph, seed: int, backward: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Every node with its depth from the seed, -1 where the search does not come."""
    found = reached(graph, seed, not backward, None, local_edges)
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("depth", F.lit(-1)).cast("bigint").alias("depth"))


def ancestry(graph: Graph, node: int, depth: int) -> DataFrame:
    """(node_id, depth) over inputs, to a depth, the node itself at 0; by depth, then node."""
    if depth < 0:
        raise GraphError("bad_depth", str(depth))
    return reached(graph, node, False, depth).orderBy("depth", "node_id")


def traverse(graph: Graph, node: int, depth: int) -> DataFrame:
    """`depth` levels over inputs (1: the node alone): (level, node_id, rank, truth, node_type).

    A level's successors leave out the level itself but not earlier ones, so a node may recur.
    """
    _require(graph, node)
    steps = _steps(graph.edges, False)
    level = graph.spark.createDataFrame([(node,)], "node_id bigint")
    out = level.withColumn("level", F.lit(0).cast("bigint")).limit(0 if depth <= 0 else 1)
    for k in range(1, depth):
        level = steps.join(level.select(F.col("node_id").alias("a")), "a").select(F.col("b").alias("node_id")).distinct().join(level, "node_id", "left_anti")
        out = out.unionByName(level.withColumn("level", F.lit(k).cast("bigint")))
        if k % 6 == 0:
            level, out = stored(level), stored(out)
    return out.join(graph.nodes, "node_id").select("level", "node_id", "rank", "truth", "node_type")


def induced(edges: DataFrame, members: DataFrame, partitions: int | None = None) -> DataFrame:
    """Edges (dst, src) with both ends in the set; large tables are dealt over so many partitions."""
    ids = members.select("node_id")
    dealt = lambda df, c: df.repartition(partitions, c) if partitions else df
    half = dealt(edges.select("dst", "src"), "dst").join(dealt(ids.withColumnRenamed("node_id", "dst"), "dst"), "dst", "left_semi")
    return dealt(half, "src").join(dealt(ids.withColumnRenamed("node_id", "src"), "src"), "src", "left_semi").select("dst", "src")


def local_ancestry(graph: Graph, origins: DataFrame, depth: int) -> DataFrame:
    """(origin, node_id): everything within `depth` inputs of each origin, itself included."""
    steps = _steps(graph.edges, False)
    level = origins.select(F.col("node_id").alias("origin"), "node_id")
    out = level
    for _ in range(depth):
        level = level.withColumnRenamed("node_id", "a").join(steps, "a").select("origin", F.col("b").alias("node_id")).distinct()
        out = out.unionByName(level)
    return out.distinct()


def shapes(graph: Graph, members: DataFrame) -> DataFrame:
    """(origin, shape, n): histogram of first-order neighbourhood labels inside each origin's set.

    A node's label is its rank and type; its shape is that with the sorted labels of its inputs in the set.
    """
    label = F.struct("rank", "node_type")
    own = members.join(graph.nodes.select("node_id", label.alias("label")), "node_id")
    inside = graph.edges.select(F.col("dst").alias("node_id"), "src").join(own.select("origin", "node_id"), "node_id")
    fed = inside.join(own.select("origin", F.col("node_id").alias("src"), F.col("label").alias("below")), ["origin", "src"])
    fed = fed.groupBy("origin", "node_id").agg(F.sort_array(F.collect_list("below")).alias("inputs"))  # six at most
    full = own.join(fed, ["origin", "node_id"], "left").select("origin", F.to_json(F.struct("label", F.coalesce("inputs", F.array().cast("array<struct<rank:bigint,node_type:smallint>>")).alias("inputs"))).alias("shape"))
    return full.groupBy("origin", "shape").agg(F.count("*").alias("n"))


def similar(graph: Graph, node: int, depth: int, k: int, truth: int | None = None) -> DataFrame:
    """The k nodes whose local ancestry is shaped most like the node's: (node_id, distance)."""
    _require(graph, node)
    candidates = graph.nodes.where(F.col("node_id") != node)
    if truth is not None:
        candidates = candidates.where(F.col("truth") == truth)
    origins = candidates.select("node_id").unionByName(graph.spark.createDataFrame([(node,)], "node_id bigint"))
    found = stored(shapes(graph, local_ancestry(graph, origins, depth)))
    sizes = found.groupBy("origin").agg(F.sum("n").alias("size"))
    query = found.where(F.col("origin") == node).select("shape", F.col("n").alias("q"))
    total = query.agg(F.sum("q").alias("q_size"))
    common = found.where(F.col("origin") != node).join(query, "shape").groupBy("origin").agg(F.sum(F.least("n", "q")).alias("common"))
    # |Q - C| = |Q| + |C| - 2 * common, as the histograms' masses are the sets' sizes.
    both = sizes.where(F.col("origin") != node).join(common, "origin", "left").crossJoin(F.broadcast(total))  # one row
    mass = F.col("size") + F.col("q_size")
    distance = (mass - 2 * F.coalesce("common", F.lit(0))) / F.greatest(mass, F.lit(1))
    return both.select(F.col("origin").alias("node_id"), distance.cast("double").alias("distance")).orderBy("distance", "node_id").limit(k)
