"""Distances between two sets of nodes of one graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.operators.traverse import induced, shapes
from tiergraph.schema import Graph, GraphError

#: Nodes of a set up to which its spectrum is computed.
SPECTRAL_NODES = 2000


def rank_range(graph: Graph, lo: int, hi: int) -> DataFrame:
    """The set of nodes with lo <= rank <= hi."""
    return graph.nodes.where(F.col("rank").between(lo, hi)).select("node_id")


def rank_profile(graph: Graph, members: DataFrame) -> DataFrame:
    return graph.nodes.join(members, "node_id", "left_semi").groupBy("rank").agg(F.count("*").alias("n"))


def _signed(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: how often it is in a and in b (one shuffle)."""
    both = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return both.groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def _histogram_distance(a: DataFrame, b: DataFrame, keys: list[str], squared: bool = False) -> float:
    gap = F.col("x") - F.col("y")
    total = F.sqrt(F.sum(gap * gap).cast("double")) if squared else F.sum(F.abs(gap)).cast("double")
    row = _signed(a, b, keys).agg(total.alias("d"), F.sum("x").alias("a"), F.sum("y").alias("b")).first()
    return (row["d"] or 0.0) / max(1, (row["a"] or 0) + (row["b"] or 0))


def _overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Sizes of intersection and union of two sets."""
    row = _signed(a.distinct(), b.distinct(), keys).agg(F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("both"), F.count("*").alias("any")).first()
    return row["both"], row["any"]


def _jaccard(both: int, union: int) -> float:
    return 1 - both / union if union else 0.0


def _kinds(graph: Graph, members: DataFrame) -> DataFrame:
    return graph.nodes.join(members, "node_id", "left_semi")


def _shape_rows(graph: Graph, members: DataFrame) -> DataFrame:
    return shapes(graph, members.select(F.lit(0).cast("bigint").alias("origin"), "node_id"))


def _wl(graph: Graph, a: DataFrame, b: DataFrame) -> float:
    left, right = _shape_rows(graph, a).select("shape", F.col("n").alias("x"), F.lit(0).alias("y")), _shape_rows(graph, b).select("shape", F.lit(0).alias("x"), F.col("n").alias("y"))
    row = left.union(right).groupBy("shape").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("d"), F.sum("x").alias("a"), F.sum("y").alias("b")).first()
    return (row["d"] or 0) / max(1, (row["a"] or 0) + (row["b"] or 0))


def laplacian(graph: Graph, members: DataFrame) -> DataFrame:
    """(row, col, value) of the set's Laplacian, nodes in order of their ids; zeros are left out."""
    ids = members.distinct()
    edges = induced(graph.edges, ids)
    pairs = edges.select(F.col("dst").alias("row"), F.col("src").alias("col")).union(edges.select("src", "dst")).where("row <> col").distinct()
    off = pairs.withColumn("value", F.lit(-1).cast("bigint"))
    return off.union(off.groupBy("row").agg(F.count("*").alias("value")).select("row", F.col("row").alias("col"), "value"))


def spectrum(graph: Graph, members: DataFrame) -> DataFrame:
    """(nth, value): ascending eigenvalues of the Laplacian of a set of at most SPECTRAL_NODES nodes."""
    n = members.distinct().limit(SPECTRAL_NODES + 1).count()
    if n > SPECTRAL_NODES:
        raise GraphError("too_large", f"spectral distance takes {SPECTRAL_NODES} nodes at most")

    def solve(ids: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        place = {v: i for i, v in enumerate(sorted(ids.node_id))}
        full = np.zeros((len(place), len(place)))
        for r, c, v in entries[["row", "col", "value"]].itertuples(index=False):
            full[place[r], place[c]] = v
        values = np.linalg.eigvalsh(full) if len(place) else np.zeros(0)
        return pd.DataFrame({"nth": np.arange(len(values)), "value": values})

    one = F.lit(0).alias("k")
    return members.distinct().groupBy(one).cogroup(laplacian(graph, members).groupBy(one)).applyInPandas(solve, "nth bigint, value double")


def _spectral(graph: Graph, a: DataFrame, b: DataFrame) -> float:
    x, y = (sorted(r["value"] for r in spectrum(graph, s).collect()) for s in (a, b))  # SPECTRAL_NODES at most
    n = max(len(x), len(y))
    x, y = [0.0] * (n - len(x)) + x, [0.0] * (n - len(y)) + y
    return float(np.sqrt(np.sum((np.array(x) - np.array(y)) ** 2))) if n else 0.0


METRICS = {
    "jaccardNodes": lambda g, a, b: _jaccard(*_overlap(a, b, ["node_id"])),
    "jaccardEdges": lambda g, a, b: _jaccard(*_overlap(induced(g.edges, a), induced(g.edges, b), ["dst", "src"])),
    "rankL1": lambda g, a, b: _histogram_distance(_kinds(g, a), _kinds(g, b), ["rank"]),
    "rankL2": lambda g, a, b: _histogram_distance(_kinds(g, a), _kinds(g, b), ["rank"], squared=True),
    "typeL1": lambda g, a, b: _histogram_distance(_kinds(g, a), _kinds(g, b), ["node_type"]),
    "boundedGED": lambda g, a, b: float(sum(any_ - both for both, any_ in (_overlap(a, b, ["node_id"]), _overlap(induced(g.edges, a), induced(g.edges, b), ["dst", "src"])))),
    "wlL1": _wl,
    "spectralL2": _spectral,
}


def distance(graph: Graph, metric: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: metric, value, size_a, size_b.  Names of metrics are case-sensitive."""
    if metric not in METRICS:
        raise GraphError("unknown_metric", metric)
    value = METRICS[metric](graph, a, b)
    return graph.spark.createDataFrame([(metric, float(value), a.count(), b.count())], "metric string, value double, size_a bigint, size_b bigint")
