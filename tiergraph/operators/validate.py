"""Invariants of a graph's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiergraph.schema import SLOTS, Graph, GraphError


def violations(graph: Graph) -> DataFrame:
    """(dst, slot, src, problem) of every edge that breaks a rule; the first rule broken is told.

    Rules in order: both ends exist, no self-loop, rank(src) > rank(dst), no second edge from one source,
    slots 0 to 5.
    """
    ranks = graph.nodes.select("node_id", "rank")
    ends = graph.edges.join(ranks.select(F.col("node_id").alias("src"), F.col("rank").alias("from_rank")), "src", "left").join(ranks.select(F.col("node_id").alias("dst"), F.col("rank").alias("to_rank")), "dst", "left")
    nth = F.row_number().over(Window.partitionBy("dst", "src").orderBy("slot"))
    problem = (
        F.when(F.col("from_rank").isNull() | F.col("to_rank").isNull(), "range")
        .when(F.col("src") == F.col("dst"), "self_loop")
        .when(F.col("from_rank") <= F.col("to_rank"), "rank")
        .when(F.col("nth") > 1, "duplicate")
        .when(~F.col("slot").between(0, SLOTS - 1), "slot")
    )
    return ends.withColumn("nth", nth).select("dst", F.col("slot").cast("int").alias("slot"), "src", problem.alias("problem")).where("problem IS NOT NULL")


def validate(graph: Graph) -> None:
    """Raise the first violation in order of destination and slot."""
    first = violations(graph).agg(F.min(F.struct("dst", "slot", "src", "problem")).alias("v")).first()["v"]
    if first is not None:
        raise GraphError("validate", f"{first['problem']} at node {first['dst']} slot {first['slot']} source {first['src']}")
