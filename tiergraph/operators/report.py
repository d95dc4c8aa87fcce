"""Reports over ingested events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_distribution(events: DataFrame, column: str) -> DataFrame:
    """(column, n, percent) of all rows."""
    counts = events.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select(column, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))  # one row


def chain_lengths(events: DataFrame, agent: str) -> DataFrame:
    return events.groupBy(agent).agg(F.count("*").alias("n")).orderBy(F.desc("n"), agent)


def rank_span(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("rank").alias("lowest"), F.max("rank").alias("highest"), F.count("*").alias("n"), F.count_distinct("rank").alias("used"))


def threads(nodes: DataFrame, thread: str) -> DataFrame:
    """(thread, n, first_node, last_node)."""
    return nodes.groupBy(thread).agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node"))
