"""Scans, predicates and lookups over nodes."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.schema import Graph, GraphError

COLUMNS = ["node_id", "rank", "truth", "node_type"]
#: Names of fields in predicates, and operators in the order they are looked for.
FIELDS = {"truth": "truth", "state": "truth", "rank": "rank", "type": "node_type"}
OPERATORS = {"!=": operator.ne, "<=": operator.le, ">=": operator.ge, "=": operator.eq, "<": operator.lt, ">": operator.gt}


@dataclass(frozen=True)
class Predicate:
    """One comparison of a field with a number; an unknown field holds for no row."""

    field: str
    op: str
    value: int

    def column(self) -> Column:
        name = FIELDS.get(self.field)
        return OPERATORS[self.op](F.col(name), F.lit(self.value)) if name else F.lit(False)


def parse_predicate(text: str) -> Predicate | None:
    """The predicate of a text; None (no filter) if it does not parse."""
    for op in OPERATORS:
        left, found, right = text.partition(op)
        if found:
            words = right.split()
            try:
                return Predicate(left.strip().lower(), op, int(words[0])) if words else None
            except ValueError:
                return None
    return None


def _filtered(nodes: DataFrame, predicate: Predicate | None) -> DataFrame:
    return nodes.where(predicate.column()) if predicate else nodes


def scan(graph: Graph, column: str) -> DataFrame:
    return graph.nodes.select("node_id", column)


def roots(graph: Graph) -> DataFrame:
    return graph.nodes.where("rank = 0").select(*COLUMNS)


def nodes(graph: Graph, at_rank: int | None = None, predicate: Predicate | None = None) -> DataFrame:
    """Nodes of a rank, or all but blank ones (rank 0 and truth 0), that meet the predicate."""
    chosen = graph.nodes.where(F.col("rank") == at_rank) if at_rank is not None else graph.nodes.where("NOT (rank = 0 AND truth = 0)")
    return _filtered(chosen, predicate).select(*COLUMNS).orderBy("node_id")


def roots_where(graph: Graph, predicate: Predicate | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Roots that meet the predicate and the rank range."""
    chosen = _filtered(roots(graph), predicate)
    return chosen.where(F.col("rank").between(lo or 0, (1 << 63) - 1 if hi is None else hi)) if lo is not None or hi is not None else chosen


def select_truth_rank(graph: Graph, truth: int, lo: int = 0, hi: int = 4294967295, limit: int | None = None) -> DataFrame:
    """Nodes of a truth code in a rank range, by ascending rank (then node)."""
    found = graph.nodes.where((F.col("truth") == truth) & F.col("rank").between(lo, hi)).select("node_id", "rank").orderBy("rank", "node_id")
    return found if limit is None else found.limit(limit)


def truth_of(graph: Graph, node: int) -> int:
    row = graph.nodes.where(F.col("node_id") == node).select("truth").first()
    if row is None:
        raise GraphError("out_of_range", str(node))
    return row["truth"]


def bucket_sizes(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("truth").agg(F.count("*").alias("n"))


def graph_info(graph: Graph) -> DataFrame:
    """Per rank, and for all (null): number of nodes and of those with truth 1."""
    return graph.nodes.rollup("rank").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("n_true"))


def indegree_distribution(graph: Graph) -> DataFrame:
    degrees = graph.edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))
    return graph.nodes.select("node_id").join(degrees, "node_id", "left").groupBy(F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")).agg(F.count("*").alias("n"))


def top_indegree(graph: Graph, k: int = 5) -> DataFrame:
    return graph.edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node_id").limit(k)
