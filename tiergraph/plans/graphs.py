"""Graphs derived from relational tables: an event log, a reduction tree, geography, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiergraph.operators.build import Builder, tree
from tiergraph.schema import TOP_RANK, Graph, gate, numbered, parts

#: Truth codes of the event table's types, and gates of the tree's levels in turn.
EVENT_CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
TREE_GATES = ["MAJ", "XOR", "NAND", "OR", "XOR", "NOR"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with node_id in order of time, the previous event of the user and of user and type."""
    events = table(spark, sf_dir, "events")
    rows = numbered(events.select("ts", "event_id", "user_id", "event_type", "value"), ["ts", "event_id"]).repartition(parts(events.count()), "user_id")
    by_user = Window.partitionBy("user_id").orderBy("node_id")
    by_type = Window.partitionBy("user_id", "event_type").orderBy("node_id")
    codes = F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])
    return rows.withColumn("p0", F.lag("node_id").over(by_user)).withColumn("p1", F.lag("node_id").over(by_type)).withColumn("truth", codes[F.col("event_type")].cast("smallint"))


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    rows = event_rows(spark, sf_dir)
    nodes = rows.select("node_id", (F.lit(TOP_RANK).cast("bigint") - F.col("node_id")).alias("rank"), "truth", (F.col("user_id") % 3).cast("smallint").alias("node_type"), F.lit(gate("ID")).cast("bigint").alias("lut"))
    one = F.lit(1.0).cast("float").alias("weight")
    first = rows.where("p0 IS NOT NULL").select(F.col("node_id").alias("dst"), F.lit(0).cast("tinyint").alias("slot"), F.col("p0").alias("src"), one)
    second = rows.where("p1 IS NOT NULL AND p1 <> p0").select(F.col("node_id").alias("dst"), F.lit(1).cast("tinyint").alias("slot"), F.col("p1").alias("src"), one)
    return Graph(nodes, first.unionByName(second))


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def line_tree(spark: SparkSession, sf_dir: str) -> Graph:
    """A six-way tree over line items in order of all columns; a leaf is true for a quantity above 25."""
    rows = table(spark, sf_dir, "lineitem")
    leaves = numbered(rows.select(*LINE_ORDER), LINE_ORDER, keep=["l_quantity"]).select("node_id", (F.col("l_quantity") > 25).cast("int").alias("truth"))
    return tree(spark, rows.count(), TREE_GATES, leaves)


def geography(spark: SparkSession, sf_dir: str) -> tuple[Builder, DataFrame]:
    """Regions (rank 0) fed by nations (rank 1) and these by suppliers (rank 8, through hubs), and node names.

    Region and nation tables have a fixed few rows; suppliers go as edges and are not collected.
    """
    b = Builder()
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        b.gate(0, "OR", f"region {r['r_regionkey']}")
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        b.connect(b.gate(1, "OR", f"nation {r['n_nationkey']}"), f"region {r['n_regionkey']}")
    return b, table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")


def conversation_graph(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """Turns in order, each fed by the one before it in its conversation; and rows with node_id."""
    rows = numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    rows = rows.withColumn("p0", F.lag("node_id").over(Window.partitionBy("conv_id").orderBy("node_id")))
    truth = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3).cast("smallint")
    nodes = rows.select("node_id", (F.lit(TOP_RANK).cast("bigint") - F.col("node_id")).alias("rank"), truth.alias("truth"), F.lit(0).cast("smallint").alias("node_type"), F.lit(gate("ID")).cast("bigint").alias("lut"))
    edges = rows.where("p0 IS NOT NULL").select(F.col("node_id").alias("dst"), F.lit(0).cast("tinyint").alias("slot"), F.col("p0").alias("src"), F.lit(1.0).cast("float").alias("weight"))
    return Graph(nodes, edges), rows
