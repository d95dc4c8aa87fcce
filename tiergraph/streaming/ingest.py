"""Event logs become causal graphs, in batches or from a stream.

Each event is a node; its inputs are the previous event of its agent, for a dialogue turn the previous turn
of its thread, and the documents it cites that were written before.  Node numbers follow the order of
arrival, so earlier nodes rank higher.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tiergraph.schema import SLOTS, TOP_RANK, Graph, GraphError, gate, stored

EVENTS = "ts string, agent string, event string, summary string, body string, branch string, partner string, turn int, max int, topic string, file string, drop_filename string"
#: Truth codes of event types, the pattern of a cited document, and citations looked at.
CODES = {"response": 1, "dialogue_turn": 2, "ceremony": 3, "drop_written": 4, "meeting_contribution": 5, "bzz": 6, "status": 7}
CITATION = r"\b(\d{4}-\d{2}-\d{2}_[\w.-]+_v\d+\.md)\b"
CITED = 4


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON-lines file; blank and malformed lines are left out."""
    return spark.read.schema(EVENTS).option("mode", "DROPMALFORMED").json(path)


@dataclass
class Ingested:
    graph: Graph
    events: DataFrame  # with node_id, truth, agent, thread columns


def check_types(events: DataFrame) -> None:
    bad = events.where(~F.coalesce(F.col("event").isin(list(CODES)), F.lit(False))).select("event").limit(1).collect()
    if bad:
        raise GraphError("unknown_event", repr(bad[0]["event"]))


def ingest(numbered_events: DataFrame, history: DataFrame | None = None) -> Ingested:
    """Graph of events that have node_id, in arrival order; `history` holds earlier ones with the same columns.

    Edges of the new events only; the state of earlier ones (last event of an agent, last turn of a thread,
    documents written) is read from their rows.
    """
    check_types(numbered_events)
    new = numbered_events.withColumn("is_new", F.lit(True))
    rows = new if history is None else new.unionByName(history.withColumn("is_new", F.lit(False)))
    agent = F.coalesce("agent", F.lit("unknown"))
    rows = rows.withColumn("agent", agent).withColumn("topic", F.coalesce("topic", F.lit(""))).withColumn("file", F.coalesce("file", F.lit("")))
    turn = F.col("event") == "dialogue_turn"
    previous = F.lag("node_id").over(Window.partitionBy("agent").orderBy("node_id"))
    # Other events get a thread of their own each, so that they neither have nor are a previous turn.
    thread = F.when(turn, F.struct("topic", "file", F.lit(-1).cast("bigint").alias("single"))).otherwise(F.struct(F.lit("").alias("topic"), F.lit("").alias("file"), F.col("node_id").alias("single")))
    rows = rows.withColumn("p0", previous).withColumn("thread", thread)
    rows = rows.withColumn("p1", F.when(turn, F.lag("node_id").over(Window.partitionBy("thread").orderBy("node_id"))))
    rows = rows.withColumn("p1", F.when(F.col("p1").eqNullSafe(F.col("p0")), None).otherwise(F.col("p1")))
    fresh = rows.where("is_new")

    used = F.col("p0").isNotNull().cast("int") + F.col("p1").isNotNull().cast("int")
    text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("body", F.lit("")))
    cites = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))), F.lit(1), F.least(F.lit(CITED), F.lit(SLOTS) - used))
    cited = fresh.select("node_id", "p0", "p1", F.posexplode(cites).alias("nth", "name"))
    written = rows.where("event = 'drop_written' AND drop_filename <> ''").select(F.col("node_id").alias("written"), F.col("drop_filename").alias("name"))
    # The latest one written before the citing event; named documents are few to a name.
    found = cited.join(written, "name").where("written < node_id").groupBy("node_id", "nth").agg(F.max("written").alias("src"), F.max("p0").alias("p0"), F.max("p1").alias("p1"))
    found = found.where("NOT coalesce(src = p0, false) AND NOT coalesce(src = p1, false)")
    first = fresh.select("node_id", F.lit(-2).alias("nth"), F.col("p0").alias("src")).unionByName(fresh.select("node_id", F.lit(-1).alias("nth"), F.col("p1").alias("src"))).where("src IS NOT NULL")
    parents = first.unionByName(found.select("node_id", "nth", "src")).groupBy("node_id", "src").agg(F.min("nth").alias("nth"))
    slot = (F.row_number().over(Window.partitionBy("node_id").orderBy("nth")) - 1).cast("tinyint")
    edges = parents.select(F.col("node_id").alias("dst"), slot.alias("slot"), "src", F.lit(1.0).cast("float").alias("weight"))
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    nodes = fresh.select("node_id", (F.lit(TOP_RANK).cast("bigint") - F.col("node_id")).alias("rank"), codes[F.col("event")].cast("smallint").alias("truth"), F.lit(0).cast("smallint").alias("node_type"), F.lit(gate("ID")).cast("bigint").alias("lut"))
    return Ingested(Graph(nodes, edges), fresh.drop("is_new", "p0", "p1", "thread"))


class StreamIngest:
    """Folds micro-batches into a stored graph; a batch that comes again is not added again."""

    def __init__(self, spark: SparkSession, path: str, number: Callable[[DataFrame], DataFrame]):
        """`number` gives a batch's rows their places 0.. in arrival order as column `place`."""
        self.spark, self.path, self.number = spark, path, number

    def _stored(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema + ", batch bigint").parquet(f"{self.path}/{part}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema + ", batch bigint")

    def events(self) -> DataFrame:
        return self._stored("events", EVENTS + ", node_id bigint")

    def graph(self) -> Graph:
        nodes = self._stored("nodes", "node_id bigint, rank bigint, truth smallint, node_type smallint, lut bigint").drop("batch")
        return Graph(nodes, self._stored("edges", "dst bigint, slot tinyint, src bigint, weight float").drop("batch"))

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Events are written last: a batch without events there is taken as not done and its parts are replaced."""
        history = self.events()
        if not history.where(F.col("batch") == batch_id).isEmpty():
            return
        start = history.agg(F.coalesce(F.max("node_id"), F.lit(-1))).first()[0] + 1
        places = stored(self.number(batch)).withColumn("node_id", F.col("place") + start).drop("place")
        done = ingest(places, history.drop("batch"))
        columns = [c.split()[0] for c in EVENTS.split(", ")]
        for part, rows in (("nodes", done.graph.nodes), ("edges", done.graph.edges), ("events", places.select(*columns, "node_id"))):
            out = rows.withColumn("batch", F.lit(batch_id).cast("bigint"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{part}")

    def start(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        return source.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
