"""Text commands, readers and event ingestion."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiergraph.schema import GraphError, make_graph
from tiergraph.session import Session
from tiergraph.streaming.ingest import EVENTS, StreamIngest, ingest, read_events


@pytest.fixture()
def session(spark, tmp_path):
    graph = make_graph(spark, [(0, 0, 0, 0, 0), (1, 1, 1, 0, -1), (2, 1, 0, 0, 0), (3, 2, 1, 0, -1)], [])
    return Session(spark, graph, root=str(tmp_path))


def test_commands(session):
    run = lambda *texts: [session.execute(t).reply for t in texts]
    assert all(r.startswith("OK") for r in run("SET 0 LUT OR", "connect from 1 to 0", "CONNECT FROM 2 TO 0", "TICK 2", "EVAL", "VALIDATE"))
    assert session.execute("GET 0 TRUTH").reply.endswith("truth=1")
    assert session.execute("EVAL WHERE truth = 1 RANK 0 TO 3").rows.count() == 1
    assert session.execute("NODES AT RANK 1 WHERE truth = 1").rows.count() == 1
    assert session.execute("SELECT truth 1 rank 0-9").rows.count() == 3
    assert "reached=3 maxDepth=1" in session.execute("BFS_DEPTHS FROM 0 BACKWARD").reply
    assert "value=1.000000" in session.execute("DISTANCE jaccardNodes 0-0 1-1").reply
    assert session.execute("SIMILAR_DECISIONS TO 1 DEPTH 1 K 2").rows.first()["node_id"] == 2
    assert run("SET 99 TRUTH 1", "SET 0 LUT NOPE", "CONNECT FROM 0 TO 0", "CONNECT FROM 0 TO 1", "CONNECT FROM 1 TO 0", "DISTANCE nope 0-0 1-1", "BFS_DEPTHS FROM 99", "NONSENSE", "SELECT truth 1", "SAVE ../x")[:] == [
        "ERROR out_of_range: 99",
        "ERROR unknown_preset: NOPE",
        "ERROR self_loop: 0",
        "ERROR rank: 0 does not rank above 1",
        "ERROR duplicate: 1 to 0",
        "ERROR unknown_metric: nope",
        "ERROR out_of_range: 99",
        "ERROR unknown_command: NONSENSE",
        "ERROR unknown_command: SELECT truth 1",
        "ERROR bad_path: ../x",
    ]
    assert run("COMPOSE NOT 0 INTO 2", "SET 2 LUT 0x8000000000000000", "CLEAR 0 EDGES")[2] == "OK CLEAR node=0"
    session.execute("SET 3 RANK 1")
    session.execute("SET 1 RANK 0")
    assert session.graph.edges.count() == 0


def test_versions_and_readers(session, tmp_path):
    assert session.execute("OPEN_READER").reply == "OK OPEN_READER id=1"
    session.execute("SET 1 TRUTH 7")
    assert session.execute("READER 1 GET 1 TRUTH").reply.endswith("truth=1")
    assert session.execute("GET 1 TRUTH").reply.endswith("truth=7")
    assert session.execute("READER 1 SET 1 TRUTH 0").reply == "ERROR forbidden: SET"
    assert session.execute("READER 9 STATUS").reply.startswith("ERROR reader")
    for save, load in (("SAVE v", "LOAD v"), ("SAVE JSON g.json", "LOAD JSON g.json"), ("SAVE CSV c", "LOAD CSV c"), ("SAVE g.dags COMPRESSED", "LOAD g.dags"), ("EXPORT MORTON m", "IMPORT MORTON m"), ("BACKUP INIT b", "BACKUP RESTORE b")):
        assert session.execute(save).ok, save
        session.execute("SET 2 TRUTH 5")
        assert session.execute(load).ok, load
        assert session.execute("GET 2 TRUTH").reply.endswith("truth=0")
    session.tables()
    assert session.spark.sql("SELECT count(*) FROM nodes").first()[0] == 4
    assert session.execute("CLOSE_READER 1").ok and not session.readers


def test_seed_script(session):
    done = session.run("# a comment\nSET 0 LUT ID   # identity\n\nCONNECT FROM 1 TO 0\nTICK 1\n")
    assert [r.ok for r in done] == [True, True, True]


def _events():
    rows = [dict(agent="a", event="response"), dict(agent="b", event="drop_written", drop_filename="2024-01-02_x_v1.md"), dict(agent="a", event="dialogue_turn", topic="t", file="f")]
    rows += [dict(agent="b", event="dialogue_turn", topic="t", file="f", body="see 2024-01-02_x_v1.md and 2024-01-02_x_v1.md"), dict(event="status"), dict(agent="c", event="bzz", summary="2024-01-02_x_v1.md"), dict(event="status", body="2024-01-02_x_v1.md")]
    return rows


WANT = {(2, 0, 0), (3, 0, 1), (3, 1, 2), (5, 0, 1), (6, 0, 4), (6, 1, 1)}


def _frame(spark, rows):
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], EVENTS)


def test_ingest(spark):
    rows = _events()
    frame = _frame(spark, rows).withColumn("node_id", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    done = ingest(frame.withColumn("node_id", F.col("node_id").cast("bigint")))
    assert {(r["dst"], r["slot"], r["src"]) for r in done.graph.edges.collect()} == WANT
    assert [r["truth"] for r in done.graph.nodes.orderBy("node_id").collect()] == [1, 4, 2, 2, 7, 6, 7]
    with pytest.raises(GraphError):
        ingest(_frame(spark, [dict(event="nope")]).withColumn("node_id", F.lit(0).cast("bigint")))


def test_stream_equals_batch(spark, tmp_path):
    rows = _events()
    source = tmp_path / "in"
    source.mkdir()
    for k, part in enumerate((rows[:2], rows[2:5], rows[5:])):
        (source / f"{k}.json").write_text("\n".join(json.dumps(r | {"ts": f"{k}-{i}"}) for i, r in enumerate(part)) + "\nnot json\n")
    number = lambda df: df.withColumn("place", (F.row_number().over(Window.orderBy("ts")) - 1).cast("bigint"))
    sink = StreamIngest(spark, str(tmp_path / "out"), number)
    stream = spark.readStream.schema(EVENTS).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))
    import os

    for k in range(3):
        os.utime(source / f"{k}.json", (1000 + k, 1000 + k))
    q = sink.start(stream.where("event IS NOT NULL"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert q.exception() is None
    assert {(r["dst"], r["slot"], r["src"]) for r in sink.graph().edges.collect()} == WANT
    sink.add(_frame(spark, rows[:2]), 0)
    assert sink.events().count() == len(rows)
    assert read_events(spark, str(source)).where("event IS NOT NULL").count() == len(rows)
