"""Queries over whole event tables see events past every fixed id range."""

from graph_data import SF

from tiergraph.plans import queries as q


def test_every_event_counts(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert n > 3000
    run = {name: q.QUERIES[name](spark, SF) for name in q.QUERIES if name.endswith("_all")}
    assert run["time_travel_all"].count() == run["rank_profile_all"].count() == n
    assert {r["n"] for r in run["ring_buffer_all"].collect()} == {n}
    assert {r["part"]: r["n"] for r in run["set_operations_all"].collect()}["any"] == n
    assert run["wal_replay_all"].where("truth >= 10").agg({"node_id": "max"}).first()[0] > n // 2
    assert run["induced_edges_all"].agg({"dst": "max"}).first()[0] > 3000
    assert run["laplacian_all"].agg({"row": "max"}).first()[0] > 3000
