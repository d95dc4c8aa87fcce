"""Steps that must not grow faster than their input: what is stored, joined and dealt."""

from graph_data import SF

from tiergraph import schema
from tiergraph.operators import evaluate
from tiergraph.plans import queries as q
from tiergraph.plans.graphs import line_tree
from tiergraph.schema import gate, make_graph


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def chain(spark, n=8):
    """Constants 1 and 0 by turns, with the opposite truth before; ranks n - 1 to 0 are negated copies."""
    nodes = [(i, n - i, i % 2, 0, gate("CONST1") if i == 0 else gate("NOR")) for i in range(n + 1)]
    return make_graph(spark, nodes, [(i, 0, i - 1) for i in range(1, n + 1)])


def test_resonance_joins_no_more_with_every_rank(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(evaluate, "stored", lambda df: (seen.append(joins(df)), schema.stored(df))[1])
    settled, told = evaluate.resonance(chain(spark))
    assert max(seen) <= 2
    assert {r["node_id"]: r["truth"] for r in settled.nodes.collect()} == {i: (i + 1) % 2 for i in range(9)}
    assert told == [(8 - i, 2, True) for i in range(9)]


def test_resonance_reference_mode(spark):
    """What changes becomes 2, which no input counts as true: the first node does, so that the others stay."""
    settled, told = evaluate.resonance(chain(spark), cap=7, mode="reference")
    assert {r["node_id"]: r["truth"] for r in settled.nodes.collect()} == {0: 2} | {i: i % 2 for i in range(1, 9)}
    assert told == [(8, 7, False)] + [(8 - i, 1, True) for i in range(1, 9)]


def test_tick_joins_nothing_at_the_end(spark):
    for rows in (evaluate.BAND_ROWS, 0):
        assert joins(evaluate.tick(chain(spark), band_rows=rows).nodes) == 0


def test_shuffled_ranks(spark, monkeypatch):
    """Ranks too wide to be sent to every task."""
    monkeypatch.setattr(evaluate, "SENT_ROWS", 0)
    after = evaluate.tick(chain(spark), band_rows=0)
    assert {r["node_id"]: r["truth"] for r in after.nodes.collect()} == {i: (i + 1) % 2 for i in range(9)}


def test_tree_keeps_only_what_it_reads(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(schema, "stored", lambda df, f=schema.stored: (seen.append(df.columns), f(df))[1])
    line_tree(spark, SF)
    assert seen == [["l_quantity", "__at"]]


def test_partitions_grow_with_rows(spark, monkeypatch):
    """Whatever the bytes: small numbers that compress well still go to as many tasks as their rows need."""
    monkeypatch.setattr(schema, "PART_ROWS", 500)
    rows = q.induced_edges_all(spark, SF)
    assert rows.rdd.getNumPartitions() >= rows.count() // 2 // 500
