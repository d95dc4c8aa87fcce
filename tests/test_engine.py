"""Small graphs with known answers, and random ones against plain Python."""

import random

import pytest

from tiergraph.operators import build, distance, evaluate, select, traverse
from tiergraph.operators.validate import validate, violations
from tiergraph.schema import GATES, GraphError, gate, make_graph
from tiergraph.sources import files, history


def truths(graph):
    return {r["node_id"]: r["truth"] for r in graph.nodes.collect()}


def nine(spark):
    """Six leaves, a majority gate, a root."""
    nodes = [(0, 0, 0, 0, 0)] + [(i, 2, 1, 1, -1) for i in range(1, 7)] + [(7, 1, 0, 2, gate("MAJ")), (8, 0, 0, 3, gate("ID"))]
    return make_graph(spark, nodes, [(7, k, k + 1) for k in range(6)] + [(8, 0, 7)])


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "node_id bigint")


@pytest.mark.parametrize(
    "a,b,want",
    [
        ((7, 1), (7, 1, 2, 3, 4, 5, 6), (0.714286, 5 / 6, 0.555556, 0.555556, 0.555556, 10, 0.777778, 5.477226)),
        ((1, 2, 3, 7), (4, 5, 6, 7, 8), (0.875, 1, 0.111111, 0.111111, 0.111111, 14, 0.111111, 1.414214)),
        ((1, 2, 3, 4, 5, 6), (7, 8), (1, 1, 1, 0.770552, 1, 9, 1, 2)),
        ((1,), (7, 1, 2, 3, 4, 5, 6), (0.857143, 1, 0.75, 0.637377, 0.75, 12, 0.75, 7.348469)),
    ],
)
def test_distances(spark, a, b, want):
    graph = nine(spark)
    names = ["jaccardNodes", "jaccardEdges", "rankL1", "rankL2", "typeL1", "boundedGED", "wlL1", "spectralL2"]
    got = [distance.METRICS[m](graph, ids(spark, *a), ids(spark, *b)) for m in names]
    assert got == pytest.approx(want, abs=1e-5)


def test_distance_to_itself_and_of_nothing(spark):
    graph = nine(spark)
    for m in distance.METRICS.values():
        assert m(graph, ids(spark, 1, 7), ids(spark, 1, 7)) == pytest.approx(0)
        assert m(graph, ids(spark), ids(spark)) == 0
    with pytest.raises(GraphError):
        distance.distance(graph, "JACCARDNODES", ids(spark), ids(spark))


def test_power_grid(spark):
    """A gate of six over three inputs is never true; leaves come back by their tables."""
    off = {109, 114, 116}
    nodes = [(i, 3, int(i not in off), 0, 0 if i in off else -1) for i in range(100, 118)]
    nodes += [(118, 2, 0, 0, gate("AND")), (119, 2, 0, 0, gate("MAJ")), (120, 2, 0, 0, gate("OR")), (121, 1, 0, 0, gate("AND")), (122, 0, 0, 0, gate("ID"))]
    edges = [(118 + k // 6, k % 6, 100 + k) for k in range(18)] + [(121, k, 118 + k) for k in range(3)] + [(122, 0, 121)]
    graph = make_graph(spark, nodes, edges)
    for rows in (evaluate.BAND_ROWS, 40, 0):
        after = truths(evaluate.tick(graph, band_rows=rows))
        assert [after[i] for i in range(118, 123)] == [1, 1, 1, 0, 0]
    changed = build.set_values(graph, "truth", spark.createDataFrame([(i, 0) for i in range(100, 104)], "node_id bigint, value int"))
    assert truths(evaluate.tick(changed)) == after


def random_graph(seed):
    rng = random.Random(seed)
    nodes = [(i, rng.randint(0, 6), rng.randint(0, 2), rng.randint(0, 2), gate(rng.choice(list(GATES)))) for i in range(60)]
    edges = []
    for i, r, *_ in nodes:
        above = [j for j, q, *_ in nodes if q > r]
        for k, s in enumerate(rng.sample(above, min(len(above), rng.randint(0, 6)))):
            edges.append((i, k, s))
    return nodes, edges


def reference_tick(nodes, edges, max_rank):
    truth = {n[0]: n[2] for n in nodes}
    for r in range(max_rank - 1, -1, -1):
        for i, q, _, _, lut in nodes:
            if q == r:
                idx = sum(1 << s for d, s, x in edges if d == i and truth[x] == 1)
                truth[i] = (lut & (1 << 64) - 1) >> idx & 1
    return truth


@pytest.mark.parametrize("seed", range(3))
def test_tick_random(spark, seed):
    nodes, edges = random_graph(seed)
    graph = make_graph(spark, nodes, edges)
    assert violations(graph).isEmpty()
    for max_rank in (16, 5):
        want = reference_tick(nodes, edges, max_rank)
        for rows in (evaluate.BAND_ROWS, 40, 0):
            after = evaluate.tick(graph, 3, max_rank, rows)
            assert truths(after) == want and after.tick == 3
    settled, told = evaluate.resonance(graph)
    assert truths(settled) == reference_tick(nodes, edges, 16) and all(t[2] for t in told)


def test_deep_chain(spark):
    """Twelve hundred ranks: as one band, as several, and with some ranks wide."""
    n = 1200
    nodes = [(i, n - i, 1, 0, gate("CONST1") if i == 0 else gate("NOR") if i % 3 == 0 else gate("ID")) for i in range(n)]
    edges = [(i, 0, i - 1) for i in range(1, n)]
    graph = make_graph(spark, nodes, edges)
    want = reference_tick_chain(nodes)
    for rows in (evaluate.BAND_ROWS, 700):
        assert truths(evaluate.tick(graph, max_rank=5000, band_rows=rows)) == want


def reference_tick_chain(nodes):
    truth = {}
    for i, _, _, _, lut in nodes:
        index = truth[i - 1] if i else 0
        truth[i] = (lut & (1 << 64) - 1) >> index & 1
    return truth


@pytest.mark.parametrize("seed", range(2))
def test_search_random(spark, seed):
    nodes, edges = random_graph(seed)
    graph = make_graph(spark, nodes, edges)
    start = min(nodes, key=lambda n: n[1])[0]
    for undirected in (False, True):
        near = {n[0]: set() for n in nodes}
        for d, _, s in edges:
            near[d].add(s)
            if undirected:
                near[s].add(d)
        want, queue = {start: 0}, [start]
        for v in queue:
            for w in sorted(near[v]):
                if w not in want:
                    want[w] = want[v] + 1
                    queue.append(w)
        for local in (traverse.LOCAL_EDGES, 0):
            got = {r["node_id"]: r["depth"] for r in traverse.bfs_depths(graph, start, not undirected, local).collect()}
            assert got == {n[0]: want.get(n[0], -1) for n in nodes}


def test_search_errors(spark):
    graph = nine(spark)
    for seed in (999999, -1):
        with pytest.raises(GraphError):
            traverse.bfs_depths(graph, seed)
    with pytest.raises(GraphError):
        traverse.ancestry(graph, 8, -1)
    assert [r["node_id"] for r in traverse.ancestry(graph, 8, 1).collect()] == [8, 7]
    assert traverse.traverse(graph, 8, 0).count() == 0
    assert traverse.traverse(graph, 8, 1).count() == 1


def test_builder_and_hub(spark):
    b = build.Builder()
    hub = b.gate(0, "OR")
    leaf = b.leaf(4, 1, "leaf")
    assert len(b.connect_with_ghosts("leaf", hub)) == 3
    wide = b.gate(0, "OR")
    b.split_hub([b.leaf(9, 1) for _ in range(300)], wide)
    assert max(map(len, b.inputs)) <= 6
    graph = b.build(spark)
    validate(graph)
    after = truths(evaluate.tick(graph))
    assert after[hub] == after[wide] == after[leaf] == 1
    with pytest.raises(GraphError):
        b.connect(hub, leaf)
    with pytest.raises(GraphError):
        b.connect(leaf, leaf)


@pytest.mark.parametrize("edge,problem", [((7, 0, 7), "self_loop"), ((1, 0, 7), "rank"), ((7, 5, 99), "range"), ((8, 1, 7), "duplicate")])
def test_violations(spark, edge, problem):
    graph = nine(spark)
    bad = graph.with_edges(graph.edges.unionByName(spark.createDataFrame([(*edge, 1.0)], graph.edges.schema)))
    assert [r["problem"] for r in violations(bad).collect()] == [problem]
    with pytest.raises(GraphError):
        validate(bad)


def test_predicates():
    assert select.parse_predicate("TRUTH = 1 tail") == select.Predicate("truth", "=", 1)
    assert select.parse_predicate("rank <= 5") == select.Predicate("rank", "<=", 5)
    assert select.parse_predicate("rank") is None and select.parse_predicate("rank = x") is None


def test_unknown_field_holds_nowhere(spark):
    assert select.nodes(nine(spark), None, select.parse_predicate("colour = 1")).count() == 0


def test_files(spark, tmp_path):
    graph = nine(spark)
    graph = graph.with_nodes(graph.nodes.replace(2, 4294967300, "rank"))
    want = sorted(map(tuple, graph.nodes.collect()))
    for data in (files.to_snapshot(graph), files.to_snapshot(graph, True)):
        assert sorted(map(tuple, files.from_snapshot(spark, data).nodes.collect())) == want
    assert sorted(map(tuple, files.from_json(spark, files.to_json(graph)).nodes.collect())) == want
    assert sorted(map(tuple, files.from_buffers(spark, files.to_buffers(graph)).nodes.collect())) == want
    files.save_csv(graph, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.load_csv(spark, str(tmp_path / "csv")).nodes.collect())) == want
    with pytest.raises(GraphError):
        files.from_snapshot(spark, b"XXXX" + files.to_snapshot(graph)[4:])
    with pytest.raises(GraphError):
        files.from_snapshot(spark, files.to_snapshot(graph)[:-1])


def test_log(spark):
    graph = nine(spark)
    rows = [("truth", 1, 0), ("truth", 2, 0), ("rank", 3, 9), ("checkpoint", 0, 42), ("truth", 4, 2), ("lut", 5, gate("AND"))]
    data = history.encode_log(rows, 9)
    after = {r["node_id"]: r for r in history.replay(graph, history.decode_log(spark, data)).nodes.collect()}
    assert after[1]["truth"] == 1 and after[3]["rank"] == 2 and after[4]["truth"] == 2 and after[5]["lut"] == gate("AND")
    torn = history.decode_log(spark, data[:-3])
    assert torn.count() == 5


def test_frames(spark):
    import numpy as np

    frames = [np.array([(i + t) % 3 for i in range(8)]) for t in range(10)]
    data = history.encode_frames(frames, np.zeros(8), np.full(8, -1), np.zeros(8), 5, 16)
    rows = history.decode_frames(spark, data)
    kept = history.changes(rows, 5)
    for t in (0, 4, 7, 9, 99):
        got = {r["node_id"]: r["truth"] for r in history.state_at(kept, t, 5).collect()}
        assert got == dict(enumerate(frames[min(t, 9)].tolist()))


def test_rank_policies(spark):
    rows = spark.createDataFrame([(i, i) for i in range(5)], "node_id bigint, seq bigint")
    assert [r["rank"] for r in build.SequencePosition(10).assign(rows).orderBy("seq").collect()] == [10, 9, 8, 7, 6]
    chains = spark.createDataFrame([(c, p) for c in range(2) for p in range(3)], "chain_id bigint, pos bigint")
    assert [r["rank"] for r in build.ChainBands(100).assign(chains).orderBy("chain_id", "pos").collect()] == [49, 48, 47, 99, 98, 97]
    with pytest.raises(GraphError):
        build.ChainBands(4).assign(chains)
    ring = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, 2), (0, 0, 3)], "dst bigint, slot int, src bigint")
    four = spark.range(4).withColumnRenamed("id", "node_id")
    assert [r["rank"] for r in build.TopologicalSort(10, 0, ring).assign(four).orderBy("node_id").collect()] == [10, 9, 8, 9]
