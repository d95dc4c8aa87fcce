"""Array formats in files: same bytes as in memory, in many blocks, and past the size one value may have."""

import json

import pytest
from test_engine import random_graph

from tiergraph.schema import GraphError, make_graph
from tiergraph.sources import arrays, files


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges = random_graph(5)
    gone = {11, 12, 13, 14, 15, 16, 17, 40}
    rows = [(*n[:1], 4294967300 if n[1] == 6 else n[1], *n[2:]) for n in nodes if n[0] not in gone]
    return make_graph(spark, rows, [e for e in edges if e[0] not in gone and e[2] not in gone])


def same(a, b):
    rows = lambda df: sorted(map(tuple, df.collect()))
    return rows(a.nodes) == rows(b.nodes) and rows(a.edges) == rows(b.edges)


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_in_blocks(spark, graph, tmp_path, monkeypatch, block):
    want = {x: files.to_buffers(graph)[x] for x in files.to_buffers(graph)}
    text, raw = files.to_json(graph), files.to_snapshot(graph)
    whole = files.from_snapshot(spark, raw)
    monkeypatch.setattr(files, "ARRAY_NODES", 10)  # no path through one value
    p = lambda name: str(tmp_path / name)
    arrays.write_buffers(graph, p("raw"), block)
    assert {x: (tmp_path / "raw" / x).read_bytes() for x in want} == want
    assert same(arrays.read_buffers(spark, p("raw"), block), whole)
    arrays.write_snapshot(graph, p("plain"), block=block)
    assert (tmp_path / "plain").read_bytes() == raw
    arrays.write_snapshot(graph, p("packed"), True, block)
    packed = (tmp_path / "packed").read_bytes()
    assert same(files.from_snapshot(spark, packed), whole)
    for name in ("plain", "packed"):
        assert same(arrays.read_snapshot(spark, p(name), block), whole)
    arrays.write_json(graph, p("json"), block)
    assert json.loads((tmp_path / "json").read_text()) == json.loads(text)
    (tmp_path / "spaced").write_text(json.dumps(json.loads(text), indent=1, sort_keys=True))
    for name in ("json", "spaced"):
        for chunk in (13, 1 << 20):
            assert same(arrays.read_json(spark, p(name), block, chunk), whole)


def test_broken(spark, graph, tmp_path):
    raw = files.to_snapshot(graph)
    for name, data in (("magic", b"XXXX" + raw[4:]), ("short", raw[:-1]), ("header", raw[:20])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(GraphError, match="bad_format"):
            arrays.read_snapshot(spark, str(tmp_path / name))
    body = json.loads(files.to_json(graph))
    for name, data in (("length", json.dumps(body | {"truth": [0]})), ("open", json.dumps(body)[:-9]), ("version", json.dumps(body | {"version": 2}))):
        (tmp_path / name).write_text(data)
        with pytest.raises(GraphError, match="bad_format"):
            arrays.read_json(spark, str(tmp_path / name))
    high = make_graph(spark, [(0, 0, 0, 0, 0), (1, -5, 0, 0, 0)], [])
    arrays.write_snapshot(high, str(tmp_path / "high"))
    with pytest.raises(GraphError, match="bad_rank"):
        arrays.read_snapshot(spark, str(tmp_path / "high"))


def test_empty(spark, tmp_path):
    none = make_graph(spark, [], [])
    arrays.write_snapshot(none, str(tmp_path / "s"), True)
    arrays.write_json(none, str(tmp_path / "j"))
    assert arrays.read_snapshot(spark, str(tmp_path / "s")).nodes.isEmpty() and arrays.read_json(spark, str(tmp_path / "j")).edges.isEmpty()
