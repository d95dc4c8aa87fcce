"""Registered queries of the graph engine, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.functions import bits
from tiergraph.operators import build, distance, evaluate, grid, report, select, traverse
from tiergraph.operators.validate import violations
from tiergraph.plans.graphs import EVENT_CODES, TREE_GATES, conversation_graph, event_graph, event_rows, geography, line_tree, table
from tiergraph.schema import GATES, TOP_RANK, Graph, gate, make_graph, parts, shared_folder, stored
from tiergraph.sources import arrays, files, history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _long(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, floats as DOUBLE, to compare by value."""
    return df.select(*[F.col(c).cast({"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}.get(t, t)).alias(c) for c, t in df.dtypes])


# -- SQL of the derived graphs -------------------------------------------------

_CODE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_CODES.items()) + " END"
EVENTS = f"""ev0 AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS node_id FROM events),
ev AS (SELECT node_id, user_id, event_type, value, {_CODE} AS truth, lag(node_id) OVER (PARTITION BY user_id ORDER BY node_id) AS p0,
       lag(node_id) OVER (PARTITION BY user_id, event_type ORDER BY node_id) AS p1 FROM ev0),
n AS (SELECT node_id, {TOP_RANK} - node_id AS rank, truth, user_id % 3 AS node_type FROM ev),
e AS (SELECT node_id AS dst, 0 AS slot, p0 AS src FROM ev WHERE p0 IS NOT NULL UNION ALL SELECT node_id, 1, p1 FROM ev WHERE p1 IS NOT NULL AND p1 <> p0)"""


def _tree_sql(value: Callable[[str, int], str], levels: int = 12, leaf: str = "CAST(l_quantity > 25 AS BIGINT)") -> str:
    """Levels l0.. of the reduction tree (id, t); value gives a gate's result from its inputs' rows."""
    parts = [f"l0 AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS id, {leaf} AS t FROM lineitem)"]
    for k in range(1, levels):
        parts.append(f"l{k} AS (SELECT id // 6 AS id, {value('id', k)} AS t FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 1 GROUP BY id // 6)")
    union = " UNION ALL ".join(f"SELECT {k} AS level, id, t FROM l{k}" for k in range(levels))
    return "WITH " + ",\n".join(parts) + f",\ntr AS ({union}), top AS (SELECT max(level) AS top FROM tr), g AS (SELECT top - level AS rank, id, level, t FROM tr, top)"


def _gate_sql(_: str, k: int) -> str:
    pattern = GATES[TREE_GATES[(k - 1) % len(TREE_GATES)]]
    return f"CAST(({pattern}::UBIGINT >> CAST(sum(t << (id % 6)) AS UBIGINT)) & 1 AS BIGINT)"


_TREE = _tree_sql(_gate_sql)

# -- evaluation ----------------------------------------------------------------


@query(_TREE + " SELECT CAST(rank AS BIGINT) AS rank, count(*) AS n, CAST(sum(t) AS BIGINT) AS n_true FROM g GROUP BY rank")
def tick_tree_rank_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluate the line-item tree and count true nodes per rank."""
    after = evaluate.tick(line_tree(spark, sf_dir))
    return after.nodes.groupBy("rank").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("n_true"))


@query(_TREE + " SELECT CAST(rank AS BIGINT) AS rank, count(*) AS n, CAST(sum(t) AS BIGINT) AS n_true FROM g GROUP BY rank")
def tick_tree_by_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every rank by joins, as for ranks that no task can hold."""
    after = evaluate.tick(line_tree(spark, sf_dir), band_rows=0)
    return after.nodes.groupBy("rank").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("n_true"))


@query(_TREE + " SELECT CAST(coalesce(rank, -1) AS BIGINT) AS rank, count(*) AS n, CAST(sum(t) AS BIGINT) AS n_true FROM g GROUP BY ROLLUP (rank)")
def graph_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per rank, and for all nodes (as rank -1)."""
    return select.graph_info(evaluate.tick(line_tree(spark, sf_dir))).withColumn("rank", F.coalesce("rank", F.lit(-1)))


@query(_TREE + " SELECT CAST(0 AS BIGINT) AS rank, t AS truth, count(*) AS n FROM g WHERE rank = 0 AND t >= 0 GROUP BY t")
def eval_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick once, then roots that meet a predicate."""
    after = evaluate.tick(line_tree(spark, sf_dir))
    return _long(select.roots_where(after, select.parse_predicate("truth >= 0"), 0, 3).groupBy("rank", "truth").agg(F.count("*").alias("n")))


@query(_tree_sql(lambda _, k: "CAST(sum(CASE WHEN t = 1 THEN 1.0 ELSE 0.0 END) >= 3.0 AS BIGINT)", leaf="0::BIGINT").replace("0::BIGINT AS t", "CAST(l_quantity > 25 AS BIGINT) AS t") + " SELECT CAST(rank AS BIGINT) AS rank, count(*) AS n, CAST(sum(t) AS BIGINT) AS n_true FROM g GROUP BY rank")
def weighted_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of at least three; leaves are above the evaluated ranks and keep their truth."""
    graph = line_tree(spark, sf_dir)
    top = graph.nodes.agg(F.max("rank")).first()[0]
    after = evaluate.weighted_tick(graph, 3.0, max_rank=top)
    return after.nodes.groupBy("rank").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("n_true"))


@query(_TREE + " SELECT CAST(rank AS BIGINT) AS rank, CAST(sum(CASE WHEN rank = 2 THEN 0 ELSE t END) AS BIGINT) AS n_true FROM g GROUP BY rank")
def reset_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = evaluate.reset_rank(evaluate.tick(line_tree(spark, sf_dir)), 2)
    return after.nodes.groupBy("rank").agg(F.count_if(F.col("truth") == 1).alias("n_true"))


@query(_TREE + " SELECT CAST(rank AS BIGINT) AS rank, CAST(sum(t) AS BIGINT) AS n_true FROM g GROUP BY rank")
def tick_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = evaluate.resonance(line_tree(spark, sf_dir))
    return after.nodes.groupBy("rank").agg(F.count_if(F.col("truth") == 1).alias("n_true"))


@query("SELECT CAST(t AS BIGINT) AS tick, CAST(t % 2 AS BIGINT) AS truth FROM range(1, 6) AS r(t)")
def back_edge_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-bit register that a NOT gate feeds: 1, 0, 1, ..."""
    graph = make_graph(spark, [(0, 1, 0, 0, 0), (1, 0, 0, 0, gate("0x5555555555555555"))], [(1, 0, 0)], [(0, 1)])
    seen = []
    for _ in range(5):
        graph = evaluate.tick(graph)
        seen.append(graph)
    return _long(evaluate.batches(iter(seen)).where("node_id = 0").select("tick", "truth"))


@query("""SELECT 'AND' AS op, CAST(3 AS BIGINT) AS node_id, CAST((18364758544493064720::UBIGINT & 7608434000728254870::UBIGINT) >> 32 AS BIGINT) AS high
UNION ALL SELECT 'OR', 3, CAST((18364758544493064720::UBIGINT | 7608434000728254870::UBIGINT) >> 32 AS BIGINT)
UNION ALL SELECT 'XOR', 3, CAST(xor(18364758544493064720::UBIGINT, 7608434000728254870::UBIGINT) >> 32 AS BIGINT)""".replace("18364758544493064720", str(GATES["MAJ"])))
def compose_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = make_graph(spark, [(1, 1, 0, 0, gate("MAJ")), (2, 1, 0, 0, gate("XOR")), (3, 0, 0, 0, 0)], [])
    out = None
    for op in ("AND", "OR", "XOR"):
        done = evaluate.compose(graph, op, 1, 2, 3).nodes.where("node_id = 3").select(F.lit(op).alias("op"), "node_id", bits.lut_high(F.col("lut")).alias("high"))
        out = done if out is None else out.unionByName(done)
    return out


_PRESETS = " UNION ALL ".join(f"SELECT '{k}' AS gate, {v}::UBIGINT AS lut" for k, v in GATES.items())


@query(f"WITH g AS ({_PRESETS}) SELECT gate, i AS pattern, CAST((lut >> CAST(i AS UBIGINT)) & 1 AS BIGINT) AS value FROM g, range(64) AS r(i)")
def lut_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate on every input pattern."""
    gates = spark.createDataFrame([(k, gate(k)) for k in GATES], "gate string, lut bigint")
    rows = gates.select("gate", "lut", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return rows.select("gate", F.col("i").cast("bigint").alias("pattern"), bits.lut_bit(F.col("lut"), F.col("i")).alias("value"))


@query(f"WITH g AS ({_PRESETS}) SELECT gate, CAST(bit_count(lut::UBIGINT::BIT) AS BIGINT) AS ones, CAST(lut & 4294967295 AS BIGINT) AS low, CAST(lut >> 32 AS BIGINT) AS high FROM g".replace("bit_count(lut::UBIGINT::BIT)", "bit_count(lut & 4294967295) + bit_count(lut >> 32)"))
def lut_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = spark.createDataFrame([(k, gate(k)) for k in GATES], "gate string, lut bigint")
    return gates.select("gate", bits.popcount(F.col("lut")).cast("bigint").alias("ones"), bits.lut_low(F.col("lut")).alias("low"), bits.lut_high(F.col("lut")).alias("high"))


# -- scans and filters over the event graph --------------------------------------


def _ev(columns: str, where: str = "") -> str:
    return f"WITH {EVENTS} SELECT {columns} FROM n {where}"


_NODE = "node_id, CAST(rank AS BIGINT) AS rank, CAST(truth AS BIGINT) AS truth, CAST(node_type AS BIGINT) AS node_type"


@query(_ev("node_id, CAST(truth AS BIGINT) AS truth"))
def node_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(select.scan(event_graph(spark, sf_dir), "truth"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS truth, CAST(0 AS BIGINT) AS node_type FROM region")
def root_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(select.roots(geography(spark, sf_dir)[0].build(spark)))


@query(_ev(_NODE, "WHERE truth >= 4"))
def nodes_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(select.nodes(event_graph(spark, sf_dir), None, select.parse_predicate("truth >= 4")))


@query(_ev(_NODE, f"WHERE rank = {TOP_RANK - 17}"))
def nodes_at_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(select.nodes(event_graph(spark, sf_dir), TOP_RANK - 17))


@query(_ev("node_id, CAST(rank AS BIGINT) AS rank", f"WHERE truth = 2 AND rank BETWEEN {TOP_RANK - 5000} AND {TOP_RANK - 100}"))
def select_truth_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_truth_rank(event_graph(spark, sf_dir), 2, TOP_RANK - 5000, TOP_RANK - 100)


@query(_ev("node_id, CAST(rank AS BIGINT) AS rank", "WHERE truth = 3 ORDER BY rank, node_id LIMIT 25"))
def hive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query tool's form with its limit, a top-k by rank."""
    return select.select_truth_rank(event_graph(spark, sf_dir), 3, limit=25)


@query(_ev("CAST(truth AS BIGINT) AS truth, count(*) AS n", "GROUP BY truth"))
def bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(select.bucket_sizes(event_graph(spark, sf_dir)))


@query(_ev("node_id", f"WHERE rank BETWEEN {TOP_RANK - 300} AND {TOP_RANK - 200}"))
def rank_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.rank_range(event_graph(spark, sf_dir), TOP_RANK - 300, TOP_RANK - 200)


@query(_ev("CAST(truth AS BIGINT) AS truth", "WHERE node_id = 42"))
def get_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(select.truth_of(event_graph(spark, sf_dir), 42),)], "truth bigint")


@query("SELECT 'nation ' || n_nationkey AS label, CAST(5 + n_nationkey AS BIGINT) AS node_id FROM nation")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = geography(spark, sf_dir)[0].build(spark)
    return spark.createDataFrame([(k, v) for k, v in graph.labels.items() if k.startswith("nation")], "label string, node_id bigint")


@query(_ev("CAST(rank AS BIGINT) AS rank, count(*) AS n", f"WHERE rank > {TOP_RANK - 1000} GROUP BY rank"))
def rank_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    return distance.rank_profile(graph, distance.rank_range(graph, TOP_RANK - 999, TOP_RANK))


@query(f"WITH {EVENTS}, d AS (SELECT node_id, count(src) AS degree FROM n LEFT JOIN e ON n.node_id = e.dst GROUP BY node_id) SELECT degree, count(*) AS n FROM d GROUP BY degree")
def indegree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.indegree_distribution(event_graph(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT dst AS node_id, count(*) AS degree FROM e GROUP BY dst ORDER BY degree DESC, node_id LIMIT 5")
def top_indegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_indegree(event_graph(spark, sf_dir))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def event_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.type_distribution(table(spark, sf_dir, "events"), "event_type").withColumn("percent", F.round("percent", 6))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def agent_chain_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.chain_lengths(table(spark, sf_dir, "events"), "user_id")


@query(_ev("CAST(min(rank) AS BIGINT) AS lowest, CAST(max(rank) AS BIGINT) AS highest, count(*) AS n, count(DISTINCT rank) AS used"))
def rank_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rank_span(event_graph(spark, sf_dir).nodes)


_CONV = "c AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS node_id FROM conversations)"


@query(f"WITH {_CONV} SELECT conv_id, count(*) AS n, min(node_id) AS first_node, max(node_id) AS last_node FROM c GROUP BY conv_id")
def thread_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.threads(conversation_graph(spark, sf_dir)[1], "conv_id")


@query(f"WITH {_CONV}, p AS (SELECT node_id, lag(node_id) OVER (PARTITION BY conv_id ORDER BY node_id) AS src FROM c) SELECT node_id AS dst, CAST(0 AS BIGINT) AS slot, src FROM p WHERE src IS NOT NULL")
def dialogue_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(conversation_graph(spark, sf_dir)[0].edges.drop("weight"))


@query(f"WITH {EVENTS} SELECT node_id, coalesce(p0, -1) AS p0 FROM ev")
def previous_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select("node_id", F.coalesce("p0", F.lit(-1)).alias("p0"))


@query(f"WITH {EVENTS} SELECT dst, CAST(slot AS BIGINT) AS slot, src FROM e")
def event_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(event_graph(spark, sf_dir).edges.drop("weight"))


@query(f"WITH {EVENTS}, bad AS (SELECT 5000 AS dst, 5 AS slot, 5000 AS src UNION ALL SELECT 10, 4, 20 UNION ALL SELECT 30, 3, 999999999) SELECT CAST(dst AS BIGINT) AS dst, CAST(slot AS BIGINT) AS slot, CAST(src AS BIGINT) AS src, CASE WHEN src > 99999999 THEN 'range' WHEN src = dst THEN 'self_loop' ELSE 'rank' END AS problem FROM bad")
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three planted faults are the only violations."""
    graph = event_graph(spark, sf_dir)
    bad = spark.createDataFrame([(5000, 5, 5000, 1.0), (10, 4, 20, 1.0), (30, 3, 999999999, 1.0)], graph.edges.schema)
    return _long(violations(graph.with_edges(graph.edges.unionByName(bad))))


# -- traversal -------------------------------------------------------------------

_STEPS = "s AS (SELECT dst AS a, src AS b FROM e)"
_LAST = "(SELECT max(node_id) FROM n)"


def _reach(steps: str, seed: str, limit: str = "") -> str:
    return f"WITH RECURSIVE {EVENTS}, s AS MATERIALIZED ({steps}), r(node_id, depth) USING KEY (node_id) AS (SELECT {seed} AS node_id, 0 AS depth UNION SELECT s.b, min(r.depth) + 1 FROM r JOIN s ON s.a = r.node_id WHERE s.b NOT IN (SELECT node_id FROM recurring.r) {limit} GROUP BY s.b)"


_DOWN = "SELECT dst AS a, src AS b FROM e"
_BOTH = _DOWN + " UNION ALL SELECT src, dst FROM e"


@query(_reach(_DOWN, _LAST) + " SELECT n.node_id, CAST(coalesce(depth, -1) AS BIGINT) AS depth FROM n LEFT JOIN r USING (node_id)")
def bfs_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    return traverse.bfs_depths(graph, graph.nodes.agg(F.max("node_id")).first()[0], backward=True)


@query(_reach(_BOTH, "0") + " SELECT n.node_id, CAST(coalesce(depth, -1) AS BIGINT) AS depth FROM n LEFT JOIN r USING (node_id)")
def bfs_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.bfs_depths(event_graph(spark, sf_dir), 0)


@query(_reach(_DOWN, _LAST, "AND r.depth < 4") + " SELECT node_id, CAST(depth AS BIGINT) AS depth FROM r")
def ancestry_d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    return traverse.ancestry(graph, graph.nodes.agg(F.max("node_id")).first()[0], 4)


def _levels(depth: int) -> str:
    parts = [f"t0 AS (SELECT {_LAST} AS node_id)"]
    parts += [f"t{k} AS (SELECT DISTINCT b AS node_id FROM t{k - 1} JOIN s ON s.a = t{k - 1}.node_id WHERE b NOT IN (SELECT node_id FROM t{k - 1}))" for k in range(1, depth)]
    union = " UNION ALL ".join(f"SELECT {k} AS level, node_id FROM t{k}" for k in range(depth))
    return f"WITH {EVENTS}, {_STEPS}, {', '.join(parts)}, lv AS ({union}) SELECT CAST(level AS BIGINT) AS level, {_NODE} FROM lv JOIN n USING (node_id)"


@query(_levels(5))
def traverse_d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    return _long(traverse.traverse(graph, graph.nodes.agg(F.max("node_id")).first()[0], 5))


_A, _B = (TOP_RANK - 1500, TOP_RANK - 100), (TOP_RANK - 2500, TOP_RANK - 900)
_SETS = f"sa AS (SELECT node_id FROM n WHERE rank BETWEEN {_A[0]} AND {_A[1]}), sb AS (SELECT node_id FROM n WHERE rank BETWEEN {_B[0]} AND {_B[1]}), ea AS (SELECT dst, src FROM e WHERE dst IN (FROM sa) AND src IN (FROM sa)), eb AS (SELECT dst, src FROM e WHERE dst IN (FROM sb) AND src IN (FROM sb))"


@query(f"WITH {EVENTS}, {_SETS} SELECT dst, src FROM ea")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    return traverse.induced(graph.edges, distance.rank_range(graph, *_A))


def _shape_sql(members: str, name: str) -> str:
    """(origin, shape, n) of sets given as (origin, node_id)."""
    return f"""{name}_i AS (SELECT m.origin, e.dst AS node_id, list(x.rank || '/' || x.node_type ORDER BY x.rank, x.node_type) AS ins FROM {members} m JOIN e ON e.dst = m.node_id JOIN {members} m2 ON m2.origin = m.origin AND m2.node_id = e.src JOIN n x ON x.node_id = e.src GROUP BY ALL),
{name} AS (SELECT m.origin, n.rank || '/' || n.node_type || ':' || coalesce(array_to_string(i.ins, ','), '') AS shape, count(*) AS n FROM {members} m JOIN n ON n.node_id = m.node_id LEFT JOIN {name}_i i ON i.origin = m.origin AND i.node_id = m.node_id GROUP BY ALL)"""


def _typed(sql: str) -> str:
    """The event graph with coarse ranks, so that shapes repeat."""
    return sql.replace(f"{TOP_RANK} - node_id AS rank", "1000 - node_id // 500 AS rank")


def _coarse(graph: Graph) -> Graph:
    return graph.with_nodes(graph.nodes.withColumn("rank", F.lit(1000).cast("bigint") - F.expr("node_id div 500")))


_C, _D = (980, 998), (990, 1000)


def _coarse_sets() -> str:
    return _typed(EVENTS) + f", sa AS (SELECT 0 AS origin, node_id FROM n WHERE rank BETWEEN {_C[0]} AND {_C[1]}), sb AS (SELECT 0 AS origin, node_id FROM n WHERE rank BETWEEN {_D[0]} AND {_D[1]}), ea AS (SELECT dst, src FROM e WHERE dst IN (SELECT node_id FROM sa) AND src IN (SELECT node_id FROM sa)), eb AS (SELECT dst, src FROM e WHERE dst IN (SELECT node_id FROM sb) AND src IN (SELECT node_id FROM sb))"


def _l_sql(a: str, b: str, key: str, power: int) -> str:
    inner = f"SELECT coalesce(x.c, 0) - coalesce(y.c, 0) AS g FROM (SELECT {key}, count(*) AS c FROM {a} GROUP BY {key}) x FULL JOIN (SELECT {key}, count(*) AS c FROM {b} GROUP BY {key}) y USING ({key})"
    total = "sum(abs(g))" if power == 1 else "sqrt(sum(g * g))"
    return f"(SELECT {total} FROM ({inner})) / ((SELECT count(*) FROM sa) + (SELECT count(*) FROM sb))"


def _jac(a: str, b: str) -> str:
    return f"1 - (SELECT count(*) FROM (FROM {a} INTERSECT FROM {b}))::DOUBLE / (SELECT count(*) FROM (FROM {a} UNION FROM {b}))"


def _delta(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM (FROM {a} EXCEPT FROM {b})) + (SELECT count(*) FROM (FROM {b} EXCEPT FROM {a}))"


_METRICS_SQL = {
    "jaccardNodes": _jac("sa", "sb"),
    "jaccardEdges": _jac("ea", "eb"),
    "rankL1": _l_sql("(SELECT n.* FROM n JOIN sa USING (node_id))", "(SELECT n.* FROM n JOIN sb USING (node_id))", "rank", 1),
    "rankL2": _l_sql("(SELECT n.* FROM n JOIN sa USING (node_id))", "(SELECT n.* FROM n JOIN sb USING (node_id))", "rank", 2),
    "typeL1": _l_sql("(SELECT n.* FROM n JOIN sa USING (node_id))", "(SELECT n.* FROM n JOIN sb USING (node_id))", "node_type", 1),
    "boundedGED": _delta("sa", "sb") + " + " + _delta("ea", "eb"),
    "wlL1": "(SELECT sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0))) FROM ha x FULL JOIN hb y USING (shape)) / ((SELECT count(*) FROM sa) + (SELECT count(*) FROM sb))",
}


@query(f"WITH {_coarse_sets()}, {_shape_sql('sa', 'ha')}, {_shape_sql('sb', 'hb')} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(CAST({sql} AS DOUBLE), 9) AS value, (SELECT count(*) FROM sa) AS size_a, (SELECT count(*) FROM sb) AS size_b" for m, sql in _METRICS_SQL.items()))
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven distances between two rank ranges."""
    graph = _coarse(event_graph(spark, sf_dir))
    graph = Graph(stored(graph.nodes), stored(graph.edges))
    a, b = distance.rank_range(graph, *_C), distance.rank_range(graph, *_D)
    out = None
    for m in _METRICS_SQL:
        row = distance.distance(graph, m, a, b)
        out = row if out is None else out.unionByName(row)
    return out.withColumn("value", F.round("value", 9))


@query(f"WITH {_coarse_sets()}, {_shape_sql('sa', 'ha')} SELECT n AS repeats, count(*) AS shapes FROM ha GROUP BY n")
def wl1_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _coarse(event_graph(spark, sf_dir))
    members = distance.rank_range(graph, *_C).select(F.lit(0).cast("bigint").alias("origin"), "node_id")
    return traverse.shapes(graph, members).groupBy(F.col("n").alias("repeats")).agg(F.count("*").alias("shapes"))


@query("SELECT i AS nth, CASE WHEN i = 0 THEN 0.0 WHEN i = 6 THEN 7.0 ELSE 1.0 END AS value FROM range(7) AS r(i)")
def spectrum_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues of a gate with six inputs."""
    graph = make_graph(spark, [(i, 2 if i < 6 else 1, 0, 0, 0) for i in range(7)], [(6, k, k) for k in range(6)])
    return distance.spectrum(graph, graph.nodes.select("node_id")).withColumn("value", F.abs(F.round("value", 6)))


@query(f"WITH {EVENTS}, {_SETS}, p AS (SELECT dst AS r, src AS c FROM ea UNION SELECT src, dst FROM ea) SELECT r AS row, c AS col, CAST(-1 AS BIGINT) AS value FROM p UNION ALL SELECT r, r, count(*) FROM p GROUP BY r")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    return distance.laplacian(graph, distance.rank_range(graph, *_A))


_ORIGINS = "SELECT node_id AS origin, node_id FROM n"
_ANC = f"a0 AS ({_ORIGINS}), a1 AS (SELECT DISTINCT origin, src AS node_id FROM a0 JOIN e ON e.dst = a0.node_id), a2 AS (SELECT DISTINCT origin, src AS node_id FROM a1 JOIN e ON e.dst = a1.node_id), anc AS (FROM a0 UNION FROM a1 UNION FROM a2)"


@query(f"""WITH {_typed(EVENTS)}, {_ANC}, {_shape_sql('anc', 'h')}, q AS (SELECT shape, n AS q FROM h WHERE origin = {_LAST}), z AS (SELECT origin, sum(n) AS size FROM h GROUP BY origin),
c AS (SELECT origin, sum(least(n, q)) AS common FROM h JOIN q USING (shape) GROUP BY origin), t AS (SELECT sum(q) AS t FROM q)
SELECT origin AS node_id, round(CAST((size + t - 2 * coalesce(common, 0)) / (size + t) AS DOUBLE), 9) AS distance FROM z LEFT JOIN c USING (origin), t JOIN n ON true WHERE n.node_id = origin AND n.truth = 2 AND origin <> {_LAST} ORDER BY 2, 1 LIMIT 10""")
def similar_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _coarse(event_graph(spark, sf_dir))
    graph = Graph(stored(graph.nodes), stored(graph.edges))
    last = graph.nodes.agg(F.max("node_id")).first()[0]
    return traverse.similar(graph, last, 2, 10, truth=2).withColumn("distance", F.round("distance", 9))


@query(f"WITH {EVENTS}, {_SETS} SELECT 'both' AS part, count(*) AS n FROM (FROM sa INTERSECT FROM sb) UNION ALL SELECT 'any', count(*) FROM (FROM sa UNION FROM sb) UNION ALL SELECT 'one', {_delta('sa', 'sb')}")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    a, b = distance.rank_range(graph, *_A), distance.rank_range(graph, *_B)
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    one = a.exceptAll(b).unionAll(b.exceptAll(a))
    return count(a.intersect(b), "both").unionAll(count(a.union(b).distinct(), "any")).unionAll(count(one, "one"))


# -- construction ------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT node_id, 100000000 - node_id AS by_sequence, {TOP_RANK} - node_id AS by_counter FROM ev")
def rank_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("node_id")
    first = build.SequencePosition(100000000, "node_id").assign(rows).withColumnRenamed("rank", "by_sequence")
    return build.InsertCounter().assign(first).select("node_id", "by_sequence", F.col("rank").alias("by_counter"))


@query(f"WITH {_CONV}, m AS (SELECT ceil(1000000 / (max(conv_id) + 1)) AS band FROM c) SELECT node_id, CAST((conv_id + 1) * band - 1 - turn AS BIGINT) AS rank FROM c, m")
def chain_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_graph(spark, sf_dir)[1]
    return build.ChainBands(1000000, "conv_id", "turn").assign(rows).select("node_id", "rank")


@query("SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS ghosts FROM nation JOIN supplier ON n_nationkey = s_nationkey CROSS JOIN range(6) GROUP BY n_regionkey")
def ghost_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers at rank 8 reach their nation at rank 1 through six pass-through nodes each."""
    builder, suppliers = geography(spark, sf_dir)
    base = builder.build(spark)
    start = len(builder.rows)
    rows = suppliers.select((F.col("s_suppkey") + start).alias("node_id"), F.lit(8).cast("bigint").alias("rank"), F.lit(1).cast("smallint").alias("truth"), F.lit(0).cast("smallint").alias("node_type"), F.lit(-1).cast("bigint").alias("lut"), "s_nationkey")
    full = base.with_nodes(base.nodes.unionByName(rows.drop("s_nationkey")))
    labels = spark.createDataFrame([(int(k.split()[1]), v) for k, v in builder.labels.items() if k.startswith("nation")], "nation int, dst bigint")
    pairs = rows.join(F.broadcast(labels), F.col("s_nationkey") == F.col("nation")).select("dst", F.col("node_id").alias("src"))
    done = build.ghost_paths(full, pairs)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    # Each ghost leads down to one nation: count the ghosts on the paths by their end.
    edges = done.edges.join(done.nodes.where("node_type = 2").select(F.col("node_id").alias("src")), "src")
    at, total = labels.select("nation", F.col("dst").alias("node_id")), None
    for _ in range(6):
        at = edges.join(at.withColumnRenamed("node_id", "dst"), "dst").select("nation", F.col("src").alias("node_id"))
        total = at if total is None else total.unionByName(at)
    return _long(total.join(nations, "nation").groupBy("region").agg(F.count("*").alias("ghosts")).select(F.col("region").cast("int"), "ghosts")).withColumn("region", F.col("region").cast("int"))


@query("SELECT CAST(25 AS BIGINT) AS hubs, CAST(0 AS BIGINT) AS bad, CAST(6 AS BIGINT) AS widest")
def hub_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred sources into each of 25 hubs: no node has more than six inputs and the graph is valid."""
    b = build.Builder()
    hubs = [b.gate(0, "OR") for _ in range(25)]
    for h in hubs:
        b.split_hub([b.leaf(9, 1) for _ in range(200)], h)
    graph = b.build(spark)
    widest = graph.edges.groupBy("dst").agg(F.count("*").alias("n")).agg(F.max("n").alias("widest"))
    return violations(graph).agg(F.count("*").alias("bad")).join(widest).select(F.lit(len(hubs)).cast("bigint").alias("hubs"), "bad", "widest")


@query("WITH RECURSIVE z(level, n) AS (SELECT 0, 50000 UNION ALL SELECT level + 1, CAST(ceil(n / 6.0) AS INT) FROM z WHERE n > 1) SELECT CAST((SELECT max(level) FROM z) - level AS BIGINT) AS rank, CAST(n AS BIGINT) AS n FROM z")
def synthetic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.tree(spark, 50000).nodes.groupBy("rank").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT node_id, CAST(CASE WHEN node_id % 10 = 0 THEN 7 ELSE truth END AS BIGINT) AS truth FROM n")
def truth_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    values = graph.nodes.where("node_id % 10 = 0").select("node_id", F.lit(7).alias("value"))
    return _long(build.set_values(graph, "truth", values).nodes.select("node_id", "truth"))


@query("WITH c AS (SELECT i AS cell, i % 40 AS c, i // 40 AS r FROM range(1200) AS t(i)) SELECT cell, CAST((c + r + 4 * (c % 2)) % 7 AS BIGINT) AS colour FROM c")
def hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cells(spark, 40, 30).select("cell", "colour")


_HEX = "WITH c AS (SELECT i AS cell, i % 40 AS c, i // 40 AS r FROM range(1200) AS t(i)), d AS (" + " UNION ALL ".join(f"SELECT {p} AS odd, {k} AS direction, {a} AS dc, {b} AS dr" for p, steps in ((0, grid.EVEN), (1, grid.ODD)) for k, (a, b) in enumerate(steps)) + ")"


@query(_HEX + " SELECT cell, CAST(direction AS BIGINT) AS direction, CAST((r + dr) * 40 + c + dc AS BIGINT) AS neighbour FROM c JOIN d ON c.c % 2 = d.odd WHERE c + dc BETWEEN 0 AND 39 AND r + dr BETWEEN 0 AND 29")
def hex_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.neighbours(grid.cells(spark, 40, 30), 40, 30)


@query("WITH c AS (SELECT i AS cell, i % 40 AS c, i // 40 AS r FROM range(1200) AS t(i)), q AS (SELECT cell, c AS x, (r - (c - c % 2) // 2 + 65536) % 65536 AS y FROM c), m AS (SELECT cell, (SELECT sum(((x >> b) & 1) << (2 * b)) + sum(((y >> b) & 1) << (2 * b + 1)) FROM range(16) AS s(b)) AS code FROM q) SELECT cell, row_number() OVER (ORDER BY code, cell) - 1 AS morton_rank FROM m")
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.morton_ranks(grid.cells(spark, 40, 30))


_FRAME = "f AS (SELECT i // 96 AS row, i % 96 AS col, (i * 7 + i // 11) % 5 AS value FROM range(9216) AS t(i))"


@query(f"WITH {_FRAME}, k AS (SELECT row // 8 AS row, col // 8 AS col, list(value & 7) AS v FROM f GROUP BY ALL), c AS (SELECT row, col, [len([x FOR x IN v IF x = j]) FOR j IN [0, 1, 2, 3, 4]] AS c FROM k) SELECT row, col, CAST(CASE WHEN c[4] * 100 > 64 THEN 3 WHEN c[3] * 100 > 192 THEN 2 ELSE list_position(c, list_max(c)) - 1 END AS BIGINT) AS value FROM c")
def lod_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.range(9216).select(F.expr("id div 96").alias("row"), (F.col("id") % 96).alias("col"), F.expr("(id * 7 + id div 11) % 5").alias("value"))
    return grid.downsample(frame, 8)


_TILES = "t AS (SELECT i // 4096 // 2 AS tile_row, i // 4096 % 2 AS tile_col, i % 4096 // 64 AS row, i % 64 AS col, i % 251 AS value FROM range(16384) AS s(i))"


@query(f"WITH {_TILES}, h AS (SELECT tile_row + 1 AS tile_row, tile_col, 'N' AS side, value FROM t WHERE row >= 61 UNION ALL SELECT tile_row - 1, tile_col, 'S', value FROM t WHERE row < 3 UNION ALL SELECT tile_row, tile_col + 1, 'W', value FROM t WHERE col >= 61 UNION ALL SELECT tile_row, tile_col - 1, 'E', value FROM t WHERE col < 3) SELECT tile_row, tile_col, side, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM h WHERE tile_row BETWEEN 0 AND 1 AND tile_col BETWEEN 0 AND 1 GROUP BY ALL")
def tile_halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = spark.range(16384).select(F.expr("id div 4096 div 2").alias("tile_row"), F.expr("id div 4096 % 2").alias("tile_col"), F.expr("id % 4096 div 64").alias("row"), (F.col("id") % 64).alias("col"), (F.col("id") % 251).alias("value"))
    return grid.halos(tiles, 64, 64).groupBy("tile_row", "tile_col", "side").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH {EVENTS} SELECT node_id, CAST(CASE WHEN value > 60 THEN 1 WHEN value < -60 THEN -1 ELSE 0 END AS BIGINT) AS level, round(avg(value) OVER (PARTITION BY user_id ORDER BY node_id ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), 6) AS smooth FROM ev")
def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("node_id", "user_id", "value")
    return grid.quantised(rows, "user_id", "node_id", "value", 60.0).select("node_id", "level", F.round("smooth", 6).alias("smooth"))


# -- versions, logs, files -----------------------------------------------------------


_TICKS = f"WITH {EVENTS}, f AS (SELECT t AS tick, node_id, (truth + (node_id % 7 = t % 7)::INT) AS truth FROM n, range(12) AS r(t) WHERE node_id < 2000)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = event_graph(spark, sf_dir).nodes.where("node_id < 2000")
    ticks = nodes.select("node_id", "truth", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t"))
    return ticks.select(F.col("t").cast("bigint").alias("tick"), "node_id", (F.col("truth") + (F.col("node_id") % 7 == F.col("t") % 7).cast("int")).cast("smallint").alias("truth"))


@query(_TICKS + " SELECT node_id, CAST(truth AS BIGINT) AS truth FROM f WHERE tick = 8")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State at a tick from keyframes and changes."""
    kept = stored(history.changes(_frames(spark, sf_dir), 5))
    return _long(history.state_at(kept, 8, 5))


@query("SELECT i AS cell, CAST(xor(xor(i % 8, (i * 3) % 8), (i * 5) % 8) AS BIGINT) AS value FROM range(1000) AS t(i)")
def xor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell series decoded from a keyframe and two exclusive-or frames."""
    base = spark.range(1000)
    out = None
    for tick, factor in ((10, 1), (11, 3), (12, 5)):
        rows = base.select(F.lit(tick).alias("tick"), F.col("id").alias("cell"), (F.col("id") * factor % 8).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return history.xor_state(out, 12, 10)


@query(_TICKS + " SELECT tick, count(*) AS n, CAST(sum(truth) AS BIGINT) AS total FROM f WHERE tick > 11 - 4 GROUP BY tick")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent(_frames(spark, sf_dir), 4).groupBy("tick").agg(F.count("*").alias("n"), F.sum("truth").alias("total"))


@query(f"""WITH {EVENTS}, log AS (SELECT node_id AS seq, node_id % 500 AS node, truth + 10 AS value FROM n WHERE node_id < 3000), w AS (SELECT node, max_by(value, seq) AS value FROM log WHERE seq > 1000 GROUP BY node)
SELECT node_id, CAST(coalesce(value, truth) AS BIGINT) AS truth FROM n LEFT JOIN w ON w.node = n.node_id""")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations after the last checkpoint, last write first."""
    graph = event_graph(spark, sf_dir)
    edits = graph.nodes.where("node_id < 3000").select(F.col("node_id").alias("seq"), F.lit("truth").alias("op"), (F.col("node_id") % 500).alias("node_id"), (F.col("truth") + 10).cast("bigint").alias("value"))
    marks = edits.where("seq = 1000").select("seq", F.lit("checkpoint").alias("op"), F.lit(None).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("value"))
    return _long(history.replay(graph, edits.where("seq <> 1000").unionByName(marks)).nodes.select("node_id", "truth"))


@query(f"WITH {EVENTS} SELECT node_id, CAST(CASE WHEN node_id % 100 = 0 THEN 9 ELSE truth END AS BIGINT) AS truth FROM n WHERE node_id % 1000 <> 1")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base, a difference with changed and removed nodes, and their restored sum."""
    graph = event_graph(spark, sf_dir)
    graph = Graph(stored(graph.nodes), stored(graph.edges))
    chain = history.Backup(spark, _new_path(spark, "backup"))
    chain.init(graph)
    changed = graph.nodes.where("node_id % 1000 <> 1").withColumn("truth", F.when(F.col("node_id") % 100 == 0, 9).otherwise(F.col("truth")).cast("smallint"))
    chain.append(graph.with_nodes(changed))
    return _long(chain.restore().nodes.select("node_id", "truth"))


def _new_path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/graph/{name}-{uuid.uuid4().hex}"


_ALL_NODES = f"WITH {EVENTS} SELECT {_NODE} FROM n"


@query(_ALL_NODES)
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "version")
    files.save(event_graph(spark, sf_dir), path)
    return _long(files.load(spark, path).nodes.drop("lut"))


@query(_ALL_NODES)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "csv")
    files.save_csv(event_graph(spark, sf_dir), path)
    return _long(files.load_csv(spark, path).nodes.drop("lut"))


@query(_ALL_NODES)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "json")
    arrays.write_json(event_graph(spark, sf_dir), path)
    return _long(arrays.read_json(spark, path).nodes.drop("lut"))


@query(f"WITH {EVENTS} SELECT dst, CAST(slot AS BIGINT) AS slot, src FROM e")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "snapshot")
    arrays.write_snapshot(event_graph(spark, sf_dir), path, compressed=True)
    return _long(arrays.read_snapshot(spark, path).edges.drop("weight"))


@query(f"WITH {EVENTS} SELECT dst, CAST(slot AS BIGINT) AS slot, src FROM e")
def buffers_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "buffers")
    arrays.write_buffers(event_graph(spark, sf_dir), path)
    return _long(arrays.read_buffers(spark, path).edges.drop("weight"))


@query("SELECT i AS node_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS truth FROM range(3, 40) AS t(i) UNION ALL SELECT i, 1, 1 FROM range(3) AS t(i)")
def pad_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = make_graph(spark, [(i, 1, 1, 0, 0) for i in range(3)], []).pad_to(40)
    return _long(graph.nodes.select("node_id", "rank", "truth"))


# -- the same over whole tables ----------------------------------------------------------
# The queries above keep their fixed id ranges, as their SQL is fixed; these take in every event.


_EVERY_TICK = f"WITH {EVENTS}, f AS (SELECT t AS tick, node_id, (truth + (node_id % 7 = t % 7)::INT) AS truth FROM n, range(12) AS r(t))"
_SPAN = "b AS (SELECT min(rank) AS lo, max(rank) AS hi FROM n), sa AS (SELECT node_id FROM n, b WHERE rank >= lo + (hi - lo) // 4), sb AS (SELECT node_id FROM n, b WHERE rank <= hi - (hi - lo) // 4)"


def _every_frame(nodes: DataFrame) -> DataFrame:
    ticks = nodes.select("node_id", "truth", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("t"))
    return ticks.select(F.col("t").cast("bigint").alias("tick"), "node_id", (F.col("truth") + (F.col("node_id") % 7 == F.col("t") % 7).cast("int")).cast("smallint").alias("truth"))


def _span(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The upper and the lower three quarters of the graph's own ranks, and all of them."""
    lo, hi = graph.nodes.agg(F.min("rank"), F.max("rank")).first()
    if lo is None:
        lo = hi = 0
    quarter = (hi - lo) // 4
    return distance.rank_range(graph, lo + quarter, hi), distance.rank_range(graph, lo, hi - quarter), distance.rank_range(graph, lo, hi)


@query(_EVERY_TICK + " SELECT node_id, CAST(truth AS BIGINT) AS truth FROM f WHERE tick = 8")
def time_travel_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stored(history.changes(_every_frame(event_graph(spark, sf_dir).nodes), 5))
    return _long(history.state_at(kept, 8, 5))


@query(_EVERY_TICK + " SELECT tick, count(*) AS n, CAST(sum(truth) AS BIGINT) AS total FROM f WHERE tick > 11 - 4 GROUP BY tick")
def ring_buffer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent(_every_frame(event_graph(spark, sf_dir).nodes), 4).groupBy("tick").agg(F.count("*").alias("n"), F.sum("truth").alias("total"))


@query(f"""WITH {EVENTS}, mark AS (SELECT max(node_id) // 2 AS mark FROM n), log AS (SELECT x.node_id AS seq, e.src AS node, x.truth + 10 AS value FROM n x JOIN e ON e.dst = x.node_id
UNION ALL SELECT node_id, min(node_id) OVER (PARTITION BY user_id), truth + 10 FROM ev), w AS (SELECT node, max_by(value, seq) AS value FROM log, mark WHERE seq > mark GROUP BY node)
SELECT node_id, CAST(coalesce(value, truth) AS BIGINT) AS truth FROM n LEFT JOIN w ON w.node = n.node_id""")
def wal_replay_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event writes to its inputs and to its user's first event, a hot node; a checkpoint is halfway."""
    graph, rows = event_graph(spark, sf_dir), event_rows(spark, sf_dir)
    first = rows.groupBy("user_id").agg(F.min("node_id").alias("to"))
    targets = graph.edges.select(F.col("dst").alias("seq"), F.col("src").alias("to")).unionByName(rows.join(first, "user_id").select(F.col("node_id").alias("seq"), "to"))
    values = graph.nodes.select(F.col("node_id").alias("seq"), (F.col("truth") + 10).cast("bigint").alias("value"))
    edits = targets.join(values, "seq").select("seq", F.lit("truth").alias("op"), F.col("to").alias("node_id"), "value")
    marks = graph.nodes.agg(F.expr("max(node_id) div 2").alias("seq")).select("seq", F.lit("checkpoint").alias("op"), F.lit(None).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("value"))
    return _long(history.replay(graph, edits.unionByName(marks)).nodes.select("node_id", "truth"))


@query(f"WITH {EVENTS}, {_SPAN} SELECT 'a' AS part, dst, src FROM e WHERE dst IN (FROM sa) AND src IN (FROM sa) UNION ALL SELECT 'b', dst, src FROM e WHERE dst IN (FROM sb) AND src IN (FROM sb)")
def induced_edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    a, b, _ = _span(graph)
    every = stored(graph.edges.select("dst", "src"))
    partitions = parts(every.count())
    edges = lambda members, part: traverse.induced(every, members, partitions).select(F.lit(part).alias("part"), "dst", "src")
    return edges(a, "a").unionByName(edges(b, "b"))


@query(f"WITH {EVENTS}, p AS (SELECT dst AS r, src AS c FROM e UNION SELECT src, dst FROM e) SELECT r AS row, c AS col, CAST(-1 AS BIGINT) AS value FROM p UNION ALL SELECT r, r, count(*) FROM p GROUP BY r")
def laplacian_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    return distance.laplacian(graph, _span(graph)[2])


@query(f"WITH {EVENTS}, {_SPAN} SELECT 'both' AS part, count(*) AS n FROM (FROM sa INTERSECT FROM sb) UNION ALL SELECT 'any', count(*) FROM (FROM sa UNION FROM sb) UNION ALL SELECT 'one', {_delta('sa', 'sb')}")
def set_operations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = _span(event_graph(spark, sf_dir))
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(a.intersect(b), "both").unionAll(count(a.union(b).distinct(), "any")).unionAll(count(a.exceptAll(b).unionAll(b.exceptAll(a)), "one"))


@query(_ev("CAST(rank AS BIGINT) AS rank, count(*) AS n", "GROUP BY rank"))
def rank_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    return distance.rank_profile(graph, _span(graph)[2])


# -- the four-stage runtime ------------------------------------------------------------


def _waves(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(0, 0, 1, 0), (1, 0, 0, 0), (2, 0, 1, 0), (3, 1, 0, gate("OR")), (4, 1, 0, gate("XOR")), (5, 2, 0, gate("AND3"))]
    nodes = spark.createDataFrame(rows, "node_id bigint, rank bigint, state tinyint, lut bigint")
    edges = spark.createDataFrame([(3, 0, 0, 1.0), (3, 1, 1, 1.0), (4, 0, 1, 1.0), (4, 1, 2, 1.0), (5, 0, 3, 1.0), (5, 1, 4, 1.0), (5, 2, 2, 1.0)], "dst bigint, slot tinyint, src bigint, weight float")
    return nodes, edges


@query("SELECT CAST(i AS BIGINT) AS node_id, CAST(r AS BIGINT) AS rank, CAST(s AS BIGINT) AS state, 'forward' AS stage FROM (VALUES (0,0,1),(1,0,0),(2,0,1),(3,1,1),(4,1,1),(5,2,1)) AS v(i, r, s) UNION ALL SELECT i + 6, 5 - r, s, 'backward' FROM (VALUES (0,0,1),(1,0,0),(2,0,1),(3,1,1),(4,1,1),(5,2,1)) AS v(i, r, s)")
def wave_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(evaluate.waves(*_waves(spark)))


@query("SELECT CAST(1 AS BIGINT) AS epoch, CAST(6 AS BIGINT) AS wave_lines, CAST(0 AS BIGINT) AS entropy")
def wave_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(evaluate.telemetry(*_waves(spark)))
