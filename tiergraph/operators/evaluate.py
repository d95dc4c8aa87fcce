"""Circuit evaluation: ticks in rank order, weighted ticks, resonance, registers, table algebra, waves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.schema import MAX_RANK, Graph, lut_bit, stored

#: Inputs of a band of consecutive ranks that one task evaluates; a wider rank is evaluated by joins.
BAND_ROWS = 1_000_000
#: Inputs that are sent to every task, which then finds their sources without a shuffle of all truths.
SENT_ROWS = 1_000_000


def _band_task(weighted: float | None, marked: bool):
    """Evaluates a band, from its highest rank down: its inputs (t -1), and those from above that count, with their truth."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows[rows.t < 0].drop_duplicates("node_id").sort_values("rank", ascending=False, kind="stable")
        ids, rank, lut = nodes.node_id.to_numpy(), nodes["rank"].to_numpy(), nodes.lut.to_numpy().astype(np.int64).view(np.uint64)
        was = nodes.was.to_numpy().astype(np.int64)
        truth = was.copy()
        if len(ids):
            order = np.argsort(ids)
            ranked = ids[order]
            place = lambda x: order[np.minimum(np.searchsorted(ranked, x), len(ids) - 1)]
            dst, src = place(rows.node_id.to_numpy()), place(rows.src.to_numpy())
            by_place = np.argsort(dst, kind="stable")
            dst, src = dst[by_place], src[by_place]
            inside = ids[src] == rows.src.to_numpy()[by_place]
            above = np.maximum(rows.t.to_numpy().astype(np.int64), 0)[by_place]
            slot = rows.slot.to_numpy().astype(np.int64)[by_place]
            weight = rows.weight.to_numpy().astype(np.float64)[by_place] if weighted is not None else None
            starts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for first, end in zip(starts, np.append(starts[1:], len(rank)), strict=True):
                a, b = np.searchsorted(dst, [first, end])
                value = np.where(inside[a:b], truth[src[a:b]], above[a:b])
                if weighted is None:
                    bits = np.bincount(dst[a:b] - first, weights=(value == 1) * np.exp2(slot[a:b]), minlength=end - first).astype(np.uint64)
                    truth[first:end] = (lut[first:end] >> bits) & np.uint64(1)
                else:
                    votes = np.where(value == 1, 1.0, np.where(value == 2, 0.5, 0.0)) * weight[a:b]
                    truth[first:end] = np.bincount(dst[a:b] - first, weights=votes, minlength=end - first) >= weighted
                if marked:
                    truth[first:end] = np.where(truth[first:end] == was[first:end], truth[first:end], 2)
        return nodes.drop(columns=["slot", "src", "weight", "t"]).assign(truth=truth.astype(np.int16))

    return run


def _bands(inputs: DataFrame, band_rows: int) -> list[tuple[int, int, int, bool]]:
    """(lowest, highest rank, inputs, whether it is one wide rank) of consecutive ranks in use, from the highest."""
    sizes = inputs.groupBy("rank").agg(F.count("*").alias("n"))
    out: list[tuple[int, int, int, bool]] = []
    room = 0
    for r, n in sorted(((x["rank"], x["n"]) for x in sizes.collect()), reverse=True):  # max_rank rows at most
        if n > band_rows:
            out.append((r, r, n, True))
            room = 0
        elif n <= room:
            out[-1] = (r, out[-1][1], out[-1][2] + n, False)
            room -= n
        else:
            out.append((r, r, n, False))
            room = band_rows - n
    return out


def _bit_sum() -> Column:
    return F.when(F.col("t") == 1, F.call_function("shiftleft", F.lit(1), F.col("slot").cast("int"))).otherwise(0)


def _weight_sum() -> Column:
    return F.col("weight").cast("double") * F.when(F.col("t") == 1, 1.0).when(F.col("t") == 2, 0.5).otherwise(0.0)


def _evaluated(graph: Graph, max_rank: int, weighted: float | None, band_rows: int, marked: bool = False) -> DataFrame:
    """The nodes after one evaluation, from the highest rank below max_rank to the lowest, and their truth before (was).

    Nodes meet their inputs once, and every step carries whole nodes, so that nothing is joined at the end.
    Nodes without inputs need no step.  Of the others, consecutive ranks go together as long as a task can
    hold them; a wider rank is a join and a sum of its own.  Each step is stored, so plans stay short and a
    lost executor costs one step.  `marked` turns what changed into 2.
    """
    own = [c for c in graph.nodes.columns if c != "truth"] + ["was"]
    before = graph.nodes.withColumnRenamed("truth", "was")
    edges = graph.edges.where("src IS NOT NULL").select(F.col("dst").alias("__dst"), "slot", "src", "weight")
    rows = stored(before.join(edges, (F.col("node_id") == F.col("__dst")) & (F.col("rank") < max_rank), "left").select(*own, "slot", "src", "weight"))

    def settled(value: Column) -> Column:
        return (F.when(value == F.col("was"), value).otherwise(2) if marked else value).cast("smallint").alias("truth")

    def result(x: Column) -> Column:
        return settled(lut_bit(F.col("lut"), x) if weighted is None else (x >= weighted).cast("int"))

    inputs = rows.where("src IS NOT NULL")
    alone = rows.where("src IS NULL").select(*own, F.when(F.col("rank") >= max_rank, F.col("was")).otherwise(result(F.lit(0))).alias("truth"))
    measure, counts = (_bit_sum(), "truth = 1") if weighted is None else (_weight_sum(), "truth IN (1, 2)")
    done = [alone]
    for lo, hi, n, wide in _bands(inputs, band_rows):
        # Other truths add nothing.
        state = [d.where(counts).select(F.col("node_id").alias("src"), F.col("truth").alias("t")) for d in done]
        sources = state[0]
        for more in state[1:]:
            sources = sources.unionByName(more)
        taken = inputs.where(F.col("rank").between(lo, hi))
        narrow = taken.select("node_id", "slot", "src", "weight")
        hits = sources.join(F.broadcast(narrow) if n <= SENT_ROWS else narrow, "src")
        if wide:
            zero = F.lit(0).cast("bigint" if weighted is None else "double")
            sums = hits.groupBy("node_id").agg(F.sum(measure).alias("x"))
            every = taken.groupBy(*own).agg(F.lit(0).alias("__n")).drop("__n")
            step = every.join(sums, "node_id", "left").select(*own, result(F.coalesce("x", zero)))
        else:
            blank = [F.lit(0).cast(t).alias(c) for c, t in taken.select(own).dtypes if c != "node_id"]
            found = hits.select("node_id", *blank, "slot", "src", "weight", "t")
            both = taken.withColumn("t", F.lit(-1).cast("smallint")).unionByName(found)
            kinds = ", ".join(f"{c} {t}" for c, t in taken.select(own).dtypes)
            step = both.groupBy(F.lit(0).alias("k")).applyInPandas(_band_task(weighted, marked), f"{kinds}, truth smallint").select(*own, "truth")
        done.append(stored(step))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def latch(nodes: DataFrame, back_edges: DataFrame) -> DataFrame:
    """Registers take their source's truth, all at once."""
    sources = nodes.select(F.col("node_id").alias("src"), F.col("truth").alias("next"))
    taken = back_edges.join(sources, "src").select(F.col("dst").alias("node_id"), "next")
    return nodes.join(taken, "node_id", "left").withColumn("truth", F.coalesce("next", "truth")).select(nodes.columns)


def tick(graph: Graph, n: int = 1, max_rank: int = MAX_RANK, band_rows: int = BAND_ROWS, idempotent: bool | None = None) -> Graph:
    """Evaluate n times.  Nodes at or above max_rank keep their truth; undefined inputs read as 0.

    Without registers a valid graph does not change after the first evaluation, so one stands for all n;
    `idempotent` says whether that may be assumed (default: if there are no back edges).
    """
    if n <= 0:
        return graph
    registers = graph.back_edges
    once = registers is None if idempotent is None else idempotent
    now = graph
    for _ in range(1 if once else n):
        if registers is None:
            nodes = _evaluated(now, max_rank, None, band_rows).select(now.nodes.columns)
        else:
            # A register stands for its stored truth while the gates are evaluated.
            ids = registers.select(F.col("dst").alias("node_id")).distinct().withColumn("register", F.lit(True))
            marked = now.nodes.join(ids, "node_id", "left")
            fixed = F.when(F.col("register"), F.when(F.col("truth") == 1, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).otherwise(F.col("lut"))
            held = stored(_evaluated(now.with_nodes(marked.withColumn("lut", fixed).select(now.nodes.columns)), max_rank, None, band_rows).drop("was"))
            nodes = latch(held.drop("lut").join(now.nodes.select("node_id", "lut"), "node_id").select(now.nodes.columns), registers)
        now = now.with_nodes(nodes if once and n == 1 else stored(nodes))
    return replace(now, tick=graph.tick + n)


def weighted_tick(graph: Graph, threshold: float, max_rank: int = MAX_RANK, band_rows: int = BAND_ROWS) -> Graph:
    """Evaluate once by weighted votes: 1 if the weighted sum of inputs (undefined: one half) reaches the threshold."""
    return replace(graph.with_nodes(_evaluated(graph, max_rank, threshold, band_rows).select(graph.nodes.columns)), tick=graph.tick + 1)


def reset_rank(graph: Graph, rank: int) -> Graph:
    """Truth 0 at one rank."""
    truth = F.when(F.col("rank") == rank, F.lit(0)).otherwise(F.col("truth")).cast("smallint")
    return graph.with_nodes(graph.nodes.withColumn("truth", truth))


def resonance(graph: Graph, max_rank: int = MAX_RANK, cap: int = 100, mode: str = "fixpoint") -> tuple[Graph, list[tuple[int, int, bool]]]:
    """Evaluate each rank again and again until it settles; (rank, rounds, settled) from the highest rank.

    mode "fixpoint" compares a round with the one before it.  Mode "reference" compares with the state
    before the rank, so a rank where anything changed never settles and its changed nodes become 2.
    """
    # Inputs come from higher ranks, so a second round gives what the first gave: one evaluation is enough.
    after = stored(_evaluated(graph, max_rank, None, BAND_ROWS, mode != "fixpoint"))
    ranks = after.where(F.col("rank") < max_rank).groupBy("rank").agg(F.max(F.col("truth") != F.col("was")).alias("moved")).collect()  # max_rank rows at most
    told = []
    for r, moved in sorted(((x["rank"], x["moved"]) for x in ranks), reverse=True):
        settled = mode == "fixpoint" or not moved
        told.append((r, (2 if moved else 1) if settled else cap, settled))
    return replace(graph.with_nodes(after.select(graph.nodes.columns)), tick=graph.tick + 1), told


def compose(graph: Graph, op: str, a: int, b: int | None, into: int) -> Graph:
    """Write the bitwise combination of two nodes' tables (one, for NOT) into a third."""
    luts = {r["node_id"]: r["lut"] for r in graph.nodes.where(F.col("node_id").isin([x for x in (a, b) if x is not None])).select("node_id", "lut").collect()}
    x, y = luts[a], luts.get(b, 0)
    value = {"AND": x & y, "OR": x | y, "XOR": x ^ y, "NOT": ~x}[op.upper()]
    return graph.with_nodes(graph.nodes.withColumn("lut", F.when(F.col("node_id") == into, F.lit(value)).otherwise(F.col("lut"))))


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One epoch of the four-stage runtime, whose ranks rise from sources: (node_id, rank, state, stage).

    The forward wave evaluates rank 0 upwards; the mirrored half (node_id + n, rank 2 * top - rank + 1)
    carries the same states back.  `nodes` has node_id, rank, state (-1, 0, 1) and lut.
    """
    top, n = nodes.agg(F.max("rank"), F.max("node_id")).first()
    if top is None:
        return nodes.select("node_id", "rank", F.col("state").cast("smallint"), F.lit("forward").alias("stage"))
    # The database's order is the reverse, so a sweep over negated ranks is the forward wave.
    flipped = nodes.select("node_id", (F.lit(top) - F.col("rank")).alias("rank"), F.when(F.col("state") > 0, 1).otherwise(0).cast("smallint").alias("truth"), F.lit(0).cast("smallint").alias("node_type"), "lut")
    fed = edges.select(F.col("dst").alias("node_id")).distinct().withColumn("fed", F.lit(True))
    # Sources keep their state: a table that is constant stands in for it.
    own = flipped.join(fed, "node_id", "left").withColumn("lut", F.when(F.col("fed"), F.col("lut")).otherwise(-F.col("truth").cast("bigint"))).drop("fed")
    after = _evaluated(Graph(own, edges), int(top) + 1, None, BAND_ROWS)
    forward = after.select("node_id", (F.lit(top) - F.col("rank")).alias("rank"), F.col("truth").alias("state"), F.lit("forward").alias("stage"))
    back = forward.select((F.col("node_id") + int(n) + 1).alias("node_id"), (F.lit(2 * int(top) + 1) - F.col("rank")).alias("rank"), "state", F.lit("backward").alias("stage"))
    return forward.unionByName(back)


def telemetry(nodes: DataFrame, edges: DataFrame, epoch: int = 1) -> DataFrame:
    """One row: epoch, wave_lines, entropy (sum over set nodes of trunc(1000 * log2(1 + inputs)))."""
    degree = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))
    joined = nodes.where("state <> 0").join(degree, "node_id", "left").select(F.floor(1000 * F.log2(1 + F.coalesce("degree", F.lit(0)))).alias("e"))
    lines = nodes.agg((epoch * (2 * F.max("rank") + 2)).cast("bigint").alias("wave_lines"))
    return joined.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("entropy")).crossJoin(lines).select(F.lit(epoch).cast("bigint").alias("epoch"), "wave_lines", "entropy")


def batches(frames: Iterator[Graph]) -> DataFrame:
    """Record ticks: (tick, node_id, truth) of several versions."""
    out = None
    for g in frames:
        rows = g.nodes.select(F.lit(g.tick).cast("bigint").alias("tick"), "node_id", "truth")
        out = rows if out is None else out.unionByName(rows)
    return out
