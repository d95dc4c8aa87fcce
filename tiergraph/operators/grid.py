"""Hexagonal grids, downsampling, halos and signal windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiergraph.functions.bits import cube_r, hex_colour, morton
from tiergraph.schema import numbered

#: Neighbours (column, row) in directions 0 to 5, for even and for odd columns.
EVEN = [(1, -1), (0, -1), (-1, -1), (-1, 0), (0, 1), (1, 0)]
ODD = [(1, 0), (0, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)]
#: Depth of a halo strip.
HALO = 3


def cells(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(cell, col, row, colour, code): cells in row-major order with colour and Morton code."""
    base = spark.range(width * height).select(F.col("id").alias("cell"), (F.col("id") % width).alias("col"), F.expr(f"id div {width}").alias("row"))
    return base.select("*", hex_colour(F.col("col"), F.col("row")).alias("colour"), morton(F.col("col"), cube_r(F.col("col"), F.col("row"))).alias("code"))


def neighbours(grid: DataFrame, width: int, height: int) -> DataFrame:
    """(cell, direction, neighbour): the neighbours that lie on the grid."""
    pick = lambda offsets: F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(c).alias("dc"), F.lit(r).alias("dr")) for d, (c, r) in enumerate(offsets)])
    steps = grid.select("cell", "col", "row", F.explode(F.when(F.col("col") % 2 == 1, pick(ODD)).otherwise(pick(EVEN))).alias("step"))
    c, r = F.col("col") + F.col("step.dc"), F.col("row") + F.col("step.dr")
    return steps.where(c.between(0, width - 1) & r.between(0, height - 1)).select("cell", F.col("step.direction").cast("bigint").alias("direction"), (r * width + c).alias("neighbour"))


def colour_conflicts(grid: DataFrame, near: DataFrame) -> DataFrame:
    """Neighbouring cells of one colour; a proper colouring has none."""
    own = near.join(grid.select("cell", "colour"), "cell").join(grid.select(F.col("cell").alias("neighbour"), F.col("colour").alias("other")), "neighbour")
    return own.where("colour = other").select("cell", "neighbour")


def morton_ranks(grid: DataFrame) -> DataFrame:
    """(cell, morton_rank): places in Morton order, ties by cell."""
    return numbered(grid.select("code", "cell"), ["code", "cell"], "morton_rank").select("cell", "morton_rank")


def downsample(frame: DataFrame, step: int) -> DataFrame:
    """(row, col, value) of blocks: the most frequent of value & 7 in 0..4, with rare codes put through.

    Ties go to the lower code; more than 3 % of code 2 make a block 2, more than 1 % of code 3 make it 3.
    """
    code = F.col("value").cast("int").bitwiseAND(F.lit(7))
    counted = frame.groupBy(F.expr(f"row div {step}").alias("row"), F.expr(f"col div {step}").alias("col")).agg(*[F.count_if(code == k).alias(f"c{k}") for k in range(5)])
    most = F.greatest(*[F.col(f"c{k}") for k in range(5)])
    first = F.coalesce(*[F.when(F.col(f"c{k}") == most, F.lit(k)) for k in range(5)])
    size = step * step
    return counted.select("row", "col", F.when(F.col("c3") * 100 > size, 3).when(F.col("c2") * 100 > 3 * size, 2).otherwise(first).cast("bigint").alias("value"))


def halos(tiles: DataFrame, height: int, width: int, depth: int = HALO) -> DataFrame:
    """Strips that each tile gets from its neighbours: (tile_row, tile_col, side, row, col, value).

    `tiles` has tile_row, tile_col, row, col (inside the tile), value.  A tile's north strip holds the
    southern rows of the tile above; tiles at the world's edge have no strip on that side.
    """
    parts = []
    for side, dr, dc, inside in (("N", 1, 0, F.col("row") >= height - depth), ("S", -1, 0, F.col("row") < depth), ("W", 0, 1, F.col("col") >= width - depth), ("E", 0, -1, F.col("col") < depth)):
        parts.append(tiles.where(inside).select((F.col("tile_row") + dr).alias("tile_row"), (F.col("tile_col") + dc).alias("tile_col"), F.lit(side).alias("side"), "row", "col", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(tiles.select("tile_row", "tile_col").distinct(), ["tile_row", "tile_col"], "left_semi")


def quantised(signal: DataFrame, key: str, order: str, value: str, limit: float = 0.15, taps: int = 17) -> DataFrame:
    """A signal in three levels (-1, 0, 1 around +-limit) and its centred moving average."""
    half = taps // 2
    window = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    level = F.when(F.col(value) > limit, 1).when(F.col(value) < -limit, -1).otherwise(0)
    return signal.select("*", level.cast("bigint").alias("level"), F.avg(value).over(window).alias("smooth"))
