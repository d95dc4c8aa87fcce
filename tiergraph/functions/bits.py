"""Scalar functions over 64-bit patterns and grid coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiergraph.schema import lut_bit

__all__ = ["lut_bit", "lut_low", "lut_high", "lut_join", "popcount", "morton", "cube_r", "hex_colour"]

LOW32 = (1 << 32) - 1


def lut_low(lut: Column) -> Column:
    return lut.bitwiseAND(F.lit(LOW32))


def lut_high(lut: Column) -> Column:
    return F.call_function("shiftrightunsigned", lut, F.lit(32))


def lut_join(low: Column, high: Column) -> Column:
    return F.call_function("shiftleft", high.cast("bigint"), F.lit(32)).bitwiseOR(low.cast("bigint").bitwiseAND(F.lit(LOW32)))


def popcount(value: Column) -> Column:
    return F.bit_count(value)


def _apart(value: Column) -> Column:
    """The low 16 bits, bit i moved to place 2 * i."""
    x = value.cast("bigint")
    out = F.lit(0).cast("bigint")
    for i in range(16):
        out = out + F.call_function("shiftleft", x.bitwiseAND(F.lit(1 << i).cast("bigint")), F.lit(i))
    return out


def morton(x: Column, y: Column) -> Column:
    """Interleaved bits of two 16-bit numbers, x in the even places."""
    return _apart(x).bitwiseOR(F.call_function("shiftleft", _apart(y), F.lit(1)))


def cube_r(col: Column, row: Column) -> Column:
    """The cube coordinate of a hexagonal cell whose odd columns are shifted."""
    return row - F.call_function("shiftright", (col - col.bitwiseAND(F.lit(1))).cast("int"), F.lit(1))


def hex_colour(col: Column, row: Column) -> Column:
    """One of seven colours, all different around any cell."""
    return (col + row + 4 * col.bitwiseAND(F.lit(1))) % 7
