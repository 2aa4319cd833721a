"""Sample arithmetic as column expressions: promotion, level shift, sign and magnitude, colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def promoted(x: Column, dtype: str) -> Column:
    """8- and 16-bit samples spread over 32 signed bits (fixed shifts of the field codec)."""
    bits = int(dtype.lstrip("uint"))
    return F.shiftleft((x - F.lit(1 << (bits - 1)) if dtype.startswith("u") else x).cast("bigint"), 31 - bits)


def demoted(v: Column, dtype: str) -> Column:
    bits = int(dtype.lstrip("uint"))
    half, low = (1 << (bits - 1)), 0 if dtype.startswith("u") else -(1 << (bits - 1))
    back = F.shiftright(v, 31 - bits) + (half if dtype.startswith("u") else 0)
    return F.least(F.greatest(back, F.lit(low)), F.lit(low + (1 << bits) - 1))


def sign_magnitude(c: Column) -> Column:
    """Bit 31 is the sign, the rest the magnitude."""
    return F.when(c < 0, F.lit(1 << 31).bitwiseOR(-c)).otherwise(c)


def from_sign_magnitude(s: Column) -> Column:
    magnitude = s.bitwiseAND(F.lit((1 << 31) - 1))
    return F.when(s.bitwiseAND(F.lit(1 << 31)) != 0, -magnitude).otherwise(magnitude)


def level_shifted(x: Column, depth: int) -> Column:
    return x - (1 << (depth - 1))


def level_restored(v: Column, depth: int) -> Column:
    return F.least(F.greatest(v + (1 << (depth - 1)), F.lit(0)), F.lit((1 << depth) - 1))


def rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue of the reversible colour transform."""
    green = y - F.shiftright(cb + cr, 2)
    return cr + green, green, cb + green
