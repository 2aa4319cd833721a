"""Cells and chunks: coordinates, transposition, reshaping, subsets and fill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear(coords: list[Column], shape: list[int]) -> Column:
    """The C-order index of coordinates."""
    return reduce(lambda a, ci: a * ci[1] + ci[0], zip(coords, shape), F.lit(0).cast("long")).cast("long")


def coordinates(index: Column, shape: list[int]) -> list[Column]:
    """Coordinates of a C-order index."""
    out, stride = [], 1
    for n in reversed(shape):
        out.append((F.floor(index / stride) % n).cast("int"))
        stride *= n
    return out[::-1]


def cells(chunks: DataFrame, keys: list[str], values: str, shape: list[int], axes: list[str], value: str = "x") -> DataFrame:
    """A row for each element of array columns in C order."""
    flat = chunks.select(*keys, F.posexplode(values).alias("_i", value))
    return flat.select(*keys, *(c.alias(a) for c, a in zip(coordinates(F.col("_i"), shape), axes)), value)


def chunked(cell_rows: DataFrame, keys: list[str], axes: list[str], shape: list[int], value: str = "x") -> DataFrame:
    """Array columns (values, in C order) of cells; a chunk is one row."""
    at = linear([F.col(a) for a in axes], shape)
    gathered = cell_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at.alias("i"), F.col(value).alias("v")))).alias("_c"))
    return gathered.select(*keys, F.transform("_c", lambda c: c["v"]).alias("values"))


def transposed(cell_rows: DataFrame, axes: list[str], order: list[int]) -> DataFrame:
    """Coordinates renamed so that stored dimension i is the source's dimension order[i]."""
    return cell_rows.select(*(F.col(axes[s]).alias(axes[i]) for i, s in enumerate(order)), *(c for c in cell_rows.columns if c not in axes))


def reshaped(cell_rows: DataFrame, axes: list[str], shape: list[int], to_axes: list[str], to_shape: list[int]) -> DataFrame:
    """Coordinates under another shape of as many elements; the C order stays."""
    at = linear([F.col(a) for a in axes], shape)
    return cell_rows.select(*(c.alias(a) for c, a in zip(coordinates(at, to_shape), to_axes)), *(c for c in cell_rows.columns if c not in axes))


def box(axes: list[str], low: list[int], size: list[int]) -> Column:
    """Whether a cell lies in an axis-aligned box. Keep it above a transform along one of its axes."""
    return reduce(lambda a, b: a & b, (F.col(a).between(s, s + n - 1) for a, s, n in zip(axes, low, size)))


def filled(grid: DataFrame, stored: DataFrame, keys: list[str], value: str, fill) -> DataFrame:
    """Every cell of the grid; absent ones read as the fill value."""
    return grid.join(stored, keys, "left").select(*grid.columns, F.coalesce(F.col(value), F.lit(fill)).alias(value))


def bit_depth(low: Column, high: Column) -> Column:
    """The narrowest depth that holds all values from low to high: unsigned, or signed where low is negative."""
    bits = lambda c: F.when(c > 0, F.length(F.bin(c))).otherwise(0)
    return F.greatest(F.when(low < 0, F.greatest(bits(-(low + 1)), bits(high)) + 1).otherwise(bits(high)), F.lit(1)).cast("int")


def pyramid(cell_rows: DataFrame, keys: list[str], levels: int, row: str = "row", col: str = "col", value: str = "x") -> DataFrame:
    """Minima over 2 x 2 blocks of 2 x 2 blocks ...: a row for each node of each level (0: the cells). Each cell is
    dealt to its nodes once and summed up before the shuffle."""
    nodes = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(F.col(row) / F.pow(F.lit(2), k)).cast("int").alias(row), F.floor(F.col(col) / F.pow(F.lit(2), k)).cast("int").alias(col))))
    dealt = cell_rows.select(*keys, F.col(value), nodes.alias("_node"))
    return dealt.groupBy(*keys, F.col("_node.level").alias("level"), F.col(f"_node.{row}").alias(row), F.col(f"_node.{col}").alias(col)).agg(F.min(value).alias(value))


def output_dtype(depth: Column, signed: Column) -> Column:
    """The smallest integer type for planes of a bit depth; take the deepest plane's for several."""
    bits = F.when(depth <= 8, "8").when(depth <= 16, "16").otherwise("32")
    return F.concat(F.when(signed, "int").otherwise("uint"), bits)
