"""Reversible integer transforms along an axis, as window expressions over cells.

A signal is a DataFrame of cells: key columns, a position column (0, 1, ...) and a bigint value. Coefficients of haar
and lift53 stay interleaved while levels are computed, at their sample's place; `subband` gives the place in subband
order (approximation first, then details from the coarsest to the finest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import AxisTransform, InvalidArgument


def signal(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """keys, pos (0, 1, ... in the unique order), n (cells of the key), x."""
    w = Window.partitionBy(*keys)
    return df.select(*keys, (F.row_number().over(w.orderBy(*order)) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(w).alias("n"), value.alias("x"))


def _segment(pos: str, group: int) -> Column:
    return F.floor(F.col(pos) / F.lit(group)).cast("long") if group else F.lit(0).cast("long")


def _level(df: DataFrame, part: list, pos: str, value: str, level: int, kind: str, inverse: bool, bias: int, also: Column | None = None) -> DataFrame:
    """One level on the rows whose place within the segment (_at) is a multiple of 2**(level-1)."""
    step = 1 << (level - 1)
    active = F.col("_at") % step == 0 if also is None else (F.col("_at") % step == 0) & also
    df = df.withColumn("_on", active)
    w = Window.partitionBy(*part, "_seg", "_on").orderBy(pos)
    even = F.floor(F.col("_at") / step) % 2 == 0
    v = F.col(value)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    if kind == "haar":
        df = df.withColumn("_b", before).withColumn("_a", after)
        if inverse:
            new = F.when(even, F.when(F.col("_a").isNull(), v).otherwise(v - F.shiftright("_a", 1))).otherwise(v + F.col("_b") - F.shiftright(v, 1))
        else:
            new = F.when(even, F.when(F.col("_a").isNull(), v).otherwise(v + F.shiftright(F.col("_a") - v, 1))).otherwise(v - F.col("_b"))
        return df.withColumn(value, F.when(F.col("_on"), new).otherwise(v)).drop("_b", "_a", "_on")

    def predict(df: DataFrame, sign: int) -> DataFrame:
        df = df.withColumn("_b", before).withColumn("_a", after)
        by = F.shiftright(F.col("_b") + F.coalesce("_a", "_b") + bias, 1)
        return df.withColumn(value, F.when(F.col("_on") & ~even, v - by if sign > 0 else v + by).otherwise(v))

    def update(df: DataFrame, sign: int) -> DataFrame:
        df = df.withColumn("_b", before).withColumn("_a", after)
        by = F.shiftright(F.coalesce("_b", "_a") + F.coalesce("_a", "_b") + 2, 2)
        return df.withColumn(value, F.when(F.col("_on") & even & F.coalesce("_a", "_b").isNotNull(), v + by if sign > 0 else v - by).otherwise(v))

    df = predict(update(df, -1), -1) if inverse else update(predict(df, 1), 1)
    return df.drop("_b", "_a", "_on")


def _lengths(n: Column, levels: int) -> list[Column]:
    """Lengths of the approximation bands: n, then each half rounded up."""
    out = [n]
    for _ in range(levels):
        out.append(F.floor((out[-1] + 1) / 2).cast("long"))
    return out


def subband(at: Column, n: Column, levels: int) -> Column:
    """The place in subband order of the coefficient at an interleaved place."""
    lens = _lengths(n, levels)
    out = F.floor(at / (1 << levels))
    for k in range(levels, 0, -1):
        out = F.when(at % (1 << k) == 1 << (k - 1), lens[k] + F.floor(at / (1 << k))).otherwise(out)
    return out.cast("long")


def interleaved(at: Column, n: Column, levels: int) -> Column:
    """The inverse of subband."""
    lens = _lengths(n, levels)
    out = at * (1 << levels)
    for k in range(levels, 0, -1):
        out = F.when((at >= lens[k]) & (at < lens[k - 1]), (at - lens[k]) * (1 << k) + (1 << (k - 1))).otherwise(out)
    return out.cast("long")


def _placed(df: DataFrame, keys: list[str], pos: str, group: int) -> DataFrame:
    df = df.withColumn("_seg", _segment(pos, group))
    first = F.col("_seg") * group if group else F.lit(0).cast("long")
    return df.withColumn("_first", first).withColumn("_at", F.col(pos) - F.col("_first")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_seg")))


def forward(df: DataFrame, keys: list[str], kind: str, levels: int = 1, group: int = 0, pos: str = "pos", value: str = "x") -> DataFrame:
    """Cells transformed along pos within each key and each `group` of positions; pos becomes the subband place."""
    names = df.columns
    if kind == "delta":
        w = Window.partitionBy(*keys, _segment(pos, group)).orderBy(pos)
        return df.withColumn(value, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))
    if kind not in ("haar", "lift53"):
        raise InvalidArgument(f"unknown kind {kind!r}")
    df = _placed(df, keys, pos, group)
    for level in range(1, levels + 1):
        df = _level(df, keys, pos, value, level, kind, False, 1)
    return df.withColumn(pos, F.col("_first") + subband(F.col("_at"), F.col("_n"), levels)).select(*names)


def inverse(df: DataFrame, keys: list[str], kind: str, levels: int = 1, group: int = 0, pos: str = "pos", value: str = "x") -> DataFrame:
    """The cells that forward made these of."""
    names = df.columns
    if kind == "delta":
        w = Window.partitionBy(*keys, _segment(pos, group)).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(value, F.sum(value).over(w))
    if kind not in ("haar", "lift53"):
        raise InvalidArgument(f"unknown kind {kind!r}")
    df = _placed(df, keys, pos, group)
    df = df.withColumn("_at", interleaved(F.col("_at"), F.col("_n"), levels)).withColumn(pos, F.col("_first") + F.col("_at"))
    for level in range(levels, 0, -1):
        df = _level(df, keys, pos, value, level, kind, True, 1)
    return df.select(*names)


def forward_steps(df: DataFrame, keys: list[str], axes: list[str], steps: list[AxisTransform], value: str = "x") -> DataFrame:
    """Several axis steps in order, over cells with a coordinate column for each axis of the chunk."""
    for s in steps:
        df = forward(df, [*keys, *(a for i, a in enumerate(axes) if i != s.dimension)], s.kind, s.levels, s.group, axes[s.dimension], value)
    return df


def inverse_steps(df: DataFrame, keys: list[str], axes: list[str], steps: list[AxisTransform], value: str = "x") -> DataFrame:
    for s in reversed(steps):
        df = inverse(df, [*keys, *(a for i, a in enumerate(axes) if i != s.dimension)], s.kind, s.levels, s.group, axes[s.dimension], value)
    return df


def modular_delta(df: DataFrame, keys: list[str], bits: int, signed: bool = False, pos: str = "pos", value: str = "x") -> DataFrame:
    """Differences along the flattened chunk, modulo 2**bits, re-centred for signed types."""
    w = Window.partitionBy(*keys).orderBy(pos)
    d = F.pmod(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)), F.lit(1 << bits))
    return df.withColumn(value, F.when(d >= 1 << (bits - 1), d - (1 << bits)).otherwise(d) if signed else d)


def modular_sum(df: DataFrame, keys: list[str], bits: int, signed: bool = False, pos: str = "pos", value: str = "x") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    d = F.pmod(F.sum(value).over(w), F.lit(1 << bits))
    return df.withColumn(value, F.when(d >= 1 << (bits - 1), d - (1 << bits)).otherwise(d) if signed else d)


def low_pass(pos: Column, kind: str, levels: int, group: int, extent: Column) -> Column:
    """Whether a subband place holds an approximation: the head of every group."""
    size = F.least(F.lit(group), extent - F.floor(pos / group) * group) if group else extent
    kept = F.lit(1).cast("long") if kind == "delta" else _lengths(size, levels)[-1]
    return (pos % group if group else pos) < kept


def dwt53(df: DataFrame, keys: list[str], levels: int = 1, row: str = "row", col: str = "col", value: str = "x") -> DataFrame:
    """2-D 5/3 wavelet of planes of cells, coefficients interleaved: at each level down the columns, then along the
    rows, on the approximations of the level before. Its predict step has no rounding term."""
    names = df.columns
    df = df.withColumn("_seg", F.lit(0))
    for level in range(1, levels + 1):
        step = 1 << (level - 1)
        for along, across in ((row, col), (col, row)):
            df = _level(df.withColumn("_at", F.col(along)), [*keys, across], along, value, level, "lift53", False, 0, F.col(across) % step == 0)
    return df.select(*names)


def idwt53(df: DataFrame, keys: list[str], levels: int = 1, row: str = "row", col: str = "col", value: str = "x") -> DataFrame:
    names = df.columns
    df = df.withColumn("_seg", F.lit(0))
    for level in range(levels, 0, -1):
        step = 1 << (level - 1)
        for along, across in ((col, row), (row, col)):
            df = _level(df.withColumn("_at", F.col(along)), [*keys, across], along, value, level, "lift53", True, 0, F.col(across) % step == 0)
    return df.select(*names)
