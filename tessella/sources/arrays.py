"""Chunked arrays as Parquet tables: one row for each stored chunk, pruned by its chunk coordinates."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from ..types import InvalidArgument, SourceError


def folder(spark: SparkSession) -> str:
    """A folder that all executors share: the session's spark.checkpoint.dir, or one of our own in local mode."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise SourceError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(cells: DataFrame, path: str, axes: list[str], chunk_shape: list[int], value: str = "x", fill=0, mode: str = "errorifexists") -> None:
    """Cells with a coordinate column for each axis, as chunks; chunks of nothing but fill are left out (a null is no fill). Rows are
    range-partitioned and sorted by chunk, so that a box touches few row groups."""
    if len(axes) != len(chunk_shape) or min(chunk_shape, default=0) < 1:
        raise InvalidArgument("a chunk extent of 1 or more is needed for each axis")
    ids = [f"c{i}" for i in range(len(axes))]
    placed = cells.select(*(F.floor(F.col(a) / n).cast("int").alias(c) for a, n, c in zip(axes, chunk_shape, ids)), *(F.pmod(F.col(a), F.lit(n)).cast("int").alias(a) for a, n in zip(axes, chunk_shape)), F.col(value).alias("x"))
    at = layout.linear([F.col(a) for a in axes], chunk_shape)
    chunks = placed.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(at.cast("int").alias("at"), "x"))).alias("cells")).where(F.exists("cells", lambda c: ~c["x"].eqNullSafe(F.lit(fill))))
    chunks.repartitionByRange(*ids).sortWithinPartitions(*ids).write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str, axes: list[str], chunk_shape: list[int], low: list[int] | None = None, size: list[int] | None = None) -> DataFrame:
    """Stored cells, of a box if one is given: whole chunks outside it are pruned at the scan, cells after decoding."""
    ids = [f"c{i}" for i in range(len(axes))]
    rows = spark.read.parquet(path)
    if low is not None and size is not None:
        rows = rows.where(reduce(lambda a, b: a & b, (F.col(c).between(s // n, (s + k - 1) // n) for c, s, k, n in zip(ids, low, size, chunk_shape))))
    cells = rows.select(*ids, F.explode("cells").alias("cell"))
    inner = layout.coordinates(F.col("cell.at"), chunk_shape)
    out = cells.select(*((F.col(c) * n + i).alias(a) for c, n, i, a in zip(ids, chunk_shape, inner, axes)), F.col("cell.x").alias("x"))
    return out if low is None or size is None else out.where(layout.box(axes, low, size))


def read_box(spark: SparkSession, path: str, axes: list[str], chunk_shape: list[int], low: list[int], size: list[int], fill=0) -> DataFrame:
    """Every cell of a box; those of absent chunks read as fill."""
    grid = spark.range(1)
    for a, s, n in zip(axes, low, size):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(s), F.lit(s + n - 1))))
    return layout.filled(grid.drop("id"), read(spark, path, axes, chunk_shape, low, size), axes, "x", fill)
